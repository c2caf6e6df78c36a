"""Nested records as columns of leaf values with repetition and definition levels, and back into flat tables.

Method: columnar shredding. Each leaf path of a record becomes a sequence of entries (record, repetition level, definition
level, value); the repetition level says at which list of the path the entry starts anew, the definition level how much of the
path is there. Null and empty lists, null elements and missing members keep their entry, so places can be counted from the levels
alone: the place in the k-th list grows where the repetition level is k and starts at 0 where it is less. Tables are put
together per repeated ancestor from those sequences.

Scale: both steps work inside an Arrow batch, without a shuffle; only the leaf columns asked for are read.

Defined cases: a null record, list, element or member has no value but keeps its place; a lone object stands for a list of one;
text that is no valid JSON (blank, cut off, NaN, too deep to parse) has no entries beyond the record itself; JSON inside a JSON
string counts as what it holds; values that are no strings come out as JSON text, lone surrogates as '?'.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def parse_path(path: str) -> list[str]:
    """``a.b[].c`` as steps; ``[]`` stands for entering a list."""
    steps: list[str] = []
    for part in path.split("."):
        while part.endswith("[]"):
            part, tail = part[:-2], steps
            if part.endswith("[]"):
                raise ValueError(f"a list of lists in {path}")
            tail += [part, "[]"] if part else ["[]"]
            part = ""
        if part:
            steps.append(part)
    return steps


class Levels:
    """The entries of one leaf path over a batch of records: arrays ``record``, ``rep``, ``defn`` and ``value`` (None unless defined)."""

    def __init__(self, record, rep, defn, value, top: int, lists: list[int]):
        self.record, self.rep, self.defn, self.value = record, rep, defn, value
        #: the definition level of a whole value, and of an element of the k-th list
        self.top, self.lists = top, lists

    def places(self, k: int) -> np.ndarray:
        """The place of each entry in its k-th list (from 1 outermost); meaningful where ``defn >= lists[k-1]``."""
        grown = np.cumsum(self.rep == k)
        start = np.maximum.accumulate(np.where(self.rep < k, np.arange(len(self.rep)), 0)) if len(self.rep) else np.zeros(0, np.int64)
        return grown - grown[start] if len(grown) else grown


def shred_arrow(column: pa.Array, path: str) -> Levels:
    """The levels of ``path`` below an Arrow column of nested type, computed from its offsets."""
    steps = parse_path(path)
    n = len(column)
    record, rep, defn = np.arange(n), np.zeros(n, np.int8), np.zeros(n, np.int8)
    live, array, depth, level, lists = np.arange(n), column, 0, 0, []

    def keep_valid():
        nonlocal live, array, level
        ok = np.asarray(array.is_valid())
        level += 1
        live, array = live[ok], array.filter(pa.array(ok))
        defn[live] = level

    keep_valid()
    for step in steps:
        if step != "[]":
            array = array.field(step) if array.null_count == 0 and array.offset == 0 else pa.compute.struct_field(array, step)
            keep_valid()
            continue
        depth += 1
        lengths = np.asarray(array.value_lengths()).astype(np.int64)
        times = np.ones(len(record), np.int64)
        times[live] = np.maximum(lengths, 1)
        first = np.cumsum(times) - times
        record, defn = np.repeat(record, times), np.repeat(defn, times)
        again = np.ones(len(record), bool)
        again[first] = False
        rep_before = rep
        rep = np.repeat(rep, times)
        rep[first] = rep_before
        rep[again] = depth
        full = lengths > 0
        starts = np.repeat(first[live[full]], lengths[full])
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths[full]) - lengths[full], lengths[full])
        live, array = starts + within, array.flatten()
        level += 1
        lists.append(level)
        defn[live] = level
        keep_valid()
    value = np.full(len(record), None, object)
    value[live] = array.to_numpy(zero_copy_only=False)
    return Levels(record, rep, defn, value, level, lists)


def load_json(text: str | None):
    """The value of a JSON text, of the JSON in a JSON string if it is one, or None."""

    def no(constant):
        raise ValueError(constant)

    try:
        value = json.loads(text, parse_constant=no) if text else None
        for _ in range(4):
            if not isinstance(value, str):
                break
            value = json.loads(value, parse_constant=no)
        return value
    except (ValueError, RecursionError):
        return None


def as_text(value) -> str:
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text.encode("utf-8", "replace").decode("utf-8")


def shred_objects(records: Iterable, path: str) -> Levels:
    """The levels of ``path`` below parsed JSON values; the same sequences as ``shred_arrow``."""
    steps = parse_path(path)
    record, rep, defn, value = [], [], [], []

    def walk(at: int, node, i: int, r: int, d: int, depth: int):
        while i < len(steps) and node is not None and steps[i] != "[]":
            node = node.get(steps[i]) if isinstance(node, dict) else None
            d += node is not None
            i += 1
        if node is None or i == len(steps):
            record.append(at)
            rep.append(r)
            defn.append(d)
            value.append(None if node is None else as_text(node))
            return
        items = node if isinstance(node, list) else [node]
        if not items:
            walk(at, None, len(steps), r, d, depth + 1)
        for k, item in enumerate(items):
            walk(at, item, i + 1, r if k == 0 else depth + 1, d + 1 + (item is not None), depth + 1)

    for at, node in enumerate(records):
        walk(at, node, 0, 0, int(node is not None), 0)
    top, lists = 1, []
    for step in steps:
        top += 1
        if step == "[]":
            lists.append(top)
            top += 1
    out = np.full(len(value), None, object)
    out[:] = value
    return Levels(np.array(record, np.int64), np.array(rep, np.int8), np.array(defn, np.int8), out, top, lists)


def links(levels: Levels) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of each whole value: its record, its places in the lists from the outermost, and itself."""
    whole = levels.defn == levels.top
    return levels.record[whole], [levels.places(k + 1)[whole] for k in range(len(levels.lists))], levels.value[whole]


def element_table(by_path: dict[str, Levels], depth: int) -> dict[str, np.ndarray]:
    """One row per element of the ``depth``-th list that all paths share, with the value each path has in it (None where it has none).

    The paths may not enter further lists.
    """
    first = next(iter(by_path.values()))
    there = first.defn >= first.lists[depth - 1]
    out: dict[str, np.ndarray] = {"record": first.record[there]}
    for k in range(depth):
        out[f"pos{k + 1}"] = first.places(k + 1)[there]
    for path, levels in by_path.items():
        out[path] = levels.value[there]
    return out


def only(column: Column, kind: T.DataType, steps: list[str]) -> Column:
    """``column`` with nothing but the leaf at ``steps`` (as ``parse_path`` gives them) and all that is absent on the way to it still absent."""
    if not steps:
        return column
    if steps[0] == "[]":
        return F.transform(column, lambda x: only(x, kind.elementType, steps[1:]))
    inner = only(column[steps[0]], kind[steps[0]].dataType, steps[1:])
    return F.when(column.isNotNull(), F.struct(inner.alias(steps[0])))


def typed_elements(df: DataFrame, key: str, column: str, members: dict[str, str], places: str = "pos1") -> DataFrame:
    """A flat table of the elements of a column that is a list: key, place, and the members (path to name) with their own types.

    Null and empty lists have no elements; a null element has a row without members. The path ``''`` is the element itself.
    """
    kind = df.schema[column].dataType

    def type_of(steps: list[str]) -> T.DataType:
        at = kind.elementType
        for step in steps:
            at = at[step].dataType
        return at

    types = {name: type_of(parse_path(path)) for path, name in members.items()}

    def run(batches):
        for b in batches:
            got = element_table({name: shred_arrow(b.column(1), f"[].{path}" if path else "[]") for path, name in members.items()}, 1)
            values = [pa.array(got[name], to_arrow_type(types[name])) for name in members.values()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(got["record"])), pa.array(got["pos1"].astype(np.int64)), *values], names=[key, places, *members.values()])

    schema = T.StructType([df.schema[key], T.StructField(places, T.LongType()), *(T.StructField(n, t) for n, t in types.items())])
    return df.select(key, column).where(F.size(column) > 0).mapInArrow(run, schema)


def children(df: DataFrame, key: str, column: str, paths: dict[str, tuple[int | None, int | None]], is_json: bool) -> DataFrame:
    """(parent_id, frame_pos, child_pos, ref): each whole value of each path, with its record's key.

    ``paths``: path to (which list gives frame_pos, which gives child_pos), None for -1.
    """
    spec = list(paths.items())

    def run(batches):
        for b in batches:
            keys = b.column(0)
            source = [load_json(x) for x in b.column(1).to_pylist()] if is_json else b.column(1)
            parts = []
            for path, (frame, child) in spec:
                record, places, value = links((shred_objects if is_json else shred_arrow)(source, path))
                none = np.full(len(record), -1, np.int64)
                at = [none if k is None else places[k - 1].astype(np.int64) for k in (frame, child)]
                parts.append((record, *at, value))
            record, frame_pos, child_pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
            value = np.concatenate([p[3] for p in parts])
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(record)), pa.array(frame_pos), pa.array(child_pos), pa.array(value, pa.string())],
                names=["parent_id", "frame_pos", "child_pos", "ref"],
            )

    return df.select(key, column).mapInArrow(run, "parent_id long, frame_pos long, child_pos long, ref string")


def json_elements(df: DataFrame, key: str, column: str, list_path: str, members: list[str]) -> DataFrame:
    """A flat table of the elements of ``list_path`` (one or two lists deep): key, places, and the members as JSON text."""
    depth = parse_path(list_path).count("[]")
    places = [f"pos{k + 1}" for k in range(depth)]

    def run(batches):
        for b in batches:
            source = [load_json(x) for x in b.column(1).to_pylist()]
            got = element_table({m: shred_objects(source, f"{list_path}.{m}") for m in members}, depth)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(got["record"])), *(pa.array(got[p].astype(np.int64)) for p in places), *(pa.array(got[m], pa.string()) for m in members)],
                names=[key, *places, *members],
            )

    schema = ", ".join([f"`{key}` long", *(f"{p} long" for p in places), *(f"`{m}` string" for m in members)])
    return df.select(key, column).mapInArrow(run, schema)


def element_members(df: DataFrame, column: str, list_path: str) -> list[str]:
    """The paths of all members that the elements of ``list_path`` have in JSON texts, objects entered, lists not.

    A path that is an object in some elements and a value in others is one member, as JSON text. The driver holds one row per path.
    """
    steps = parse_path(list_path)

    def elements(node, i: int):
        while i < len(steps) and steps[i] != "[]":
            node = node.get(steps[i]) if isinstance(node, dict) else None
            i += 1
        if i == len(steps):
            yield node
        else:
            for item in node if isinstance(node, list) else [node]:
                yield from elements(item, i + 1)

    def members(node, prefix: str, seen: set):
        for name, value in node.items() if isinstance(node, dict) else ():
            if isinstance(value, dict) and value:
                members(value, f"{prefix}{name}.", seen)
            elif value is not None:
                seen.add(as_text(prefix + name))

    def run(batches):
        seen: set[str] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                for element in elements(load_json(text), 0):
                    members(element, "", seen)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["path"])

    found = {r.path for r in df.select(column).mapInArrow(run, "path string").distinct().collect()}
    return sorted(p for p in found if not any(p.startswith(q + ".") for q in found))


def nested_children(wire: DataFrame, frames: DataFrame, journal: DataFrame) -> DataFrame:
    """(tbl, parent_id, frame_pos, child_pos, ref): every frame and provenance link of the three tables with its parent and place."""
    w = children(wire.where("payload IS NOT NULL"), "msg_id", "payload", {"result.frames[].id": (1, None), "result.frames[].provenance[].uri": (1, 2)}, True)
    leaf = lambda df, key, column, path: df.where(F.size(column) > 0).select(key, only(F.col(column), df.schema[column].dataType, parse_path(path)).alias(column))
    f = children(leaf(frames, "frame_no", "provenance", "[].uri"), "frame_no", "provenance", {"[].uri": (None, 1)}, False)
    j = children(leaf(journal, "delivery_id", "frames", "[].frame.frame_id"), "delivery_id", "frames", {"[].frame.frame_id": (1, None)}, False)
    once = w.withColumn("tbl", F.lit("wire_messages")).unionByName(f.withColumn("tbl", F.lit("frames"))).dropDuplicates()
    return once.unionByName(j.withColumn("tbl", F.lit("journal"))).select("tbl", "parent_id", "frame_pos", "child_pos", "ref")
