"""Schemas that drift between the files of a stream: one consistent table, and a report of each change.

Method: every line is loaded as (path, raw type, value); path and type statistics are added up by file, with a bounded sketch of the
contents; each file is held against the one before it; lines are projected to typed columns, one for each path of the statistics
under its first name, and casts that fail are reported.

A renamed field is one that goes while another of the same type comes in the same object and carries on its content. Contents are
compared by their sketches: counts of hashed values, of hashed first words, of punctuation and of length or magnitude; lists by
their elements, objects by their members. Where values repeat, the values themselves must recur. Equal constants of small kinds
(booleans, single numbers) say nothing, so there the names must be alike too.

Scale: statistics are combined in each task into one sketch per file, which is bounded by the schema, not by the rows; the sketches
of a file, however hot, are added up by salt first, as a sorted stream; a comparison sees two files' sketches, never a stream's.

Defined cases: lines that are blank, cut off, no object or without a text ``type`` are not valid and have no fields; null members
are absent; a field with several types in one file has the most frequent (ties: first by name); a file without lines of a type
has no fields of it; repeated lines change nothing; an empty table has no changes.
"""

from __future__ import annotations

import datetime
import json
import math
import pickle
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanforge.operators.shred import as_text, load_json

SIMILAR, FEW, HELD = 0.4, 6, 2_000
#: from here on a number that stands for an instant counts milliseconds (as seconds it would be in the year 5138)
MILLISECONDS = 10**11
VALUE_SLOTS, WORD_SLOTS = 4096, 256


_TYPES = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def raw_type(value) -> str:
    return _TYPES[type(value)]


def path_values(node: dict, prefix: str = ""):
    """(path, raw type, value) of every member other than null; ``[]`` after a list whose objects are entered."""
    for name, value in node.items():
        if value is None or (not prefix and name == "type"):
            continue
        path = f"{prefix}.{name}" if prefix else name
        yield path, raw_type(value), value
        yield from _inside(value, path)


def _inside(value, path: str):
    if isinstance(value, dict):
        yield from path_values(value, path)
    elif isinstance(value, list):
        for item in value:
            if isinstance(item, (dict, list)):
                yield from _inside(item, path + "[]")


def _slot(kind: str, text: str, slots: int) -> str:
    return f"{kind}{(zlib.crc32(text.encode('utf-8', 'replace')) * 0x9E3779B1 % (1 << 32) >> 12) % slots}"  # numbers in a row would spread too evenly by the sum alone


REMEMBERED = 200_000
_TEXTS: dict[str, list[str]] = {}
_WORD, _MARK = re.compile(r"[^\W\d_]*"), re.compile(r"[^\w]")


def _text_features(value: str) -> list[str]:
    word = _WORD.match(value).group()
    return [_slot("v", value, VALUE_SLOTS), _slot("w", word, WORD_SLOTS), "u" + "".join(sorted(set(_MARK.findall(value)))), f"l{len(value).bit_length()}"]


def features(value) -> list[str]:
    """The kinds of a value that its sketch counts."""
    if isinstance(value, str):
        known = _TEXTS.get(value)
        if known is None:
            known = _text_features(value)
            if len(value) <= 64:
                if len(_TEXTS) >= REMEMBERED:
                    _TEXTS.clear()
                _TEXTS[value] = known
        return known
    if isinstance(value, bool):
        return [f"v{value}"]
    if isinstance(value, (int, float)):
        size = abs(value)
        return [_slot("v", repr(value), VALUE_SLOTS), f"l{-99 if size == 0 else max(-20, min(200, len(bin(int(size))) - 2 if size >= 1 else -int(1 / size).bit_length()))}", f"u{float(value).is_integer()}{value < 0}"]
    if isinstance(value, dict):
        return [_slot("m", k, VALUE_SLOTS) for k in value if value[k] is not None]
    out = []
    for item in value:
        out += [f"e{raw_type(item)}", *(f for f in features(item) if f[0] in "vmwul")] if item is not None else []
    return out


_PATHS: dict[tuple[str, str], str] = {}


def _count(node: dict, prefix: str, sketch: dict) -> None:
    """Add the path and type of each value below an object to its file's sketch; what ``path_values`` gives, counted."""
    for name, value in node.items():
        if value is None or (not prefix and name == "type"):
            continue
        path = _PATHS.get((prefix, name))
        if path is None:
            if len(_PATHS) >= REMEMBERED:
                _PATHS.clear()
            path = _PATHS[prefix, name] = _clean(f"{prefix}.{name}" if prefix else name)
        kinds = sketch.get(path)
        if kinds is None:
            kinds = sketch[path] = {}
        kind = raw_type(value)
        counts = kinds.get(kind)
        if counts is None:
            counts = kinds[kind] = Counter()
        counts[""] += 1
        for feature in features(value):
            counts[feature] += 1
        if kind == "object":
            _count(value, path, sketch)
        elif kind == "array":
            _count_items(value, path + "[]", sketch)


def _count_items(items: list, prefix: str, sketch: dict) -> None:
    for item in items:
        if isinstance(item, dict):
            _count(item, prefix, sketch)
        elif isinstance(item, list):
            _count_items(item, prefix + "[]", sketch)


SKETCH = "stream string, file_no long, msg_type string, salt int, sketch binary"


def _add(into: dict, sketch: bytes) -> None:
    """Add a sketch, path to raw type to counts by feature ('' counts the values), to one in memory."""
    for path, kinds in pickle.loads(zlib.decompress(sketch)).items():
        mine = into.setdefault(path, {})
        for kind, counts in kinds.items():
            mine.setdefault(kind, Counter()).update(counts)


def _packed(sketch: dict) -> bytes:
    return zlib.compress(pickle.dumps(sketch), 1)


def file_statistics(lines: DataFrame, salts: int = 8) -> DataFrame:
    """(stream, file_no, msg_type, salt, sketch): the path and type statistics of each file and type, in at most ``salts`` parts."""

    def out(seen: dict[tuple, dict]) -> pa.RecordBatch:
        keys = list(zip(*seen)) if seen else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*keys, [_packed(x) for x in seen.values()]], kinds)], names=["stream", "file_no", "msg_type", "salt", "sketch"])

    def run(batches):
        seen: dict[tuple, dict] = {}
        salt = TaskContext.get().partitionId() % salts
        for b in batches:
            for stream, no, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                node = load_json(payload)
                if not isinstance(node, dict) or not isinstance(node.get("type"), str) or stream is None or no is None:
                    continue
                sketch = seen.get(key := (stream, no, _clean(node["type"]), salt))
                if sketch is None:
                    sketch = seen[key] = {}
                _count(node, "", sketch)
            if len(seen) > HELD:
                yield out(seen)
                seen = {}
        yield out(seen)

    def merge(batches):
        """Sorted sketches to one of each key, as a stream: one sketch is held at a time."""
        key, total = None, {}
        for b in batches:
            done: dict[tuple, dict] = {}
            for *at, sketch in zip(*(b.column(i).to_pylist() for i in range(5))):
                if tuple(at) != key:
                    if key is not None:
                        done[key] = total
                    key, total = tuple(at), {}
                _add(total, sketch)
            yield out(done)
        if key is not None:
            yield out({key: total})

    keyed = lines.select("stream", F.col("file_no").cast("long").alias("file_no"), "payload")
    keys = ["stream", "file_no", "msg_type", "salt"]
    return keyed.mapInArrow(run, SKETCH).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, SKETCH)


def _clean(x):
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) else x


def overlap(a: Counter, b: Counter) -> float:
    """The share that two distributions have in common."""
    na, nb = sum(a.values()), sum(b.values())
    if not na or not nb:
        return 1.0 if na == nb else 0.0
    return sum(min(a[k] / na, b[k] / nb) for k in a.keys() & b.keys())


def distinct(slots: Counter, of: int = VALUE_SLOTS) -> float:
    """How many distinct values fell into ``slots`` of ``of``, whatever the number of rows: by the share of slots still empty (linear
    counting) and, where hardly any is, by how unevenly the rows are spread over the slots (values that do not recur spread evenly).
    """
    filled, n = len(slots), sum(slots.values())
    if filled < 0.95 * of:
        return -of * math.log1p(-filled / of)
    often = (sum(c * c for c in slots.values()) - n * n / of) / (n * (1 - 1 / of))
    return n / max(1.0, often)


def name_words(path: str) -> set[str]:
    return set(re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", path.rpartition(".")[2]).lower().split("_"))


def names_alike(a: str, b: str) -> bool:
    x, y = name_words(a), name_words(b)
    return bool(x & y) or any(len(p) >= 3 and len(q) >= 3 and (p.startswith(q) or q.startswith(p)) for p in x for q in y)


def carries_on(old: str, new: str, kind: str, a: Counter, b: Counter) -> float:
    """How far ``new`` has the content that ``old`` had, from 0 to 1, by their feature counts."""
    part = lambda c, k: Counter({f: n for f, n in c.items() if f[:1] == k})
    values = part(a, "v"), part(b, "v")
    bonus = 0.15 * names_alike(old, new)
    if kind == "object":
        return overlap(part(a, "m"), part(b, "m")) + bonus
    if kind == "array":
        if overlap(part(a, "e"), part(b, "e")) < 0.5:
            return 0.0
        members = part(a, "m"), part(b, "m")
        few = min(sum(v.values()) for v in values) < 2 * FEW  # then the same vocabulary may show other words
        shape = 0.75 * min(overlap(part(a, k), part(b, k)) for k in "ul") if few and values[0] else 0.0
        return max(overlap(*values) if values[0] else 0.0, overlap(*members) if members[0] else 0.0, shape) + bonus
    if kind == "boolean":
        return bonus and overlap(*values) + bonus
    telling = ("u", "l", "w") if len(part(a, "w")) * 2 < sum(part(a, "w").values()) else ("u", "l")  # first words that hardly recur tell nothing
    shapes = [overlap(part(a, k), part(b, k)) for k in telling if part(a, k) or part(b, k)]
    shape = 0.3 * shapes[0] + 0.7 * shapes[1] if kind == "number" else sum(shapes) / len(shapes)
    n = [max(1, sum(v.values())) for v in values]
    repeats = [1 - min(1.0, distinct(v) / m) for v, m in zip(values, n)]
    if kind == "number" and min(len(v) for v in values) == 1 and not bonus:  # a constant says little, unless it is a fraction and stays
        return float(values[0].keys() == values[1].keys() and "uFalseFalse" in a)
    if min(repeats) > 0.5 and min(n) >= FEW:  # few values, often: they must recur
        shape = min(shape, overlap(*values) + 0.15)
    elif abs(repeats[0] - repeats[1]) > 0.75 and min(n) > 3:  # few values against many
        shape *= 0.5
    return shape + bonus


def compare(old: dict[str, tuple[str, Counter]], new: dict[str, tuple[str, Counter]]) -> list[tuple[str, str]]:
    """(old_path, new_path) of each change between two files' fields of one type: path to (type, feature counts)."""
    gone, come = [p for p in old if p not in new], [p for p in new if p not in old]
    changed = [p for p in old if p in new and old[p][0] != new[p][0]]
    below = lambda p, roots: any(p[: len(r)] == r and p[len(r) : len(r) + 1] in (".", "[") for r in roots)
    roots_old, roots_new = {*gone, *changed}, {*come, *changed}
    gone, come = [p for p in gone if not below(p, roots_old)], [p for p in come if not below(p, roots_new)]
    changed = [p for p in changed if not below(p, {*gone, *come, *changed})]
    pairs = []
    for p in gone:
        for q in come:
            if p.rpartition(".")[0] == q.rpartition(".")[0] and old[p][0] == new[q][0]:
                score = carries_on(p, q, old[p][0], old[p][1], new[q][1])
                if score >= SIMILAR:
                    pairs.append((-score, p, q))
    renamed = []
    for _, p, q in sorted(pairs):
        if p in gone and q in come:
            renamed.append((p, q))
            gone.remove(p)
            come.remove(q)
    return [*renamed, *((p, p) for p in changed), *((p, "") for p in gone), *(("", q) for q in come)]


def changes(lines: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(stream, file_no, file_name, msg_type, old_path, new_path): every change of a file against the one before it in its stream.

    ``stats`` is what ``file_statistics`` gives, where it is at hand.
    """
    stats = file_statistics(lines) if stats is None else stats
    names = lines.where("stream is not null and file_no is not null").groupBy("stream", F.col("file_no").cast("long").alias("file_no")).agg(F.min("file_name").alias("file_name"))
    in_order = Window.partitionBy("stream").orderBy("file_no")
    after = names.select("stream", "file_no", F.lead("file_no").over(in_order).alias("next_no"), F.lead("file_name").over(in_order).alias("next_name"), "file_name", F.lag("file_no").over(in_order).alias("before"))
    # each file's statistics serve twice: as the new ones, and as the old ones of the next file
    role = F.array(
        F.struct(F.col("file_no").alias("at"), F.col("file_name").alias("name"), F.col("before").isNotNull().alias("wanted"), F.lit(True).alias("new")),
        F.struct(F.col("next_no").alias("at"), F.col("next_name").alias("name"), F.col("next_no").isNotNull().alias("wanted"), F.lit(False).alias("new")),
    )
    both = stats.join(after, ["stream", "file_no"]).select("stream", "msg_type", "sketch", F.explode(role).alias("r")).where("r.wanted").select("stream", F.col("r.at").alias("file_no"), F.col("r.name").alias("file_name"), "msg_type", F.col("r.new").alias("new"), "sketch")

    def run(t: pa.Table) -> pa.Table:
        sketches: dict[bool, dict] = {False: {}, True: {}}
        for new, sketch in zip(t.column("new").to_pylist(), t.column("sketch").to_pylist()):
            _add(sketches[new], sketch)
        fields = {}
        for new, sketch in sketches.items():
            top = {path: min(kinds, key=lambda k: (-kinds[k][""], k)) for path, kinds in sketch.items()}
            fields[new] = {path: (kind, sketch[path][kind]) for path, kind in top.items()}
        found = compare(fields[False], fields[True])
        head = t.slice(0, 1).to_pylist()[0]
        out = {c: [head[c]] * len(found) for c in ("stream", "file_no", "file_name", "msg_type")}
        out |= {"old_path": [a for a, _ in found], "new_path": [b for _, b in found]}
        return pa.table({c: pa.array(v, pa.int64() if c == "file_no" else pa.string()) for c, v in out.items()})

    return both.groupBy("stream", "file_no", "msg_type").applyInArrow(run, "stream string, file_no long, file_name string, msg_type string, old_path string, new_path string")


#: columns of the consistent table whose name and type are given: name, path under the first names, type; all other paths get theirs from the statistics
LINE_COLUMNS = [
    ("protocol_version", "protocol_version", "string"),
    ("correlation", "id", "string"),
    ("provider_name", "provider.name", "string"),
    ("provider_version", "provider.version", "string"),
    ("representations", "capabilities.representations", "array<string>"),
    ("embeddings_fingerprint", "capabilities.embeddings_fingerprint", "string"),
    ("goal", "query.goal", "string"),
    ("query_text", "query.query_text", "string"),
    ("max_frames", "query.max_frames", "bigint"),
    ("max_tokens", "query.max_tokens", "bigint"),
    ("kinds", "query.kinds", "array<string>"),
    ("as_of", "query.as_of", "timestamp"),
    ("truncated", "result.truncated", "boolean"),
    ("dropped_estimate", "result.dropped_estimate", "bigint"),
]


def first_name(path: str, renames: list[tuple[int, str, str]], file_no: int) -> str:
    """The first name of what file ``file_no`` calls ``path``, by the renames (file, old, new) in order of file.

    A name that comes again after its field was renamed is another field: it gets the number of that file.
    """
    under = lambda p, root: p == root or (p.startswith(root) and p[len(root)] in ".[")
    for at, old, new in reversed(renames):
        if at > file_no:
            continue
        if under(path, new):
            path = old + path[len(new) :]
        elif under(path, old):
            path = f"{old}~{at}{path[len(old) :]}"
    return path


def convert(value, kind: str):
    """``value`` as ``kind``; raises ValueError where it cannot be."""
    if isinstance(value, dict) and len(value) == 1 and "value" in value:
        value = value["value"]
    if kind == "string":
        if isinstance(value, (dict, list)):
            raise ValueError(value)
        return _clean(value) if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
    if kind == "bigint":
        if isinstance(value, (bool, dict, list)) or float(value) != int(float(value)) or abs(int(float(value))) >= 1 << 63:
            raise ValueError(value)
        return value if isinstance(value, int) else int(value) if isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d+\s*", value) else int(float(value))
    if kind == "double":
        if isinstance(value, (bool, dict, list)) or not math.isfinite(float(value)):
            raise ValueError(value)
        return float(value)
    if kind == "boolean":
        known = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
        if isinstance(value, (dict, list)) or str(value).lower() not in known:
            raise ValueError(value)
        return known[str(value).lower()]
    if kind == "timestamp":
        if isinstance(value, str):
            return datetime.datetime.fromisoformat(value)
        if isinstance(value, (bool, dict, list)):
            raise ValueError(value)
        return datetime.datetime.fromtimestamp(value / 1000 if abs(value) >= MILLISECONDS else value, datetime.timezone.utc)
    if isinstance(value, dict) and isinstance(value.get("items"), list):
        value = value["items"]
    if isinstance(value, str):
        value = [x for x in value.split(",") if x]
    if not isinstance(value, list):
        raise ValueError(value)
    return [convert(x, kind[6:-1]) if x is not None else None for x in value]


ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC"), "json": pa.string()}
ARROW |= {f"array<{k}>": pa.list_(ARROW[k]) for k in ("string", "bigint", "double", "boolean")}


def _renames(drift: DataFrame) -> DataFrame:
    """(stream, renames): message type to the renames of the stream in order of file."""
    return (
        drift.where("old_path <> '' and new_path <> '' and old_path <> new_path")
        .groupBy("stream", "msg_type")
        .agg(F.array_sort(F.collect_list(F.struct("file_no", "old_path", "new_path"))).alias("r"))
        .groupBy("stream")
        .agg(F.map_from_entries(F.collect_list(F.struct("msg_type", "r"))).alias("renames"))
    )


def _of_type(renames, msg_type: str) -> list[tuple[int, str, str]]:
    return [(r["file_no"], r["old_path"], r["new_path"]) for r in dict(renames or []).get(msg_type, [])]


def path_kinds(stats: DataFrame, drift: DataFrame) -> dict[str, str]:
    """Each path, under its first name, to the kind of its column by its most frequent type (ties: first by name).

    Objects are entered; lists with more objects or lists than anything else are 'json'.
    """

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for no, msg_type, sketch, renames in zip(*(b.column(i).to_pylist() for i in range(4))):
                known = _of_type(renames, msg_type)
                for path, kinds in pickle.loads(zlib.decompress(sketch)).items():
                    first = first_name(path, known, no)
                    for kind, counts in kinds.items():
                        seen[first, kind] += counts[""]
                        for feature, n in counts.items():
                            if feature[:1] == "e":
                                seen[first, feature] += n
                            elif feature.startswith("uFalse"):
                                seen[first, f"{kind} of fractions"] += n
        keys = list(zip(*seen)) if seen else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["path", "what", "n"])

    found = stats.join(_renames(drift), "stream", "left").select("file_no", "msg_type", "sketch", "renames").mapInArrow(run, "path string, what string, n long")
    paths: dict[str, dict[str, int]] = {}
    for path, what, n in found.groupBy("path", "what").agg(F.sum("n").alias("n")).collect():
        paths.setdefault(path, {})[what] = n
    top = lambda n, among: min((k for k in among if k in n), key=lambda k: (-n[k], k), default=None)
    out = {}
    for path, n in paths.items():
        kind = top(n, ("array", "boolean", "number", "object", "string"))
        item = kind if kind != "array" else (top(n, ("earray", "eboolean", "enumber", "eobject", "estring")) or "estring")[1:]
        if kind == "array" and item in ("array", "object"):
            out[path] = "json"
            continue
        item = ("double" if n.get(f"{kind} of fractions") else "bigint") if item == "number" else item
        out[path] = f"array<{item}>" if kind == "array" else item
    return out


def line_columns(kinds: dict[str, str], given: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The columns (name, path, kind) of the consistent table: those given, then every other path that is no object and in none that has a column."""
    columns, taken = list(given), {"line_id", "stream", "file_no", "line_no", "valid", "msg_type", "failed", "rest", *(c for c, _, _ in given)}
    scalars = {p for p, k in kinds.items() if k != "object"} | {p for _, p, _ in given}
    for path in sorted(kinds.keys() - {p for _, p, _ in given}):
        if kinds[path] == "object" or "[]" in path or any(path[:i] in scalars for i, c in enumerate(path) if c == "."):
            continue
        name = base = re.sub(r"\W", "_", path).lower() or "_"
        n = 1
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        columns.append((name, path, kinds[path]))
    return columns


class Projection:
    """One envelope after another as (column to value, failed, rest)."""

    def __init__(self, columns: list[tuple[str, str, str]], kinds: dict[str, str]):
        self.kinds = kinds | {p: k for _, p, k in columns}
        self.column = {p: c for c, p, _ in columns}
        self.names: dict[tuple, dict[str, str]] = {}

    def first(self, path: str) -> str:
        if path not in self.cache:
            self.cache[path] = first_name(path, self.renames, self.file_no)
        return self.cache[path]

    def row(self, node: dict, stream, file_no: int, renames: list[tuple[int, str, str]]) -> tuple[dict, list[str], dict]:
        self.file_no, self.renames = file_no, renames
        key = (stream, file_no, node["type"])
        if key not in self.names and len(self.names) > HELD:
            self.names.clear()
        self.cache = self.names.setdefault(key, {})
        self.values, self.failed, self.rest = {}, {}, {}
        self.members({k: v for k, v in node.items() if k != "type"}, "")
        return self.values, list(self.failed), self.rest

    def members(self, node: dict, prefix: str) -> None:
        for name, value in node.items():
            if value is None:
                continue
            path = _clean(f"{prefix}.{name}" if prefix else name)
            first = self.first(path)
            kind, column = self.kinds.get(first), self.column.get(first)
            if kind == "object" and isinstance(value, dict) and value:
                self.members(value, path)
            elif column is None or column in self.values:
                self.rest[path] = value
                if kind == "object" and not isinstance(value, dict):
                    self.failed[first] = None
            else:
                try:
                    self.values[column] = as_text(self.shaped(value, path, first, path)) if kind == "json" else convert(value, kind)
                    if kind not in ("string", "json") and isinstance(value, dict) and "items" in value:  # a list with its count: what is beside the list
                        self.rest |= {_clean(f"{path}.{k}"): x for k, x in value.items() if k != "items" and x is not None}
                except (ValueError, OverflowError, OSError):
                    self.rest[path] = value
                    self.failed[column] = None

    def shaped(self, value, path: str, first: str, place: str) -> list:
        """A list of objects (a lone one stands for a list of one) under the first names, its members cast."""
        if isinstance(value, dict):
            value = [value]
        if not isinstance(value, list):
            raise ValueError(value)
        return [self.inner(x, path + "[]", first + "[]", f"{place}[{i}]") for i, x in enumerate(value)]

    def inner(self, value, path: str, first: str, place: str):
        if isinstance(value, list):
            return [self.inner(x, path + "[]", first + "[]", f"{place}[{i}]") for i, x in enumerate(value)]
        if not isinstance(value, dict):
            return value
        out = {}
        for name, x in value.items():
            at, under = _clean(f"{path}.{name}"), _clean(f"{place}.{name}")
            named = self.first(at)
            kind, name = self.kinds.get(named), named[len(first) + 1 :] if named.startswith(first + ".") else _clean(name)
            if x is None or name in out and out[name] is not None:
                out.setdefault(name, None)
                if x is not None:
                    self.rest[under] = x
                continue
            try:
                if kind is None:
                    out[name] = x
                elif kind == "object":
                    if not isinstance(x, dict):
                        raise ValueError(x)
                    out[name] = self.inner(x, at, named, under)
                else:
                    out[name] = self.shaped(x, at, named, under) if kind == "json" else convert(x, kind)
            except (ValueError, OverflowError, OSError):
                out[name] = None
                self.rest[under] = x
                self.failed[named] = None
        return out


def consistent_lines(lines: DataFrame, drift: DataFrame, columns: list[tuple[str, str, str]] = LINE_COLUMNS, stats: DataFrame | None = None) -> DataFrame:
    """Every line as one row of typed columns, whatever its file calls them.

    The columns are those of ``columns`` and one for each other path of the statistics; the path is in the metadata of the column.
    Lists of objects are JSON text under the first names, their members cast. ``failed`` has the columns (within lists, the paths)
    whose value could not be cast; ``rest`` is a JSON object from path to each value that is in no column as it was, so no value is lost.
    ``valid`` is false where the line has no envelope. ``drift`` is what ``changes`` gives, ``stats`` what ``file_statistics`` gives.
    """
    found = path_kinds(file_statistics(lines) if stats is None else stats, drift)
    columns = line_columns(found, columns)
    keyed = lines.select("line_id", "stream", F.col("file_no").cast("long").alias("file_no"), "line_no", "payload").join(_renames(drift), "stream", "left")
    kinds = {"valid": pa.bool_(), "msg_type": pa.string(), **{c: ARROW[k] for c, _, k in columns}, "failed": pa.list_(pa.string()), "rest": pa.string()}

    def run(batches):
        projection = Projection(columns, found)
        for b in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            for payload, stream, file_no, names in zip(*(b.column(c).to_pylist() for c in ("payload", "stream", "file_no", "renames"))):
                node = load_json(payload)
                valid = isinstance(node, dict) and isinstance(node.get("type"), str)
                msg_type = _clean(node["type"]) if valid else None
                values, failed, rest = projection.row(node, stream, file_no or 0, _of_type(names, msg_type)) if valid else ({}, [], {})
                out["valid"].append(valid)
                out["msg_type"].append(msg_type)
                for column, _, _ in columns:
                    out[column].append(values.get(column))
                out["failed"].append(failed)
                out["rest"].append(as_text(rest) if rest else None)
            yield pa.RecordBatch.from_arrays([b.column("line_id"), b.column("stream"), b.column("file_no"), b.column("line_no"), *(pa.array(v, kinds[k]) for k, v in out.items())], names=["line_id", "stream", "file_no", "line_no", *out])

    schema = T.StructType([T.StructField(n, T.StringType() if n == "stream" else T.LongType()) for n in ("line_id", "stream", "file_no", "line_no")])
    schema.add("valid", T.BooleanType()).add("msg_type", T.StringType())
    for column, path, kind in columns:
        schema.add(column, T._parse_datatype_string("string" if kind == "json" else kind), True, {"path": path})
    return keyed.mapInArrow(run, schema.add("failed", T.ArrayType(T.StringType())).add("rest", T.StringType()))
