"""Nested records, drift and repeated deliveries on small fixtures and brute force."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.operators import drift, exactly_once, shred

JOURNAL = "delivery_id long, received_at timestamp, session string, seq long, effect_id string, session_id int"


@given(st.lists(st.binary(max_size=60), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_permutation_is_a_bijection(ids):
    data = np.frombuffer(b"".join(ids) or b"\0", np.uint8)
    lengths = np.array([len(i) for i in ids], np.int64)
    words = exactly_once.fixed_width(data, np.cumsum(lengths) - lengths, lengths, 9)
    assert (exactly_once.unpermute(exactly_once.permute(words)) == words).all()
    assert len({w.tobytes() for w in words}) == len(set(ids))


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5), st.integers(0, 99)), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_insert_once_keeps_the_first(rows):
    words = np.array([[r[0], r[0] * 7] for r in rows], np.uint64)
    order = [np.array([r[1] for r in rows]), np.arange(len(rows))]
    kept = exactly_once.insert_once(words, order)
    assert (exactly_once.first_of_runs(words, order) == kept).all()
    for key in {r[0] for r in rows}:
        mine = [i for i, r in enumerate(rows) if r[0] == key]
        assert [i for i in mine if kept[i]] == [min(mine, key=lambda i: (rows[i][1], i))]


def test_surplus_with_nulls_ties_and_long_identifiers(spark):
    long = "s" * 30_000
    rows = [
        (1, "2026-01-01 00:00:00", "a", 1, None), (2, "2026-01-01 00:00:00", "a", 1, None), (3, "2025-01-01 00:00:00", "a", 1, None),
        (4, None, "a", 2, None), (5, "2026-01-01 00:00:00", "a", 2, None), (6, None, None, 1, None), (7, None, None, 1, None), (8, None, "a", None, None), (9, None, "a", None, None),
        (10, "2026-01-01 00:00:00", "a", 1, "e"), (11, "2026-01-01 00:00:00", "a", 9, "e"), (12, None, long, 1, None), (13, None, long, 1, None), (14, None, "", 1, None), (15, None, "", 1, ""),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "delivery_id long, received_at string, session string, seq long, effect_id string, row int").withColumn("received_at", F.to_timestamp("received_at"))
    got = {r.row for r in exactly_once.journal_surplus(df.drop("row")).where("surplus").collect()}
    assert got == {1, 2, 4, 11, 13}
    assert exactly_once.journal_surplus(df.where("false")).count() == 0
    assert exactly_once.deliver_once(df).count() == len(rows) - len(got)


def test_batches_meet_what_came_before(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"2026-01-{1 + i // 40:02d} 00:00:{rng.randrange(60):02d}", rng.choice(["a", "b", None, "s" * 5000]), rng.choice([1, 2, 3, None]), rng.choice([None, None, "e", "f"])) for i in range(160)]
    df = spark.createDataFrame(rows, "delivery_id long, received_at string, session string, seq long, effect_id string").withColumn("received_at", F.to_timestamp("received_at"))
    whole = {r.row for r in exactly_once.journal_surplus(df).where("surplus").collect()}
    got = [r.row for i in (0, 40, 80, 120) for r in exactly_once.journal_batch(df.where(f"delivery_id >= {i} AND delivery_id < {i + 40}"), f"{tmp_path}/store").where("surplus").collect()]
    assert set(got) == whole and len(got) == len(whole) and exactly_once.journal_batch(df.where("false"), f"{tmp_path}/store").count() == 0


def test_typed_columns_keep_what_is_absent(spark):
    rows = [(1, [("u", ("x", 1)), None, (None, None), ("w", (None, 2))]), (2, []), (3, None), (4, [None])]
    df = spark.createDataFrame(rows, "id long, l array<struct<a:string,b:struct<c:string,d:bigint>>>")
    got = [tuple(r) for r in shred.typed_elements(df, "id", "l", {"a": "a", "b.c": "c", "b.d": "d"}).orderBy("id", "pos1").collect()]
    assert got == [(1, 0, "u", "x", 1), (1, 1, None, None, None), (1, 2, None, None, None), (1, 3, "w", None, 2), (4, 0, None, None, None)]
    leaf = df.select("id", shred.only(F.col("l"), df.schema["l"].dataType, ["[]", "b", "c"]).alias("l"))
    levels = shred.shred_arrow(leaf.orderBy("id").select("l").toArrow().column(0).combine_chunks(), "[].b.c")
    assert levels.defn.tolist() == [levels.top, 2, 3, 4, 1, 0, 2] and levels.rep.tolist() == [0, 1, 1, 1, 0, 0, 0]
    words = spark.createDataFrame([(1, ["x", None]), (2, None)], "id long, l array<string>")
    assert [tuple(r) for r in shred.typed_elements(words, "id", "l", {"": "value"}).collect()] == [(1, 0, "x"), (1, 1, None)]


def test_distinct_values_are_told_at_any_size():
    rng = random.Random(6)
    for n, d in ((30, 30), (4000, 4000), (20_000, 20_000), (200_000, 200_000), (200_000, 50), (200_000, 3000), (50_000, 20_000)):
        slots = drift.Counter(drift._slot("v", str(rng.randrange(10**9) if d == n else i % d), drift.VALUE_SLOTS) for i in range(n))
        assert 0.8 * d <= drift.distinct(slots) <= 1.25 * d, (n, d, drift.distinct(slots))


def test_counted_is_what_the_paths_say():
    node = {"type": "query", "a": {"type": "x", "b": [1, {"c": None, "d": True}, [{"e": "f"}]]}, "g": None, "h": 1.5}
    sketch: dict = {}
    drift._count(node, "", sketch)
    want: dict = {}
    for path, kind, value in drift.path_values(node):
        counts = want.setdefault(path, {}).setdefault(kind, drift.Counter())
        counts.update(["", *drift.features(value)])
    assert sketch == want and drift.convert("12.0", "bigint") == 12 and drift.convert(1_700_000_000_000, "timestamp") == drift.convert(1_700_000_000, "timestamp")
    assert drift.convert(str(2**62 + 1), "bigint") == 2**62 + 1


def test_shards_are_even():
    ids = [f"s15:sess_0000000{i % 7:03}{i}".encode() for i in range(20_000)]
    lengths = np.array([len(i) for i in ids], np.int64)
    words = exactly_once.permute(exactly_once.fixed_width(np.frombuffer(b"".join(ids), np.uint8), np.cumsum(lengths) - lengths, lengths, 4))
    counts = np.bincount((words[:, 0] >> np.uint64(58)).astype(int), minlength=64)
    assert counts.min() > 200 and counts.max() < 430


def test_hot_identifier(spark):
    df = spark.range(60_000).select(F.col("id").alias("delivery_id"), F.timestamp_seconds(F.lit(0)).alias("received_at"), F.when(F.col("id") % 3 == 0, "hot").otherwise("s").alias("session"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("seq"), F.lit(None).cast("string").alias("effect_id"))
    assert exactly_once.journal_surplus(df).where("surplus").count() == 19_999


RECORDS = [None, {}, {"a": None}, {"a": []}, {"a": [None]}, {"a": [{"b": None}, {"b": []}, None, {"b": [{"c": "x"}, None, {"c": None}, {"c": "y"}]}]}, {"a": {"b": {"c": "z"}}}, {"a": "text"}, "text", [1]]


def test_levels_give_every_value_its_place():
    levels = shred.shred_objects(RECORDS, "a[].b[].c")
    record, places, value = shred.links(levels)
    assert list(zip(record.tolist(), places[0].tolist(), places[1].tolist(), value.tolist())) == [(5, 3, 0, "x"), (5, 3, 3, "y"), (6, 0, 0, "z")]


ITEM = st.one_of(st.none(), st.builds(lambda b: {"b": b}, st.one_of(st.none(), st.lists(st.one_of(st.none(), st.text(max_size=3)), max_size=4))))


@given(st.lists(st.one_of(st.none(), st.lists(ITEM, max_size=4)), max_size=6))
@settings(max_examples=100, deadline=None)
def test_arrow_and_object_levels_agree(lists):
    kind = pa.list_(pa.struct([("b", pa.list_(pa.string()))]))
    arrow = shred.shred_arrow(pa.array(lists, kind), "[].b[]")
    objects = shred.shred_objects([None if x is None else {"r": x} for x in lists], "r[].b[]")
    for a, b in zip(shred.links(arrow), shred.links(objects)):
        if isinstance(a, list):
            assert [x.tolist() for x in a] == [x.tolist() for x in b]
        else:
            assert a.tolist() == b.tolist()


@pytest.mark.parametrize("text, value", [(None, None), ("", None), ("  ", None), ('{"a":', None), ("NaN", None), ('"{\\"a\\": 1}"', {"a": 1}), ("[" * 100_000, None), ('{"a": 1}\r', {"a": 1})])
def test_load_json(text, value):
    assert shred.load_json(text) == value


def test_children_of_odd_payloads(spark):
    frames = {"result": {"frames": [{"id": "f0", "provenance": {"uri": "u"}}, None, {"id": 7, "provenance": [None, {"uri": "v"}]}]}}
    rows = [(1, json.dumps(frames)), (1, json.dumps(frames)), (2, json.dumps(json.dumps(frames))), (3, '{"result": {"frames": '), (4, None), (5, json.dumps({"result": {"frames": {"id": "\ud800"}}}))]
    wire = spark.createDataFrame(rows, "msg_id long, payload string")
    other = spark.createDataFrame([(1, [("a",), None, (None,)]), (2, None), (3, [])], "frame_no long, provenance array<struct<uri:string>>")
    journal = spark.createDataFrame([(1, [None, (("x",),)]), (2, None)], "delivery_id long, frames array<struct<frame:struct<frame_id:string>>>")
    got = sorted(map(tuple, shred.nested_children(wire, other, journal).collect()))
    one = [(0, -1, "f0"), (0, 0, "u"), (2, -1, "7"), (2, 1, "v")]
    assert got == sorted([("frames", 1, -1, 0, "a"), ("journal", 1, 1, -1, "x"), *(("wire_messages", m, *x) for m in (1, 2) for x in one), ("wire_messages", 5, 0, -1, "?")])


def _capture(files):
    return [(i, "s", f"f{n}", n, k, json.dumps(x) if not isinstance(x, str) else x) for n, lines in enumerate(files, 1) for k, x in enumerate(lines) for i in [n * 100 + k]]


def test_drift_on_a_small_stream(spark):
    rng = random.Random(1)
    q = lambda **x: {"type": "query", "id": f"q{rng.randrange(99)}", "query": {"goal": rng.choice(["find the page on", "what is"]) + " it", **x}}
    files = [
        [q(max_tokens=rng.randrange(500, 900), kinds=["doc"]) for _ in range(9)] + ["", "{cut", '"text"'],
        [q(token_budget=rng.randrange(500, 900), kinds="doc", priority=0.25) for _ in range(9)],
        [{"type": "query", "ref": x["id"], "query": {"goal": {"text": x["query"]["goal"]}, "token_budget": rng.randrange(500, 900), "kinds": "doc"}} for x in (q() for _ in range(9))],
    ]
    df = spark.createDataFrame(_capture(files), "line_id long, stream string, file_name string, file_no long, line_no long, payload string")
    got = sorted((r.file_name, r.old_path, r.new_path) for r in drift.changes(df).collect())
    assert got == [("f2", "", "query.priority"), ("f2", "query.kinds", "query.kinds"), ("f2", "query.max_tokens", "query.token_budget"), ("f3", "id", "ref"), ("f3", "query.goal", "query.goal"), ("f3", "query.priority", "")]
    lines = drift.consistent_lines(df, drift.changes(df)).orderBy("line_id").collect()
    assert len(lines) == 30 and sum(r.valid for r in lines) == 27
    assert all(r.max_tokens and r.correlation and r.kinds == ["doc"] for r in lines if r.valid)
    assert [r.failed for r in lines[-9:]] == [["goal"]] * 9
    assert drift.changes(df.where("false")).count() == 0


def test_conversions():
    assert drift.convert("12", "bigint") == 12 and drift.convert("a,b", "array<string>") == ["a", "b"] and drift.convert("yes", "boolean") is True
    for value, kind in (("x", "bigint"), (1.5, "bigint"), ({}, "string"), ("maybe", "boolean"), (1, "array<string>")):
        with pytest.raises(ValueError):
            drift.convert(value, kind)
