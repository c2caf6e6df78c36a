"""What a review found missing, each on a small case that the code before did not pass."""

import json

import pytest
from conftest import SF
from oracle import same

from spanforge.operators import drift
from spanforge.plans import general, sources

LINES = "line_id long, stream string, file_name string, file_no long, line_no long, payload string"


def test_every_field_of_a_line_has_a_column(spark):
    frame = lambda **x: {"type": "frames", "id": "q", "result": {"frames": [{"id": "f", **x}]}}
    query = lambda i, **x: {"type": "query", "id": f"q{i}", "query": {"goal": "find", "anchors": ["a"], **x}}
    files = [
        [query(i, token_limit=500 + i, future_field="x") for i in range(10)] + [frame(score=0.25, title="one two"), frame(score=0.5, title="two three"), "", "{cut"],
        [query(i, token_cap=505 + i, priority=0.5, future_field={"stage": "y"}) for i in range(9)] + [frame(score="high", title="one two"), frame(score="0.5", title="two three", locale="de")],
    ]
    rows = [(100 * n + k, "s", f"f{n}", n, k, x if isinstance(x, str) else json.dumps(x)) for n, lines in enumerate(files, 1) for k, x in enumerate(lines)]
    got = drift.consistent_lines(df := spark.createDataFrame(rows, LINES), drift.changes(df)).orderBy("line_id").collect()
    assert len(got) == len(rows) and [r.valid for r in got if r.msg_type is None] == [False, False]
    first, second = [r for r in got if r.msg_type == "query" and r.file_no == 1], [r for r in got if r.msg_type == "query" and r.file_no == 2]
    assert [r.query_token_limit for r in first + second] == [*range(500, 510), *range(505, 514)]
    assert {tuple(r.query_anchors) for r in first + second} == {("a",)}
    assert {(r.query_priority, r.query_future_field) for r in first} == {(None, "x")} and {r.query_priority for r in second} == {0.5}
    assert {(tuple(r.failed), r.rest) for r in second} == {(("query_future_field",), '{"query.future_field":{"stage":"y"}}')}
    frames = [r for r in got if r.msg_type == "frames"]
    assert [json.loads(r.result_frames)[0]["score"] for r in frames] == [0.25, 0.5, None, 0.5]
    assert json.loads(frames[3].result_frames)[0]["locale"] == "de"
    assert [r.failed for r in frames] == [[], [], ["result.frames[].score"], []] and json.loads(frames[2].rest) == {"result.frames[0].score": "high"}


def test_a_name_that_comes_again_is_another_field():
    renames = [(2, "a", "b"), (5, "c", "d")]
    assert [drift.first_name(p, renames, n) for p, n in (("a", 1), ("b", 2), ("b.x", 9), ("a", 3), ("d[].y", 5), ("d", 4))] == ["a", "a", "a.x", "a~2", "c[].y", "d"]


def test_off_kind_and_early_frames_fail_their_provider(spark, duck):
    sql = """WITH f AS (SELECT DISTINCT frame_no, query_id, provider_id, kind, valid_from FROM frames), p AS (SELECT DISTINCT provider_id, kinds FROM providers),
    q AS (SELECT DISTINCT query_id, kinds AS asked, as_of FROM queries),
    r AS (SELECT p.provider_id, coalesce(len(any_value(p.kinds)), 0) > 0 AS declares, count(f.frame_no) AS n, count(*) FILTER (len(asked) > 0) AS narrowed, count(*) FILTER (as_of IS NOT NULL) AS pinned,
    count(*) FILTER (f.frame_no IS NOT NULL AND ((len(p.kinds) > 0 AND NOT coalesce(list_contains(p.kinds, kind), false)) OR (len(asked) > 0 AND NOT coalesce(list_contains(asked, kind), false)))) AS off,
    count(*) FILTER (valid_from > as_of) AS early FROM p LEFT JOIN f USING (provider_id) LEFT JOIN q USING (query_id) GROUP BY p.provider_id)
    SELECT provider_id, 'kinds' AS "check", CASE WHEN n = 0 OR NOT (declares OR narrowed > 0) THEN 'skipped' WHEN off > 0 THEN 'fail' ELSE 'pass' END AS status FROM r
    UNION ALL SELECT provider_id, 'as_of', CASE WHEN pinned = 0 THEN 'skipped' WHEN early > 0 THEN 'fail' ELSE 'pass' END FROM r"""
    same(spark, duck, lambda s, d: sources.provider_checks(s, d).where("check IN ('kinds', 'as_of')"), sql, SF)
    assert {r.check for r in sources.provider_checks(spark, SF).where("status = 'fail'").collect()} >= {"kinds", "as_of"}


ENVELOPES = """WITH m AS (SELECT DISTINCT msg_id, conn_id, payload FROM wire_messages WHERE trim(regexp_replace(payload, '\\s', ' ', 'g'), ' ') <> ''),
j AS (SELECT msg_id, conn_id, CASE WHEN NOT json_valid(payload) THEN NULL WHEN json_type(payload) <> 'VARCHAR' THEN CAST(payload AS JSON) WHEN json_valid(payload ->> '$') THEN CAST(payload ->> '$' AS JSON) END AS j FROM m),
r AS (SELECT msg_id, conn_id, j ->> '$.id' AS id, j ->> '$.type' AS type FROM j WHERE j ->> '$.id' IS NOT NULL) """
WHOLE = {
    "envelope_types": "SELECT j ->> '$.type' AS type, count(*) AS lines FROM j GROUP BY 1",
    "envelope_queries": "SELECT msg_id, j ->> '$.id' AS id, j ->> '$.query.goal' AS goal, try_cast(j ->> '$.query.max_frames' AS BIGINT) AS max_frames, try_cast(j ->> '$.query.max_tokens' AS BIGINT) AS max_tokens FROM j WHERE j ->> '$.type' = 'query'",
    "correlation_echo": "SELECT msg_id, id FROM r WHERE type IN ('frames', 'error') AND NOT EXISTS (SELECT 1 FROM r a WHERE a.type = 'query' AND a.conn_id = r.conn_id AND a.id = r.id)",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_wrapped_envelopes_are_counted(spark, duck, name):
    same(spark, duck, sources.QUERIES[name], ENVELOPES + WHOLE[name], "/root/testdata/sf0.001")


def test_wrapped_envelopes_on_a_small_session(spark, tmp_path):
    wrap = lambda x, n=1: x if not n else json.dumps(wrap(x, n - 1))
    query, answer = json.dumps({"type": "query", "id": "q1", "query": {"goal": "a \"b\" é", "max_frames": 3}, "extra": 1}), json.dumps({"type": "frames", "id": "q1"})
    stray = json.dumps({"type": "error", "id": "q9"})
    payloads = [wrap(query), answer, wrap(stray, 2), '"text"', wrap("{cut"), wrap(query)[:-9], "  ", None, f" {wrap(answer)} ", '"a","b"']
    spark.createDataFrame([(i, "c", p) for i, p in enumerate(payloads)], "msg_id long, conn_id string, payload string").write.parquet(f"{tmp_path}/wire_messages.parquet")
    got = {n: sorted(map(tuple, sources.QUERIES[n](spark, str(tmp_path)).collect()), key=str) for n in ("envelope_types", *WHOLE, "envelope_unknown_members")}
    assert got["envelope_types"] == sorted([("query", 1), ("frames", 2), ("error", 1), (None, 4)], key=str)
    assert got["envelope_queries"] == [(0, "q1", 'a "b" é', 3, None)] and got["correlation_echo"] == [(2, "q9")]
    assert got["envelope_unknown_members"] == [(0, "extra"), (1, ""), (2, ""), (8, "")]


def test_flat_tables_have_every_member(spark, tmp_path):
    frames = [{"id": "f0", "score": 0.5, "content_ref": {"uri": "u"}, "relations": [{"rel": "r"}], "provenance": {"uri": "v", "note": "n"}}, None, {"id": 7, "extra": True, "provenance": [None, {"digest": "d"}]}]
    payload = json.dumps({"result": {"frames": frames}})
    spark.createDataFrame([(1, payload), (1, payload), (2, json.dumps(payload)), (3, "{cut"), (4, None)], "msg_id long, payload string").write.parquet(f"{tmp_path}/wire_messages.parquet")
    got = general.p3_wire_frame_members(spark, str(tmp_path)).orderBy("msg_id", "frame_pos").collect()
    assert [(r.msg_id, r.frame_pos, r.id, r.score, r["content_ref.uri"], r.relations, r.extra) for r in got] == [
        (m, *x) for m in (1, 2) for x in ((0, "f0", "0.5", "u", '[{"rel":"r"}]', None), (1, None, None, None, None, None), (2, "7", None, None, None, "true"))
    ]
    links = general.p3_wire_link_members(spark, str(tmp_path)).where("msg_id = 2 AND coalesce(uri, note, digest) IS NOT NULL").orderBy("frame_pos", "child_pos").collect()
    assert [(r.frame_pos, r.child_pos, r.uri, r.note, r.digest) for r in links] == [(0, 0, "v", "n", None), (2, 1, None, None, "d")]
