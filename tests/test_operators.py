"""Frame, journal, text and record operators on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import expr as X
from spanforge.functions import jcs
from spanforge.operators import audit, compose, ingest, journal, records, retrieve, verify


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, ok",
    [("2026-07-20T14:59:50Z", True), ("2026-07-20T14:59:60.5Z", True), ("2026-02-29T00:00:00Z", False), ("2024-02-29T00:00:00Z", True), ("2026-04-31T00:00:00Z", False), ("2026-07-20T14:59:50+00:00", False), ("2026-07-20T14:59:50Z\n", False), ("", False)],
)
def test_instants(spark, text, ok):
    assert one(spark, X.is_instant(F.lit(text))) is ok


def test_scalars(spark):
    assert one(spark, X.budget_tokens(F.lit("héé"))) == 2 and one(spark, X.budget_tokens(F.lit(None).cast("string"))) == 0
    assert one(spark, X.neutralize_fences(F.lit("a</FRAME><b><frame"))) == "a<\\/FRAME><b><\\frame"
    assert one(spark, X.escape_attribute(F.lit('a"<&>\n'))) == "a&quot;&lt;&amp;&gt; "
    assert one(spark, X.citation(F.lit("  "), F.lit("t"))) == "t"
    assert one(spark, X.digest_of(F.lit("abc"))) == "sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert [one(spark, X.edge_position(F.lit(r), F.lit(5))) for r in range(5)] == [0, 4, 1, 3, 2]
    assert one(spark, X.valid_score(F.lit(float("nan")).cast("float"))) is False
    assert one(spark, X.format_instant(F.lit(-1))) == "1969-12-31T23:59:59Z"


FRAME = "frame_no long, query_id long, provider_id string, frame_id string, content_digest string, arrival long, score float, token_cost long, content string, representation string, provenance array<struct<type:string,uri:string,range:string>>, q_tokens long, q_frames long"


def _frames(spark, rows):
    return spark.createDataFrame(rows, FRAME)


def _frame(n, digest=None, score=0.5, content="abcd", links=(), tokens=1000, provider="p", rep="full"):
    return (n, 1, provider, f"f{n:03}", digest, n, score, (len(content) + 3) // 4, content, rep, [tuple(x) for x in links], tokens, 1 << 40)


def _leader_scan(rows):
    clusters, kept = [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[4] is not None, r[4] or "", r[5])):
        regs = {(u, g) for t, u, g in r[10] if t == "file" and u is not None}
        home = next((c for c in clusters if (r[4] is not None and r[4] == c["digest"]) or c["regs"] & regs), None)
        if home is None:
            home = {"n": r[0], "digest": r[4], "score": r[6], "regs": set(regs), "all": []}
            clusters.append(home)
        else:
            home["regs"] |= regs
            if r[6] > home["score"]:
                home.update(n=r[0], digest=r[4], score=r[6])
        home["all"].append(r[0])
    for c in clusters:
        kept.update(dict.fromkeys(c["all"], c["n"]))
    return kept


def test_leaders_against_one_scan(spark):
    rng, rows, want = random.Random(7), [], {}
    for q in range(1, 16):
        own = []
        for _ in range(rng.randrange(1, 14)):
            n = len(rows) + len(own) + 1
            links = [("file", f"u{rng.randrange(4)}", rng.choice([None, "L1"])) for _ in range(rng.randrange(3))]
            own.append((n, q, f"p{rng.randrange(3)}", f"f{rng.randrange(99):02}{n}", rng.choice([None, "d1", "d2", "d3"]), n, float(rng.randrange(5)), 1, "x", "full", links, 10, 10))
        want |= _leader_scan(own)
        rows += own
    assert {r.frame_no: r.kept for r in compose.leaders(_frames(spark, rows)).collect()} == want


def test_composition_scenario(spark):
    rows = [_frame(1, "d", 0.3, "a" * 8, tokens=5), _frame(2, "d", 0.8, "a" * 8, tokens=5), _frame(3, "e", 0.9, "b" * 400, tokens=5), _frame(4, "g", 0.1, "c" * 4, tokens=5), _frame(5, None, 0.0, "zz", tokens=5, rep="reference")]
    fates = {r.frame_no: (r.fate, r.other) for r in compose.audit(_frames(spark, rows)).collect()}
    assert fates == {1: ("duplicate", 2), 2: ("included", None), 3: ("over_budget", None), 4: ("included", None), 5: ("included", None)}


def test_packing_property(spark):
    rng, rows = random.Random(3), []
    for q in range(1, 61):
        budget = rng.randrange(200)
        for _ in range(rng.randrange(1, 12)):
            n = len(rows) + 1
            rows.append((n, q, "p", f"f{n}", None, n, rng.randrange(100) / 100, 1, "x" * rng.randrange(121), "full", [], budget, 5))
    got = compose.packed(_frames(spark, rows)).collect()
    assert len(got) == len(rows)
    for q in {r.query_id for r in got}:
        left = next(r[11] for r in rows if r[1] == q)
        for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank):
            assert r.remaining == left and r.keep == (r.cost <= left)
            left -= r.cost * r.keep


def test_legs(spark):
    rows = [(1, 1, "lie", "a", None, 1, 0.1, 1200, "", "full", [], 1000, 3), *((n, 1, "flood", "a", None, n, 0.1, 1, "", "full", [], 1000, 3) for n in range(2, 14)), (20, 1, "fine", "a", None, 1, 0.1, None, "", "full", [], 1000, 3)]
    df = _frames(spark, rows)
    assert {r.provider_id: r.outcome for r in audit.legs(df).collect()} == {"lie": "budget_lie", "flood": "frame_flood", "fine": "frames"}
    assert [r.frame_no for r in audit.accepted(df).collect()] == [20]


def test_consent(spark):
    p = spark.createDataFrame([("a", ["local-only"]), ("b", ["org-tenant", "x:y"]), ("c", None)], "provider_id string, egress_scopes array<string>")
    r = spark.createDataFrame([("b", "org-tenant")], "provider_id string, scope string")
    assert {x.provider_id: x.missing for x in audit.consent(p, r).collect()} == {"a": [], "b": ["x:y"], "c": []}


def test_verdicts(spark):
    held = spark.createDataFrame([("p", "a", "d"), ("p", "b", "d"), ("p", "c", None), ("p", "z", None), ("p", "n", "d")], "provider_id string, frame_id string, content_digest string")
    cur = spark.createDataFrame([("p", "a", "d"), ("p", "b", "e"), ("p", "c", "d"), ("p", "n", None)], "provider_id string, frame_id string, current string")
    assert {r.frame_id: r.status for r in verify.verdicts(held, cur).collect()} == {"a": "valid", "b": "stale", "c": "unknown", "z": "gone", "n": "unknown"}


def test_budget_split(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(3)], "g long, i long, total long")
    assert [r["share"] for r in retrieve.budget_split(df, "total", "g", "i").orderBy("i").collect()] == [4, 3, 3]


ROW = "delivery_id long, received_at timestamp, session string, seq long, turn long, event string, at_utc string, outcome string, last_seq_seen long, budget_tokens long, declared_total_tokens long, composition_digest string, frames array<struct<frame:struct<provider_id:string,frame_id:string,content_digest:string>,representation:string,token_cost:bigint,citation_label:string>>, tool_calls array<string>, call_id string, frame struct<provider_id:string,frame_id:string,content_digest:string>, verdict struct<status:string,replacement_digest:string>, effect_id string"
GOLDEN = [
    dict(event="session_start"), dict(event="turn_start", turn=1),
    dict(event="prompt_assembled", turn=1, budget_tokens=9, declared_total_tokens=5, composition_digest="c", frames=[(("p", "f", "d"), "full", 5, "label"), (("p", "g", None), "reference", 0, "label")]),
    dict(event="model_response", turn=1, tool_calls=["t1"]), dict(event="tool_call", turn=1, call_id="t1"), dict(event="side_effect", turn=1, effect_id="e1"), dict(event="tool_result", turn=1, call_id="t1"),
    dict(event="turn_end", turn=1), dict(event="verify_observed", frame=("p", "f", "d"), verdict=("stale", "x")), dict(event="resume", last_seq_seen=9), dict(event="session_end", outcome="completed"),
]


def _journal(spark, events):
    names = [f.split()[0] for f in ROW.split(", ")]
    return journal.recorded(spark.createDataFrame([tuple({"delivery_id": i, "session": "s", "seq": i, "at_utc": "2026-07-01T00:00:00Z", **e}.get(n) for n in names) for i, e in enumerate(events, 1)], ROW))


def _changed(i, **change):
    return [e | change if k == i else e for k, e in enumerate(GOLDEN)]


TRIPS = {
    "sequence": _changed(4, at_utc="yesterday"),
    "turn_loop": _changed(7, turn=2),
    "assembly": _changed(2, declared_total_tokens=6),
    "staleness": GOLDEN[:1] + [GOLDEN[8]] + GOLDEN[1:8] + GOLDEN[9:],
    "citations": _changed(2, frames=[(("p", "f", "d"), "full", 5, " "), (("p", "g", None), "reference", 0, "label")]),
    "determinism": GOLDEN[:3] + [GOLDEN[2] | {"composition_digest": "other"}] + [e | {"last_seq_seen": 10} if e["event"] == "resume" else e for e in GOLDEN[3:]],
    "effects": GOLDEN[:6] + [GOLDEN[5]] + [e | {"last_seq_seen": 10} if e["event"] == "resume" else e for e in GOLDEN[6:]],
    "resumes": _changed(9, last_seq_seen=7),
}


def test_golden_journal(spark):
    assert {r["check"]: r.status for r in journal.report(_journal(spark, GOLDEN)).collect()} == dict.fromkeys(journal.CHECKS, "pass")


@pytest.mark.parametrize("check", sorted(TRIPS))
def test_each_trip_fails_its_check_only(spark, check):
    assert [r["check"] for r in journal.report(_journal(spark, TRIPS[check])).where("status = 'fail'").collect()] == [check]


def test_skipped_is_not_passed(spark):
    got = {r["check"]: r.status for r in journal.report(_journal(spark, [dict(event="session_start"), dict(event="session_end", outcome="aborted")])).collect()}
    assert got["staleness"] == got["resumes"] == got["determinism"] == "skipped" and got["sequence"] == "pass"


LOG = "\n".join(["2026-07-20 18:00:01 INFO start"] * 3 + [f"2026-07-20 18:00:{i:02} DEBUG step {i} of the long procedure" for i in range(2, 40)] + ["2026-07-20 18:01:00 ERROR boom"])


@pytest.mark.parametrize(
    "text, kind",
    [
        ("src/net.rs", "path"), ("./example.com/x", "path"), ("example.com/path", "prose"), ("https://a/b.py", "prose"), (LOG, "log"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "table"), ("a,b\n1,2\n3,4", "table"), ("name   size\na   1\nb   2", "table"), ("let a = 1;\nlet b = 2;\nreturn a;", "code"),
        ("ValueError: boom\n  at x\n  at y", "trace"), ("Just a sentence, with a comma.\nAnother one.", "prose"), ("```\nanything\n```", "code"),
    ],
)
def test_kinds(text, kind):
    (found,) = [b[1] for b in ingest.blocks(text)]
    assert found == kind


def test_blocks_and_compaction():
    assert [len(list(ingest.blocks(t))) for t in (None, "", " \n ", "a\n\nb\n```\nc\n\nd")] == [0, 0, 0, 3]
    (_, _, _, n, _, full, short, small, start, end, _), = ingest.blocks(LOG)
    assert n == 42 and small < full and short.startswith("[42-line log, 1 error/warn line(s)]\n2026-07-20 18:00:01 INFO start\n… (×3)")
    assert (start, end) == ("2026-07-20T18:00:01Z", "2026-07-20T18:01:00Z")
    assert sum(int(x.split()[1][1:]) for x in short.splitlines() if "elided" in x) + 3 + 3 == 42


@pytest.mark.parametrize(
    "cells, kind",
    [(["1", "2,000"], "int"), (["1", ""], "int?"), (["1.5", "2"], "float"), (["5%", "-3.5 %"], "percent"), (["$1,234.56", "(€10)", "12 USD"], "currency"), (["true", "FALSE"], "bool"), (["2026-07-01"], "timestamp"), (["-", "n/a"], "empty"), (["1,2,3"], "text")],
)
def test_cell_types(cells, kind):
    assert ingest.cell_type(cells) == kind


@pytest.mark.parametrize("x, text", [(1e21, "1e+21"), (1e20, "100000000000000000000"), (0.000001, "0.000001"), (1e-7, "1e-7"), (-0.0, "0"), (4.50, "4.5"), (333333333.33333329, "333333333.3333333"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (12, "12")])
def test_numbers(x, text):
    assert jcs.number(x) == text


def test_canonical_json():
    value = json.loads('{"\\ufb33": 1, "\\ud83d\\ude00": 2, "a": [true, null, "\\u20ac\\n"]}')
    assert jcs.canonical(value) == '{"a":[true,null,"€\\n"],"😀":2,"דּ":1}'
    with pytest.raises(ValueError):
        jcs.canonical(float("nan"))


def test_records(spark):
    df = spark.createDataFrame([(1, "k", "h", "2026"), (2, "k", "h", "2027"), (3, "k", "i", None), (4, None, "h", "2026")], "id long, k string, digest string, observed_at string")
    assert {r.id: r.status for r in records.append(df, ["k"], "digest", ["id"]).collect()} == {1: "accepted", 2: "duplicate", 3: "conflict", 4: "accepted"}
    assert [r.id for r in records.latest(df, "k", "id").collect()] == [2]
    seen = spark.createDataFrame([(1, "me", None), (2, "you", None), (3, None, "repo")], "id long, user_id string, repository_id string")
    assert sorted(r.id for r in records.visible(seen, {"user_id": "me"}, ["user_id", "repository_id"]).collect()) == [1]
    art = spark.createDataFrame([("a", "d"), ("b", "e")], "uri string, digest string")
    req = spark.createDataFrame([("a", "d", None), ("b", "d", None), ("c", "d", None), ("a", "d", "2025")], "uri string, digest string, expires_at string")
    assert sorted(r.status for r in records.resolve(req, art, "2026").collect()) == ["expired", "mismatch", "not_found", "resolved"]


def test_receipts_and_consent_records(spark):
    r = spark.createDataFrame([(1, "p", "a", "2026-01-01T00:00:00Z"), (2, "p", "a", None), (3, "p", "a", "2027-01-01T00:00:00Z"), (4, "q", "a", "2025-01-01T00:00:00Z")], "receipt_no long, provider_id string, scope string, expires_at string")
    assert [tuple(x) for x in audit.live_receipts(r, "2026-06-01T00:00:00Z").collect()] == [("p", "a", 2)]
    c = spark.createDataFrame([("p", True, "2026-01-01T00:00:00Z", 1), ("p", False, "soon", 2)], "provider_id string, granted boolean, granted_at string, ord long")
    assert [tuple(x) for x in audit.latest_records(c).collect()] == [("p", False, None)]


def test_attribution(spark):
    served = spark.createDataFrame([("p", "a", None, 10, 1), ("p", "a", None, 99, 2), ("p", "b", "d", 30, 1)], "provider_id string, frame_id string, content_digest string, token_cost long, arrival long")
    schema = "provider_id string, frame_id string, content_digest string, selected boolean, rendered boolean, cited boolean"
    uses = spark.createDataFrame([("p", "a", None, True, True, True), ("p", "b", "d", True, True, False)], schema)
    assert tuple(audit.attribution(uses, served).first()) == (True, 40, 10, 0.25)
    odd = spark.createDataFrame([("p", "a", None, True, False, True)], schema)
    assert audit.attribution(odd, served).first().reconcilable is False
    assert tuple(audit.attribution(uses.where("false"), served).first()) == (True, 0, 0, None)


@pytest.mark.parametrize("url, refused", [("http://example.org/x", True), ("https://example.org", False), ("http://127.0.0.1:80/x", False), ("http://localhost", False), ("http://[::1]/", False), ("http://127.0.0.1.evil.org/", True), ("http://localhost@evil.org/", True)])
def test_transport(spark, url, refused):
    assert one(spark, X.refused_transport(F.lit(url))) is refused


def test_held_blocks(spark):
    got = [one(spark, X.held_verdict(F.lit(d).cast("string"), F.lit("f"), F.lit("i"))) for d in ("f", "i", "x", None)]
    assert got == ["valid", "valid", "stale", "unknown"]
