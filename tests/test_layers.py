"""Artifacts, registry, conformance, records, vocabularies and streams on small cases."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions import expr as X
from spanforge.functions import vocabulary as V
from spanforge.operators import artifacts as A
from spanforge.operators import audit, conformance, ingest, journal, records, registry, retrieve, scan, symbols
from spanforge.sources import ndjson
from spanforge.streaming import journal as S


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# vocabularies


@pytest.mark.parametrize("code, reaction, retry", [("unavailable", "retry_with_backoff", True), ("shutting_down", "respawn", True), ("bad_request", "do_not_retry", False), ("vendor:x", "report_and_count", False), (None, "report_and_count", False)])
def test_reactions(spark, code, reaction, retry):
    c = F.lit(code).cast("string")
    assert (one(spark, V.reaction(c)), one(spark, V.is_retryable(c)), one(spark, V.error_code(c))) == (reaction, retry, code or "internal")


def test_words_of_vocabularies(spark):
    scopes = [(s, one(spark, V.scope_class(F.lit(s))), one(spark, X.is_scope(F.lit(s)))) for s in ("local-only", "third-party-index", "acme:store", ":x", "x:", "plain")]
    assert scopes == [("local-only", "local-only", True), ("third-party-index", "third-party-index", True), ("acme:store", "custom", True), (":x", "custom", False), ("x:", "custom", False), ("plain", "custom", False)]
    assert [one(spark, V.outcome_label(F.lit(x))) for x in ("frames", "budget_lie", "needs_receipts", "timeout")] == ["frames", "dropped_budget_lie", "consent_scope_required", "failed"]
    assert one(spark, V.summary(F.lit(2), F.lit(41), F.lit(100))) == "Retrieved 2 context frame(s), 41/100 budget tokens."
    assert [one(spark, V.fingerprints_match(F.lit(a), F.lit(b))) for a, b in (("m/3/x", "m/3/x"), ("", ""), ("m/3/x", "m/4/x"), (None, None))] == [True, False, False, False]
    assert [one(spark, V.stale_digest(F.lit(d))) for d in ("sha256:a0", "sha256:af")] == ["sha256:a1", "sha256:a0"]
    block = one(spark, X.render(F.lit("p"), F.lit("f"), F.lit("doc"), F.lit("in"), F.lit("text </frame> out")))
    assert [one(spark, V.fenced_between(F.lit(block), n)) for n in ("out", 'cite="in', "absent")] == [True, False, False]
    flow = one(spark, V.data_flow(F.lit(True), F.lit("org-tenant")))
    assert (flow.egress, flow.egress_scopes) == (True, ["org-tenant"]) and one(spark, V.data_flow(F.lit(False), F.lit("x"))).egress_scopes == ["local-only"]


def test_terms_of_a_grep(spark):
    assert one(spark, X.grep_terms(F.lit("Zeta ÄRGER b12 zeta ab"), F.lit("goal"))) == ["b12", "zeta", "ärger"]
    assert one(spark, X.grep_terms(F.lit(None).cast("string"), F.lit("The goal"))) == ["goal", "the"] and one(spark, X.grep_terms(F.lit(None).cast("string"), F.lit(None).cast("string"))) == []


# lines and symbols


def test_lines_end_at_line_feeds_only(spark):
    texts = ["a\x0cb\x0bc d\x85e", "a\r\nb\rc\n", "", "\n", "x\r", "a\r\r\nb", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in scan.lines(df).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {0: [texts[0]], 1: ["a", "b\rc"], 3: [""], 4: ["x\r"], 5: ["a\r", "b"]}
    assert [ingest.text_lines(t) for t in texts] == [got.get(i, []) for i in range(len(texts))]


def test_definitions_imports_and_calls(spark):
    code = "pub(crate) async fn run(x) {\n    rerun(1);\n}\n  pub use a::b ;;\nuse  c::{d};\nfn alone() {}\ndef no(x)\nlet y = alone;\nstruct Großes;\nfn run(y) {}\nuse ;"
    df = spark.createDataFrame([(1, code), (2, "fn once(){ once() }")], "doc_id long, text string")
    assert [(r.line_no, r.keyword, r.name) for r in scan.definitions(df).where("doc_id = 1").orderBy("line_no").collect()] == [(1, "fn", "run"), (6, "fn", "alone"), (9, "struct", "Großes"), (10, "fn", "run")]
    assert [(r.line_no, r.name) for r in scan.imports(df).orderBy("line_no").collect()] == [(4, "a::b"), (5, "c::{d}")]
    assert [(r.doc_id, r.name) for r in scan.calls(df).collect()] == [(1, "run")]
    assert {r.doc_id: r.summary for r in symbols.graph_summaries(df).collect()} == {1: "defines run, alone, Großes, run; imports a::b, c::{d}; calls run", 2: "defines once"}
    kinds = spark.createDataFrame([(m,) for m in ("application/pdf", "text/rust", "image/svg+xml", "text/x-c", "text/plain", None, "TEXT/X-C")], "m string").select(symbols.kind_for("m").alias("k")).collect()
    assert [r.k for r in kinds] == ["snippet", "snippet", "doc", "snippet", "doc", "doc", "doc"]


def test_a_line_too_long_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(ndjson, "MAX_LINE", 40)
    rows = spark.createDataFrame([(1, '{"type": "query", "id": "é"}'), (2, '{"type": "query", "id": "' + "é" * 20 + '"}'), (3, "{cut")], "n long, line string")
    got = {r.n: (r.type, r.broken) for r in ndjson.parsed(rows, "line", ndjson.ENVELOPE).collect()}
    assert got == {1: ("query", None), 2: (None, "line of more than 40 bytes"), 3: (None, "{cut")}


# consent and attribution


def test_consent(spark):
    p = spark.createDataFrame([("local", False, ["local-only"]), ("flag", True, None), ("agreed", True, []), ("revoked", True, []), ("scoped", True, ["org-tenant", "a:b"]), ("granted", False, ["org-tenant"])], "provider_id string, egress boolean, egress_scopes array<string>")
    receipts = spark.createDataFrame([("scoped", "org-tenant"), ("granted", "org-tenant")], "provider_id string, scope string")
    log = spark.createDataFrame([("agreed", 1, True, "2026-01-01T00:00:00Z"), ("revoked", 1, True, None), ("revoked", 2, False, None), ("scoped", 1, True, None)], "provider_id string, ord int, granted boolean, granted_at string")
    got = {r.provider_id: (r.decision, r.missing) for r in audit.consent(p, receipts, audit.latest_records(log).where("granted")).collect()}
    assert got == {"local": ("permitted", []), "flag": ("needs_consent", []), "agreed": ("permitted", []), "revoked": ("needs_consent", []), "scoped": ("needs_receipts", ["a:b"]), "granted": ("permitted", [])}


# artifacts

LOG = "\n".join(f"2026-07-20T18:00:{i:02d}Z INFO step {i} of the job is done and written" for i in range(40))
PASTE = f"src/main.rs\n\n{LOG}\n\nA note in prose.\n\nsrc/lib.rs\n\n{LOG}\n\nsrc/main.rs"


def test_a_paste_as_a_provider(spark):
    df = spark.createDataFrame([(1, PASTE, ["given", "src/lib.rs"]), (2, None, None), (3, " \n", None)], "doc_id long, text string, given array<string>")
    report = A.segments(df).orderBy("block").collect()
    assert [(r.kind, r.outcome) for r in report] == [("path", "anchor"), ("log", "frame"), ("prose", "frame"), ("path", "anchor"), ("log", "duplicate"), ("path", "anchor")]
    assert report[1].id == report[4].id and report[1].summary.startswith("log · 40 lines · ") and report[1].inline_tokens < report[1].source_tokens and report[0].summary == "anchor · src/main.rs"
    assert {r.doc_id: r.anchors for r in A.anchors(df, "given").collect()} == {1: ["given", "src/lib.rs", "src/main.rs"], 2: [], 3: []}
    a = A.artifacts(df)
    told = A.capabilities(a).collect()
    assert [(r.doc_id, r.kinds, r.artifacts) for r in told] == [(1, ["doc", "episode"], 2)] and told[0].default_budget == sum(r.inline_tokens for r in report[1:3])
    frames = {(r.kind, r.representation): r for r in A.as_frames(a.withColumn("representation", F.explode(F.array(*map(F.lit, A.REPRESENTATIONS))))).collect()}
    full, compact, reference = (frames["episode", x] for x in A.REPRESENTATIONS)
    assert full.content == LOG and full.content_digest == compact.canonical_content_hash == reference.canonical_content_hash and full.content_ref is None and full.transform is None
    assert compact.content_digest != full.content_digest and compact.canonical_token_cost == full.token_cost > compact.token_cost and compact.transform.method == "extractive_summary" and compact.content_fidelity == "summarized"
    assert (reference.content, reference.token_cost, reference.content_digest, reference.content_fidelity) == (None, 0, None, "omitted") and reference.content_ref.uri == f"context://prompt-ingest/artifacts/{full.content_digest}"
    assert (full.valid_from, full.valid_to) == ("2026-07-20T18:00:00Z", "2026-07-20T18:00:39Z") and full.provenance[0].method == "paste" and round(full.score, 3) == 0.8
    assert frames["doc", "compact"].transform.method == "verbatim" and frames["doc", "compact"].content_digest == frames["doc", "full"].content_digest


def test_answers_of_a_paste(spark):
    a = A.artifacts(spark.createDataFrame([(1, PASTE)], "doc_id long, text string")).cache()
    cost = {r.frame_kind: (r.full_tokens, r.inline_tokens) for r in a.collect()}
    schema = "query_id long, doc_id long, kinds array<string>, max_frames long, max_tokens long, representation_preferences array<string>"
    asked = [(1, 1, [], 9, None, ["compact"]), (2, 1, ["doc"], 9, None, []), (3, 1, [], 1, None, ["reference"]), (4, 1, [], 9, cost["doc"][0], ["odd"]), (5, 1, ["graph"], 9, 9, [])]
    got = {}
    for r in A.answers(a, spark.createDataFrame(asked, schema)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.representation, r.token_cost, r.keep))
    assert got == {1: [("compact", cost["episode"][1], True), ("compact", cost["doc"][1], True)], 2: [("full", cost["doc"][0], True)], 3: [("reference", 0, True), ("reference", 0, False)], 4: [("full", cost["episode"][0], False), ("full", cost["doc"][0], True)]}


def test_a_trace_is_one_instant(spark):
    text = "2026-07-20T18:00:01Z Traceback (most recent call last)\n  File \"a.py\", line 1\n  File \"b.py\", line 2\nValueError: no"
    assert [(b[1], b[8], b[9]) for b in ingest.blocks(text)] == [("trace", "2026-07-20T18:00:01Z", "2026-07-20T18:00:01Z")]


# registry and scenarios


def test_registry(spark):
    r = registry.Registry(spark)
    queries = conformance.probe_query(spark, (2, 10)).unionByName(spark.createDataFrame([(2, "g", None, ["fact"], [], 8, 100, None)], conformance.probe_query(spark).schema))
    r.register("long", lambda s, q: q.select("query_id", F.explode(F.split(F.lit("1,2,3,4,5"), ",")).alias("frame_id"), F.lit("x" * 20).alias("content")), kinds=["doc"])
    r.register("lacks", lambda s, q: q.select("query_id"), kinds=["doc"])
    r.register("gone", lambda s, q: 1 / 0)
    none = spark.createDataFrame([], "provider_id string, scope string")
    assert r.remove("gone") and not r.remove("gone")
    r.register("away", lambda s, q: 1 / 0, egress=True)
    frames, legs = r.ask_all(queries, none, none)
    assert sorted(map(tuple, legs.select("query_id", "provider_id", "outcome").collect())) == [(1, "away", "needs_consent"), (1, "lacks", "failed"), (1, "long", "frames")]
    assert [(x.frame_id, x.token_cost, x.content_digest == one(spark, X.digest_of(F.lit("x" * 20)))) for x in frames.orderBy("frame_id").collect()] == [("1", 5, True), ("2", 5, True)]
    assert r.ask("long", queries).count() == 2
    with pytest.raises(ValueError, match="lack frame_id, content"):
        r.ask("lacks", queries)


def test_scenarios_notice_a_host_that_does_wrong(spark, monkeypatch):
    assert {r.status for r in conformance.host_scenarios(spark).collect()} == {"pass"}
    monkeypatch.setattr(audit, "accepted", lambda offers: offers)
    monkeypatch.setattr(X, "same_family", lambda a, b: F.lit(True))
    assert {r.scenario for r in conformance.host_scenarios(spark).where("status = 'fail'").collect()} == {"quarantine", "version_reject"}


def test_built_frames(spark):
    rows = spark.createDataFrame([(1, "f", "abc", "file:///x", "L1")], "query_id long, frame_id string, content string, uri string, range string")
    f = registry.file_frames(rows, "me").first()
    assert (f.token_cost, f.content_digest, f.provenance[0].digest, f.provenance[0].range, f.relations) == (1, f.provenance[0].digest, f.content_digest, "L1", [])
    assert registry.derived_frames(rows.drop("range"), "summary", "me").first().provenance[0].digest is None
    ref = registry.reference_frames(registry.full_frames(rows.drop("range")), "uri").first()
    assert (ref.content, ref.token_cost, ref.content_digest, ref.content_ref.uri, ref.canonical_content_hash) == (None, 0, None, "file:///x", f.content_digest)
    assert conformance.flooded(registry.full_frames(rows.drop("range")).withColumn("frame_no", F.lit(1).cast("long"))).select("frame_no").distinct().count() == 64


# records


def test_rules_of_records(spark):
    good = '{"record_kind": "directive", "directive_kind": "constraint", "constraint_effect": "forbid", "statement": "s", "origin": "derived", "provenance": {"derivation_kind": "inference"}, "observed_at": "2026-07-01T00:00:00Z", "schema_version": "lifecycle/1.0-draft", "record_hash": "sha256:%s", "confidence": 0.5}' % ("a" * 64)
    texts = [good, good.replace('"forbid"', "null"), good.replace("derivation_kind", "x"), good.replace('"derived"', '"observed"'), good.replace("0.5", "1.5"), good.replace("a" * 64, "A"), good.replace("1.0-draft", "2"), good.replace("07-01T", "02-30T"), good.replace('"statement": "s", ', ""), good.replace('"directive"', '"wish"'), "no json", None]
    df = spark.createDataFrame([(i, "u", None, t) for i, t in enumerate(texts)], "doc_id long, uri string, loaded_at timestamp, text string")
    got = {r.doc_id: r.p for r in records.embedded(df).select("doc_id", records.problems().alias("p")).collect()}
    assert got == {0: [], 1: ["constraint without effect"], 2: ["derived without derivation"], 3: ["derivation of what is not derived"], 4: ["bad confidence"], 5: ["bad record hash"], 6: ["schema version"], 7: ["bad instant"], 8: ["body lacks a member"], 9: ["unknown kind"]}


def test_commands(spark):
    schema = "authority_id string, client_id string, operation string, idempotency_key string, command_hash string, record_id string, record_hash string"
    ledger = spark.createDataFrame([("a", "c", "append", "k1", "h1", "r1", "x", None), ("a", "c", "append", "k2", "h2", "r2", "y", "2026-01-01T00:00:00Z")], schema + ", expires_at string")
    cases = [("k1", "h1", "r1", "x", "duplicate"), ("k1", "h9", "r1", "x", "idempotency_conflict"), ("k2", "h2", "r2", "y", "idempotency_expired"), ("k3", "h3", "r1", "z", "record_identity_conflict"), ("k3", "h3", "r1", "x", "accepted"), ("k4", "h4", "r9", "z", "accepted"), (None, "h1", None, None, "accepted")]
    got = records.append_commands(spark.createDataFrame([("a", "c", "append", *c[:4]) for c in cases], schema), ledger, "2026-07-01T00:00:00Z").collect()
    assert sorted((r.idempotency_key or "", r.command_hash, r.record_hash or "", r.status) for r in got) == sorted((k or "", h, d or "", s) for k, h, _, d, s in cases)
    gate = records.retention_gate(spark.createDataFrame([(1, "long"), (2, "short"), (3, None)], "n long, requested_retention string"), ["short"])
    assert {r.n: r.status for r in gate.collect()} == {1: "retention_rejected", 2: None, 3: None}
    hashes = spark.createDataFrame([("h", "a", None), ("h", "a", ""), ("h", "b", None)], "record_hash string, requested_retention string, options string").select(records.command_hash().alias("c")).collect()
    assert hashes[0] == hashes[1] != hashes[2]


def test_reading_records(spark):
    kept = spark.createDataFrame([("r1", "u1", None), ("r2", None, None), ("r3", "u2", None)], "record_id string, user_id string, task_id string")
    asked = spark.createDataFrame([(x,) for x in ("r1", "r2", "r3", "r4")], "record_id string")
    assert {r.record_id: r.status for r in records.get(asked, kept, {"user_id": "u1"}, ["user_id", "task_id"]).collect()} == {"r1": "found", "r2": "found", "r3": "scope_denied", "r4": "not_found"}
    rows = spark.createDataFrame([("a/net/x.rs", "rust"), ("a/net/deep/y.rs", "rust"), ("b.rs", "rust"), (None, "rust"), ("a/net/x.py", "python")], "path string, lang string")
    known = {"path": "path", "language": "lang"}
    assert sorted(r.path for r in records.filtered(rows, {"path": "a/net/**", "language": "rust"}, known).collect()) == ["a/net/deep/y.rs", "a/net/x.rs"]
    assert [r.path for r in records.filtered(rows, {"path": "a/net/*.rs"}, known).collect()] == ["a/net/x.rs"]
    with pytest.raises(ValueError, match="bad_request"):
        records.filtered(rows, {"size": "1"}, known)
    assert records.filtered(rows, {"size": "1"}, known, "ignore").count() == 5
    signed = spark.createDataFrame([("h", "k1", "2026-02-01T00:00:00Z"), ("h", "k1", "2027-02-01T00:00:00Z"), ("h", "k9", "2026-02-01T00:00:00Z"), ("x", "k1", None)], "signed_record_hash string, key_id string, issued_at string")
    keys = spark.createDataFrame([("k1", "2026-01-01T00:00:00Z", "2027-01-01T00:00:00Z")], "key_id string, valid_from string, valid_to string")
    got = records.attested(spark.createDataFrame([("r1", "h"), ("r2", "none")], "record_id string, record_hash string"), signed, keys).collect()
    assert {r.record_id: (r.attestations, r.valid) for r in got} == {"r1": (3, 2), "r2": (0, 0)}


# journals


def test_open_turns():
    assert journal.open_after(["turn_start", "turn_end", "turn_start"], [1, 1, 2]) == (2, {1: 2}, False, None)
    assert journal.open_after(["turn_start", "turn_start", "resume", "turn_end"], [1, 2, None, 2]) == (None, {2: None}, True, None)
    assert journal.open_after(["turn_end", "turn_start", "turn_end"], [5, 6, 5]) == (None if False else 6, {5: 6}, False, None)
    assert journal.open_after([], []) == (None, {}, False, None)


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_blocks_do_not_change_what_a_row_knows(spark, block):
    rows = [("s", i, e, t, None, None, None) for i, (e, t) in enumerate([("session_start", None), ("turn_start", 1), ("prompt_assembled", 1), ("turn_start", 2), ("turn_end", 1), ("resume", None), ("turn_start", 1), ("verify_observed", 2), ("turn_end", 1), ("session_end", 1)], 1)]
    df = spark.createDataFrame(rows, "session string, seq long, event string, turn long, tool_calls array<string>, call_id string, outcome string")
    got = sorted((r.seq, r.problem) for r in journal.turn_loop(df, block).collect())
    assert got == [(4, "turn started inside a turn"), (7, "turn does not increase"), (8, "event of another turn"), (10, "session_end carries a turn")]
    seen = journal.with_before(df.select("session", "seq", "turn"), block, last=("last", "turn"), most=("max", "seq"), n=("sum", "1")).orderBy("seq").collect()
    assert [(r.last, r.most, r.n) for r in seen] == [(t, i or None, i) for i, t in enumerate([None, None, 1, 1, 2, 1, 1, 1, 2, 1])]


# streams


def test_streams_of_several_files(spark, tmp_path):
    path, kinds = str(tmp_path / "notices.parquet"), "provider_id string, frame_ids array<string>, reason string, scope string, granted_at string"
    for n, row in enumerate([("p", ["a", "b"], "changed", "s", "2"), ("p", ["a"], "changed", "s", "1"), (None, None, None, None, None)]):
        spark.createDataFrame([row], kinds).write.mode("append").parquet(path)
    stream = S.stream_parquet(spark, path, spark.read.parquet(path).schema, 1)
    assert [tuple(r) for r in S.drain(spark, S.receipt_log(stream), "update", "t", ["provider_id", "scope"]).collect()] == [("p", "s", 2, "1", "2")]
    held = spark.createDataFrame([("p", "a", "d"), ("p", "a", "d"), ("q", "b", "e")], "provider_id string, frame_id string, content_digest string")
    assert [tuple(r) for r in S.drain(spark, S.invalidated(stream, held), "append", "t").collect()] == [("p", "a", "d", "changed")] * 2


# graph


def test_neighbors(spark):
    rel = lambda *to: [("code.calls", t, None) for t in to]
    rows = [(1, "a", rel("b")), (2, "b", rel("c", None)), (3, "c", rel("d")), (4, "d", None), (5, "x", [("doc.documents", "a", None)]), (6, None, rel("e")), (7, "e", rel("e", "a")), (8, "far", [])]
    frames = spark.createDataFrame(rows, f"frame_no long, uri string, relations {registry.RELATIONS}")
    starts = spark.createDataFrame([(1, "a"), (1, "a"), (2, "nowhere"), (3, "d")], "query_id long, uri string")
    hops = lambda depth, rels=None: {(r.query_id, r.frame_no): r.hops for r in retrieve.neighbors(frames, starts, depth, rels).collect()}
    assert hops(1) == {(1, 1): 1, (1, 5): 1, (1, 7): 1, (3, 4): 1, (3, 3): 1}
    assert hops(2) == hops(1) | {(1, 2): 2, (1, 6): 2, (3, 2): 2}
    assert hops(1, ["doc.documents"]) == {(1, 1): 1, (1, 5): 1, (3, 4): 1}
    assert hops(5)[1, 4] == 4 and (1, 8) not in hops(5)
