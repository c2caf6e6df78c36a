"""Queries of sources, and of checks by provider."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import expr as X
from spanforge.functions import vocabulary as V
from spanforge.operators import audit, compose, ingest, quality, retrieve, symbols
from spanforge.plans.frames import _ACC, _BASE, _COST, _F, _FATES, _LEGS, _O, _OFF, _P, _PACK, _frames, _offers, _providers
from spanforge.plans.streams import _BROKEN
from spanforge.plans.texts import _BLOCKS, _DEF, _LINES, _USE
from spanforge.sources import files, ndjson
from spanforge.sources.tables import materialise, table


def _wire(spark, d):
    """Each line once; an envelope inside a JSON string counts as that envelope."""
    return table(spark, d, "wire_messages").dropDuplicates(["msg_id"]).select("msg_id", "conn_id", ndjson.unwrapped("payload").alias("payload"))


def envelope_types(spark, d):
    """Lines of stdio sessions by type; broken ones apart."""
    wire = _wire(spark, d)
    return ndjson.parsed(wire, "payload", ndjson.ENVELOPE).groupBy(F.when(F.col("broken").isNull(), F.col("type")).alias("type")).agg(F.count("*").alias("lines"))


def envelope_queries(spark, d):
    wire = _wire(spark, d)
    return ndjson.parsed(wire, "payload", ndjson.ENVELOPE).where("broken IS NULL AND type = 'query'").select("msg_id", "id", "query.goal", "query.max_frames", "query.max_tokens")


def envelope_unknown_members(spark, d):
    wire = _wire(spark, d).where(r"regexp_replace(payload, '^\\s+|\\s+$', '') LIKE '{%}'")
    known = ["type", "id", "protocol_version", "provider", "capabilities", "query", "result", "request", "response", "code", "message"]
    return ndjson.unknown_members(wire, "payload", known).select("msg_id", F.array_join("unknown", ",").alias("unknown"))


def correlation_echo(spark, d):
    """Answers whose id no query of their connection had."""
    wire = _wire(spark, d)
    rows = ndjson.parsed(wire, "payload", ndjson.ENVELOPE).where("broken IS NULL AND id IS NOT NULL")
    asked = rows.where("type = 'query'").select("conn_id", "id").distinct()
    return rows.where("type IN ('frames', 'error')").join(asked, ["conn_id", "id"], "left_anti").select("msg_id", "id")


def file_uris(spark, d):
    return _frames(spark, d).select("frame_no", files.file_path("uri").alias("path"))


def provenance_check(spark, d):
    """Links of frames into documents, which stand for the files: re-hashed, whole or by range."""
    links = _frames(spark, d).select("frame_no", F.posexplode("provenance").alias("pos", "p")).where("p IS NOT NULL").select("frame_no", "pos", "p.type", "p.uri", "p.range", "p.digest")
    docs = table(spark, d, "documents").where("uri IS NOT NULL").groupBy("uri").agg(F.min_by("text", "doc_id").alias("text"))
    return files.provenance_status(links, docs).groupBy("status").agg(F.count("*").alias("links"))


def symbol_frames(spark, d):
    return symbols.symbol_frames(table(spark, d, "documents"))


def graph_summaries(spark, d):
    return symbols.graph_summaries(table(spark, d, "documents"))


def graph_edges(spark, d):
    return symbols.graph_edges(table(spark, d, "documents"))


def grep_frames(spark, d):
    """What a grep provider finds in the texts for the words of the first query."""
    first = table(spark, d, "queries").where("query_id IS NOT NULL").orderBy("query_id").limit(1).select(X.grep_terms("query_text", "goal")).first()
    return symbols.grep_frames(table(spark, d, "documents"), first[0] if first else [])


def resource_frames(spark, d):
    docs = table(spark, d, "documents").where("uri IS NOT NULL AND text IS NOT NULL")
    media = F.when(F.col("uri").endswith(".rs"), "text/rust").when(F.col("uri").endswith(".json"), "application/json").when(F.col("uri").endswith(".svg"), "image/svg+xml").when(F.col("uri").endswith(".py"), "text/x-script").otherwise("text/plain")
    return symbols.resource_frames(docs.select("doc_id", "uri", F.col("citation_label").alias("title"), "text", media.alias("media_type"))).drop("content")


def prompt_costs(spark, d):
    """Per query: tokens of the packed prompt and how much of the budget they take."""
    pack = compose.packed(_offers(spark, d)).where("keep").groupBy("query_id").agg(F.sum("cost").alias("tokens"), F.count("*").alias("frames"))
    return pack.select("query_id", "tokens", "frames")


def tool_results(spark, d):
    """One JSON document per query: the frames of its prompt with their members and citations, what each leg came to, and the budget. Bounded by the query's budget and providers."""
    offers = _offers(spark, d)
    member = _frames(spark, d).select("frame_no", "provider_id", F.col("frame_id").alias("id"), "kind", "title", "content", "uri", "score", "token_cost", X.citation("citation_label", "title").alias("citation_label"), "provenance")
    kept = compose.placed(compose.packed(audit.accepted(offers))).join(member, "frame_no")
    frames = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", *(c for c in member.columns if c != "frame_no")))).alias("frames"))
    outcome = F.struct("provider_id", V.outcome_label("outcome").alias("outcome"), "tokens")
    legs = audit.legs(offers).groupBy("query_id").agg(F.array_sort(F.collect_list(outcome)).alias("legs"))
    budget = audit.usage(offers).join(offers.groupBy("query_id").agg(F.max("q_tokens").alias("q_tokens")), "query_id")
    asked = F.struct(F.when(F.col("q_tokens") < retrieve.UNLIMITED, F.col("q_tokens")).alias("budget_requested"), F.col("tokens_consumed").alias("budget_consumed"), "frames_served", "frames_rejected").alias("budget_audit")
    return legs.join(budget, "query_id").join(frames, "query_id", "left").select("query_id", F.to_json(F.struct("frames", "legs", asked)).alias("result"))


def global_budget(spark, d):
    """Each query's budget split over its providers, and every leg held to its part."""
    offers = _offers(spark, d)
    legs = retrieve.budget_split(offers.where("q_tokens < 4611686018427387904").select("query_id", "q_tokens", "provider_id").distinct(), "q_tokens", "query_id", "provider_id")
    spent = offers.groupBy("query_id", "provider_id").agg(F.sum(F.coalesce("token_cost", F.lit(0))).alias("tokens"))
    return legs.join(spent.withColumnRenamed("provider_id", "p"), [legs.query_id == spent.query_id, legs.provider_id.eqNullSafe(F.col("p"))]).select(legs.query_id, "provider_id", F.col("share").cast("long").alias("share"), "tokens", (F.col("tokens") <= F.col("share")).alias("within"))


def served_representations(spark, d):
    """Blocks of pasted text as each representation is billed: full, compact where there is one, reference for nothing."""
    b = ingest.ingest(table(spark, d, "documents")).where("kind <> 'path'")
    return b.groupBy("kind").agg(F.sum("tokens").alias("full"), F.sum(F.coalesce("compact_tokens", "tokens")).alias("compact"), F.lit(0).cast("long").alias("reference"), F.count_if(F.col("compact").isNotNull()).alias("shortened"))


def provider_checks(spark, d):
    """(provider_id, check, status): rules over a provider's frames and its own declaration; nothing served is skipped, not passed.

    'kinds' fails on frames of a kind that the provider does not declare or that their query did not ask for, 'as_of' on frames that
    were not yet valid at the instant of their query.
    """
    p = _providers(spark, d)
    broken = quality.frame_problems(_frames(spark, d)).groupBy("provider_id").agg(F.count_if(F.col("rule") != "cost").alias("invalid"))
    served = _frames(spark, d).groupBy("provider_id").agg(F.count("*").alias("frames"), F.count_if(F.col("token_cost") != X.budget_tokens("content")).alias("dishonest"))
    legs = audit.legs(_offers(spark, d)).groupBy("provider_id").agg(F.count_if(F.col("outcome") != "frames").alias("bad_legs"))
    off = X.off_machine("egress_scopes")
    asked = _offers(spark, d).groupBy("provider_id").agg(F.count_if(F.size("q_kinds") > 0).alias("narrowed"), F.count_if(~retrieve.asked_kind()).alias("unasked"), F.count_if(F.col("q_as_of").isNotNull()).alias("pinned"), F.count_if(~F.expr(retrieve.VALID_AS_OF)).alias("early"))
    declared = F.coalesce(F.size("kinds"), F.lit(0)) > 0
    undeclared = _frames(spark, d).join(p.select("provider_id", "kinds"), "provider_id").groupBy("provider_id").agg(F.count_if(~retrieve.asked_kind("kinds")).alias("undeclared"))
    rows = p
    for found in (served, broken, legs, asked, undeclared):
        rows = rows.join(found, "provider_id", "left")
    state = lambda bad: F.when(F.col("frames").isNull(), "skipped").when(F.coalesce(bad, F.lit(False)), "fail").otherwise("pass")
    checks = {
        "frame_validity": state(F.col("invalid") > 0),
        "cost_honesty": state(F.col("dishonest") > 0),
        "budget": state(F.col("bad_legs") > 0),
        "scopes": F.when((F.size(off) > 0) & ~F.coalesce("egress", F.lit(False)), "fail").otherwise("pass"),
        "kinds": F.when(declared | (F.coalesce("narrowed", F.lit(0)) > 0), state((F.col("undeclared") > 0) | (F.col("unasked") > 0))).otherwise("skipped"),
        "as_of": F.when(F.col("pinned") > 0, state(F.col("early") > 0)).otherwise("skipped"),
    }
    return rows.select("provider_id", F.explode(F.create_map(*(x for k, v in checks.items() for x in (F.lit(k), v)))).alias("check", "status"))


def composition_checks(spark, d):
    """(check, failures) over all queries: bound by the budget, every frame accounted for once, no frame of a rejected leg."""
    offers = _offers(spark, d)
    ok = audit.accepted(offers)
    fates = materialise(compose.audit(ok), "fates")
    over = compose.packed(ok).where("keep").groupBy("query_id").agg(F.sum("cost").alias("used")).join(offers.select("query_id", "q_tokens").distinct(), "query_id").where("used > q_tokens")
    times = fates.groupBy("query_id", "frame_no").agg(F.count("*").alias("n"))
    lost = ok.select("query_id", "frame_no", F.lit(1).alias("one")).join(times, ["query_id", "frame_no"], "full").where("NOT coalesce(one = 1 AND n = 1, false)")
    bad = fates.join(offers.join(audit.legs(offers).where("outcome <> 'frames'"), ["query_id", "provider_id"], "left_semi").select("query_id", "frame_no"), ["query_id", "frame_no"], "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias("failures")).withColumn("check", F.lit(name))
    return one(over, "budget").unionByName(one(lost, "partition")).unionByName(one(bad, "quarantine")).select("check", "failures")


QUERIES = {
    f.__name__: f
    for f in (
        envelope_types, envelope_queries, envelope_unknown_members, correlation_echo, file_uris, provenance_check, symbol_frames, graph_summaries, graph_edges, grep_frames, resource_frames, prompt_costs,
        tool_results, global_budget, served_representations, provider_checks, composition_checks,
    )
}

_M = "m AS (SELECT * FROM wire_messages QUALIFY row_number() OVER (PARTITION BY msg_id) = 1)"
_J = f"{_M}, j AS (SELECT msg_id, conn_id, CASE WHEN NOT json_valid(payload) THEN NULL WHEN json_type(payload) <> 'VARCHAR' THEN CAST(payload AS JSON) WHEN json_valid(payload ->> '$') THEN CAST(payload ->> '$' AS JSON) END AS j FROM m WHERE trim(regexp_replace(payload, '\\s', ' ', 'g'), ' ') <> '')"

SQL = {
    "envelope_types": f"WITH {_J} SELECT j ->> '$.type' AS type, count(*) AS lines FROM j GROUP BY 1",
    "envelope_queries": f"WITH {_J} SELECT msg_id, j ->> '$.id' AS id, j ->> '$.query.goal' AS goal, try_cast(j ->> '$.query.max_frames' AS BIGINT) AS max_frames, try_cast(j ->> '$.query.max_tokens' AS BIGINT) AS max_tokens FROM j WHERE j ->> '$.type' = 'query'",
    "envelope_unknown_members": f"""WITH {_M}, u AS (SELECT msg_id, CASE WHEN json_valid(payload) AND json_type(payload) = 'VARCHAR' THEN payload ->> '$' ELSE payload END AS p FROM m)
SELECT msg_id, CASE WHEN json_valid(p) THEN array_to_string(list_sort(list_filter(json_keys(p), lambda k: k NOT IN ('type', 'id', 'protocol_version', 'provider', 'capabilities', 'query', 'result', 'request', 'response', 'code', 'message'))), ',') ELSE '' END AS unknown
FROM u WHERE regexp_replace(p, '^\\s+|\\s+$', '', 'g') LIKE '{{%}}'""",
    "correlation_echo": f"WITH {_J}, r AS (SELECT msg_id, conn_id, j ->> '$.id' AS id, j ->> '$.type' AS type FROM j WHERE j ->> '$.id' IS NOT NULL) SELECT msg_id, id FROM r WHERE type IN ('frames', 'error') AND NOT EXISTS (SELECT 1 FROM r a WHERE a.type = 'query' AND a.conn_id = r.conn_id AND a.id = r.id)",
    "file_uris": f"WITH {_F} SELECT frame_no, CASE WHEN regexp_matches(uri, '^file://(localhost)?/') THEN url_decode(replace(regexp_extract(uri, '^file://(?:localhost)?(/.*)$', 1), '+', '%2B')) END AS path FROM f",
    "grep_frames": f"""WITH {_LINES}, q1 AS (SELECT list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce(query_text, goal), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3), lambda w: lower(w)))) AS ts FROM queries WHERE query_id IS NOT NULL ORDER BY query_id LIMIT 1),
h AS (SELECT doc_id, line_no, raw, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS rank FROM l, q1 WHERE len(list_filter(ts, lambda t: contains(lower(line), t))) > 0)
SELECT doc_id, line_no, 'rg:' || doc_id || '#L' || line_no AS frame_id, doc_id || ' L' || line_no AS title, raw AS content, 'sha256:' || sha256(raw) AS content_digest, ((strlen(raw) + 3) // 4)::BIGINT AS token_cost, least(greatest((0.95::FLOAT - 0.03::FLOAT * rank::FLOAT)::FLOAT, 0.05::FLOAT), 1::FLOAT) AS score FROM h""",
    "served_representations": _BLOCKS + "SELECT kind, sum(tokens)::BIGINT AS \"full\", sum(coalesce(compact_tokens, tokens))::BIGINT AS compact, 0::BIGINT AS reference, count(compact) AS shortened FROM bk WHERE kind <> 'path' GROUP BY kind",
    "graph_edges": f"""WITH {_LINES}, df AS (SELECT doc_id, line_no, regexp_extract(line, '{_DEF}', 1) AS kw, regexp_extract(line, '{_DEF}', 2) AS name FROM l WHERE regexp_matches(line, '{_DEF}')),
im AS (SELECT doc_id, trim(rtrim(trim(regexp_extract(line, '{_USE}', 1), ' ' || chr(9)), ';'), ' ' || chr(9)) AS name FROM l WHERE regexp_matches(line, '{_USE}'))
SELECT doc_id, 'code.defines' AS rel, 'symbol://' || doc_id || '#' || name AS target_uri, name AS display_name FROM df UNION ALL SELECT doc_id, 'code.imports', 'symbol://' || name, name FROM im WHERE name <> ''
UNION ALL SELECT DISTINCT df.doc_id, 'code.calls', 'symbol://' || df.doc_id || '#' || df.name, df.name FROM df JOIN l ON l.doc_id = df.doc_id AND contains(l.line, df.name || '(') WHERE kw = 'fn' AND l.line_no <> df.line_no""",
    "graph_summaries": f"""WITH {_LINES}, df AS (SELECT doc_id, line_no, regexp_extract(line, '{_DEF}', 1) AS kw, regexp_extract(line, '{_DEF}', 2) AS name FROM l WHERE regexp_matches(line, '{_DEF}')),
im AS (SELECT doc_id, line_no, trim(rtrim(trim(regexp_extract(line, '{_USE}', 1), ' ' || chr(9)), ';'), ' ' || chr(9)) AS name FROM l WHERE regexp_matches(line, '{_USE}')),
ca AS (SELECT df.doc_id, df.name, min(df.line_no) AS line_no FROM df JOIN l ON l.doc_id = df.doc_id AND contains(l.line, df.name || '(') WHERE kw = 'fn' AND l.line_no <> df.line_no GROUP BY ALL),
a AS (SELECT doc_id, 'defines ' || string_agg(name, ', ' ORDER BY line_no, name) AS x FROM df GROUP BY 1), b AS (SELECT doc_id, 'imports ' || string_agg(name, ', ' ORDER BY line_no, name) AS x FROM im WHERE name <> '' GROUP BY 1),
c AS (SELECT doc_id, 'calls ' || string_agg(name, ', ' ORDER BY line_no, name) AS x FROM ca GROUP BY 1)
SELECT doc_id, concat_ws('; ', a.x, b.x, c.x) AS summary FROM a FULL JOIN b USING (doc_id) FULL JOIN c USING (doc_id)""",
    "provenance_check": f"""WITH {_F}, p AS (SELECT frame_no, provenance[i] AS p FROM f, LATERAL (SELECT unnest(range(1, len(provenance) + 1)) AS i)), dt AS (SELECT uri, first(text ORDER BY doc_id) AS text FROM documents WHERE uri IS NOT NULL GROUP BY uri),
ln AS (SELECT uri, text, list_transform(string_split(text, chr(10)), lambda x: x || chr(10)) AS ls FROM dt),
k AS (SELECT p.type AS type, p.digest AS digest, p."range" AS rg, text, ls, try_cast(regexp_extract(p."range", '^L(\\d+)(?:-L?(\\d+))?$', 1) AS INT) AS a, coalesce(try_cast(nullif(regexp_extract(p."range", '^L(\\d+)(?:-L?(\\d+))?$', 2), '') AS INT), try_cast(regexp_extract(p."range", '^L(\\d+)(?:-L?(\\d+))?$', 1) AS INT)) AS b FROM p LEFT JOIN ln ON ln.uri = p.uri WHERE p IS NOT NULL),
h AS (SELECT *, len(ls) - CASE WHEN suffix(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS n FROM k),
t AS (SELECT type, digest, CASE WHEN rg IS NULL THEN text WHEN a >= 1 AND b >= a AND a <= n THEN array_to_string(list_slice(ls, a, b), '') END AS part, NOT suffix(text, chr(10)) AND b >= n AND rg IS NOT NULL AS cut FROM h),
s AS (SELECT CASE WHEN coalesce(type <> 'file', true) THEN 'not_file' WHEN part IS NULL OR digest IS NULL THEN 'unreadable' WHEN 'sha256:' || sha256(CASE WHEN cut THEN left(part, length(part) - 1) ELSE part END) <> digest THEN 'mismatch' ELSE 'verified' END AS status FROM t)
SELECT status, count(*) AS links FROM s GROUP BY 1""",
    "prompt_costs": _PACK + " SELECT query_id, sum(cost)::BIGINT AS tokens, count(*) AS frames FROM g WHERE keep GROUP BY query_id",
    "symbol_frames": f"""WITH {_LINES}, s AS (SELECT doc_id, line_no, raw, regexp_extract(line, '{_DEF}', 1) AS keyword, regexp_extract(line, '{_DEF}', 2) AS name, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS rank FROM l WHERE regexp_matches(line, '{_DEF}'))
SELECT doc_id, line_no, 'sym:' || doc_id || '#' || name AS frame_id, keyword || ' ' || name AS title, raw AS content, 'sha256:' || sha256(raw) AS content_digest, ((strlen(raw) + 3) // 4)::BIGINT AS token_cost, doc_id || ' L' || line_no AS citation_label,
least(greatest((0.9::FLOAT - 0.02::FLOAT * rank::FLOAT)::FLOAT, 0.05::FLOAT), 1::FLOAT) AS score, 'symbol://' || doc_id || '#' || name AS target_uri FROM s""",
    "resource_frames": f"""SELECT 'frm_mcp_' || regexp_replace({_BASE}, '[^A-Za-z0-9]', '_', 'g') AS frame_id, uri, CASE WHEN uri LIKE '%.rs' OR uri LIKE '%.json' OR uri LIKE '%.py' THEN 'snippet' ELSE 'doc' END AS kind, coalesce(nullif(trim(citation_label, ' '), ''), {_BASE}) AS title,
'sha256:' || sha256(text) AS content_digest, ((strlen(text) + 3) // 4)::BIGINT AS token_cost, uri || '#overview' AS overview, CASE WHEN starts_with(uri, 'file://') THEN 2 ELSE 1 END AS links FROM documents WHERE uri IS NOT NULL AND text IS NOT NULL""",
    "provider_checks": f"""{_BROKEN}, {_P}, {_O[len(_F) + 2 :]}, {_LEGS}, i AS (SELECT provider_id, count(*) AS n FROM b WHERE rule <> 'cost' GROUP BY 1), h AS (SELECT provider_id, count(*) AS frames, count(*) FILTER (token_cost <> (strlen(coalesce(content, '')) + 3) // 4) AS dishonest FROM f GROUP BY 1),
g AS (SELECT provider_id, count(*) FILTER (outcome <> 'frames') AS bad FROM legs GROUP BY 1), r AS (SELECT p.*, h.frames, coalesce(i.n, 0) AS invalid, coalesce(h.dishonest, 0) AS dishonest, coalesce(g.bad, 0) AS bad FROM p LEFT JOIN h USING (provider_id) LEFT JOIN i USING (provider_id) LEFT JOIN g USING (provider_id)),
k AS (SELECT p.provider_id, coalesce(len(any_value(p.kinds)), 0) > 0 AS declares, count(f.frame_no) AS n, count(*) FILTER (len(q_kinds) > 0) AS narrowed, count(*) FILTER (q_as_of IS NOT NULL) AS pinned,
count(*) FILTER (f.frame_no IS NOT NULL AND ((len(p.kinds) > 0 AND NOT coalesce(list_contains(p.kinds, kind), false)) OR (len(q_kinds) > 0 AND NOT coalesce(list_contains(q_kinds, kind), false)))) AS off, count(*) FILTER (valid_from > q_as_of) AS early
FROM p LEFT JOIN f USING (provider_id) LEFT JOIN q USING (query_id) GROUP BY p.provider_id)
SELECT provider_id, 'frame_validity' AS "check", CASE WHEN frames IS NULL THEN 'skipped' WHEN invalid > 0 THEN 'fail' ELSE 'pass' END AS status FROM r
UNION ALL SELECT provider_id, 'cost_honesty', CASE WHEN frames IS NULL THEN 'skipped' WHEN dishonest > 0 THEN 'fail' ELSE 'pass' END FROM r
UNION ALL SELECT provider_id, 'budget', CASE WHEN frames IS NULL THEN 'skipped' WHEN bad > 0 THEN 'fail' ELSE 'pass' END FROM r
UNION ALL SELECT provider_id, 'scopes', CASE WHEN len({_OFF}) > 0 AND NOT coalesce(egress, false) THEN 'fail' ELSE 'pass' END FROM r
UNION ALL SELECT provider_id, 'kinds', CASE WHEN n = 0 OR NOT (declares OR narrowed > 0) THEN 'skipped' WHEN off > 0 THEN 'fail' ELSE 'pass' END FROM k
UNION ALL SELECT provider_id, 'as_of', CASE WHEN pinned = 0 THEN 'skipped' WHEN early > 0 THEN 'fail' ELSE 'pass' END FROM k""",
    "global_budget": f"""WITH {_O}, l AS (SELECT query_id, provider_id, any_value(q_tokens) AS q_tokens, sum(coalesce(token_cost, 0))::BIGINT AS tokens FROM o WHERE q_tokens < 4611686018427387904 GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY provider_id NULLS FIRST) - 1 AS i FROM l),
s AS (SELECT query_id, provider_id, tokens, (q_tokens // n + CASE WHEN i < q_tokens % n THEN 1 ELSE 0 END)::BIGINT AS share FROM n) SELECT query_id, provider_id, share, tokens, tokens <= share AS within FROM s""",
}

_ACCEPTED_FATES = _FATES.replace(_O, f"{_O}, {_LEGS}, {_ACC}").replace(" AS i FROM o)", " AS i FROM acc)").replace("FROM o WHERE (query_id", "FROM acc WHERE (query_id")
SQL["composition_checks"] = f"""WITH fx AS MATERIALIZED ({_ACCEPTED_FATES}), {_O}, {_LEGS}, {_ACC}, bu AS (SELECT o.query_id FROM fx JOIN o ON o.query_id = fx.query_id AND o.frame_no = fx.frame_no WHERE fate = 'included' GROUP BY o.query_id HAVING sum(CASE WHEN representation = 'reference' THEN 0 ELSE {_COST} END) > any_value(q_tokens))
SELECT 'budget' AS "check", (SELECT count(*) FROM bu) AS failures
UNION ALL SELECT 'partition', (SELECT count(*) FROM (SELECT query_id, frame_no FROM acc EXCEPT ALL SELECT query_id, frame_no FROM fx)) + (SELECT count(*) FROM (SELECT query_id, frame_no FROM fx EXCEPT ALL SELECT query_id, frame_no FROM acc))
UNION ALL SELECT 'quarantine', (SELECT count(*) FROM fx JOIN o ON o.query_id = fx.query_id AND o.frame_no = fx.frame_no JOIN legs ON legs.query_id = o.query_id AND legs.provider_id = o.provider_id WHERE outcome <> 'frames')"""
