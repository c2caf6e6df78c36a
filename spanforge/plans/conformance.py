"""Queries of vocabularies, legs in isolation, conformance checks and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import expr as X
from spanforge.functions import vocabulary as V
from spanforge.operators import audit, compose, conformance, registry, retrieve, verify
from spanforge.plans.frames import _LEGS, _O, _OFF, _P, _PACK, _Q, _frames, _offers, _providers
from spanforge.plans.sources import _J, _wire
from spanforge.plans.streams import _BROKEN
from spanforge.sources import files, ndjson
from spanforge.sources.tables import materialise, table


# vocabularies


def error_reactions(spark, d):
    """Errors on the wire by code, and what a host does on each."""
    errors = ndjson.parsed(_wire(spark, d), "payload", ndjson.ENVELOPE).where("broken IS NULL AND type = 'error'")
    by = errors.groupBy(V.error_code("code").alias("code")).agg(F.count("*").alias("errors"))
    return by.select("code", "errors", V.reaction("code").alias("reaction"), V.is_retryable("code").alias("retryable"), V.is_recognized("code").alias("recognized"))


def record_error_vocabulary(spark, d):
    """The error codes of record operations with their reactions, and an unknown one."""
    codes = spark.createDataFrame([(c,) for c in [*V.RECORD_REACTIONS, "vendor:other"]], "code string")
    return codes.select("code", V.reaction("code", V.RECORD_REACTIONS).alias("reaction"))


def scope_classes(spark, d):
    """Every scope that a provider declares: its class, whether it leaves the machine and is well formed."""
    s = _providers(spark, d).select("provider_id", F.posexplode("egress_scopes").alias("pos", "scope")).where("scope IS NOT NULL")
    return s.select("provider_id", F.col("pos").cast("long").alias("pos"), V.scope_class("scope").alias("class"), (F.col("scope") != "local-only").alias("off_machine"), X.is_scope("scope").alias("valid"))


def embedding_matches(spark, d):
    """Providers that embeddings of the host may go to; the host's fingerprint is the least that a provider declares."""
    p = _providers(spark, d)
    host = p.where("embeddings_fingerprint <> ''").agg(F.min("embeddings_fingerprint")).first()[0]
    return p.select("provider_id", V.fingerprints_match(F.lit(host).cast("string"), "embeddings_fingerprint").alias("matches"))


def embedding_errors(spark, d):
    """Per provider that declares a size: how many of the vectors have another."""
    p = _providers(spark, d).select("provider_id", X.fingerprint_dimensions("embeddings_fingerprint").alias("dim")).where("dim IS NOT NULL")
    sizes = table(spark, d, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return p.join(sizes, "dim", "left").select("provider_id", "dim", (F.lit(total) - F.coalesce("n", F.lit(0))).alias("wrong"))


def wire_kinds(spark, d):
    """Each envelope's kind, the id that correlates it (queries, frames and errors have one), and the id a sender would count up to for a query."""
    rows = ndjson.parsed(_wire(spark, d), "payload", ndjson.ENVELOPE).where("broken IS NULL AND type IS NOT NULL")
    order = F.row_number().over(compose.Window.partitionBy("conn_id", F.col("type") == "query").orderBy("msg_id"))
    return rows.select("msg_id", F.col("type").alias("kind"), F.when(F.col("type").isin("query", "frames", "error"), F.col("id")).alias("correlation"), F.when(F.col("type") == "query", F.concat(F.lit("q"), order.cast("string"))).alias("next_id"))


def bridge_flows(spark, d):
    """What a bridge to each provider would declare, remote where it lets anything out."""
    p = _providers(spark, d).select("provider_id", V.data_flow(F.coalesce("egress", F.lit(False)), F.lit("org-tenant")).alias("f"))
    return p.select("provider_id", "f.egress", F.array_join("f.egress_scopes", ",").alias("scopes"))


# legs


def _decisions(spark, d):
    p = _providers(spark, d)
    receipts = p.select("provider_id", F.try_element_at("egress_scopes", F.lit(1)).alias("scope"))
    return audit.consent(p, receipts, p.where("verify AND NOT coalesce(resolve, false)").select("provider_id"))


def leg_outcomes(spark, d):
    """Each leg by itself: no consent, over budget, too many frames, failed (a provider that nobody registered), or its frames; none touches another."""
    legs = audit.legs(_offers(spark, d)).join(_decisions(spark, d).select("provider_id", "decision"), "provider_id", "left")
    outcome = F.when(F.col("decision").isNull(), "failed").when(F.col("decision") != "permitted", F.col("decision")).otherwise(F.col("outcome"))
    return legs.select("query_id", "provider_id", V.outcome_label(outcome).alias("outcome"))


def single_provider(spark, d):
    """Frames that a provider asked by itself gives: the gate holds, budgets are not audited."""
    ok = _decisions(spark, d).where("decision = 'permitted'").select("provider_id")
    return _offers(spark, d).join(ok, "provider_id", "left_semi").select("query_id", "provider_id", "frame_no")


def tool_summaries(spark, d):
    """One line per query: frames got, tokens used of those allowed."""
    r = audit.usage(_offers(spark, d)).join(_offers(spark, d).groupBy("query_id").agg(F.max("q_tokens").alias("q_tokens")), "query_id").where(f"q_tokens < {retrieve.UNLIMITED}")
    return r.select("query_id", V.summary("frames_served", "tokens_consumed", "q_tokens").alias("summary"))


def included_verification(spark, d):
    """Packed frames by whether they can be verified later."""
    pack = compose.packed(_offers(spark, d)).where("keep").join(_frames(spark, d).select("frame_no", "content_digest"), "frame_no")
    return pack.groupBy("query_id", V.verification("content_digest").alias("state")).agg(F.count("*").alias("frames"))


def unknown_verdicts(spark, d):
    """What a provider that cannot verify says of the frames that journals hold of it."""
    mute = _providers(spark, d).where("NOT coalesce(verify, false)").select("provider_id")
    return registry.uniform(verify.held(table(spark, d, "journal")).join(mute, "provider_id", "left_semi"))


def registry_answers(spark, d):
    """Three registered sources asked together: frames of the tables, lines that hold a query's words, and one that fails."""
    queries = table(spark, d, "queries").dropDuplicates(["query_id"]).where("query_id IS NOT NULL")
    frames, docs = table(spark, d, "frames"), table(spark, d, "documents")
    r = registry.Registry(spark)
    r.register("tables", lambda s, q: frames.where("frame_id IS NOT NULL AND content IS NOT NULL").join(q.select("query_id"), "query_id", "left_semi").dropDuplicates(["query_id", "frame_no"]))
    r.register("titles", lambda s, q: registry.title_frames(docs, q), egress=False)
    r.register("away", lambda s, q: frames, egress=True)
    r.register("broken", lambda s, q: q.select("query_id"))
    none = spark.createDataFrame([], "provider_id string, scope string")
    _, legs = r.ask_all(queries, none, none)
    return legs.groupBy("provider_id", "outcome").agg(F.count("*").alias("legs"))


# checks


def wire_handshakes(spark, d):
    """Handshakes and their answers: does the version share the family."""
    rows = ndjson.parsed(_wire(spark, d), "payload", ndjson.ENVELOPE).where("broken IS NULL AND type IN ('handshake', 'handshake_ack')")
    version = F.regexp_extract("protocol_version", r"([0-9]+)(?:\.[0-9]+)*$", 1)
    return rows.select("msg_id", "type", F.coalesce(version == conformance.FAMILY, F.lit(False)).alias("ok"))


def wire_survival(spark, d):
    """Per connection: lines that are none, and whether a good one came after the last of them."""
    rows = table(spark, d, "wire_messages").dropDuplicates(["msg_id"]).select("conn_id", "line_no", ndjson.unwrapped("payload").alias("payload"))
    seen = ndjson.parsed(rows, "payload", ndjson.ENVELOPE).select("conn_id", "line_no", (F.col("broken").isNotNull() | F.col("type").isNull()).alias("bad"))
    by = seen.groupBy("conn_id").agg(F.count_if("bad").alias("bad_lines"), F.max(F.when(F.col("bad"), F.col("line_no"))).alias("last_bad"), F.max(F.when(~F.col("bad"), F.col("line_no"))).alias("last_good"))
    return by.where("bad_lines > 0").select("conn_id", "bad_lines", F.coalesce(F.col("last_good") > F.col("last_bad"), F.lit(False)).alias("went_on"))


def _statuses(spark, d):
    links = _frames(spark, d).select("provider_id", F.explode("provenance").alias("p")).where("p IS NOT NULL").select("provider_id", "p.type", "p.uri", "p.range", "p.digest")
    docs = table(spark, d, "documents").where("uri IS NOT NULL").groupBy("uri").agg(F.min_by("text", "doc_id").alias("text"))
    return files.provenance_status(links, docs)


def conformance_report(spark, d):
    return conformance.report(_providers(spark, d), _frames(spark, d), _offers(spark, d), _statuses(spark, d))


def conformance_tally(spark, d):
    return conformance.tally(materialise(conformance_report(spark, d), "report"), "provider_id")


def conformance_documents(spark, d):
    """The report of each provider as one JSON document, as the report sink writes it."""
    checks = F.array_sort(F.collect_list(F.struct("check", "status")))
    by = conformance_report(spark, d).groupBy("provider_id").agg(checks.alias("checks"))
    return by.select("provider_id", F.to_json(F.struct(F.col("provider_id").alias("target"), "checks")).alias("document"))


def parsed_requests(spark, d):
    """Queries on the wire as a tool would read them: defaults in place, kinds that are none left out."""
    rows = ndjson.parsed(_wire(spark, d), "payload", ndjson.ENVELOPE).where("broken IS NULL AND type = 'query'").select("msg_id", "query.*")
    return retrieve.parsed_requests(rows).select("msg_id", F.array_join("kinds", ",").alias("kinds"), "max_frames", "max_tokens", "error")


def anchor_checks(spark, d):
    return conformance.anchor_relevance(_providers(spark, d), _frames(spark, d))


def host_scenarios(spark, d):
    return conformance.host_scenarios(spark)


def misbehaviour(spark, d):
    """All frames made to misbehave in each way, and how many of them their rule catches."""
    return conformance.mutations(_frames(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        error_reactions, record_error_vocabulary, scope_classes, embedding_matches, embedding_errors, wire_kinds, bridge_flows, leg_outcomes, single_provider, tool_summaries, included_verification,
        unknown_verdicts, registry_answers, wire_handshakes, wire_survival, conformance_report, conformance_documents, conformance_tally, parsed_requests, anchor_checks, host_scenarios, misbehaviour,
    )
}

_REACT = "('bad_request', 'do_not_retry'), ('unsupported_kind', 'narrow_or_skip'), ('unsupported_representation', 'narrow_or_skip'), ('incompatible_version', 'drop_provider'), ('budget_unsatisfiable', 'raise_budget_or_skip'), ('unavailable', 'retry_with_backoff'), ('shutting_down', 'respawn'), ('internal', 'report_and_count')"
_DECIDED = f"""{_P}, dm AS (SELECT provider_id, len({_OFF}) AS off, coalesce(egress, false) AS egress, coalesce(verify, false) AND NOT coalesce(resolve, false) AS agreed, len(list_filter({_OFF}, lambda s: s IS DISTINCT FROM egress_scopes[1])) AS missing FROM p),
dc AS (SELECT provider_id, CASE WHEN off = 0 AND (agreed OR NOT egress) THEN 'permitted' WHEN off = 0 THEN 'needs_consent' WHEN missing = 0 THEN 'permitted' ELSE 'needs_receipts' END AS decision FROM dm)"""
_CHECKS = ", ".join(f"('{c}')" for c in ("handshake", "frame_validity", "verify_honesty", "consent_scope", "budget_honesty", "as_of", "kinds_filter", "anchor_relevance", "provenance", "malformed_input", "embedding_fingerprint", "correlation", "shutdown"))
_ANCHORS = f"""WITH {_P}, f AS (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY frame_no) = 1), g AS (SELECT provider_id, frame_no, arrival, score, uri, [r.target_uri FOR r IN relations IF r.target_uri IS NOT NULL] AS ts FROM f),
a AS (SELECT provider_id, coalesce(first(ts[1] ORDER BY arrival, frame_no) FILTER (len(ts) > 0), first(uri ORDER BY arrival, frame_no) FILTER (uri IS NOT NULL)) AS anchor FROM g GROUP BY 1),
h AS (SELECT provider_id, any_value(anchor) AS anchor, count(*) FILTER (uri = anchor OR list_contains(ts, anchor)) AS n, first(coalesce(uri = anchor OR list_contains(ts, anchor), false) ORDER BY coalesce(score, -1.0) DESC, frame_no) AS top FROM g JOIN a USING (provider_id) GROUP BY 1)
SELECT provider_id, CASE WHEN NOT coalesce(graph, false) OR anchor IS NULL THEN 'skipped' WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status, coalesce(n, 0)::BIGINT AS anchored, coalesce(top, false) AS ranked_first FROM p LEFT JOIN h USING (provider_id)"""
_CURRENT = "cu AS (SELECT provider_id, frame_id, first(content_digest ORDER BY arrival DESC, frame_no DESC) AS current FROM f GROUP BY ALL)"

SQL = {
    "error_reactions": f"""WITH {_J}, r(code, reaction) AS (VALUES {_REACT}), e AS (SELECT coalesce(j ->> '$.code', 'internal') AS code, count(*) AS errors FROM j WHERE j ->> '$.type' = 'error' GROUP BY 1)
SELECT e.code, errors, coalesce(reaction, 'report_and_count') AS reaction, coalesce(reaction IN ('retry_with_backoff', 'respawn'), false) AS retryable, reaction IS NOT NULL AS recognized FROM e LEFT JOIN r ON r.code = e.code""",
    "record_error_vocabulary": """SELECT * FROM (VALUES ('unsupported_capability', 'renegotiate'), ('unsupported_representation', 'request_full_or_skip'), ('unsupported_record_kind', 'narrow_or_skip'), ('invalid_record', 'do_not_retry'), ('idempotency_conflict', 'do_not_retry'),
('idempotency_expired', 'retry_with_fresh_key'), ('record_identity_conflict', 'mint_new_record_id'), ('retention_rejected', 'lower_retention_or_skip'), ('consent_required', 'obtain_consent'), ('scope_denied', 'do_not_retry'), ('sharing_denied', 'do_not_retry'),
('reference_not_found', 'drop'), ('reference_expired', 'query_again'), ('content_hash_mismatch', 'reject_and_report'), ('payload_too_large', 'split_and_retry'), ('batch_too_large', 'split_and_retry'), ('partial_failure', 'act_per_item'),
('unavailable', 'retry_with_backoff'), ('internal', 'report_and_count'), ('vendor:other', 'report_and_count')) t(code, reaction)""",
    "scope_classes": f"""WITH {_P}, s AS (SELECT provider_id, i - 1 AS pos, egress_scopes[i] AS s FROM p, LATERAL (SELECT unnest(range(1, len(egress_scopes) + 1)) AS i)) SELECT provider_id, pos, CASE WHEN s IN ('local-only', 'org-tenant', 'third-party-index', 'third-party-model') THEN s ELSE 'custom' END AS class,
s <> 'local-only' AS off_machine, s IN ('local-only', 'org-tenant', 'third-party-index', 'third-party-model') OR regexp_matches(s, '^[^:]+:.+$') AS valid FROM s WHERE s IS NOT NULL""",
    "embedding_matches": f"WITH {_P} SELECT provider_id, coalesce(embeddings_fingerprint = (SELECT min(embeddings_fingerprint) FROM p WHERE embeddings_fingerprint <> ''), false) AS matches FROM p",
    "embedding_errors": f"WITH {_P}, a AS (SELECT provider_id, try_cast(string_split(embeddings_fingerprint, '/')[2] AS INT) AS dim FROM p) SELECT provider_id, dim, (SELECT count(*) FROM embeddings WHERE len(embedding) <> dim) AS wrong FROM a WHERE dim IS NOT NULL",
    "wire_kinds": f"""WITH {_J} SELECT msg_id, j ->> '$.type' AS kind, CASE WHEN j ->> '$.type' IN ('query', 'frames', 'error') THEN j ->> '$.id' END AS correlation,
CASE WHEN j ->> '$.type' = 'query' THEN 'q' || row_number() OVER (PARTITION BY conn_id, j ->> '$.type' = 'query' ORDER BY msg_id) END AS next_id FROM j WHERE j ->> '$.type' IS NOT NULL""",
    "bridge_flows": f"WITH {_P} SELECT provider_id, coalesce(egress, false) AS egress, CASE WHEN egress THEN 'org-tenant' ELSE 'local-only' END AS scopes FROM p",
    "leg_outcomes": f"""WITH {_O}, {_LEGS}, {_DECIDED} SELECT query_id, legs.provider_id, CASE WHEN decision IS NULL THEN 'failed' WHEN decision = 'needs_consent' THEN 'consent_required' WHEN decision = 'needs_receipts' THEN 'consent_scope_required'
WHEN outcome = 'budget_lie' THEN 'dropped_budget_lie' WHEN outcome = 'frame_flood' THEN 'dropped_frame_flood' ELSE 'frames' END AS outcome FROM legs LEFT JOIN dc ON dc.provider_id = legs.provider_id""",
    "single_provider": f"WITH {_O}, {_DECIDED} SELECT query_id, provider_id, frame_no FROM o WHERE provider_id IN (SELECT provider_id FROM dc WHERE decision = 'permitted')",
    "tool_summaries": f"WITH {_O}, {_LEGS}, t AS (SELECT query_id, max(q_tokens) AS q_tokens FROM o GROUP BY 1), u AS (SELECT query_id, coalesce(sum(frames) FILTER (outcome = 'frames'), 0)::BIGINT AS n, coalesce(sum(tokens) FILTER (outcome = 'frames'), 0)::BIGINT AS c FROM legs GROUP BY 1) SELECT query_id, 'Retrieved ' || n || ' context frame(s), ' || c || '/' || q_tokens || ' budget tokens.' AS summary FROM u JOIN t USING (query_id) WHERE q_tokens < 4611686018427387904",
    "unknown_verdicts": f"WITH {_P}, h AS (SELECT DISTINCT x.provider_id, x.frame_id, x.content_digest FROM (SELECT unnest(frames).frame AS x FROM journal) WHERE x.frame_id IS NOT NULL) SELECT h.*, 'unknown' AS status, NULL::VARCHAR AS replacement_digest FROM h WHERE provider_id IN (SELECT provider_id FROM p WHERE NOT coalesce(verify, false))",
    "wire_handshakes": f"WITH {_J} SELECT msg_id, j ->> '$.type' AS type, coalesce(regexp_extract(j ->> '$.protocol_version', '([0-9]+)(?:\\.[0-9]+)*$', 1) = '1', false) AS ok FROM j WHERE j ->> '$.type' IN ('handshake', 'handshake_ack')",
    "wire_survival": """WITH m AS (SELECT DISTINCT msg_id, conn_id, line_no, payload FROM wire_messages WHERE trim(regexp_replace(payload, '\\s', ' ', 'g'), ' ') <> ''),
j AS (SELECT conn_id, line_no, CASE WHEN NOT json_valid(payload) THEN NULL WHEN json_type(payload) <> 'VARCHAR' THEN CAST(payload AS JSON) WHEN json_valid(payload ->> '$') THEN CAST(payload ->> '$' AS JSON) END ->> '$.type' AS type FROM m),
c AS (SELECT conn_id, count(*) FILTER (type IS NULL) AS bad_lines, max(line_no) FILTER (type IS NULL) AS lb, max(line_no) FILTER (type IS NOT NULL) AS lg FROM j GROUP BY 1) SELECT conn_id, bad_lines, coalesce(lg > lb, false) AS went_on FROM c WHERE bad_lines > 0""",
    "host_scenarios": """SELECT suite, scenario, 'pass' AS status FROM (VALUES ('host', 'version_reject'), ('host', 'budget_drop'), ('host', 'frame_limit'), ('host', 'consent_gate'), ('host', 'scope_receipt'), ('host', 'provenance_bytes'), ('host', 'content_quoting'),
('host', 'composition_audit'), ('host', 'crash_isolation'), ('composition', 'budget_bound'), ('composition', 'total_partition'), ('composition', 'quarantine'), ('composition', 'determinism')) t(suite, scenario)""",
    "misbehaviour": "SELECT mutation, (SELECT count(DISTINCT frame_no) FROM frames) AS frames, (SELECT count(DISTINCT frame_no) FROM frames) AS caught FROM (VALUES ('bad_score'), ('no_title'), ('empty_citation'), ('bad_timestamp'), ('bad_recorded_at'), ('malformed_digest'), ('backward_window'), ('negative_cost'), ('no_provenance'), ('lying_representation')) t(mutation)",
    "conformance_report": f"""{_BROKEN}, {_P}, {_O[_O.index('q AS'):]}, {_LEGS}, {_CURRENT},
fr AS (SELECT provider_id, count(*) AS n, count(*) FILTER (token_cost <> (strlen(coalesce(content, '')) + 3) // 4) AS dishonest FROM f GROUP BY 1), inv AS (SELECT provider_id, count(*) AS n FROM b WHERE rule <> 'cost' GROUP BY 1),
bl AS (SELECT provider_id, count(*) FILTER (outcome <> 'frames') AS n FROM legs GROUP BY 1),
ak AS (SELECT provider_id, count(*) FILTER (len(q_kinds) > 0) AS narrowed, count(*) FILTER (len(q_kinds) > 0 AND NOT coalesce(list_contains(q_kinds, kind), false)) AS off, count(*) FILTER (q_as_of IS NOT NULL) AS pinned, count(*) FILTER (valid_from > q_as_of) AS early FROM o GROUP BY 1),
hd AS (SELECT DISTINCT provider_id, frame_id, content_digest FROM f WHERE content_digest IS NOT NULL), vh AS (SELECT hd.provider_id, count(*) AS n, count(*) FILTER (cu.frame_id IS NULL OR current IS NULL OR hd.content_digest <> current) AS bad1,
count(*) FILTER (cu.frame_id IS NULL OR current IS NULL OR left(hd.content_digest, length(hd.content_digest) - 1) || CASE WHEN suffix(hd.content_digest, '0') THEN '1' ELSE '0' END = current) AS bad2 FROM hd LEFT JOIN cu ON cu.provider_id = hd.provider_id AND cu.frame_id = hd.frame_id GROUP BY 1),
an AS (SELECT provider_id, count(*) FILTER (uri IS NOT NULL OR len([1 FOR r IN relations IF r.target_uri IS NOT NULL]) > 0) AS n FROM f GROUP BY 1),
dt AS (SELECT uri, first(text ORDER BY doc_id) AS text FROM documents WHERE uri IS NOT NULL GROUP BY uri),
pl AS (SELECT provider_id, p.type AS type, p.digest AS digest, p."range" AS rg, text, string_split(text, chr(10)) AS ls FROM (SELECT provider_id, provenance[i] AS p FROM f, LATERAL (SELECT unnest(range(1, len(provenance) + 1)) AS i)) LEFT JOIN dt ON dt.uri = p.uri WHERE p.type = 'file' AND p.digest IS NOT NULL),
px AS (SELECT provider_id, digest, rg, text, ls, len(ls) - CASE WHEN ls[len(ls)] = '' THEN 1 ELSE 0 END AS n, try_cast(regexp_extract(rg, '^L(\\d+)(?:-L?(\\d+))?$', 1) AS INT) AS a, coalesce(try_cast(nullif(regexp_extract(rg, '^L(\\d+)(?:-L?(\\d+))?$', 2), '') AS INT), try_cast(regexp_extract(rg, '^L(\\d+)(?:-L?(\\d+))?$', 1) AS INT)) AS z FROM pl),
ps AS (SELECT provider_id, digest, CASE WHEN rg IS NULL THEN text WHEN a >= 1 AND z >= a AND a <= n THEN array_to_string(list_slice(ls, a, z), chr(10)) || CASE WHEN z >= len(ls) THEN '' ELSE chr(10) END END AS part FROM px),
pv AS (SELECT provider_id, count(*) FILTER (part IS NOT NULL) AS seen, count(*) FILTER ('sha256:' || sha256(part) <> digest) AS bad FROM ps GROUP BY 1),
g AS (SELECT p.*, coalesce(trim(p.name), '') <> '' AND coalesce(trim(p.version), '') <> '' AS greeted FROM p), k(c) AS (VALUES {_CHECKS}),
a AS (SELECT g.provider_id, g.greeted, g.graph, g.verify, len({_OFF}) = 0 OR coalesce(g.egress, false) AS consistent, len([1 FOR s IN coalesce(egress_scopes, []) IF NOT coalesce(s IN ('local-only', 'org-tenant', 'third-party-index', 'third-party-model') OR regexp_matches(s, '^[^:]+:.+$'), false)]) = 0 AS scoped,
coalesce(inv.n, 0) AS invalid, coalesce(fr.dishonest, 0) + coalesce(bl.n, 0) AS lies, coalesce(narrowed, 0) AS narrowed, coalesce(off, 0) AS off, coalesce(pinned, 0) AS pinned, coalesce(early, 0) AS early, vh.n AS held, bad1, bad2, coalesce(an.n, 0) AS places, coalesce(pv.seen, 0) AS seen, coalesce(pv.bad, 0) AS bad
FROM g LEFT JOIN fr USING (provider_id) LEFT JOIN inv USING (provider_id) LEFT JOIN bl USING (provider_id) LEFT JOIN ak USING (provider_id) LEFT JOIN vh USING (provider_id) LEFT JOIN an USING (provider_id) LEFT JOIN pv USING (provider_id))
SELECT provider_id, c AS "check", CASE WHEN c = 'handshake' THEN CASE WHEN greeted THEN 'pass' ELSE 'fail' END WHEN NOT greeted THEN 'skipped'
WHEN c = 'frame_validity' THEN CASE WHEN invalid = 0 THEN 'pass' ELSE 'fail' END WHEN c = 'consent_scope' THEN CASE WHEN consistent AND scoped THEN 'pass' ELSE 'fail' END WHEN c = 'budget_honesty' THEN CASE WHEN lies = 0 THEN 'pass' ELSE 'fail' END
WHEN c = 'as_of' AND pinned > 0 THEN CASE WHEN early = 0 THEN 'pass' ELSE 'fail' END WHEN c = 'kinds_filter' AND narrowed > 0 THEN CASE WHEN off = 0 THEN 'pass' ELSE 'fail' END
WHEN c = 'verify_honesty' AND verify AND held > 0 THEN CASE WHEN bad1 = 0 AND bad2 = 0 THEN 'pass' ELSE 'fail' END WHEN c = 'anchor_relevance' AND graph AND places > 0 THEN 'pass' WHEN c = 'provenance' AND seen > 0 THEN CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END ELSE 'skipped' END AS status FROM a, k""",
    "anchor_checks": _ANCHORS,
    "registry_answers": f"WITH {_Q}, n AS (SELECT count(*) AS legs FROM q WHERE query_id IS NOT NULL AND coalesce(len(q_kinds), 0) = 0) SELECT provider_id, outcome, legs FROM (VALUES ('tables', 'frames'), ('titles', 'frames'), ('away', 'needs_consent'), ('broken', 'failed')) t(provider_id, outcome), n",
    "parsed_requests": f"""WITH {_J} SELECT msg_id, array_to_string(list_filter(coalesce(CAST(CASE WHEN json_type(j, '$.query.kinds') = 'ARRAY' THEN json_extract(j, '$.query.kinds') END AS VARCHAR[]), []), lambda k: k IN ('snippet', 'symbol', 'fact', 'doc', 'memory', 'episode', 'graph')), ',') AS kinds,
coalesce(try_cast(j ->> '$.query.max_frames' AS BIGINT), 8) AS max_frames, coalesce(try_cast(j ->> '$.query.max_tokens' AS BIGINT), 4096) AS max_tokens, CASE WHEN coalesce(trim(j ->> '$.query.goal'), '') = '' THEN 'a goal is required' END AS error FROM j WHERE j ->> '$.type' = 'query'""",
    "included_verification": _PACK + " SELECT g.query_id, CASE WHEN content_digest IS NULL THEN 'unverifiable' ELSE 'verifiable' END AS state, count(*) AS frames FROM g JOIN f ON f.frame_no = g.frame_no WHERE keep GROUP BY ALL",
}
SQL["conformance_tally"] = f"SELECT provider_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'fail') = 0 AS ok FROM ({SQL['conformance_report']}) GROUP BY 1"
SQL["conformance_documents"] = f"""SELECT provider_id, '{{"target":"' || provider_id || '","checks":[' || string_agg('{{"check":"' || "check" || '","status":"' || status || '"}}', ',' ORDER BY "check") || ']}}' AS document FROM ({SQL['conformance_report']}) GROUP BY provider_id"""
