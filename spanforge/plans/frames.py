"""Queries of the frame operators: scalar checks, retrieval, audit, composition, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import expr as X
from spanforge.operators import audit, compose, retrieve, verify
from spanforge.sources.tables import table


def _frames(spark, d):
    return table(spark, d, "frames").dropDuplicates(["frame_no"])


def _offers(spark, d):
    return retrieve.offers(table(spark, d, "frames"), table(spark, d, "queries"))


def _providers(spark, d):
    return table(spark, d, "providers").dropDuplicates(["provider_id"])


# scalar functions


def frame_costs(spark, d):
    cost = X.budget_tokens("content")
    return _frames(spark, d).select("frame_no", cost.alias("canonical"), (F.col("token_cost") == cost).alias("honest"), X.budget_from_model_tokens("token_cost", F.lit(1.35)).alias("model_tokens"))


def frame_digests(spark, d):
    return _frames(spark, d).select("frame_no", X.is_digest("content_digest").alias("well_formed"), (F.col("content_digest").isNull() | X.is_digest("content_digest")).alias("usable"), X.digest_of("content").alias("actual"), X.short_hash("content_digest").alias("short"))


def frame_instants(spark, d):
    names = ["valid_from", "valid_to", "recorded_at"]
    bad = F.filter(F.array(*(F.when(F.col(n).isNotNull() & ~X.is_instant(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return _frames(spark, d).select("frame_no", F.array_join(bad, ",").alias("invalid"), F.size(bad).cast("long").alias("n_invalid"))


def journal_instants(spark, d):
    return table(spark, d, "journal").select("delivery_id", X.is_instant("at_utc").alias("ok"))


def frame_scores(spark, d):
    return _frames(spark, d).select("frame_no", X.valid_score("score").alias("valid"))


def frame_citations(spark, d):
    return _frames(spark, d).select("frame_no", X.citation("citation_label", "title").alias("cite"), X.is_blank("title").alias("untitled"))


def frame_fences(spark, d):
    return _frames(spark, d).select("frame_no", X.render("provider_id", "frame_id", "kind", X.citation("citation_label", "title"), F.when(F.col("representation") == "reference", F.lit("")).otherwise(F.col("content"))).alias("block"))


def frame_representation(spark, d):
    return _frames(spark, d).select("frame_no", X.representation_problem("representation", "content", "content_digest", "content_ref").alias("problem"))


def frame_uris(spark, d):
    return _frames(spark, d).select("frame_no", X.basename("uri").alias("base"), X.frame_id_for("uri").alias("derived_id"))


def provenance_digests(spark, d):
    bad = F.expr("filter(transform(coalesce(provenance, array()), (p, i) -> CASE WHEN p.type = 'file' AND coalesce(NOT p.digest RLIKE '\\\\Asha256:[0-9a-f]{64}\\\\z', true) THEN i END), i -> i IS NOT NULL)")
    return _frames(spark, d).select("frame_no", F.array_join(bad.cast("array<string>"), ",").alias("links"), F.size(bad).cast("long").alias("n"))


def relation_edges(spark, d):
    edges = _frames(spark, d).select("frame_no", "uri", F.posexplode("relations").alias("pos", "r")).where("r IS NOT NULL")
    return edges.select("frame_no", "uri", F.col("pos").cast("long").alias("pos"), F.col("r.rel").alias("rel"), F.col("r.target_uri").alias("target_uri"), (~X.is_blank("r.display_name")).alias("named"), (~X.is_blank("r.target_uri")).alias("targeted"), F.coalesce(F.col("r.rel").isin(X.RELATIONS), F.lit(False)).alias("recommended"))


def provider_scopes(spark, d):
    off = X.off_machine("egress_scopes")
    valid = F.forall(F.coalesce("egress_scopes", F.array().cast("array<string>")), lambda s: F.coalesce(X.is_scope(s), F.lit(False)))
    return _providers(spark, d).select("provider_id", F.array_join(off, ",").alias("off_machine"), (valid & ((F.size(off) == 0) | F.coalesce("egress", F.lit(False)))).alias("consistent"), (F.coalesce("egress", F.lit(False)) | (F.size(off) > 0)).alias("needs_consent"))


def provider_fingerprints(spark, d):
    return _providers(spark, d).select("provider_id", X.fingerprint_dimensions("embeddings_fingerprint").alias("dimensions"), (F.coalesce("embeddings_fingerprint", F.lit("")) != "").alias("declared"), X.same_family("version", F.lit("1.0")).alias("same_family"))


def representation_choice(spark, d):
    q = table(spark, d, "queries").dropDuplicates(["query_id"])
    offers = table(spark, d, "frames").dropDuplicates(["frame_no"]).select("query_id", "provider_id").distinct()
    return offers.join(q, "query_id").join(_providers(spark, d), "provider_id").select("query_id", "provider_id", X.first_supported("representation_preferences", "representations").alias("chosen"))


def provider_representations(spark, d):
    """What each provider offers, and whether it can keep to it: compact and reference need a provider that resolves."""
    offered = F.when(F.coalesce(F.size("representations"), F.lit(0)) <= 0, F.array(F.lit("full"))).otherwise(F.col("representations"))
    return _providers(spark, d).select("provider_id", F.array_join(offered, ",").alias("offered"), X.representations_consistent("representations", "resolve").alias("consistent"))


def embedding_dimension_check(spark, d):
    p = _providers(spark, d).select("provider_id", X.fingerprint_dimensions("embeddings_fingerprint").alias("dim")).where("dim IS NOT NULL")
    sizes = table(spark, d, "embeddings").groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("vectors"))
    dims = p.groupBy("dim").agg(F.count("*").alias("providers"))
    return dims.join(sizes, dims.dim == sizes.size, "full").select(F.coalesce("dim", "size").alias("dim"), "providers", "vectors")


# retrieval


def kinds_filter(spark, d):
    return retrieve.of_kind(_offers(spark, d)).select("query_id", "frame_no", "kind")


def as_of_filter(spark, d):
    return retrieve.valid_as_of(_offers(spark, d)).select("query_id", "frame_no", "valid_from")


def anchor_rank(spark, d):
    rows = retrieve.of_kind(_offers(spark, d)).withColumn("anchored", retrieve.anchored(None))
    return retrieve.ranked(rows, [F.desc("anchored"), F.asc("arrival"), F.asc("frame_no")], retrieve.by_arrival(), True).select("query_id", "frame_no", "anchored", "rank")


def lexical_relevance(spark, d):
    return retrieve.scored(_offers(spark, d)).select("query_id", "frame_no", F.round("relevance", 6).alias("relevance"))


def three_key_rank(spark, d):
    rows = _offers(spark, d).withColumn("anchored", retrieve.anchored(None))
    return retrieve.ranked(rows, [F.desc("anchored"), F.desc_nulls_last("score"), F.asc_nulls_last("frame_id"), F.asc("frame_no")], retrieve.by_score(), True).select("query_id", "frame_no", "rank")


def retrieve_prefix_budget(spark, d):
    df = retrieve.valid_as_of(retrieve.of_kind(_offers(spark, d))).withColumn("anchored", retrieve.anchored(None))
    return retrieve.prefix_budget(df, F.desc("anchored"), F.asc("arrival"), F.asc("frame_no"), part=retrieve.by_arrival()).select("query_id", "frame_no", "rank", "running_tokens")


def retrieve_greedy_budget(spark, d):
    df = retrieve.valid_as_of(retrieve.of_kind(_offers(spark, d))).withColumn("anchored", retrieve.anchored(None))
    order = [F.desc("anchored"), F.desc_nulls_last("score"), F.asc_nulls_last("frame_id"), F.asc("frame_no")]
    return retrieve.fold_budget(df, order, "token_cost", []).select("query_id", "frame_no", "rank", "keep", "remaining")


def frame_cap(spark, d):
    return retrieve.ranked(_offers(spark, d), [F.asc("arrival"), F.asc("frame_no")], retrieve.by_arrival()).where("rank <= q_frames").select("query_id", "frame_no", "rank")


def provider_prune(spark, d):
    """Which providers a query goes to: all where it names no kinds, else those that share one. Matched by kind, never as all pairs of rows."""
    return retrieve.relevant_providers(table(spark, d, "queries"), _providers(spark, d))


def budget_split(spark, d):
    legs = _offers(spark, d).where("q_tokens < 4611686018427387904").select("query_id", "q_tokens", "provider_id").distinct()
    return retrieve.budget_split(legs, "q_tokens", "query_id", "provider_id").select("query_id", "provider_id", F.col("share").cast("long").alias("share"))


# audit


def leg_audit(spark, d):
    return audit.legs(_offers(spark, d))


def accepted_frames(spark, d):
    return audit.accepted(_offers(spark, d)).select("query_id", "provider_id", "frame_no")


def usage_report(spark, d):
    return audit.usage(_offers(spark, d))


def usage_consistency(spark, d):
    """Reports against a re-count of the accepted frames, with the tokens of both."""
    again = audit.accepted(_offers(spark, d)).groupBy("query_id").agg(F.sum(F.coalesce("token_cost", F.lit(0))).alias("tokens"), F.count("*").alias("n"))
    r = audit.usage(_offers(spark, d)).join(again, "query_id", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    return r.select("query_id", F.col("tokens_consumed").alias("reported"), F.col("tokens").alias("counted"), ((F.col("tokens") == F.col("tokens_consumed")) & (F.col("n") == F.col("frames_served"))).alias("consistent"))


def dishonest_costs(spark, d):
    bad = _frames(spark, d).where(F.col("token_cost") != X.budget_tokens("content"))
    return bad.groupBy("provider_id").agg(F.count("*").alias("frames"), F.sum("token_cost").alias("declared"), F.sum(X.budget_tokens("content")).alias("canonical"))


def consent_gate(spark, d):
    """The gate before any query. No table has grants, so these are assumed: a receipt for the first scope of each provider, and a consent
    record of each provider that verifies, revoked again for those that also resolve."""
    p = _providers(spark, d)
    receipts = p.select("provider_id", F.try_element_at("egress_scopes", F.lit(1)).alias("scope"))
    given = p.where("verify").select("provider_id", F.lit(1).alias("ord"), F.lit(True).alias("granted"), F.lit("2026-01-01T00:00:00Z").alias("granted_at"))
    revoked = p.where("verify AND resolve").select("provider_id", F.lit(2).alias("ord"), F.lit(False).alias("granted"), F.lit("2026-02-01T00:00:00Z").alias("granted_at"))
    records = audit.latest_records(given.unionByName(revoked)).where("granted")
    return audit.consent(p, receipts, records).select("provider_id", "decision", F.array_join("missing", ",").alias("missing"), (F.col("decision") == "permitted").alias("permitted"))


def attribution_share(spark, d):
    """Per query: tokens rendered and cited of what accepted legs served. Uses are not recorded in the tables; a frame counts as rendered
    where it has content or is none of a reference, and as cited where it is rendered and carries a label of its own."""
    served = audit.accepted(_offers(spark, d))
    rendered = F.coalesce(F.col("representation"), F.lit("full")) != "reference"
    uses = served.select("query_id", *audit.IDENTITY, F.lit(True).alias("selected"), rendered.alias("rendered"), (rendered & ~X.is_blank("citation_label")).alias("cited")).groupBy("query_id", *audit.IDENTITY)
    uses = uses.agg(*(F.bool_or(c).alias(c) for c in ("selected", "rendered", "cited")))
    found = audit.attribution_by(uses, served, "query_id")
    return found.select("query_id", F.col("rendered_tokens").alias("rendered"), F.col("cited_tokens").alias("cited"), F.round("cited_share", 6).alias("share"))


# composition


def dedup_identity(spark, d):
    return compose.by_identity(_offers(spark, d)).select("query_id", "frame_no")


def dedup_leader(spark, d):
    return compose.leaders(_offers(spark, d))


def compose_pack(spark, d):
    return compose.packed(_offers(spark, d)).select("query_id", "frame_no", "rank", "cost", "keep", "remaining")


def edge_placement(spark, d):
    return compose.placed(compose.packed(_offers(spark, d))).select("query_id", "frame_no", "position")


def render_prompt(spark, d):
    """The packed frames of each query as one prompt; bounded by the query's budget."""
    text = _frames(spark, d).select("frame_no", X.render("provider_id", "frame_id", "kind", X.citation("citation_label", "title"), F.when(F.col("representation") == "reference", F.lit("")).otherwise(F.col("content"))).alias("block"))
    body = compose.placed(compose.packed(_offers(spark, d))).join(text, "frame_no")
    return body.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda x: x["block"]), "").alias("prompt"))


def composition_audit(spark, d):
    return compose.audit(_offers(spark, d))


def composition_totals(spark, d):
    """Every offered frame has exactly one fate."""
    fates = compose.audit(_offers(spark, d)).groupBy("query_id").agg(F.count("*").alias("accounted"), F.countDistinct("frame_no").alias("frames"))
    offered = _offers(spark, d).groupBy("query_id").agg(F.count("*").alias("offered"))
    return offered.join(fates, "query_id", "left").select("query_id", "offered", "accounted", "frames")


# verification


def served_digests(spark, d):
    return verify.served(table(spark, d, "frames"))


def verify_verdicts(spark, d):
    return verify.verdicts(verify.held(table(spark, d, "journal")), verify.served(table(spark, d, "frames")))


def verify_outcomes(spark, d):
    return verify.outcomes(verify.held(table(spark, d, "journal")), verify.served(table(spark, d, "frames")), _providers(spark, d))


# graph


def neighbors_two_hops(spark, d):
    """Frames at most two relations away from each query's anchors, whoever they were offered to, with their least distance; none is visited twice."""
    starts = table(spark, d, "queries").dropDuplicates(["query_id"]).select("query_id", F.explode(F.array_distinct("anchors")).alias("uri")).where("uri IS NOT NULL")
    return retrieve.neighbors(_frames(spark, d), starts, 2)


QUERIES = {
    f.__name__: f
    for f in (
        frame_costs, frame_digests, frame_instants, journal_instants, frame_scores, frame_citations, frame_fences, frame_representation, frame_uris, provenance_digests,
        relation_edges, provider_scopes, provider_fingerprints, representation_choice, provider_representations, embedding_dimension_check, kinds_filter, as_of_filter, anchor_rank, lexical_relevance,
        three_key_rank, retrieve_prefix_budget, retrieve_greedy_budget, frame_cap, provider_prune, budget_split, leg_audit, accepted_frames, usage_report, usage_consistency,
        dishonest_costs, consent_gate, attribution_share, dedup_identity, dedup_leader, compose_pack, edge_placement, render_prompt, composition_audit, composition_totals,
        served_digests, verify_verdicts, verify_outcomes, neighbors_two_hops,
    )
}

_INSTANT = "^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\\.[0-9]+)?Z$"
_DIGEST = "^sha256:[0-9a-f]{64}$"
_BLANK = "regexp_replace(coalesce({0}, ''), '[\\s\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{85}}]', '', 'g') = ''"


def _ok(c):
    leap = f"((try_cast(substr({c},1,4) AS INT) % 4 = 0 AND try_cast(substr({c},1,4) AS INT) % 100 <> 0) OR try_cast(substr({c},1,4) AS INT) % 400 = 0)"
    return f"(regexp_matches({c}, '{_INSTANT}') AND try_cast(substr({c},9,2) AS INT) <= CASE substr({c},6,2) WHEN '02' THEN CASE WHEN {leap} THEN 29 ELSE 28 END WHEN '04' THEN 30 WHEN '06' THEN 30 WHEN '09' THEN 30 WHEN '11' THEN 30 ELSE 31 END)"


def _esc(c):
    return f"translate(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;'), chr(10) || chr(13), '  ')"


_F = "f AS (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY frame_no) = 1)"
_P = "p AS (SELECT * FROM providers QUALIFY row_number() OVER (PARTITION BY provider_id) = 1)"
_Q = "q AS (SELECT query_id, goal, query_text, kinds AS q_kinds, anchors AS q_anchors, coalesce(max_frames, 4611686018427387904) AS q_frames, coalesce(max_tokens, 4611686018427387904) AS q_tokens, as_of AS q_as_of, representation_preferences FROM queries QUALIFY row_number() OVER (PARTITION BY query_id) = 1)"
_O = f"{_F}, {_Q}, o AS (SELECT f.*, q.* EXCLUDE (query_id), coalesce(list_contains(q_anchors, uri), false) OR coalesce(list_has_any(q_anchors, [r.target_uri FOR r IN relations]), false) AS anchored FROM f JOIN q USING (query_id))"
_KIND = "(coalesce(len(q_kinds), 0) = 0 OR coalesce(list_contains(q_kinds, kind), false))"
_AS_OF = "(q_as_of IS NULL OR valid_from IS NULL OR valid_from <= q_as_of)"
_COST = "((strlen(coalesce(content, '')) + 3) // 4)"
_CITE = f"CASE WHEN {_BLANK.format('citation_label')} THEN title ELSE citation_label END"
_BODY = "CASE WHEN representation = 'reference' THEN '' ELSE content END"
_FENCE = f"""'<frame provider="' || {_esc('provider_id')} || '" id="' || {_esc('frame_id')} || '" kind="' || {_esc('kind')} || '" cite="' || {_esc(_CITE)} || '">' || chr(10) || regexp_replace(regexp_replace(coalesce({_BODY}, ''), '<(/?frame)', '<\\\\\\1', 'gi'), '', '') || chr(10) || '</frame>' || chr(10)"""
_BASE = "coalesce(list_filter(regexp_split_to_array(uri, '[/#?]'), lambda x: x <> '')[-1], uri)"
_CUSTOM = "regexp_matches(s, '^[^:]+:.+$')"
_OFF = "list_filter(coalesce(egress_scopes, []), lambda s: s <> 'local-only')"
_LEGS = "legs AS (SELECT query_id, provider_id, count(*) AS frames, sum(coalesce(token_cost, 0))::BIGINT AS tokens, CASE WHEN sum(coalesce(token_cost, 0)) > any_value(q_tokens) THEN 'budget_lie' WHEN count(*) > any_value(q_frames) THEN 'frame_flood' ELSE 'frames' END AS outcome FROM o GROUP BY query_id, provider_id)"
_ACC = "acc AS (SELECT o.* FROM o JOIN legs USING (query_id, provider_id) WHERE outcome = 'frames')"
_VALUE = "score DESC NULLS LAST, provider_id NULLS FIRST, frame_id NULLS FIRST, content_digest NULLS FIRST, arrival, frame_no"


def _greedy(source, order, cost, frames):
    return f"""WITH RECURSIVE {_O}, r AS MATERIALIZED (SELECT query_id, frame_no, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank, ({cost})::BIGINT AS cost, q_tokens, {frames} AS q_frames FROM o WHERE {source}),
g AS (SELECT query_id, frame_no, rank, cost, q_tokens, q_frames, cost <= q_tokens AND q_frames > 0 AS keep, q_tokens AS remaining, CASE WHEN cost <= q_tokens AND q_frames > 0 THEN cost ELSE 0 END AS used, CASE WHEN cost <= q_tokens AND q_frames > 0 THEN 1 ELSE 0 END AS n FROM r WHERE rank = 1
UNION ALL SELECT r.query_id, r.frame_no, r.rank, r.cost, r.q_tokens, r.q_frames, g.used + r.cost <= r.q_tokens AND g.n < r.q_frames, r.q_tokens - g.used, CASE WHEN g.used + r.cost <= r.q_tokens AND g.n < r.q_frames THEN g.used + r.cost ELSE g.used END, CASE WHEN g.used + r.cost <= r.q_tokens AND g.n < r.q_frames THEN g.n + 1 ELSE g.n END
FROM g JOIN r ON r.query_id = g.query_id AND r.rank = g.rank + 1)"""


_PACK = _greedy("true", _VALUE, f"CASE WHEN representation = 'reference' THEN 0 ELSE {_COST} END", "4611686018427387904")
_PLACED = "k AS (SELECT query_id, frame_no, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS vr, count(*) OVER (PARTITION BY query_id) AS n FROM g WHERE keep), pl AS (SELECT query_id, frame_no, (CASE WHEN vr % 2 = 0 THEN vr // 2 ELSE n - (vr + 1) // 2 END)::BIGINT AS position FROM k)"
_CUR = "cur AS (SELECT provider_id, frame_id, arg_max(content_digest, (arrival, frame_no)) FILTER (WHERE true) AS c0, first(content_digest ORDER BY arrival DESC, frame_no DESC) AS current FROM f GROUP BY ALL)"
_HELD = "h AS (SELECT DISTINCT x.provider_id, x.frame_id, x.content_digest FROM (SELECT unnest(frames).frame AS x FROM journal) WHERE x.frame_id IS NOT NULL)"
_VERDICT = "v AS (SELECT h.*, CASE WHEN cur.frame_id IS NULL THEN 'gone' WHEN h.content_digest IS NULL OR current IS NULL THEN 'unknown' WHEN h.content_digest = current THEN 'valid' ELSE 'stale' END AS status, CASE WHEN h.content_digest <> current THEN current END AS replacement_digest FROM h LEFT JOIN cur ON h.provider_id = cur.provider_id AND h.frame_id = cur.frame_id)"

#: the scan for duplicates, query by query: clusters are a list that each frame finds its place in
_LEADERS = f"""WITH RECURSIVE {_O}, lf AS MATERIALIZED (SELECT query_id, frame_no, content_digest AS dg, coalesce(score, 0)::FLOAT AS sc, [p.uri || chr(1) || coalesce('r' || p."range", '-') FOR p IN coalesce(provenance, []) IF p.type = 'file' AND p.uri IS NOT NULL] AS rg,
row_number() OVER (PARTITION BY query_id ORDER BY provider_id NULLS FIRST, frame_id NULLS FIRST, content_digest NULLS FIRST, arrival, frame_no) AS i FROM o),
st AS (SELECT query_id, 0::BIGINT AS i, []::STRUCT(kept BIGINT, dg VARCHAR, sc FLOAT, rg VARCHAR[])[] AS cl, []::STRUCT(f BIGINT, c BIGINT)[] AS asg FROM (SELECT DISTINCT query_id FROM lf)
UNION ALL SELECT query_id, i, CASE WHEN place IS NULL THEN list_append(cl, {{'kept': frame_no, 'dg': dg, 'sc': sc, 'rg': rg}})
ELSE list_transform(cl, lambda c, k: CASE WHEN k = place THEN {{'kept': CASE WHEN sc > c.sc THEN frame_no ELSE c.kept END, 'dg': CASE WHEN sc > c.sc THEN dg ELSE c.dg END, 'sc': greatest(sc, c.sc), 'rg': list_distinct(list_concat(c.rg, rg))}} ELSE c END) END, list_append(asg, {{'f': frame_no, 'c': coalesce(place, len(cl) + 1)}})
FROM (SELECT st.query_id, lf.i, frame_no, dg, sc, rg, cl, asg, list_filter(list_transform(cl, lambda c, k: CASE WHEN coalesce(c.dg = dg, false) OR list_has_any(c.rg, rg) THEN k END), lambda k: k IS NOT NULL)[1] AS place FROM st JOIN lf ON lf.query_id = st.query_id AND lf.i = st.i + 1)),
fin AS (SELECT query_id, cl, asg FROM st QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1), le AS (SELECT query_id, a.f AS frame_no, cl[a.c].kept AS kept FROM (SELECT query_id, cl, unnest(asg) AS a FROM fin))"""
_FATES = f"""{_LEADERS}, r AS MATERIALIZED (SELECT query_id, frame_no, row_number() OVER (PARTITION BY query_id ORDER BY {_VALUE}) AS rank, (CASE WHEN representation = 'reference' THEN 0 ELSE {_COST} END)::BIGINT AS cost, q_tokens FROM o WHERE (query_id, frame_no) IN (SELECT (query_id, frame_no) FROM le WHERE frame_no = kept)),
g AS (SELECT query_id, frame_no, rank, q_tokens, cost <= q_tokens AS keep, CASE WHEN cost <= q_tokens THEN cost ELSE 0 END AS used FROM r WHERE rank = 1
UNION ALL SELECT r.query_id, r.frame_no, r.rank, r.q_tokens, g.used + r.cost <= r.q_tokens, CASE WHEN g.used + r.cost <= r.q_tokens THEN g.used + r.cost ELSE g.used END FROM g JOIN r ON r.query_id = g.query_id AND r.rank = g.rank + 1)
SELECT query_id, frame_no, 'duplicate' AS fate, kept AS other FROM le WHERE frame_no <> kept UNION ALL SELECT query_id, frame_no, CASE WHEN keep THEN 'included' ELSE 'over_budget' END, NULL::BIGINT FROM g"""

SQL = {
    "dedup_leader": _LEADERS + " SELECT query_id, frame_no, kept FROM le",
    "composition_audit": _FATES,
    "frame_costs": f"WITH {_F} SELECT frame_no, {_COST} AS canonical, token_cost = {_COST} AS honest, floor(token_cost / 1.35::DOUBLE)::BIGINT AS model_tokens FROM f",
    "frame_digests": f"WITH {_F} SELECT frame_no, regexp_matches(content_digest, '{_DIGEST}') AS well_formed, content_digest IS NULL OR regexp_matches(content_digest, '{_DIGEST}') AS usable, 'sha256:' || sha256(content) AS actual, substr(content_digest, 8, 12) AS short FROM f",
    "frame_instants": f"WITH {_F}, b AS (SELECT frame_no, list_filter([{', '.join(f'CASE WHEN {c} IS NOT NULL AND NOT {_ok(c)} THEN ' + chr(39) + c + chr(39) + ' END' for c in ('valid_from', 'valid_to', 'recorded_at'))}], lambda x: x IS NOT NULL) AS bad FROM f) SELECT frame_no, array_to_string(bad, ',') AS invalid, len(bad) AS n_invalid FROM b",
    "journal_instants": f"SELECT delivery_id, {_ok('at_utc')} AS ok FROM journal",
    "frame_scores": f"WITH {_F} SELECT frame_no, coalesce(score BETWEEN 0 AND 1, false) AS valid FROM f",
    "frame_citations": f"WITH {_F} SELECT frame_no, {_CITE} AS cite, {_BLANK.format('title')} AS untitled FROM f",
    "frame_fences": f"WITH {_F} SELECT frame_no, {_FENCE} AS block FROM f",
    "frame_representation": f"""WITH {_F} SELECT frame_no, CASE WHEN coalesce(representation, 'full') IN ('full', 'compact') AND content IS NULL THEN coalesce(representation, 'full') || ' without content'
WHEN representation = 'compact' AND content_digest IS NULL THEN 'compact without content digest' WHEN representation = 'compact' AND content_ref IS NULL THEN 'compact without content reference'
WHEN representation = 'reference' AND content IS NOT NULL THEN 'reference with content' WHEN representation = 'reference' AND content_ref IS NULL THEN 'reference without content reference'
WHEN representation = 'reference' AND content_digest IS NOT NULL THEN 'reference with content digest' END AS problem FROM f""",
    "frame_uris": f"WITH {_F} SELECT frame_no, {_BASE} AS base, 'frm_mcp_' || regexp_replace({_BASE}, '[^A-Za-z0-9]', '_', 'g') AS derived_id FROM f",
    "provenance_digests": f"WITH {_F}, b AS (SELECT frame_no, list_filter(list_transform(coalesce(provenance, []), lambda p, i: CASE WHEN p.type = 'file' AND coalesce(NOT regexp_matches(p.digest, '{_DIGEST}'), true) THEN i - 1 END), lambda i: i IS NOT NULL) AS bad FROM f) SELECT frame_no, array_to_string(bad, ',') AS links, len(bad) AS n FROM b",
    "relation_edges": f"WITH {_F}, e AS (SELECT frame_no, uri, i - 1 AS pos, relations[i] AS r FROM f, LATERAL (SELECT unnest(range(1, len(relations) + 1)) AS i)) SELECT frame_no, uri, pos, r.rel AS rel, r.target_uri AS target_uri, NOT ({_BLANK.format('r.display_name')}) AS named, NOT ({_BLANK.format('r.target_uri')}) AS targeted, coalesce(r.rel IN ('code.calls', 'code.imports', 'code.defines', 'code.references', 'doc.documents', 'episode.follows'), false) AS recommended FROM e WHERE r IS NOT NULL",
    "provider_scopes": f"WITH {_P} SELECT provider_id, array_to_string({_OFF}, ',') AS off_machine, len(list_filter(coalesce(egress_scopes, []), lambda s: NOT coalesce(s IN ('local-only', 'org-tenant', 'third-party-index', 'third-party-model') OR {_CUSTOM}, false))) = 0 AND (len({_OFF}) = 0 OR coalesce(egress, false)) AS consistent, coalesce(egress, false) OR len({_OFF}) > 0 AS needs_consent FROM p",
    "provider_fingerprints": f"WITH {_P} SELECT provider_id, try_cast(string_split(embeddings_fingerprint, '/')[2] AS INT) AS dimensions, coalesce(embeddings_fingerprint, '') <> '' AS declared, string_split(version, '.')[1] = '1' AS same_family FROM p",
    "representation_choice": f"WITH {_F}, {_P}, {_Q}, x AS (SELECT DISTINCT query_id, provider_id FROM f) SELECT query_id, provider_id, list_filter(CASE WHEN coalesce(len(representation_preferences), 0) = 0 THEN ['full'] ELSE representation_preferences END, lambda r: coalesce(list_contains(CASE WHEN coalesce(len(representations), 0) = 0 THEN ['full'] ELSE representations END, r), false))[1] AS chosen FROM x JOIN q USING (query_id) JOIN p USING (provider_id)",
    "provider_representations": f"WITH {_P} SELECT provider_id, array_to_string(CASE WHEN coalesce(len(representations), 0) = 0 THEN ['full'] ELSE representations END, ',') AS offered, coalesce(resolve, false) OR NOT coalesce(list_has_any(representations, ['compact', 'reference']), false) AS consistent FROM p",
    "embedding_dimension_check": f"WITH {_P}, a AS (SELECT try_cast(string_split(embeddings_fingerprint, '/')[2] AS INT) AS dim, count(*) AS providers FROM p GROUP BY ALL), b AS (SELECT len(embedding)::INT AS size, count(*) AS vectors FROM embeddings GROUP BY ALL) SELECT coalesce(dim, size) AS dim, providers, vectors FROM (SELECT * FROM a WHERE dim IS NOT NULL) FULL JOIN b ON dim = size",
    "kinds_filter": f"WITH {_O} SELECT query_id, frame_no, kind FROM o WHERE {_KIND}",
    "as_of_filter": f"WITH {_O} SELECT query_id, frame_no, valid_from FROM o WHERE {_AS_OF}",
    "anchor_rank": f"WITH {_O} SELECT query_id, frame_no, anchored, row_number() OVER (PARTITION BY query_id ORDER BY anchored DESC, arrival, frame_no) AS rank FROM o WHERE {_KIND}",
    "lexical_relevance": f"""WITH {_O}, t AS (SELECT query_id, frame_no, list_filter(regexp_split_to_array(lower(concat_ws(' ', query_text, goal)), '[^a-z0-9]+'), lambda w: length(w) >= 3) AS ts, lower(concat_ws(' ', title, content)) AS hay FROM o)
SELECT query_id, frame_no, round(CASE WHEN len(ts) = 0 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE + 0.5::DOUBLE * len(list_filter(ts, lambda w: contains(hay, w))) / len(ts) END, 6) AS relevance FROM t""",
    "three_key_rank": f"WITH {_O} SELECT query_id, frame_no, row_number() OVER (PARTITION BY query_id ORDER BY anchored DESC, score DESC NULLS LAST, frame_id NULLS LAST, frame_no) AS rank FROM o",
    "retrieve_prefix_budget": f"""WITH {_O}, r AS (SELECT *, row_number() OVER w AS rank, (sum(coalesce(token_cost, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS running_tokens FROM o WHERE {_KIND} AND {_AS_OF}
WINDOW w AS (PARTITION BY query_id ORDER BY anchored DESC, arrival, frame_no)) SELECT query_id, frame_no, rank, running_tokens FROM r WHERE rank <= q_frames AND running_tokens <= q_tokens""",
    "retrieve_greedy_budget": _greedy(f"{_KIND} AND {_AS_OF}", "anchored DESC, score DESC NULLS LAST, frame_id NULLS LAST, frame_no", "coalesce(token_cost, 0)", "q_frames") + " SELECT query_id, frame_no, rank, keep, remaining FROM g",
    "frame_cap": f"WITH {_O}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY arrival, frame_no) AS rank FROM o) SELECT query_id, frame_no, rank FROM r WHERE rank <= q_frames",
    "provider_prune": f"WITH {_P}, {_Q} SELECT query_id, provider_id FROM q, p WHERE coalesce(len(q_kinds), 0) = 0 OR list_has_any(coalesce(kinds, []), q_kinds)",
    "budget_split": f"WITH {_O}, l AS (SELECT DISTINCT query_id, q_tokens, provider_id FROM o WHERE q_tokens < 4611686018427387904), n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY provider_id NULLS FIRST) - 1 AS i FROM l) SELECT query_id, provider_id, (q_tokens // n + CASE WHEN i < q_tokens % n THEN 1 ELSE 0 END)::BIGINT AS share FROM n",
    "leg_audit": f"WITH {_O}, {_LEGS} SELECT * FROM legs",
    "accepted_frames": f"WITH {_O}, {_LEGS}, {_ACC} SELECT query_id, provider_id, frame_no FROM acc",
    "usage_report": f"WITH {_O}, {_LEGS} SELECT query_id, coalesce(sum(frames) FILTER (outcome = 'frames'), 0)::BIGINT AS frames_served, coalesce(sum(frames) FILTER (outcome <> 'frames'), 0)::BIGINT AS frames_rejected, coalesce(sum(tokens) FILTER (outcome = 'frames'), 0)::BIGINT AS tokens_consumed, count(*) FILTER (outcome = 'frames') AS legs_accepted FROM legs GROUP BY query_id",
    "usage_consistency": f"""WITH {_O}, c AS (SELECT query_id, provider_id, sum(coalesce(token_cost, 0)) AS cost, count(*) AS n, min(q_tokens) AS most, min(q_frames) AS many FROM o GROUP BY ALL)
SELECT query_id, coalesce(sum(cost) FILTER (cost <= most AND n <= many), 0)::BIGINT AS reported, coalesce(sum(cost) FILTER (cost <= most AND n <= many), 0)::BIGINT AS counted, true AS consistent FROM c GROUP BY query_id""",
    "dishonest_costs": f"WITH {_F} SELECT provider_id, count(*) AS frames, sum(token_cost)::BIGINT AS declared, sum({_COST})::BIGINT AS canonical FROM f WHERE token_cost <> {_COST} GROUP BY provider_id",
    "consent_gate": f"""WITH {_P}, m AS (SELECT provider_id, len({_OFF}) AS off, coalesce(egress, false) AS egress, coalesce(verify, false) AND NOT coalesce(resolve, false) AS agreed, list_sort(list_distinct(list_filter({_OFF}, lambda s: s IS DISTINCT FROM egress_scopes[1]))) AS missing FROM p),
c AS (SELECT provider_id, missing, CASE WHEN off = 0 AND (agreed OR NOT egress) THEN 'permitted' WHEN off = 0 THEN 'needs_consent' WHEN len(missing) = 0 THEN 'permitted' ELSE 'needs_receipts' END AS decision FROM m)
SELECT provider_id, decision, array_to_string(missing, ',') AS missing, decision = 'permitted' AS permitted FROM c""",
    "attribution_share": f"""WITH {_O}, {_LEGS}, {_ACC}, i AS (SELECT query_id, provider_id, frame_id, content_digest, first(coalesce(token_cost, 0) ORDER BY arrival, frame_no) AS cost, bool_or(coalesce(representation, 'full') <> 'reference') AS rendered,
bool_or(coalesce(representation, 'full') <> 'reference' AND NOT ({_BLANK.format('citation_label')})) AS cited FROM acc GROUP BY ALL),
s AS (SELECT query_id, coalesce(sum(cost) FILTER (rendered), 0)::BIGINT AS rendered, coalesce(sum(cost) FILTER (cited), 0)::BIGINT AS cited FROM i GROUP BY query_id) SELECT query_id, rendered, cited, round(cited / nullif(rendered, 0), 6) AS share FROM s""",
    "dedup_identity": f"WITH {_O} SELECT query_id, frame_no FROM o QUALIFY row_number() OVER (PARTITION BY query_id, provider_id, frame_id, content_digest ORDER BY arrival, frame_no) = 1",
    "compose_pack": _PACK + " SELECT query_id, frame_no, rank, cost, keep, remaining FROM g",
    "edge_placement": _PACK + f", {_PLACED} SELECT query_id, frame_no, position FROM pl",
    "render_prompt": _PACK + f", {_PLACED}, bl AS (SELECT frame_no, {_FENCE} AS block FROM f) SELECT query_id, string_agg(block, '' ORDER BY position) AS prompt FROM pl JOIN bl USING (frame_no) GROUP BY query_id",
    "composition_totals": f"WITH {_O} SELECT query_id, count(*) AS offered, count(*) AS accounted, count(DISTINCT frame_no) AS frames FROM o GROUP BY query_id",
    "served_digests": f"WITH {_F}, {_CUR} SELECT provider_id, frame_id, current FROM cur",
    "verify_verdicts": f"WITH {_F}, {_CUR}, {_HELD}, {_VERDICT} SELECT * FROM v",
    "verify_outcomes": f"WITH {_F}, {_P}, {_CUR}, {_HELD}, {_VERDICT} SELECT v.provider_id, v.frame_id, v.content_digest, CASE WHEN p.provider_id IS NULL THEN 'unknown_provider' WHEN NOT coalesce(p.verify, false) THEN 'verify_unsupported' WHEN v.content_digest IS NULL THEN 'no_digest' WHEN status = 'valid' THEN 'retained' ELSE status END AS outcome FROM v LEFT JOIN p ON v.provider_id = p.provider_id",
    "neighbors_two_hops": f"""WITH {_F}, {_Q}, s AS (SELECT DISTINCT query_id, unnest(q_anchors) AS uri FROM q), e AS (SELECT DISTINCT frame_no, unnest(relations).target_uri AS target FROM f),
a AS (SELECT s.query_id, frame_no FROM f JOIN s USING (uri) UNION SELECT s.query_id, frame_no FROM e JOIN s ON s.uri = e.target),
ends AS (SELECT a.query_id, uri FROM a JOIN f USING (frame_no) WHERE uri IS NOT NULL UNION SELECT a.query_id, target FROM a JOIN e USING (frame_no)),
b AS (SELECT ends.query_id, frame_no FROM f JOIN ends USING (uri) UNION SELECT ends.query_id, frame_no FROM e JOIN ends ON ends.uri = e.target)
SELECT query_id, frame_no, 1::INT AS hops FROM a UNION ALL SELECT query_id, frame_no, 2::INT FROM b WHERE (query_id, frame_no) NOT IN (SELECT (query_id, frame_no) FROM a)""",
}
