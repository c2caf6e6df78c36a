"""Queries of pasted texts as providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import expr as X
from spanforge.functions import vocabulary as V
from spanforge.operators import artifacts as A
from spanforge.plans.texts import _BLOCKS
from spanforge.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents")


def _artifacts(spark, d):
    return A.artifacts(_docs(spark, d))


def ingest_report(spark, d):
    """What each block of each paste became."""
    return A.segments(_docs(spark, d))


def ingest_anchors(spark, d):
    """The anchors of each paste: the document's own uri, then the paths in it."""
    docs = _docs(spark, d).withColumn("given", F.when(F.col("uri").isNotNull(), F.array("uri")))
    return A.anchors(docs, "given").select("doc_id", F.array_join("anchors", "\n").alias("anchors"))


def ingest_providers(spark, d):
    """What the provider of each paste declares."""
    return A.capabilities(_artifacts(spark, d)).select("doc_id", F.array_join("kinds", ",").alias("kinds"), "artifacts", "default_budget")


def ingest_frames(spark, d):
    """Every artifact in all three representations; digests stand for the contents."""
    a = _artifacts(spark, d).withColumn("representation", F.explode(F.array(*map(F.lit, A.REPRESENTATIONS))))
    f = A.as_frames(a)
    return f.select("doc_id", "frame_id", "representation", "kind", "title", "citation_label", "score", "content_digest", "canonical_content_hash", "token_cost", "canonical_token_cost", F.col("content_ref.uri").alias("resolver"), F.col("transform.method").alias("method"), "content_fidelity", "valid_from", "valid_to", X.representation_problem("representation", "content", "content_digest", "content_ref").alias("problem"))


def _asked(spark, d):
    """A query to the provider of each paste: compact renderings within 200 tokens and three frames."""
    full = F.array(F.lit("compact"), F.lit("full"))
    return _docs(spark, d).select(F.col("doc_id").alias("query_id"), "doc_id", F.array().cast("array<string>").alias("kinds"), F.lit(3).cast("long").alias("max_frames"), F.lit(200).cast("long").alias("max_tokens"), full.alias("representation_preferences"))


def ingest_answers(spark, d):
    """What each paste's provider answers to a small query, frame by frame."""
    return A.answers(_artifacts(spark, d), _asked(spark, d)).select("doc_id", "frame_id", "representation", "token_cost", F.col("rank").cast("long").alias("rank"), "keep")


def ingest_answer_totals(spark, d):
    """Per paste: frames answered, dropped, and whether the answer is cut short."""
    got = ingest_answers(spark, d).groupBy("doc_id").agg(F.count_if("keep").alias("served"), F.count_if(~F.col("keep")).alias("dropped"), F.sum(F.when(F.col("keep"), F.col("token_cost")).otherwise(0)).alias("tokens"))
    return got.withColumn("truncated", F.col("dropped") > 0)


def ingest_verdicts(spark, d):
    """Held identities of artifacts (as served in full and compact, with a changed digest, with none, of an unknown id) by kind and verdict."""
    a = _artifacts(spark, d)
    held = a.select(
        "doc_id", "frame_kind",
        F.explode(F.array(
            F.struct(F.lit("full").alias("how"), F.col("frame_id"), F.col("digest").alias("content_digest")),
            F.struct(F.lit("inline").alias("how"), F.col("frame_id"), X.digest_of("inline").alias("content_digest")),
            F.struct(F.lit("changed").alias("how"), F.col("frame_id"), V.stale_digest("digest").alias("content_digest")),
            F.struct(F.lit("none").alias("how"), F.col("frame_id"), F.lit(None).cast("string").alias("content_digest")),
            F.struct(F.lit("unknown").alias("how"), F.concat("frame_id", F.lit("?")).alias("frame_id"), F.col("digest").alias("content_digest")),
        )).alias("h"),
    ).select("doc_id", "frame_kind", "h.*")
    return A.verify(held, a).groupBy("how", "status").agg(F.count("*").alias("identities"), F.count("replacement_digest").alias("replacements"))


QUERIES = {f.__name__: f for f in (ingest_report, ingest_anchors, ingest_providers, ingest_frames, ingest_answers, ingest_answer_totals, ingest_verdicts)}
_NAMED = _BLOCKS + """, n0 AS (SELECT *, 'frm_' || substr(digest, 8, 12) || CASE WHEN kind = 'path' THEN '#' ELSE '' END AS fid, coalesce(compact_tokens, tokens) AS inl,
CASE kind WHEN 'log' THEN 'log · ' WHEN 'trace' THEN 'stack trace · ' WHEN 'table' THEN 'table · ' WHEN 'code' THEN 'code · ' END || len(string_split(regexp_replace(txt, '\\n$', ''), chr(10))) || ' lines' AS counted FROM bk),
n1 AS (SELECT *, coalesce(counted, 'note') AS title, CASE WHEN kind = 'path' THEN 'anchor' WHEN block = min(block) OVER (PARTITION BY doc_id, fid) THEN 'frame' ELSE 'duplicate' END AS outcome FROM n0),
ar AS (SELECT *, CASE WHEN kind IN ('log', 'trace') THEN 'episode' WHEN kind = 'table' THEN 'fact' WHEN kind = 'code' THEN 'snippet' ELSE 'doc' END AS fk, CASE kind WHEN 'trace' THEN 0.85 WHEN 'log' THEN 0.8 WHEN 'code' THEN 0.75 WHEN 'table' THEN 0.7 ELSE 0.5 END::FLOAT AS score FROM n1 WHERE outcome = 'frame')"""
_ANSWERS = (
    _NAMED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, rk AS MATERIALIZED (SELECT doc_id, fid, inl AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, fid) AS rank FROM ar),
fo AS (SELECT doc_id, fid, cost, rank, cost <= 200 AS keep, CASE WHEN cost <= 200 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 200 THEN 1 ELSE 0 END AS n FROM rk WHERE rank = 1
UNION ALL SELECT rk.doc_id, rk.fid, rk.cost, rk.rank, used + rk.cost <= 200 AND n < 3, CASE WHEN used + rk.cost <= 200 AND n < 3 THEN used + rk.cost ELSE used END, CASE WHEN used + rk.cost <= 200 AND n < 3 THEN n + 1 ELSE n END FROM fo JOIN rk ON rk.doc_id = fo.doc_id AND rk.rank = fo.rank + 1)"""
)

SQL = {
    "ingest_report": _NAMED + """ SELECT doc_id, block, kind, CASE WHEN outcome = 'anchor' THEN 'anchor · ' || trim(txt, ' ') WHEN compact IS NOT NULL THEN title || ' · ' || tokens || ' → ' || inl || ' tokens' ELSE title || ' · ' || tokens || ' tokens' END AS summary, outcome,
CASE WHEN outcome = 'anchor' THEN trim(txt, ' ') ELSE fid END AS id, CASE WHEN outcome <> 'anchor' THEN inl END AS inline_tokens, CASE WHEN outcome <> 'anchor' THEN tokens END AS source_tokens FROM n1""",
    "ingest_anchors": _NAMED + """, aa AS (SELECT doc_id, v, min(p) AS p FROM (SELECT doc_id, uri AS v, -1 AS p FROM documents WHERE uri IS NOT NULL UNION ALL SELECT doc_id, trim(txt, ' '), block FROM n1 WHERE outcome = 'anchor') GROUP BY doc_id, v),
ag AS (SELECT doc_id, string_agg(v, chr(10) ORDER BY p) AS anchors FROM aa GROUP BY doc_id) SELECT doc_id, coalesce(anchors, '') AS anchors FROM documents LEFT JOIN ag USING (doc_id)""",
    "ingest_providers": _NAMED + " SELECT doc_id, string_agg(DISTINCT fk, ',' ORDER BY fk) AS kinds, count(*) AS artifacts, sum(inl)::BIGINT AS default_budget FROM ar GROUP BY doc_id",
    "ingest_frames": _NAMED + """ SELECT doc_id, fid AS frame_id, r AS representation, fk AS kind, title, CASE kind WHEN 'log' THEN 'pasted log' WHEN 'trace' THEN 'pasted stack trace' WHEN 'table' THEN 'pasted table' WHEN 'code' THEN 'pasted code' ELSE 'pasted note' END AS citation_label, score,
CASE r WHEN 'full' THEN digest WHEN 'compact' THEN 'sha256:' || sha256(coalesce(compact, txt)) END AS content_digest, CASE WHEN r <> 'full' THEN digest END AS canonical_content_hash, CASE r WHEN 'full' THEN tokens WHEN 'compact' THEN inl ELSE 0 END AS token_cost,
CASE WHEN r <> 'full' THEN tokens END AS canonical_token_cost, CASE WHEN r <> 'full' THEN 'context://prompt-ingest/artifacts/' || digest END AS resolver,
CASE WHEN r = 'compact' THEN CASE WHEN compact IS NULL THEN 'verbatim' ELSE CASE kind WHEN 'log' THEN 'extractive_summary' WHEN 'trace' THEN 'stack_frame_head' WHEN 'table' THEN 'tabular_sample' WHEN 'code' THEN 'truncation' END END END AS method,
CASE WHEN r = 'full' THEN 'exact' WHEN r = 'reference' THEN 'omitted' WHEN compact IS NULL THEN 'exact' ELSE 'summarized' END AS content_fidelity, valid_from, valid_to, NULL::VARCHAR AS problem FROM ar, (VALUES ('full'), ('compact'), ('reference')) v(r)""",
    "ingest_answers": _ANSWERS + " SELECT doc_id, fid AS frame_id, 'compact' AS representation, cost AS token_cost, rank, keep FROM fo",
    "ingest_answer_totals": _ANSWERS + " SELECT doc_id, count(*) FILTER (keep) AS served, count(*) FILTER (NOT keep) AS dropped, coalesce(sum(cost) FILTER (keep), 0)::BIGINT AS tokens, count(*) FILTER (NOT keep) > 0 AS truncated FROM fo GROUP BY doc_id",
    "ingest_verdicts": _NAMED + " SELECT how, status, count(*) AS identities, CASE WHEN status = 'stale' THEN count(*) ELSE 0 END AS replacements FROM ar, (VALUES ('full', 'valid'), ('inline', 'valid'), ('changed', 'stale'), ('none', 'unknown'), ('unknown', 'gone')) v(how, status) GROUP BY how, status",
}
