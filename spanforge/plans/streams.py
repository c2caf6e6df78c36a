"""Queries of the streams and of the quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import quality
from spanforge.plans.frames import _BLANK, _CITE, _DIGEST, _F, _ok
from spanforge.sources.tables import stream_parquet, table
from spanforge.streaming import journal as S


def stream_effect_deliveries(spark, d):
    return S.drain(spark, S.effect_deliveries(S.journal_stream(spark, f"{d}/journal.parquet")), "update", "effects", ["session", "effect_id"])


def stream_token_spend(spark, d):
    return S.drain(spark, S.token_spend(S.journal_stream(spark, f"{d}/journal.parquet")), "update", "spend", ["opened"])


def stream_latest_verdicts(spark, d):
    return S.drain(spark, S.latest_verdicts(S.journal_stream(spark, f"{d}/journal.parquet")), "update", "verdicts", ["session", "provider_id", "frame_id", "content_digest"])


def stream_gaps(spark, d):
    return S.drain(spark, S.gaps(S.journal_stream(spark, f"{d}/journal.parquet")), "append", "gaps")


def stream_resume_losses(spark, d):
    return S.drain(spark, S.resume_losses(S.journal_stream(spark, f"{d}/journal.parquet")), "append", "resumes")


def stream_receipts(spark, d):
    """Frames served, as grants of their provider for each kind of frame at the instant of recording."""
    path = f"{d}/frames.parquet"
    frames = stream_parquet(spark, path, spark.read.parquet(path).schema)
    grants = frames.select("provider_id", F.col("kind").alias("scope"), F.col("recorded_at").alias("granted_at"))
    return S.drain(spark, S.receipt_log(grants), "update", "receipts", ["provider_id", "scope"])


def stream_invalidations(spark, d):
    """Verdicts of the journal that a frame is stale or gone, as notices to whoever holds the frames served."""
    seen = S.journal_stream(spark, f"{d}/journal.parquet").where("frame IS NOT NULL AND verdict.status IN ('stale', 'gone')")
    notices = seen.select("frame.provider_id", F.array("frame.frame_id").alias("frame_ids"), F.col("verdict.status").alias("reason"))
    evicted = S.drain(spark, S.invalidated(notices, table(spark, d, "frames")), "append", "invalidations")
    return evicted.groupBy("provider_id", "frame_id", "content_digest", "reason").agg(F.count("*").alias("notices"))


def frame_validity(spark, d):
    return quality.frame_problems(table(spark, d, "frames").dropDuplicates(["frame_no"])).select("frame_no", "rule")


def quality_report(spark, d):
    return quality.by_provider(table(spark, d, "frames").dropDuplicates(["frame_no"]))


QUERIES = {f.__name__: f for f in (stream_effect_deliveries, stream_token_spend, stream_latest_verdicts, stream_gaps, stream_resume_losses, stream_receipts, stream_invalidations, frame_validity, quality_report)}

_RULES = {
    "score": "NOT coalesce(score BETWEEN 0 AND 1, false)",
    "title": _BLANK.format("title"),
    "citation": _BLANK.format(f"({_CITE})"),
    "content_digest": f"NOT coalesce(regexp_matches(content_digest, '{_DIGEST}'), true)",
    "valid_from": f"NOT coalesce({_ok('valid_from')}, true)",
    "valid_to": f"NOT coalesce({_ok('valid_to')}, true)",
    "recorded_at": f"NOT coalesce({_ok('recorded_at')}, true)",
    "window": "coalesce(valid_to < valid_from, false)",
    "cost": "NOT coalesce(token_cost >= 0, false)",
    "provenance": "coalesce(len(provenance), 0) = 0",
    "file_digest": f"coalesce(len([1 FOR p IN provenance IF p.type = 'file' AND NOT coalesce(regexp_matches(p.digest, '{_DIGEST}'), false)]), 0) > 0",
    "representation": "coalesce((coalesce(representation, 'full') IN ('full', 'compact') AND content IS NULL) OR (representation = 'compact' AND (content_digest IS NULL OR content_ref IS NULL)) OR (representation = 'reference' AND (content IS NOT NULL OR content_ref IS NULL OR content_digest IS NOT NULL)), false)",
}
_BROKEN = f"WITH {_F}, b AS (" + " UNION ALL ".join(f"SELECT frame_no, provider_id, '{name}' AS rule FROM f WHERE {cond}" for name, cond in _RULES.items()) + ")"

SQL = {
    "stream_effect_deliveries": "SELECT session, effect_id, count(*) AS deliveries FROM journal WHERE session IS NOT NULL AND effect_id IS NOT NULL GROUP BY ALL",
    "stream_token_spend": "SELECT time_bucket(INTERVAL 1 DAY, received_at, TIMESTAMP '1970-01-01') AS opened, count(*) AS prompts, sum(declared_total_tokens)::BIGINT AS tokens FROM journal WHERE lower(trim(event)) = 'prompt_assembled' AND received_at IS NOT NULL GROUP BY 1",
    "stream_latest_verdicts": "SELECT session, frame.provider_id AS provider_id, frame.frame_id AS frame_id, frame.content_digest AS content_digest, max(seq) AS seq, arg_max(verdict.status, (seq, verdict.status)) AS status FROM journal WHERE frame IS NOT NULL AND verdict.status IS NOT NULL AND session IS NOT NULL AND seq IS NOT NULL GROUP BY ALL",
    "stream_gaps": "SELECT session, coalesce(top, 0) AS after, seq FROM (SELECT session, seq, max(seq) OVER (PARTITION BY session ORDER BY received_at, delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM journal WHERE session IS NOT NULL AND seq IS NOT NULL) WHERE seq > coalesce(top, 0) + 1",
    "stream_resume_losses": """SELECT session, seq, last_seq_seen, least(coalesce(top, 0), seq - 1) AS recorded, least(coalesce(top, 0), seq - 1) - last_seq_seen AS lost FROM (SELECT *, max(seq) OVER (PARTITION BY session ORDER BY received_at, delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
FROM journal WHERE session IS NOT NULL AND seq IS NOT NULL) WHERE lower(trim(event)) = 'resume' AND last_seq_seen >= 0""",
    "stream_receipts": "SELECT provider_id, kind AS scope, count(*) AS grants, min(recorded_at) AS first_at, max(recorded_at) AS last_at FROM frames WHERE provider_id IS NOT NULL AND kind IS NOT NULL GROUP BY ALL",
    "stream_invalidations": "SELECT h.provider_id, h.frame_id, h.content_digest, verdict.status AS reason, count(*) AS notices FROM journal j JOIN (SELECT DISTINCT provider_id, frame_id, content_digest FROM frames) h ON h.provider_id = j.frame.provider_id AND h.frame_id = j.frame.frame_id WHERE verdict.status IN ('stale', 'gone') GROUP BY ALL",
    "frame_validity": f"{_BROKEN} SELECT frame_no, rule FROM b",
    "quality_report": f"{_BROKEN} SELECT provider_id, rule, count(*) AS frames FROM b GROUP BY ALL",
}
