"""Held frames against what their providers serve now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def served(frames: DataFrame) -> DataFrame:
    """(provider_id, frame_id, current): the digest each frame was last served with."""
    return frames.dropDuplicates(["frame_no"]).groupBy("provider_id", "frame_id").agg(F.max_by("content_digest", F.struct("arrival", "frame_no")).alias("current"))


def held(journal: DataFrame) -> DataFrame:
    """(provider_id, frame_id, content_digest): every identity that prompts of the journal rendered."""
    return journal.select(F.explode("frames.frame").alias("f")).where("f.frame_id IS NOT NULL").select("f.provider_id", "f.frame_id", "f.content_digest").distinct()


def verdicts(held_frames: DataFrame, current: DataFrame) -> DataFrame:
    """gone (never served, asked first), unknown (no digest on either side), valid, or stale with the replacement."""
    return held_frames.join(current.withColumn("known", F.lit(True)), ["provider_id", "frame_id"], "left").select(
        "provider_id",
        "frame_id",
        "content_digest",
        F.expr("CASE WHEN known IS NULL THEN 'gone' WHEN content_digest IS NULL OR current IS NULL THEN 'unknown' WHEN content_digest = current THEN 'valid' ELSE 'stale' END").alias("status"),
        F.expr("CASE WHEN content_digest <> current THEN current END").alias("replacement_digest"),
    )


def outcomes(held_frames: DataFrame, current: DataFrame, providers: DataFrame) -> DataFrame:
    """(…, outcome): what becomes of each held frame: retained, or why not; asked in this order."""
    v = verdicts(held_frames, current).join(providers.dropDuplicates(["provider_id"]).select("provider_id", "verify", F.lit(True).alias("registered")), "provider_id", "left")
    return v.select(
        "provider_id",
        "frame_id",
        "content_digest",
        F.expr(
            """CASE WHEN registered IS NULL THEN 'unknown_provider' WHEN NOT coalesce(verify, false) THEN 'verify_unsupported'
            WHEN content_digest IS NULL THEN 'no_digest' WHEN status = 'valid' THEN 'retained' ELSE status END"""
        ).alias("outcome"),
    )
