"""Data-quality rules over frames, as rows: which frame breaks which rule, and how many by provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import expr as X


def frame_problems(frames: DataFrame) -> DataFrame:
    """(frame_no, provider_id, rule) of every rule a frame breaks; all rules are one pass over the frames."""
    none = F.array().cast("array<string>")
    file_links = F.filter(F.coalesce("provenance", F.array().cast(frames.schema["provenance"].dataType)), lambda p: F.coalesce(p["type"] == "file", F.lit(False)))
    rules = {
        "score": ~X.valid_score("score"),
        "title": X.is_blank("title"),
        "citation": X.is_blank(X.citation("citation_label", "title")),
        "content_digest": ~F.coalesce(X.is_digest("content_digest"), F.lit(True)),
        "valid_from": ~F.coalesce(X.is_instant("valid_from"), F.lit(True)),
        "valid_to": ~F.coalesce(X.is_instant("valid_to"), F.lit(True)),
        "recorded_at": ~F.coalesce(X.is_instant("recorded_at"), F.lit(True)),
        "window": F.coalesce(F.col("valid_to") < F.col("valid_from"), F.lit(False)),
        "cost": ~F.coalesce(F.col("token_cost") >= 0, F.lit(False)),
        "provenance": F.coalesce(F.size("provenance"), F.lit(0)) <= 0,
        "file_digest": F.exists(file_links, lambda p: ~F.coalesce(X.is_digest(p["digest"]), F.lit(False))),
        "representation": X.representation_problem("representation", "content", "content_digest", "content_ref").isNotNull(),
    }
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))
    return frames.select("frame_no", "provider_id", F.explode(F.coalesce(broken, none)).alias("rule"))


def by_provider(frames: DataFrame) -> DataFrame:
    """(provider_id, rule, frames)."""
    return frame_problems(frames).groupBy("provider_id", "rule").agg(F.count("*").alias("frames"))
