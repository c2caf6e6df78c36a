"""What a host checks of its providers' answers: legs over budget, honest costs, usage, consent.

All are aggregations by (query, provider), combined before their shuffle; the small providers table joins by whatever way its size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import expr as X


def legs(offers: DataFrame) -> DataFrame:
    """(query_id, provider_id, frames, tokens, outcome): tokens are checked before frames, and a failing leg is dropped whole."""
    return offers.groupBy("query_id", "provider_id").agg(F.count("*").alias("frames"), F.sum(F.coalesce("token_cost", F.lit(0))).alias("tokens"), F.first("q_tokens").alias("q_tokens"), F.first("q_frames").alias("q_frames")).select(
        "query_id", "provider_id", "frames", "tokens", F.expr("CASE WHEN tokens > q_tokens THEN 'budget_lie' WHEN frames > q_frames THEN 'frame_flood' ELSE 'frames' END").alias("outcome")
    )


def accepted(offers: DataFrame) -> DataFrame:
    """Frames of legs that passed."""
    return offers.join(legs(offers).where("outcome = 'frames'").select("query_id", "provider_id"), ["query_id", "provider_id"], "left_semi")


def usage(offers: DataFrame) -> DataFrame:
    """Per query: served and rejected frames, consumed tokens."""
    ok = F.col("outcome") == "frames"
    return legs(offers).groupBy("query_id").agg(
        F.sum(F.when(ok, F.col("frames")).otherwise(0)).alias("frames_served"),
        F.sum(F.when(ok, 0).otherwise(F.col("frames"))).alias("frames_rejected"),
        F.sum(F.when(ok, F.col("tokens")).otherwise(0)).alias("tokens_consumed"),
        F.count_if(ok).alias("legs_accepted"),
    )


def consent(providers: DataFrame, receipts: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(provider_id, decision, missing): whether a query may go to each provider.

    Where off-machine scopes are declared, each must have a receipt (``needs_receipts`` names the ``missing`` ones; expiry is not
    looked at); where only ``egress`` is, a consent record that holds (see ``latest_records``), else ``needs_consent``; others are local.
    """
    held = records if records is not None else providers.sparkSession.createDataFrame([], "provider_id string")
    egress = F.coalesce("egress", F.lit(False)) if "egress" in providers.columns else F.lit(False)
    agreed = held.where("provider_id IS NOT NULL").select("provider_id", F.lit(True).alias("agreed")).distinct()
    gaps = missing_receipts(providers, receipts).join(providers.select("provider_id", F.size(X.off_machine("egress_scopes")).alias("n_off"), egress.alias("egress")), "provider_id").join(agreed, "provider_id", "left")
    decision = F.when(F.col("n_off") > 0, F.when(F.size("missing") > 0, "needs_receipts").otherwise("permitted")).when(F.col("egress") & F.col("agreed").isNull(), "needs_consent").otherwise("permitted")
    return gaps.select("provider_id", decision.alias("decision"), "missing")


def missing_receipts(providers: DataFrame, receipts: DataFrame) -> DataFrame:
    """(provider_id, missing): off-machine scopes without a receipt; an empty list where nothing is missing."""
    wanted = providers.select("provider_id", F.explode(F.array_distinct(X.off_machine("egress_scopes"))).alias("scope"))
    lacking = wanted.join(receipts.select("provider_id", "scope"), ["provider_id", "scope"], "left_anti").groupBy("provider_id").agg(F.array_sort(F.collect_list("scope")).alias("missing"))
    return providers.select("provider_id").join(lacking, "provider_id", "left").select("provider_id", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def live_receipts(receipts: DataFrame, now: str) -> DataFrame:
    """The first receipt of each (provider, scope) that has not expired at ``now``; instants compare as text, none means never."""
    live = receipts.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
    return live.groupBy("provider_id", "scope").agg(F.min_by("receipt_no", "receipt_no").alias("receipt_no"))


def latest_records(records: DataFrame) -> DataFrame:
    """The last consent record of each provider, by ``ord``; a bad ``granted_at`` counts as none. ``granted`` is false where the last word was a revocation."""
    last = records.groupBy("provider_id").agg(F.max_by(F.struct("granted", "granted_at"), "ord").alias("r"))
    return last.select("provider_id", "r.granted", F.when(X.is_instant("r.granted_at"), F.col("r.granted_at")).alias("granted_at"))


IDENTITY = ["provider_id", "frame_id", "content_digest"]


def attribution_by(uses: DataFrame, served: DataFrame, group: str) -> DataFrame:
    """As ``attribution``, one row for each ``group``, a column of both."""
    first = served.groupBy(group, *IDENTITY).agg(F.min_by(F.coalesce("token_cost", F.lit(0)), F.struct("arrival", "frame_no")).alias("cost"))
    same = uses[group] == first[group]
    for c in IDENTITY:
        same = same & uses[c].eqNullSafe(first[c])
    joined = uses.join(first, same, "left").select(uses[group], "selected", "rendered", "cited", "cost")
    coherent = (~F.col("cited") | F.col("rendered")) & (~F.col("rendered") | F.col("selected"))
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("cost"))), F.lit(0)).cast("long")
    one = joined.groupBy(group).agg(F.bool_and(coherent & F.col("cost").isNotNull()).alias("reconcilable"), total("rendered").alias("rendered_tokens"), total("cited").alias("cited_tokens"))
    return one.withColumn("cited_share", F.col("cited_tokens") / F.nullif(F.col("rendered_tokens"), F.lit(0)))


def attribution(uses: DataFrame, served: DataFrame) -> DataFrame:
    """What a report of uses (identity, selected, rendered, cited) comes to against the served frames (identity, token_cost, arrival).

    One row: whether cited implies rendered implies selected and every use was served, tokens rendered and cited, and the cited share
    (null where nothing was rendered). A frame served twice costs what it did first.
    """
    first = served.groupBy(*IDENTITY).agg(F.min_by(F.coalesce("token_cost", F.lit(0)), "arrival").alias("cost"))
    same = [uses[c].eqNullSafe(first[c]) for c in IDENTITY]
    joined = uses.join(first, same[0] & same[1] & same[2], "left").select("selected", "rendered", "cited", "cost")
    coherent = (~F.col("cited") | F.col("rendered")) & (~F.col("rendered") | F.col("selected"))
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("cost"))), F.lit(0)).cast("long")
    one = joined.agg(F.coalesce(F.bool_and(coherent & F.col("cost").isNotNull()), F.lit(True)).alias("reconcilable"), total("rendered").alias("rendered_tokens"), total("cited").alias("cited_tokens"))
    return one.withColumn("cited_share", F.col("cited_tokens") / F.nullif(F.col("rendered_tokens"), F.lit(0)))
