"""Streaming over the journal and its kin: counts of deliveries, spend by time, gaps as they arrive, what resumes lost, receipts, invalidations.

Built-in aggregations keep keyed state in the JVM and give only what changed; ``drain`` keeps the last row of each key. The detectors
keep one or two numbers per session. Each query drains a stored table here; on a live source the same streams run with any trigger.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.sources.tables import scratch, stream_parquet


def drain(spark: SparkSession, stream: DataFrame, mode: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream to the end of what its source has now; gives its result. In ``update`` mode the last row of each of ``keys`` holds, else rows add up."""
    base = scratch(spark, label)
    out = f"{base}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is done again replaces itself

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if mode == "update":
        others = [c for c in stream.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
        return last.select(*keys, "last.*").select(stream.columns)
    return rows.select(stream.columns)


def journal_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return stream_parquet(spark, path, spark.read.parquet(path).schema, files_per_trigger).withColumn("received_at", F.col("received_at").cast("timestamp"))


def effect_deliveries(journal: DataFrame) -> DataFrame:
    """(session, effect_id, deliveries) so far: repeats are counted, not hidden."""
    return journal.where("effect_id IS NOT NULL AND session IS NOT NULL").groupBy("session", "effect_id").agg(F.count("*").alias("deliveries"))


def token_spend(journal: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(opened, prompts, tokens) declared by prompts in tumbling windows of arrival."""
    prompts = journal.where(F.lower(F.trim("event")) == "prompt_assembled").withWatermark("received_at", lateness)
    by = prompts.groupBy(F.window("received_at", window)).agg(F.count("*").alias("prompts"), F.sum("declared_total_tokens").alias("tokens"))
    return by.select(F.col("window.start").alias("opened"), "prompts", "tokens")


def latest_verdicts(journal: DataFrame) -> DataFrame:
    """(session, frame identity, seq, status): the verdict with the greatest seq so far."""
    seen = journal.where("frame IS NOT NULL AND verdict.status IS NOT NULL AND session IS NOT NULL AND seq IS NOT NULL")
    best = seen.groupBy("session", F.col("frame.provider_id").alias("provider_id"), F.col("frame.frame_id").alias("frame_id"), F.col("frame.content_digest").alias("content_digest"))
    return best.agg(F.max(F.struct("seq", "verdict.status")).alias("m")).select("session", "provider_id", "frame_id", "content_digest", "m.seq", "m.status")


def gaps(journal: DataFrame) -> DataFrame:
    """(session, after, seq) each time a session's highest seq so far is passed by more than one; rows of one batch count in order of receipt."""

    def step(key, frames, state):
        top = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["received_at", "delivery_id"])
        out = []
        for seq in rows["seq"].tolist():
            if seq > top + 1:
                out.append((key[0], top, seq))
            top = max(top, seq)
        state.update((top,))
        yield pd.DataFrame(out, columns=["session", "after", "seq"])

    ready = journal.where("session IS NOT NULL AND seq IS NOT NULL").select("session", "seq", "received_at", "delivery_id")
    return ready.groupBy("session").applyInPandasWithState(step, "session string, after long, seq long", "top long", "append", "NoTimeout")


def resume_losses(journal: DataFrame) -> DataFrame:
    """(session, seq, last_seq_seen, recorded, lost): each resume, with the highest seq recorded before it when it was received; ``lost`` is negative where it saw what was not."""

    def step(key, frames, state):
        top = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["received_at", "delivery_id"])
        out = []
        for seq, event, seen in zip(rows["seq"].tolist(), rows["event"].tolist(), rows["last_seq_seen"].tolist()):
            if event == "resume" and seen >= 0:
                before = min(top, seq - 1)
                out.append((key[0], seq, seen, before, before - seen))
            top = max(top, seq)
        state.update((top,))
        yield pd.DataFrame(out, columns=["session", "seq", "last_seq_seen", "recorded", "lost"])

    ready = journal.where("session IS NOT NULL AND seq IS NOT NULL").select("session", "seq", F.lower(F.trim("event")).alias("event"), F.coalesce("last_seq_seen", F.lit(-1)).alias("last_seq_seen"), "received_at", "delivery_id")
    return ready.groupBy("session").applyInPandasWithState(step, "session string, seq long, last_seq_seen long, recorded long, lost long", "top long", "append", "NoTimeout")


def receipt_log(receipts: DataFrame) -> DataFrame:
    """(provider_id, scope, grants, first_at, last_at): receipts only ever add up; a grant given again is another receipt."""
    whole = receipts.where("provider_id IS NOT NULL AND scope IS NOT NULL")
    return whole.groupBy("provider_id", "scope").agg(F.count("*").alias("grants"), F.min("granted_at").alias("first_at"), F.max("granted_at").alias("last_at"))


def invalidated(notices: DataFrame, held: DataFrame) -> DataFrame:
    """(provider_id, frame_id, content_digest, reason): held frames that a notice (provider_id, frame_ids, reason) evicts, a stream against a table.

    Notices of one frame that come together are one; a frame that is not held is nobody's business.
    """
    one = notices.select("provider_id", F.explode("frame_ids").alias("frame_id"), "reason")
    return one.join(held.select("provider_id", "frame_id", "content_digest").distinct(), ["provider_id", "frame_id"]).select("provider_id", "frame_id", "content_digest", "reason")
