"""Retrieval: filters, ranking and budgets over the frames offered for queries.

Frames meet their queries in one shuffle on ``query_id``. Ranks, and the budget that stops at the first frame that does not fit, come in
two steps over parts of a query's frames (``ranked``). The budget that skips what does not fit depends on every frame before: it is a fold
over sorted rows that holds two numbers per query, so a query of any size streams through its task, but through one: at a
million frames a second a query of 10^8 frames takes some minutes.

Null budgets and frame limits mean no limit, null costs 0; exact duplicate rows count once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import expr as X
from spanforge.sources.tables import materialise

UNLIMITED = 1 << 62


def wanted(queries: DataFrame) -> DataFrame:
    """What each query asks for: kinds, anchors, as_of and limits as ``q_*``."""
    return queries.dropDuplicates(["query_id"]).select(
        "query_id",
        "goal",
        "query_text",
        F.col("kinds").alias("q_kinds"),
        F.col("anchors").alias("q_anchors"),
        F.coalesce("max_frames", F.lit(UNLIMITED)).alias("q_frames"),
        F.coalesce("max_tokens", F.lit(UNLIMITED)).alias("q_tokens"),
        F.col("as_of").alias("q_as_of"),
    )


def offers(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """Each frame with what its query asks for."""
    return frames.dropDuplicates(["frame_no"]).join(wanted(queries), "query_id")


def asked_kind(kinds: str = "q_kinds"):
    """Whether a frame's kind is among ``kinds``; no kinds means all."""
    return F.coalesce(F.size(kinds), F.lit(0)).isin(0, -1) | F.coalesce(F.array_contains(kinds, F.col("kind")), F.lit(False))


def of_kind(df: DataFrame) -> DataFrame:
    """No kinds asked for means all."""
    return df.where(asked_kind())


#: instants compare as text; only the start of validity counts
VALID_AS_OF = "q_as_of IS NULL OR valid_from IS NULL OR valid_from <= q_as_of"


def valid_as_of(df: DataFrame) -> DataFrame:
    return df.where(VALID_AS_OF)


def anchored(df: DataFrame):
    """Whether a frame or a relation of it points at one of the query's anchors."""
    return F.coalesce(F.array_contains("q_anchors", F.col("uri")), F.lit(False)) | F.coalesce(F.arrays_overlap("q_anchors", F.col("relations.target_uri")), F.lit(False))


#: fixed values: the kinds of frames, and what a request is given that names no limits
KINDS = ["snippet", "symbol", "fact", "doc", "memory", "episode", "graph"]
DEFAULT_TOKENS, DEFAULT_FRAMES = 4096, 8


def parsed_requests(requests: DataFrame) -> DataFrame:
    """Requests (goal, query_text, kinds, max_frames, max_tokens) with defaults in place, unknown kinds left out, and ``error`` where there is no goal."""
    none = F.array().cast("array<string>")
    return requests.withColumns({
        "kinds": F.filter(F.coalesce("kinds", none), lambda k: F.coalesce(k.isin(KINDS), F.lit(False))),
        "max_frames": F.coalesce("max_frames", F.lit(DEFAULT_FRAMES)).cast("long"),
        "max_tokens": F.coalesce("max_tokens", F.lit(DEFAULT_TOKENS)).cast("long"),
        "error": F.when(X.is_blank("goal"), F.lit("a goal is required")),
    })


def relevant_providers(queries: DataFrame, providers: DataFrame) -> DataFrame:
    """(query_id, provider_id): the providers a query goes to: all where it names no kinds, else those that declare one of them.

    Met by kind: a query that names none asks for the kind that every provider is given besides its own, so no pairs are made that are
    no result. A null among the kinds asked for matches nothing.
    """
    every = F.array(F.lit(None).cast("string"))
    asked = F.when(F.coalesce(F.size("kinds"), F.lit(0)) <= 0, every).otherwise(F.array_compact("kinds"))
    served = F.array_union(F.array_compact(F.coalesce("kinds", F.array().cast("array<string>"))), every)
    q = queries.where("query_id IS NOT NULL").dropDuplicates(["query_id"]).select("query_id", F.explode(asked).alias("kind"))
    p = providers.select("provider_id", F.explode(served).alias("own_kind"))
    return q.join(p, q["kind"].eqNullSafe(p["own_kind"])).select("query_id", "provider_id").distinct()


def by_arrival(rows: int = 4096):
    """A number that grows along an order by arrival: which run of ``rows`` arrivals a row is in."""
    return F.floor(F.coalesce("arrival", F.lit(-1)) / rows).cast("long")


def by_score(parts: int = 64):
    """A number that grows along an order by falling score, unknown scores last."""
    return F.when(F.col("score").isNull(), parts).otherwise(F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((1 - F.col("score")) * parts)))).cast("long")


def ranked(df: DataFrame, order: list, part, anchored_first: bool = False, by: str = "query_id") -> DataFrame:
    """``df`` with ``rank`` and ``running_tokens`` of each query's rows in ``order``, in two steps, so that no task orders all rows of a query.

    ``part`` must grow along the order (after ``anchored``, where that comes first): parts are ordered each by itself, and one row per
    part gives what came before. ``by`` names another column to rank within.
    """
    part = part + F.when(F.col("anchored"), 0).otherwise(1 << 50) if anchored_first else part
    rows = df.withColumn("_part", part)
    inside = Window.partitionBy(by, "_part").orderBy(*order)
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cost = F.coalesce("token_cost", F.lit(0))
    sums = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.sum(cost).alias("_t"))
    before = sums.select(by, "_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", "_t")))
    near = rows.withColumns({"rank": F.row_number().over(inside), "running_tokens": F.sum(cost).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    far = near.join(before, [by, "_part"])
    return far.withColumns({"rank": (F.col("rank") + F.col("_n")).cast("long"), "running_tokens": F.col("running_tokens") + F.col("_t")}).drop("_part", "_n", "_t")


def prefix_budget(df: DataFrame, *order, part=None) -> DataFrame:
    """Rows up to the first that exceeds the query's tokens or frames, with ``rank`` and ``running_tokens``; the order begins with ``anchored``."""
    return ranked(df, list(order), F.lit(0).cast("long") if part is None else part, True).where("rank <= q_frames AND running_tokens <= q_tokens")


def fold_budget(df: DataFrame, order: list, cost: str, extra: list[str]) -> DataFrame:
    """(query_id, frame_no, *extra, rank, cost, keep, remaining): rows in order, each kept if it still fits; ``remaining`` is before it.

    ``df`` needs query_id, frame_no, q_tokens and q_frames.
    """
    cols = ["query_id", "frame_no", *extra]
    schema = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches):
        query, used, n, rank = object(), 0, 0, 0
        for b in batches:
            rows = []
            for q, c, tokens, frames in zip(*(b.column(k).to_pylist() for k in ("query_id", "_cost", "q_tokens", "q_frames"))):
                if q != query:
                    query, used, n, rank = q, 0, 0, 0
                keep = n < frames and used + c <= tokens
                rank += 1
                rows.append((rank, c, keep, tokens - used))
                if keep:
                    used, n = used + c, n + 1
            got = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), *(pa.array(g, t) for g, t in zip(got, (pa.int64(), pa.int64(), pa.bool_(), pa.int64())))], names=[*cols, "rank", "cost", "keep", "remaining"])

    ready = df.withColumn("_cost", F.coalesce(F.col(cost), F.lit(0)).cast("long"))
    ready = ready.repartition("query_id").sortWithinPartitions("query_id", *order).select(*cols, "_cost", "q_tokens", "q_frames")
    return ready.mapInArrow(run, ", ".join([*(f"`{c}` {schema[c]}" for c in cols), "rank long, cost long, keep boolean, remaining long"]))


def budget_split(df: DataFrame, total: str, group: str, order: str) -> DataFrame:
    """``share`` of ``total`` for each row of a group: equal, the first rows one more, summing exactly."""
    w = Window.partitionBy(group)
    return df.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("share", F.expr(f"{total} div _n") + F.when(F.col("_i") < F.col(total) % F.col("_n"), 1).otherwise(0)).drop("_n", "_i")


def neighbors(frames: DataFrame, starts: DataFrame, depth: int, rels: list[str] | None = None) -> DataFrame:
    """(query_id, frame_no, hops): frames at most ``depth`` steps from each query's places (query_id, uri), with their least distance.

    A step goes from a place to the frames that are at it or point at it by one of ``rels`` (all if none are given), and on to the places
    that these are at or point at. No frame is visited twice. Each step's frames are written to the shared folder.
    """
    nodes = frames.where("uri IS NOT NULL").select("frame_no", "uri")
    edges = frames.select("frame_no", F.explode("relations").alias("r")).where("r.target_uri IS NOT NULL")
    edges = (edges if rels is None else edges.where(F.col("r.rel").isin(rels))).select("frame_no", F.col("r.target_uri").alias("uri")).distinct()
    there = nodes.unionByName(edges)
    seen, places = None, starts.distinct()
    for hops in range(1, depth + 1):
        near = there.join(places, "uri").select("query_id", "frame_no").distinct()
        near = near if seen is None else near.join(seen, ["query_id", "frame_no"], "left_anti")
        near = materialise(near.withColumn("hops", F.lit(hops)), "neighbors")
        seen = near if seen is None else seen.unionByName(near)
        places = near.join(there, "frame_no").select("query_id", "uri").distinct()
    return seen


def scored(df: DataFrame) -> DataFrame:
    """``relevance`` of each offer to its query's text and goal."""
    return df.withColumn("relevance", X.relevance(X.terms("query_text", "goal"), "title", "content"))
