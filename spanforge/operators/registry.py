"""Sources of frames that a user registers, asked together: each one's answer is held to the contract, none can spoil the others.

A source is a function of (spark, queries) that gives candidate frames; ``serve`` makes of them what the contract allows. The loop
over sources runs on the driver and is as long as the registry; all rows stay in plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import expr as X
from spanforge.operators import audit, retrieve, scan, verify

Source = Callable[[SparkSession, DataFrame], DataFrame]
#: the columns a candidate needs; all others are filled
NEEDED = {"query_id": "long", "frame_id": "string", "content": "string"}
FILLED = {
    "kind": "doc", "title": None, "uri": None, "representation": "full", "score": None, "valid_from": None, "valid_to": None, "recorded_at": None, "citation_label": None,
}
PROVENANCE = "array<struct<type:string,uri:string,range:string,digest:string,method:string,by:string>>"
RELATIONS = "array<struct<rel:string,target_uri:string,display_name:string>>"


def full_frames(rows: DataFrame) -> DataFrame:
    """Rows with NEEDED columns as whole frames: own digest and cost, what is absent as its default."""
    out = rows
    for name, value in FILLED.items():
        if name not in rows.columns:
            out = out.withColumn(name, F.lit(value).cast("float" if name == "score" else "string"))
    for name, kind in (("provenance", PROVENANCE), ("relations", RELATIONS)):
        out = out.withColumn(name, F.coalesce(F.col(name).cast(kind), F.array().cast(kind)) if name in rows.columns else F.array().cast(kind))
    return out.withColumns({"content_digest": X.digest_of("content"), "token_cost": X.budget_tokens("content")})


def reference_frames(rows: DataFrame, handle: str) -> DataFrame:
    """Whole frames as references: no content and no cost, ``handle`` (a column of URIs) to resolve them, the digest of what is left out."""
    kept = rows.withColumns({"canonical_content_hash": F.col("content_digest"), "canonical_token_cost": F.col("token_cost"), "content_ref": F.struct(F.col("provider_id") if "provider_id" in rows.columns else F.lit(None).cast("string").alias("provider_id"), F.col(handle).alias("uri"), F.lit(None).cast("string").alias("expires_at"))})
    return kept.withColumns({"representation": F.lit("reference"), "content": F.lit(None).cast("string"), "content_digest": F.lit(None).cast("string"), "token_cost": F.lit(0).cast("long")})


def file_frames(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``uri`` and ``range`` as whole frames whose provenance is that part of the file."""
    link = F.struct(F.lit("file").alias("type"), F.col("uri"), F.col("range"), X.digest_of("content").alias("digest"), F.lit(None).cast("string").alias("method"), F.lit(by).alias("by"))
    return full_frames(rows.withColumn("provenance", F.array(link)).drop("range"))


def derived_frames(rows: DataFrame, method: str, by: str) -> DataFrame:
    """Rows whose content was made from something else: their provenance says how, and names no bytes."""
    none = F.lit(None).cast("string")
    link = F.struct(F.lit("derivation").alias("type"), none.alias("uri"), none.alias("range"), none.alias("digest"), F.lit(method).alias("method"), F.lit(by).alias("by"))
    return full_frames(rows.withColumn("provenance", F.array(link)))


def serve(candidates: DataFrame, queries: DataFrame, provider_id: str) -> DataFrame:
    """What the contract lets a source answer: the kinds asked for, nothing not yet valid, anchored frames first, up to the query's tokens and frames.

    A frame that comes more than once is kept once, the same one whenever that is computed. All is done within a query, so rows that
    come by query are not moved again.
    """
    missing = [c for c in NEEDED if c not in candidates.columns]
    if missing:
        raise ValueError(f"candidates of {provider_id} lack {', '.join(missing)}")
    rows = (candidates if "token_cost" in candidates.columns else full_frames(candidates)).where("frame_id IS NOT NULL")
    frames = rows.withColumns({"provider_id": F.lit(provider_id), "arrival": F.monotonically_increasing_id(), "frame_no": F.xxhash64("query_id", "frame_id", "content")})
    once = Window.partitionBy("query_id", "frame_no").orderBy("score", "token_cost", "kind", "uri", "relations", "valid_from")
    frames = frames.withColumn("_copy", F.row_number().over(once)).where("_copy = 1").drop("_copy")
    ready = retrieve.valid_as_of(retrieve.of_kind(frames.join(retrieve.wanted(queries), "query_id"))).withColumn("anchored", retrieve.anchored(None))
    return retrieve.prefix_budget(ready, F.desc("anchored"), F.desc_nulls_last("score"), F.asc("frame_id"), F.asc("frame_no"), part=retrieve.by_score())


#: fixed value: how many entries of a word's list meet a query at a time
RUN = 16


def title_frames(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents whose first line holds a word of a query, met by word: of these what ``serve`` keeps, and not every pair there is.

    ``serve`` takes these frames in the order of their ids. What comes before a frame in the list of a word that it shares with a query
    comes before it in the query's answer too, so a list is read as far as the query's frames and tokens reach in it, and through the
    entry that exceeds the tokens, where the answer ends. Rows grow with the lists and the answers; only a query without limits meets whole lists.
    """
    from spanforge.sources.tables import materialise

    part = F.left("frame_id", F.lit(7))  # grows with the ids
    asked = retrieve.wanted(queries.where("query_id IS NOT NULL")).where("q_frames > 0 AND q_tokens > 0").select("query_id", "q_frames", "q_tokens", F.explode(X.grep_terms("query_text", "goal")).alias("word"))
    first = scan.first_lines(documents).where("doc_id IS NOT NULL").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("frame_id"), F.col("line").alias("content"))
    first = materialise(first, "titles")
    words = first.select("frame_id", X.budget_tokens("content").alias("token_cost"), F.explode(F.array_distinct(F.split(F.lower("content"), r"[^\p{IsAlphabetic}\p{N}]+"))).alias("word"))
    reach = asked.groupBy("word").agg(F.max("q_frames").alias("most_frames"), F.max("q_tokens").alias("most_tokens"))
    listed = retrieve.ranked(words.join(reach, "word"), [F.asc("frame_id")], part, by="word").withColumn("before", F.col("running_tokens") - F.col("token_cost"))
    listed = listed.where("rank <= most_frames AND before <= most_tokens").select("word", "frame_id", "token_cost", "before", F.col("rank").alias("place"), F.expr(f"(rank - 1) div {RUN}").alias("run"))
    listed = materialise(listed, "titles")
    # a first line is not blank and costs a token at least, so tokens bound places as well
    asked = asked.join(listed.groupBy("word").agg(F.max("run").alias("last")), "word").withColumn("run", F.explode(F.expr(f"sequence(0, least(last, (q_frames - 1) div {RUN}, q_tokens div {RUN}))")))
    hits = asked.join(listed, ["word", "run"]).where("place <= q_frames AND before <= q_tokens").select("query_id", "frame_id", "token_cost", "q_frames", "q_tokens").distinct()
    kept = retrieve.ranked(hits, [F.asc("frame_id")], part).where("rank <= q_frames AND running_tokens <= q_tokens")
    return kept.select("query_id", "frame_id").join(first, "frame_id")


class Registry:
    """Providers by id: what they declare (a row like those of ``providers``) and the source that answers for them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sources, self.declared = spark, {}, {}

    def register(self, provider_id: str, source: Source, kinds: list[str] | None = None, egress: bool = False, egress_scopes: list[str] | None = None) -> None:
        """Add a provider, or put another in its place."""
        self.sources[provider_id] = source
        self.declared[provider_id] = (provider_id, kinds or [], egress, egress_scopes or [])

    def remove(self, provider_id: str) -> bool:
        return self.sources.pop(provider_id, None) is not None and self.declared.pop(provider_id) is not None

    def providers(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.declared.values()), "provider_id string, kinds array<string>, egress boolean, egress_scopes array<string>")

    def ask(self, provider_id: str, queries: DataFrame) -> DataFrame:
        """One provider's answer as it is, not audited; an unknown one is an error."""
        return serve(self.sources[provider_id](self.spark, queries), queries, provider_id)

    def ask_all(self, queries: DataFrame, receipts: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(frames, legs): the frames of all legs that passed; one row per provider and query, (query_id, provider_id, outcome), whatever came of it.

        Nothing is sent to a provider without consent. A source that fails, at once or when its rows are made, fails alone: its rows are
        written to the shared folder by themselves. What each provider is asked is written too, as the plan of a source may read it many times.
        """
        from spanforge.sources.tables import materialise

        gate = {r.provider_id: r.decision for r in audit.consent(self.providers(), receipts, records).collect()}  # one row per registered provider
        relevant = materialise(retrieve.relevant_providers(queries, self.providers()), "relevant")
        answered, outcomes = [], []
        for provider_id in sorted(self.sources):
            mine = relevant.where(F.col("provider_id") == provider_id).select("query_id")
            outcome = gate[provider_id]
            if outcome == "permitted":
                asked = materialise(queries.join(mine, "query_id", "left_semi"), "asked")
                try:
                    answered.append(materialise(serve(self.sources[provider_id](self.spark, asked), asked, provider_id).drop("rank", "running_tokens", "anchored"), "answer"))
                    continue
                except Exception:  # whatever a user's source raises is its own failure
                    outcome = "failed"
            outcomes.append(mine.select("query_id", F.lit(provider_id).alias("provider_id"), F.lit(outcome).alias("outcome")))
        offers = None
        for part in answered:
            offers = part if offers is None else offers.unionByName(part, allowMissingColumns=True)
        legs = None if offers is None else audit.legs(offers).select("query_id", "provider_id", "outcome")
        for part in outcomes:
            legs = part if legs is None else legs.unionByName(part)
        silent = relevant.where(F.col("provider_id").isin([p for p in self.sources if gate[p] == "permitted"])).join(legs.select("query_id", "provider_id"), ["query_id", "provider_id"], "left_anti")
        legs = legs.unionByName(silent.select("query_id", "provider_id", F.lit("frames").alias("outcome")))  # asked, and nothing to say
        return (None if offers is None else audit.accepted(offers)), legs


def uniform(held: DataFrame, status: str = "unknown") -> DataFrame:
    """The same verdict for every held identity: what a provider that cannot verify answers."""
    return held.select("provider_id", "frame_id", "content_digest", F.lit(status).alias("status"), F.lit(None).cast("string").alias("replacement_digest"))


def verify_with(held: DataFrame, current: DataFrame | None) -> DataFrame:
    """Verdicts of a provider that knows what it serves, or ``unknown`` for all."""
    return uniform(held) if current is None else verify.verdicts(held, current)
