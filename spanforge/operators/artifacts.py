"""Pasted text as a provider: each distinct block of a paste is an artifact, served full, compact or as a reference.

A paste is a document. Its path blocks become anchors, every other block an artifact known by the digest of its text; blocks of equal
text are one artifact of the paste. All that is said of an artifact follows from its block, so artifacts are one pass over the texts
and a grouping by (paste, artifact); answers to queries are a fold over the artifacts of one paste, held by no task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import expr as X
from spanforge.functions.vocabulary import looked_up
from spanforge.operators import ingest, retrieve

PROVIDER, IMPLEMENTATION, VERSION = "prompt-ingest", "spanforge/ingest", "1"
#: fixed values, by kind of block
FRAME_KIND = {"log": "episode", "trace": "episode", "table": "fact", "code": "snippet", "prose": "doc"}
LABEL = {"log": "pasted log", "trace": "pasted stack trace", "table": "pasted table", "code": "pasted code", "prose": "pasted note"}
NOUN = {"log": "log", "trace": "stack trace", "table": "table", "code": "code"}
METHOD = {"log": "extractive_summary", "trace": "stack_frame_head", "table": "tabular_sample", "code": "truncation"}
PRIOR = {"trace": "0.85", "log": "0.8", "code": "0.75", "table": "0.7", "prose": "0.5", "path": "0.0"}
REPRESENTATIONS = ["full", "compact", "reference"]

def _none() -> Column:
    return F.lit(None).cast("string")


def _of_kind(table: dict[str, str]) -> Column:
    return looked_up(F.col("kind"), table, _none())


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, block, kind, summary, outcome, id, inline_tokens, source_tokens): what each block of a paste was taken for and became.

    ``outcome``: 'anchor' (``id`` is its text), 'frame' or 'duplicate' of an earlier block of the paste.
    """
    b = ingest.ingest(documents, with_content=True)
    return _named(b).select("doc_id", "block", "kind", "summary", "outcome", F.when(F.col("outcome") == "anchor", F.trim("content")).otherwise(F.col("frame_id")).alias("id"), "inline_tokens", "source_tokens")


def _named(b: DataFrame) -> DataFrame:
    lines = F.size(F.split(F.regexp_replace("content", r"\n\z", ""), "\n"))
    title = F.when(F.col("kind") == "prose", "note").when(F.col("kind") == "path", "path").otherwise(F.concat(_of_kind(NOUN), F.lit(" · "), lines.cast("string"), F.lit(" lines")))
    anchor = F.col("kind") == "path"
    inline = F.coalesce("compact_tokens", "tokens")
    told = F.when(F.col("compact").isNotNull(), F.concat("title", F.lit(" · "), F.col("tokens").cast("string"), F.lit(" → "), inline.cast("string"), F.lit(" tokens"))).otherwise(F.concat("title", F.lit(" · "), F.col("tokens").cast("string"), F.lit(" tokens")))
    first = F.min("block").over(Window.partitionBy("doc_id", "frame_id"))  # the blocks of one text in one paste
    rows = b.withColumn("title", title).withColumn("frame_id", F.concat(F.lit("frm_"), X.short_hash("digest"), F.when(anchor, F.lit("#")).otherwise(F.lit(""))))
    return (
        rows.withColumn("outcome", F.when(anchor, "anchor").when(F.col("block") == first, "frame").otherwise("duplicate"))
        .withColumn("summary", F.when(anchor, F.concat(F.lit("anchor · "), F.trim("content"))).otherwise(told))
        .withColumns({"inline_tokens": F.when(~anchor, inline), "source_tokens": F.when(~anchor, F.col("tokens"))})
    )


def artifacts(documents: DataFrame) -> DataFrame:
    """One row per artifact of a paste: frame_id, frame_kind, title, citation_label, score, digest, content, inline content, method, fidelity and validity."""
    a = _named(ingest.ingest(documents, with_content=True)).where("outcome = 'frame'")
    short = F.col("compact").isNotNull()
    return a.select(
        "doc_id", "block", "frame_id", _of_kind(FRAME_KIND).alias("frame_kind"), "title", _of_kind(LABEL).alias("citation_label"), _of_kind(PRIOR).cast("float").alias("score"), "digest", "content",
        F.coalesce("compact", "content").alias("inline"), F.col("tokens").alias("full_tokens"), "inline_tokens", short.alias("compacted"), F.when(short, _of_kind(METHOD)).otherwise("verbatim").alias("method"),
        F.when(short, "summarized").otherwise("exact").alias("fidelity"), "valid_from", "valid_to", "summary",
    )


def as_frames(a: DataFrame, representation: str | Column = "representation", provider: str = PROVIDER) -> DataFrame:
    """Artifacts as frames in the representation that a column names, each with its own cost and digest."""
    r = F.col(representation) if isinstance(representation, str) else representation
    full, compact, reference = (r == x for x in REPRESENTATIONS)
    content = F.when(full, F.col("content")).when(compact, F.col("inline"))
    handle = F.struct(F.lit(provider).alias("provider_id"), F.concat(F.lit(f"context://{provider}/artifacts/"), "digest").alias("uri"), _none().alias("expires_at"))
    paste = F.struct(F.lit("derivation").alias("type"), _none().alias("uri"), _none().alias("range"), _none().alias("digest"), F.lit("paste").alias("method"), F.lit(IMPLEMENTATION).alias("by"))
    return a.select(
        *(c for c in a.columns if c in ("doc_id", "block", "representation")) if "representation" in a.columns else ("doc_id", "block", r.alias("representation")),
        F.lit(provider).alias("provider_id"), "frame_id", F.col("frame_kind").alias("kind"), "title", "citation_label", "score", content.alias("content"),
        F.when(full, F.col("digest")).when(compact, X.digest_of("inline")).alias("content_digest"),
        F.when(~full, F.col("digest")).alias("canonical_content_hash"),
        F.when(reference, 0).otherwise(X.budget_tokens(content)).cast("long").alias("token_cost"),
        F.when(~full, F.col("full_tokens")).alias("canonical_token_cost"),
        F.when(~full, handle).alias("content_ref"),
        F.when(compact, F.struct(F.col("method"), F.lit(IMPLEMENTATION).alias("implementation"), F.lit(VERSION).alias("version"))).alias("transform"),
        F.when(full, "exact").when(compact, F.col("fidelity")).otherwise("omitted").alias("content_fidelity"),
        F.lit("resolvable_reference_allowed").alias("inline_content_requirement"), F.array(paste).alias("provenance"), "valid_from", "valid_to",
    )


def anchors(documents: DataFrame, given: str | None = None) -> DataFrame:
    """(doc_id, anchors): the anchors a paste came with, then the paths in it, in order, each once. Bounded by the text."""
    found = segments(documents).where("outcome = 'anchor'").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "id"))), lambda x: x["id"]).alias("found"))
    none = F.array().cast("array<string>")
    own = none if given is None else F.coalesce(F.col(given), none)
    return documents.select("doc_id", own.alias("own")).join(found, "doc_id", "left").select("doc_id", F.array_distinct(F.concat("own", F.coalesce("found", none))).alias("anchors"))


def capabilities(a: DataFrame) -> DataFrame:
    """(doc_id, kinds, artifacts, default_budget, …): what the provider of each paste declares; the budget that serves all of it inline."""
    return a.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("frame_kind")).alias("kinds"), F.count("*").alias("artifacts"), F.sum("inline_tokens").alias("default_budget")
    ).withColumns({"egress_scopes": F.array(F.lit("local-only")), "representations": F.array(*map(F.lit, REPRESENTATIONS)), "verify": F.lit(True), "resolve": F.lit(True)})


def answers(a: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, block, frame_id, representation, token_cost, rank, keep): what the provider of a paste answers to each query put to it.

    ``queries``: query_id, doc_id, kinds, max_frames, max_tokens, representation_preferences. The first representation preferred that is
    offered (else full), the kinds asked for, best score first and then by id, each frame that still fits.
    """
    offered = F.array(*map(F.lit, REPRESENTATIONS))
    q = queries.withColumn("representation", F.coalesce(X.first_supported("representation_preferences", offered), F.lit("full")))
    limits = {"q_tokens": F.coalesce("max_tokens", F.lit(retrieve.UNLIMITED)), "q_frames": F.coalesce("max_frames", F.lit(retrieve.UNLIMITED))}
    joined = a.join(q.select("query_id", "doc_id", F.col("kinds").alias("q_kinds"), "representation", *(v.alias(k) for k, v in limits.items())), "doc_id").withColumn("kind", F.col("frame_kind"))
    cost = F.when(F.col("representation") == "full", F.col("full_tokens")).when(F.col("representation") == "compact", F.col("inline_tokens")).otherwise(0)
    ready = retrieve.of_kind(joined).withColumns({"token_cost": cost.cast("long"), "frame_no": F.col("block")})
    folded = retrieve.fold_budget(ready, [F.desc_nulls_last("score"), F.asc("frame_id")], "token_cost", ["doc_id", "frame_id", "representation"])
    return folded.select("query_id", "doc_id", F.col("frame_no").alias("block"), "frame_id", "representation", F.col("cost").alias("token_cost"), "rank", "keep")


def verify(held: DataFrame, a: DataFrame) -> DataFrame:
    """(…, status, replacement_digest) of held identities (doc_id, frame_id, content_digest): an artifact never changes, so its digest, or that of
    its compact rendering, is valid for ever; any other is stale; gone is what the paste never had."""
    served = a.select("doc_id", "frame_id", "digest", F.when(F.col("compacted"), X.digest_of("inline")).alias("inline_digest"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "gone").otherwise(X.held_verdict("content_digest", "digest", "inline_digest"))
    return held.join(served, ["doc_id", "frame_id"], "left").withColumn("status", status).select(*held.columns, "status", F.when(F.col("status") == "stale", F.col("digest")).alias("replacement_digest"))
