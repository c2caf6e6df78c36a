"""Frames made from sources: symbols and graphs of code, grep hits, resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import expr as X
from spanforge.operators import scan

#: fixed values: score of the first row, step by rank
SNIPPET, SYMBOL, LEAST = (0.95, 0.03), (0.9, 0.02), 0.05
#: ranks after which a snippet's score falls no further
FALLS = 31
#: fixed values: what the media type of code contains, or begins with
CODE_TYPES, CODE_STARTS = ["rust", "javascript", "python", "typescript"], ["text/x-", "application/"]


def decayed(rank: Column, first_step: tuple[float, float]) -> Column:
    """Score by rank from 0, in single precision, never under LEAST nor over 1."""
    first, step = (F.lit(x).cast("float") for x in first_step)
    return F.least(F.greatest((first - step * rank.cast("float")).cast("float"), F.lit(LEAST).cast("float")), F.lit(1).cast("float"))


def symbol_frames(documents: DataFrame) -> DataFrame:
    """One frame per definition, its line as it is: (doc_id, line_no, frame_id, title, content, content_digest, token_cost, citation_label, score, target_uri)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    path = F.col("doc_id").cast("string")
    rows = scan.raw_lines(documents).where(F.col("line").rlike(scan.DEFINITION))
    found = rows.select("doc_id", "line_no", "raw", F.regexp_extract("line", scan.DEFINITION, 1).alias("keyword"), F.regexp_extract("line", scan.DEFINITION, 2).alias("name")).withColumn("rank", F.row_number().over(w) - 1)
    return found.select(
        "doc_id", "line_no", F.concat(F.lit("sym:"), path, F.lit("#"), "name").alias("frame_id"), F.concat_ws(" ", "keyword", "name").alias("title"), F.col("raw").alias("content"), X.digest_of("raw").alias("content_digest"),
        X.budget_tokens("raw").alias("token_cost"), F.concat(path, F.lit(" L"), F.col("line_no").cast("string")).alias("citation_label"), decayed(F.col("rank"), SYMBOL).alias("score"), symbol_uri(path, F.col("name")).alias("target_uri"),
    )


def graph_summaries(documents: DataFrame) -> DataFrame:
    """(doc_id, summary): what a text defines, imports and calls, each in order of lines, parts without content left out. Bounded by the text."""
    in_order = lambda df, name: df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "name"))), lambda x: x["name"]), ", ").alias(name))
    parts = in_order(scan.definitions(documents), "d").join(in_order(scan.imports(documents), "i"), "doc_id", "full").join(in_order(scan.calls(documents), "c"), "doc_id", "full")
    text = F.concat_ws("; ", F.concat(F.lit("defines "), "d"), F.concat(F.lit("imports "), "i"), F.concat(F.lit("calls "), "c"))
    return parts.select("doc_id", text.alias("summary"))


def symbol_uri(path: Column, name) -> Column:
    return F.concat(F.lit("symbol://"), path, F.lit("#"), name)


def graph_edges(documents: DataFrame) -> DataFrame:
    """(doc_id, rel, target_uri, display_name): the edges of each text to what it defines, imports and calls."""
    path = F.col("doc_id").cast("string")
    edge = lambda df, rel, target: df.select("doc_id", F.lit(rel).alias("rel"), target.alias("target_uri"), F.col("name").alias("display_name"))
    own = symbol_uri(path, F.col("name"))
    return edge(scan.definitions(documents), "code.defines", own).unionByName(edge(scan.imports(documents), "code.imports", F.concat(F.lit("symbol://"), "name"))).unionByName(edge(scan.calls(documents), "code.calls", own))


def grep_frames(documents: DataFrame, terms: list[str]) -> DataFrame:
    """A snippet frame per matching line, its line as it is; where nothing matches anywhere, the first line of every text.

    Scores fall by rank over all matches, in order of document and line, down to LEAST; so only the first ``FALLS`` need a rank.
    """
    rows = scan.raw_lines(documents)
    hits = rows.where(scan.has_any("line", terms))
    if hits.isEmpty():
        hits = rows.join(scan.first_lines(documents).select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi")
    order = ["doc_id", "line_no"]
    first = hits.select(*order).orderBy(*order).limit(FALLS).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)
    place = F.concat(F.col("doc_id").cast("string"), F.lit(" L"), F.col("line_no").cast("string"))
    score = F.coalesce(decayed(F.col("rank"), SNIPPET), F.lit(LEAST).cast("float"))
    return hits.where(~X.is_blank("line")).join(first, order, "left").select(
        *order, F.concat(F.lit("rg:"), F.replace(place, F.lit(" "), F.lit("#"))).alias("frame_id"), place.alias("title"), F.col("raw").alias("content"), X.digest_of("raw").alias("content_digest"), X.budget_tokens("raw").alias("token_cost"), score.alias("score"),
    )


def kind_for(media_type: str) -> Column:
    """``snippet`` for media types of code, else ``doc``."""
    t = F.col(media_type)
    code = F.lit(False)
    for x in CODE_TYPES:
        code = code | F.contains(t, F.lit(x))
    for x in CODE_STARTS:
        code = code | t.startswith(x)
    return F.when(F.coalesce(code, F.lit(False)), "snippet").otherwise("doc")


def resource_frames(resources: DataFrame) -> DataFrame:
    """Resources (uri, title, text, media_type) as frames with digest, cost, provenance and an edge to their overview."""
    return resources.select(
        X.frame_id_for("uri").alias("frame_id"),
        "uri",
        kind_for("media_type").alias("kind"),
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), X.basename("uri")).alias("title"),
        F.col("text").alias("content"),
        X.digest_of("text").alias("content_digest"),
        X.budget_tokens("text").alias("token_cost"),
        F.concat("uri", F.lit("#overview")).alias("overview"),
        F.when(F.col("uri").startswith("file://"), 2).otherwise(1).alias("links"),
    )
