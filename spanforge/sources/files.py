"""File trees as rows, and the bytes that provenance addresses in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import expr as X

#: fixed values
SKIPPED = ["target", "node_modules"]
TEXT = ["rs", "md", "mdx", "txt", "toml", "json", "py", "ts", "js", "go", "yaml", "yml", "sh", "cfg", "ini", "html", "css"]


def tree(spark: SparkSession, root: str, text_only: bool = True) -> DataFrame:
    """(path, bytes) below ``root``, without build, dependency and hidden folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("content").alias("bytes"))
    inside = F.regexp_replace("path", F.lit(r"^file:/+"), F.lit("/"))
    rel = F.substring_index(inside, root.rstrip("/") + "/", -1)
    kept = files.withColumn("rel", rel).where(~F.col("rel").rlike(rf"(^|/)(\.[^/]*|{'|'.join(SKIPPED)})/"))
    return kept.where(F.regexp_extract("rel", r"\.([^./]+)$", 1).isin(TEXT)) if text_only else kept


def file_path(uri) -> Column:
    """The path of a ``file://`` URI with an empty or local authority, percent-decoded (a plus sign stays); else null."""
    rest = F.regexp_extract(uri, r"^file://(?:localhost)?(/.*)$", 1)
    plain = F.replace(rest, F.lit("+"), F.lit("%2B"))
    return F.when(rest != "", F.try_url_decode(plain))


def line_range(text, range_) -> Column:
    """Lines a to b (``La-b``, ``La`` or none for all) of a text, each with its newline; null for an empty, inverted or absent range."""
    a = F.regexp_extract(range_, r"^L(\d+)(?:-L?(\d+))?$", 1).try_cast("int")
    b = F.coalesce(F.regexp_extract(range_, r"^L(\d+)(?:-L?(\d+))?$", 2).try_cast("int"), a)
    lines = F.filter(F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+$"), 0), lambda x: x != "")
    part = F.when((a >= 1) & (b >= a) & (a <= F.size(lines)), F.array_join(F.slice(lines, a, b - a + 1), ""))
    return F.when(F.isnull(range_), F.col(text) if isinstance(text, str) else text).otherwise(part)


def provenance_status(links: DataFrame, files: DataFrame) -> DataFrame:
    """``status`` of each link (type, uri, range, digest): not_file, unreadable, mismatch or verified against ``files`` (uri, text)."""
    parts = links.where("type = 'file' AND uri IS NOT NULL").select("uri", "range").distinct()  # each place is read and hashed once, however many links name it
    read = parts.join(files.select("uri", "text"), "uri").select("uri", "range", X.digest_of(line_range("text", F.col("range"))).alias("actual"))
    found = links.join(read.withColumnsRenamed({"uri": "_uri", "range": "_range"}), F.col("uri").eqNullSafe(F.col("_uri")) & F.col("range").eqNullSafe(F.col("_range")), "left")
    return found.select(
        *(c for c in links.columns),
        F.when(~F.coalesce(F.col("type") == "file", F.lit(False)), "not_file").when(F.col("actual").isNull() | F.col("digest").isNull(), "unreadable").when(F.col("actual") != F.col("digest"), "mismatch").otherwise("verified").alias("status"),
    )
