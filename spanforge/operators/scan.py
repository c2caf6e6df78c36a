"""Line-wise scans of texts: grep, runs of equal lines, definitions, imports and calls in code. All by built-in functions.

Lines number from 1 and end at a line feed, with or without a carriage return before it; a final line feed begins no further line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed values: a definition and an import at the start of a line
DEFINITION = r"^\s*(?:pub\(crate\) |pub )?(?:async )?(fn|struct|enum|trait|mod|type|const) ([\p{IsAlphabetic}\p{N}_]+)"
IMPORT = r"(?s)^\s*(?:pub\(crate\) |pub )?(?:async )?use (.*)$"


def lines(documents: DataFrame) -> DataFrame:
    pieces = F.split("text", "\r?\n")
    whole = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return documents.where("text IS NOT NULL").select("doc_id", F.posexplode(whole).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def raw_lines(documents: DataFrame) -> DataFrame:
    """As ``lines``, with each line's own bytes, its end included, as ``raw``."""
    pieces = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+\z"), 0)).alias("at", "raw"))
    return pieces.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), F.regexp_replace("raw", r"\r?\n\z", "").alias("line"), "raw")


def grep(documents: DataFrame, terms: list[str]) -> DataFrame:
    """Lines that hold any of the terms, in any letter case; no terms, no lines."""
    return lines(documents).where(has_any("line", terms)).select("doc_id", "line_no", "line")


def has_any(line: str, terms: list[str]):
    low, hit = F.lower(line), F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t.lower()))
    return hit


def first_lines(documents: DataFrame) -> DataFrame:
    """The first line of each text that is not blank."""
    return lines(documents).where(F.trim(F.regexp_replace("line", "[\t\r]", " ")) != "").groupBy("doc_id").agg(F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("line_no"))


def matches(found: DataFrame, walked: DataFrame) -> DataFrame:
    """(doc_id, line_no): the places that a first scan found, or, where it found none at all, those of a second; each once."""
    return (walked if found.isEmpty() else found).select("doc_id", "line_no").distinct()


def runs(documents: DataFrame) -> DataFrame:
    """Runs of equal lines: (doc_id, line_no of the first, line, repeats)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines(documents).withColumn("new", F.when(F.lag("line").over(w) == F.col("line"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return marked.groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.min("line").alias("line"), F.count("*").alias("repeats")).drop("run")


def definitions(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, keyword, name) of every definition."""
    found = lines(documents).where(F.col("line").rlike(DEFINITION))
    return found.select("doc_id", "line_no", "line", F.regexp_extract("line", DEFINITION, 1).alias("keyword"), F.regexp_extract("line", DEFINITION, 2).alias("name"))


def imports(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, name) of every import that names something: what stands after ``use``, without the semicolons at its end."""
    rest = F.regexp_extract("line", IMPORT, 1)
    return lines(documents).where(F.col("line").rlike(IMPORT)).select("doc_id", "line_no", F.regexp_replace(rest, r"^\s+|\s*;*\s*$", "").alias("name")).where("name <> ''")


def calls(documents: DataFrame) -> DataFrame:
    """(doc_id, name, line_no of its definition) of functions whose name and an opening bracket are on another line, if only as the end of a longer name.

    Met by name, not by pairs of lines: what stands before a bracket is cut to the lengths that names of the document have.
    """
    defined = definitions(documents).where("keyword = 'fn'").groupBy("doc_id", "name").agg(F.min("line_no").alias("line_no"), F.collect_set("line_no").alias("own"))
    lengths = defined.groupBy("doc_id").agg(F.collect_set(F.length("name")).alias("lengths"))
    used = lines(documents).select("doc_id", F.col("line_no").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([\p{IsAlphabetic}\p{N}_]+)\("), 1))).alias("word"))
    ends = used.join(lengths, "doc_id").withColumn("n", F.explode("lengths")).where("n <= length(word)").select("doc_id", "at", F.expr("right(word, n)").alias("name")).distinct()
    return defined.join(ends, ["doc_id", "name"]).where("size(own) > 1 OR at <> line_no").select("doc_id", "name", "line_no").distinct()
