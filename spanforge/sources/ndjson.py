"""Envelopes and journals as NDJSON, one value per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "type string, id string, protocol_version string, code string, message string, query struct<goal:string,query_text:string,kinds:array<string>,anchors:array<string>,max_frames:bigint,max_tokens:bigint,as_of string>, result struct<truncated:boolean,dropped_estimate:bigint>, broken string".replace("as_of string>", "as_of:string>")
JOURNAL = "seq bigint, at string, session string, turn bigint, event string, agent string, harness string, model string, outcome string, last_seq_seen bigint, budget_tokens bigint, declared_total_tokens bigint, composition_digest string, frames array<struct<frame:struct<provider_id:string,frame_id:string,content_digest:string>,representation:string,token_cost:bigint,citation_label:string>>, tool_calls array<string>, call_id string, tool string, status string, frame struct<provider_id:string,frame_id:string,content_digest:string>, verdict struct<status:string,replacement_digest:string>, effect_id string, kind string, broken string"
#: fixed value: a line of more bytes is an error
MAX_LINE = 16 * 1024 * 1024


def parsed(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """``column`` as ``schema``; unknown members are left out; a line that is no such object is kept in ``broken``, blank lines are not rows.

    A line of more than ``MAX_LINE`` bytes is broken too; ``broken`` says so in its place.
    """
    long = F.octet_length(column) > MAX_LINE
    rows = lines.where(F.trim(F.regexp_replace(column, r"\s", " ")) != "")
    got = rows.withColumn("_p", F.from_json(F.when(~long, F.col(column)), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})).withColumn("_long", long).select(*lines.columns, "_p.*", "_long")
    return got.withColumn("broken", F.when(F.col("_long"), F.lit(f"line of more than {MAX_LINE} bytes")).otherwise(F.col("broken"))).drop("_long")


def unwrapped(column: str):
    """``column``, or the envelope inside it where it is a JSON string that holds one (at most four deep, as ``shred.load_json``)."""

    def inner(text, _):
        held = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
        wrapped = F.ltrim(text).startswith('"') & (F.length(text) <= 2 * MAX_LINE)
        return F.when(wrapped & (F.size(held) == 1) & held[0].rlike(r'^\s*[{"]'), held[0]).otherwise(text)

    return F.aggregate(F.array(*map(F.lit, range(4))), F.col(column), inner)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path), "value", ENVELOPE).drop("value")


def read_journal(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A recorded journal; ``strict`` fails on a malformed line or an empty journal, as nothing can then be said of it."""
    rows = parsed(spark.read.text(path), "value", JOURNAL).drop("value")
    if strict:
        n, bad = rows.agg(F.count("*"), F.count_if(F.col("broken").isNotNull() | F.col("event").isNull())).first()
        if bad or not n:
            raise ValueError(f"{bad} malformed lines of {n} in {path}")
    return rows


def write_ndjson(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Each row as one JSON line; null members are left out."""
    df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "true"}).alias("value")).write.text(path)


def unknown_members(lines: DataFrame, column: str, known: list[str]) -> DataFrame:
    """``unknown``: top-level members a strict reader would refuse."""
    return lines.withColumn("unknown", F.array_sort(F.array_except(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")), F.array(*(F.lit(k) for k in known)))))
