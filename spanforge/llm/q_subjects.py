"""Queries on subject areas. SQL has no language models; tests measure them on held-out labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.llm import subjects
from spanforge.sources.tables import table


def p8_subjects(spark, sf_dir):
    return subjects.subject_areas(*(table(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")))


def p8_found(spark, sf_dir):
    return p8_subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark, sf_dir):
    """Documents and characters of each subject."""
    chars = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return p8_found(spark, sf_dir).join(chars, "doc_id").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


QUERIES = {"p8_found": p8_found, "p8_subjects": p8_subjects, "p8_composition": p8_composition}
SQL: dict[str, str] = {}
