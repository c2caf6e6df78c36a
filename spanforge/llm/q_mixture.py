"""Queries on the mixture of sources. SQL has no tokenizer; tests check shares, caps and that blocks are the documents' tokens."""

from __future__ import annotations

from spanforge.llm import mixture
from spanforge.sources.tables import table


def p7_mix(spark, sf_dir):
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark, sf_dir):
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p7_mix": p7_mix, "p7_report": p7_report}
SQL: dict[str, str] = {}
