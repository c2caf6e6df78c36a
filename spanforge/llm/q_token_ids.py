"""Queries on token ids. SQL has no tokenizer; tests hold them against the tokenizer's own library."""

from __future__ import annotations

from spanforge.llm import token_ids
from spanforge.sources.tables import table


def p6_ids(spark, sf_dir):
    return token_ids.encode(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
