"""Comparison of a Spark result with a DuckDB result: columns by name, rows in any order."""

import datetime
import decimal
import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def same(spark, duck, query, sql, sf):
    df = query(spark, sf)
    got, want = rows(df.columns, df.collect()), duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())
