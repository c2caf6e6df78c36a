"""Queries on packing frames into prompts and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.llm import containers
from spanforge.sources.tables import table


def p4_found(spark, sf_dir):
    packed = containers.prompts(table(spark, sf_dir, "frames"), table(spark, sf_dir, "queries"))
    return packed.where("parts <> 1").select("query_id", "frame_no").distinct()


def p4_prompts(spark, sf_dir):
    return containers.prompts(table(spark, sf_dir, "frames"), table(spark, sf_dir, "queries"))


def p4_fill(spark, sf_dir):
    """Per query: tokens packed, and the least number of prompts that could hold them."""
    capacity = table(spark, sf_dir, "queries").select("query_id", "max_tokens").dropDuplicates()
    packed = p4_prompts(spark, sf_dir).where("container IS NOT NULL").groupBy("query_id").agg(F.sum("part_size").alias("tokens"))
    return packed.join(capacity, "query_id").select("query_id", "max_tokens", "tokens", F.expr("(tokens + max_tokens - 1) div max_tokens").alias("least_prompts"))


def p4_waste(spark, sf_dir):
    """Per query: prompts used and the room left over in them."""
    capacity = table(spark, sf_dir, "queries").select("query_id", "max_tokens").dropDuplicates()
    own = F.when((F.col("part") == 0) & (F.col("parts") > 1), F.expr("part_size div max_tokens")).otherwise(1)
    packed = p4_prompts(spark, sf_dir).where("container IS NOT NULL").join(capacity, "query_id")
    used = packed.groupBy("query_id", "max_tokens").agg(F.max(F.col("container") + own).alias("prompts"), F.sum("part_size").alias("tokens"))
    return used.select("query_id", "prompts", "tokens", (F.col("prompts") * F.col("max_tokens") - F.col("tokens")).alias("room_left"))


def p4_plans(spark, sf_dir):
    """Per query: prompts of its plan, the least that could do, and what packing greedily alone takes."""
    offers = containers.offered(table(spark, sf_dir, "frames"), table(spark, sf_dir, "queries"))
    return containers.fill_report(offers, "query_id", "frame_no", "token_cost", "capacity")


QUERIES = {"p4_found": p4_found, "p4_prompts": p4_prompts, "p4_fill": p4_fill, "p4_waste": p4_waste, "p4_plans": p4_plans}

SQL = {
    "p4_found": "SELECT DISTINCT f.query_id, f.frame_no FROM frames f JOIN queries q ON f.query_id = q.query_id WHERE f.token_cost > q.max_tokens",
    "p4_fill": """SELECT f.query_id, q.max_tokens, sum(f.token_cost)::BIGINT AS tokens, ((sum(f.token_cost) + any_value(q.max_tokens) - 1) // any_value(q.max_tokens))::BIGINT AS least_prompts
FROM (SELECT DISTINCT frame_no, query_id, token_cost FROM frames WHERE token_cost IS NOT NULL) f JOIN (SELECT DISTINCT query_id, max_tokens FROM queries WHERE max_tokens IS NOT NULL) q ON f.query_id = q.query_id GROUP BY f.query_id, q.max_tokens""",
}
