"""Queries of the general data-processing operators: nested records and repeated deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import drift, exactly_once, shred
from spanforge.sources.tables import materialise, scratch, table


def p2_found(spark, sf_dir):
    return drift.changes(table(spark, sf_dir, "capture_lines")).select("file_name", "msg_type", "old_path", "new_path")


def p2_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "capture_lines")
    stats = materialise(drift.file_statistics(lines), "statistics")
    return drift.consistent_lines(lines, materialise(drift.changes(lines, stats), "drift"), stats=stats)


def p2_failed_casts(spark, sf_dir):
    failed = p2_lines(spark, sf_dir).select("stream", "file_no", "msg_type", F.explode("failed").alias("column"))
    return failed.groupBy("stream", "file_no", "msg_type", "column").agg(F.count("*").alias("lines"))


def p3_found(spark, sf_dir):
    return shred.nested_children(*(table(spark, sf_dir, t) for t in ("wire_messages", "frames", "journal")))


def p3_wire_frames(spark, sf_dir):
    wire = table(spark, sf_dir, "wire_messages")
    flat = shred.json_elements(wire, "msg_id", "payload", "result.frames[]", ["id", "kind", "title", "uri", "token_cost"])
    return flat.withColumnRenamed("pos1", "frame_pos").dropDuplicates()


def p3_wire_links(spark, sf_dir):
    wire = table(spark, sf_dir, "wire_messages")
    flat = shred.json_elements(wire, "msg_id", "payload", "result.frames[].provenance[]", ["type", "uri", "range", "digest", "method", "by"])
    return flat.withColumnsRenamed({"pos1": "frame_pos", "pos2": "child_pos"}).dropDuplicates()


def p3_wire_frame_members(spark, sf_dir):
    """As ``p3_wire_frames``, with every member that the frames have."""
    wire = table(spark, sf_dir, "wire_messages")
    flat = shred.json_elements(wire, "msg_id", "payload", "result.frames[]", shred.element_members(wire, "payload", "result.frames[]"))
    return flat.withColumnRenamed("pos1", "frame_pos").dropDuplicates()


def p3_wire_link_members(spark, sf_dir):
    """As ``p3_wire_links``, with every member that the links have."""
    wire = table(spark, sf_dir, "wire_messages")
    links = "result.frames[].provenance[]"
    flat = shred.json_elements(wire, "msg_id", "payload", links, shred.element_members(wire, "payload", links))
    return flat.withColumnsRenamed({"pos1": "frame_pos", "pos2": "child_pos"}).dropDuplicates()


def p3_frame_links(spark, sf_dir):
    """The provenance links of the frames, with all members and their places."""
    frames = table(spark, sf_dir, "frames").dropDuplicates(["frame_no"])
    return shred.typed_elements(frames, "frame_no", "provenance", {m: m for m in ("type", "uri", "range", "digest", "method", "by")}, "child_pos")


def p3_frame_relations(spark, sf_dir):
    """The relations of the frames, with all members and their places."""
    frames = table(spark, sf_dir, "frames").dropDuplicates(["frame_no"])
    return shred.typed_elements(frames, "frame_no", "relations", {m: m for m in ("rel", "target_uri", "display_name")}, "child_pos")


def p3_query_lists(spark, sf_dir):
    """The kinds, anchors and preferences of the queries, one row for each, with its place."""
    queries = table(spark, sf_dir, "queries").dropDuplicates(["query_id"])
    out = None
    for name in ("kinds", "anchors", "representation_preferences"):
        part = shred.typed_elements(queries, "query_id", name, {"": "value"}, "pos").withColumn("list", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def p3_journal_frames(spark, sf_dir):
    """The frames of every delivery, with all members and their places."""
    members = {f"frame.{m}": m for m in ("provider_id", "frame_id", "content_digest")} | {m: m for m in ("representation", "token_cost", "citation_label")}
    return shred.typed_elements(table(spark, sf_dir, "journal"), "delivery_id", "frames", members, "frame_pos")


def p5_found(spark, sf_dir):
    return exactly_once.journal_surplus(table(spark, sf_dir, "journal")).where("surplus").select(F.col("row").alias("delivery_id"))


def p5_batches(spark, sf_dir):
    """As ``p5_found``, the journal coming in three batches by ``batch_no``, each inserted into what the ones before left."""
    journal, store, out = table(spark, sf_dir, "journal"), scratch(spark, "delivered-store"), None
    low, high = journal.agg(F.min("batch_no"), F.max("batch_no")).first()
    edges = [low + (high + 1 - low) * i // 3 for i in range(4)] if low is not None else []
    for a, b in zip(edges, edges[1:]):
        part = exactly_once.journal_batch(journal.where((F.col("batch_no") >= a) & (F.col("batch_no") < b)), store)
        out = part if out is None else out.unionByName(part)
    rest = exactly_once.journal_batch(journal.where("batch_no IS NULL"), store)
    out = rest if out is None else out.unionByName(rest)
    return out.where("surplus").select(F.col("row").alias("delivery_id"))


def p5_once(spark, sf_dir):
    journal = table(spark, sf_dir, "journal").select("delivery_id", "received_at", "session", "seq", "effect_id", "last_seq_seen", F.lower(F.trim("event")).alias("event"))
    return exactly_once.deliver_once(journal)


#: the elements of a list, of a lone object, or of nothing, with their places
_ITEMS = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE CAST([] AS JSON[]) END"
_ENVELOPES = """m AS (SELECT DISTINCT msg_id, payload FROM wire_messages WHERE json_valid(payload)),
e AS (SELECT msg_id, CASE WHEN json_type(payload) = 'VARCHAR' THEN CASE WHEN json_valid(payload ->> '$') THEN CAST(payload ->> '$' AS JSON) END ELSE CAST(payload AS JSON) END AS j FROM m)"""
_FRAMES = f"""fl AS (SELECT msg_id, {_ITEMS.format("json_extract(j, '$.result.frames')")} AS items FROM e),
f AS (SELECT msg_id, i - 1 AS frame_pos, items[i] AS fr FROM fl, LATERAL (SELECT unnest(range(1, len(items) + 1)) AS i))"""
_LINKS = f"""pl AS (SELECT msg_id, frame_pos, {_ITEMS.format("json_extract(fr, '$.provenance')")} AS items FROM f),
p AS (SELECT msg_id, frame_pos, i - 1 AS child_pos, items[i] AS link FROM pl, LATERAL (SELECT unnest(range(1, len(items) + 1)) AS i))"""

_IDENTIFIED = "session IS NOT NULL AND (effect_id IS NOT NULL OR seq IS NOT NULL)"
_NTH_COPY = f"""row_number() OVER (PARTITION BY {_IDENTIFIED}, session, effect_id, CASE WHEN effect_id IS NULL THEN seq END, CASE WHEN NOT ({_IDENTIFIED}) THEN delivery_id END
ORDER BY received_at, delivery_id)"""

QUERIES = {"p2_found": p2_found, "p2_lines": p2_lines, "p2_failed_casts": p2_failed_casts, "p3_found": p3_found, "p3_wire_frames": p3_wire_frames, "p3_wire_links": p3_wire_links, "p5_found": p5_found, "p5_once": p5_once, "p5_batches": p5_batches}
QUERIES |= {f.__name__: f for f in (p3_wire_frame_members, p3_wire_link_members, p3_frame_links, p3_frame_relations, p3_query_lists, p3_journal_frames)}

SQL = {
    "p3_found": f"""WITH {_ENVELOPES}, {_FRAMES}, {_LINKS},
fr1 AS (SELECT DISTINCT frame_no, provenance FROM frames),
frp AS (SELECT frame_no, i - 1 AS child_pos, provenance[i].uri AS uri FROM fr1, LATERAL (SELECT unnest(range(1, len(provenance) + 1)) AS i)),
jf AS (SELECT delivery_id, i - 1 AS frame_pos, frames[i].frame.frame_id AS frame_id FROM journal, LATERAL (SELECT unnest(range(1, len(frames) + 1)) AS i))
SELECT * FROM (
SELECT 'wire_messages' AS tbl, msg_id AS parent_id, frame_pos, CAST(-1 AS BIGINT) AS child_pos, fr ->> '$.id' AS ref FROM f
UNION ALL SELECT 'wire_messages', msg_id, frame_pos, child_pos, link ->> '$.uri' FROM p
UNION ALL SELECT 'frames', frame_no, -1, child_pos, uri FROM frp
UNION ALL SELECT 'journal', delivery_id, frame_pos, -1, frame_id FROM jf) WHERE ref IS NOT NULL""",
    "p3_wire_frames": f"""WITH {_ENVELOPES}, {_FRAMES}
SELECT msg_id, frame_pos, fr ->> '$.id' AS id, fr ->> '$.kind' AS kind, fr ->> '$.title' AS title, fr ->> '$.uri' AS uri, fr ->> '$.token_cost' AS token_cost FROM f""",
    "p3_wire_links": f"""WITH {_ENVELOPES}, {_FRAMES}, {_LINKS}
SELECT msg_id, frame_pos, child_pos, link ->> '$.type' AS type, link ->> '$.uri' AS uri, link ->> '$.range' AS "range", link ->> '$.digest' AS digest, link ->> '$.method' AS method, link ->> '$.by' AS "by" FROM p""",
    "p3_frame_links": """WITH f AS (SELECT DISTINCT frame_no, provenance FROM frames), p AS (SELECT frame_no, i - 1 AS child_pos, provenance[i] AS p FROM f, LATERAL (SELECT unnest(range(1, len(provenance) + 1)) AS i))
SELECT frame_no, child_pos, p.type AS type, p.uri AS uri, p."range" AS "range", p.digest AS digest, p.method AS method, p."by" AS "by" FROM p""",
    "p3_frame_relations": """WITH f AS (SELECT DISTINCT frame_no, relations FROM frames), p AS (SELECT frame_no, i - 1 AS child_pos, relations[i] AS p FROM f, LATERAL (SELECT unnest(range(1, len(relations) + 1)) AS i))
SELECT frame_no, child_pos, p.rel AS rel, p.target_uri AS target_uri, p.display_name AS display_name FROM p""",
    "p3_query_lists": " UNION ALL ".join(f"SELECT query_id, i - 1 AS pos, {c}[i] AS value, '{c}' AS list FROM (SELECT DISTINCT query_id, {c} FROM queries), LATERAL (SELECT unnest(range(1, len({c}) + 1)) AS i)" for c in ("kinds", "anchors", "representation_preferences")),
    "p3_journal_frames": """WITH j AS (SELECT delivery_id, i - 1 AS frame_pos, frames[i] AS e FROM journal, LATERAL (SELECT unnest(range(1, len(frames) + 1)) AS i))
SELECT delivery_id, frame_pos, e.frame.provider_id AS provider_id, e.frame.frame_id AS frame_id, e.frame.content_digest AS content_digest, e.representation AS representation, e.token_cost AS token_cost, e.citation_label AS citation_label FROM j""",
    "p5_found": f"SELECT delivery_id FROM (SELECT delivery_id, {_NTH_COPY} AS n FROM journal) WHERE n > 1",
    "p5_batches": f"SELECT delivery_id FROM (SELECT delivery_id, {_NTH_COPY} AS n FROM journal) WHERE n > 1",
    "p5_once": f"""SELECT delivery_id, received_at, session, seq, effect_id, last_seq_seen, event FROM
(SELECT delivery_id, received_at, session, seq, effect_id, last_seq_seen, lower(trim(event)) AS event, {_NTH_COPY} AS n FROM journal) WHERE n = 1""",
}
