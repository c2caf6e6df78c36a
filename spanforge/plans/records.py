"""Queries of the record layer. The tables have few records, so documents and frames stand for them: what stands for what is said of each query."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import expr as X
from spanforge.operators import records, retrieve
from spanforge.plans.frames import _BLANK, _F, _Q, _frames
from spanforge.sources.tables import table

NOW = "2026-07-01T00:00:00Z"


def _commands(spark, d):
    """Each document as a command to append a record: its label is the record, its uri the key that its source chose."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, d, "documents").select(
        "doc_id", F.lower(F.trim("source")).alias("authority_id"), F.lit("client").alias("client_id"), F.lit("append").alias("operation"), F.col("uri").alias("idempotency_key"),
        records.command_hash(digest, "kind", "lang").alias("command_hash"), F.col("citation_label").alias("record_id"), digest.alias("record_hash"), F.col("kind").alias("requested_retention"), F.col("recorded_at").alias("expires_at"),
    )


def record_commands(spark, d):
    """All commands against a ledger that has the first of each key: what becomes of each."""
    c = _commands(spark, d)
    key = ["authority_id", "client_id", "operation", "idempotency_key"]
    first = c.groupBy(*key).agg(F.min_by(F.struct("command_hash", "record_id", "record_hash", "expires_at"), "doc_id").alias("x")).select(*key, "x.*")
    return records.append_commands(c.drop("expires_at"), first, NOW).groupBy("status").agg(F.count("*").alias("commands"))


def record_retention(spark, d):
    """Commands that ask for a retention (the document's kind) which is not honoured."""
    return records.retention_gate(_commands(spark, d), ["prose", "log", "code"]).select("doc_id", "status")


def record_get(spark, d):
    """The uris that frames refer to, asked of the documents as records of their source, by a principal of one source."""
    docs = table(spark, d, "documents").where("uri IS NOT NULL").select(F.col("uri").alias("record_id"), F.lower(F.trim("source")).alias("workspace_id"))
    one = docs.where("workspace_id IS NOT NULL").agg(F.min("workspace_id")).first()[0]
    asked = _frames(spark, d).where("uri IS NOT NULL").select(F.col("uri").alias("record_id")).distinct()
    return records.get(asked, docs, {"workspace_id": one}, ["workspace_id"])


def record_resolve(spark, d):
    """The handles of frames resolved against the documents, whose text must have the frame's digest."""
    docs = table(spark, d, "documents").where("uri IS NOT NULL").groupBy("uri").agg(F.min_by("text", "doc_id").alias("text")).select("uri", X.digest_of("text").alias("digest"))
    asked = _frames(spark, d).where("content_ref IS NOT NULL").select(F.coalesce("content_ref.uri", "uri").alias("uri"), F.col("content_digest").alias("digest"), F.col("content_ref.expires_at").alias("expires_at"))
    return records.resolve(asked, docs, NOW).groupBy("status").agg(F.count("*").alias("requests"))


def record_attestations(spark, d):
    """Frames as records under their digest; a provenance link with a digest attests it, signed by who made the link, at the instant of its frame."""
    f = _frames(spark, d)
    kept = f.where("content_digest IS NOT NULL").select(F.col("frame_no").alias("record_id"), F.col("content_digest").alias("record_hash"))
    links = f.select("recorded_at", F.explode("provenance").alias("p")).where("p.digest IS NOT NULL")
    signed = links.select(F.col("p.digest").alias("signed_record_hash"), F.col("p.by").alias("key_id"), F.col("recorded_at").alias("issued_at"), "p.uri")
    keys = signed.where("key_id IS NOT NULL").select("key_id", F.lit("2026-01-01T00:00:00Z").alias("valid_from"), F.lit(NOW).alias("valid_to")).distinct()
    return records.attested(kept, signed, keys)


def query_filters(spark, d):
    """Frames of files in a folder and of one kind."""
    return records.filtered(_frames(spark, d), {"path": "file:///**", "kind": "doc", "language": "x"}, {"path": "uri", "kind": "kind"}, unknown="ignore").select("frame_no")


def use_reconciliation(spark, d):
    """Frames that journals rendered, as reported uses, against the frames served, as records of use."""
    uses = table(spark, d, "journal").select(F.explode("frames").alias("e")).where("e.frame.frame_id IS NOT NULL").select(F.col("e.frame.frame_id").alias("used_record_ref"), F.lit(True).alias("selected"), (F.coalesce("e.representation", F.lit("full")) != "reference").alias("rendered"), (~X.is_blank("e.citation_label")).alias("cited"))
    kept = _frames(spark, d).where("frame_id IS NOT NULL").select(F.lit("context_use").alias("record_kind"), F.col("frame_id").alias("used_record_ref"), F.lit(True).alias("selected"), (F.coalesce("representation", F.lit("full")) != "reference").alias("rendered"), (~X.is_blank("citation_label")).alias("cited"))
    return records.reconciled(uses, kept).groupBy("in_report", "in_records", "same").agg(F.count("*").alias("frames"))


def normalised_frames(spark, d):
    """Frames with empty lists for absent ones."""
    return records.normalised(_frames(spark, d), ["provenance", "relations"]).select("frame_no", F.size("provenance").alias("links"), F.size("relations").alias("relations"))


def neighbors_by_relation(spark, d):
    """Frames at most two steps from each query's anchors over two relations only."""
    q = table(spark, d, "queries").dropDuplicates(["query_id"])
    starts = q.select("query_id", F.explode(F.array_distinct("anchors")).alias("uri")).where("uri IS NOT NULL")
    return retrieve.neighbors(_frames(spark, d), starts, 2, ["code.calls", "doc.documents"]).select("query_id", "frame_no", "hops")


QUERIES = {f.__name__: f for f in (record_commands, record_retention, record_get, record_resolve, record_attestations, query_filters, use_reconciliation, normalised_frames, neighbors_by_relation)}

_C = """c AS (SELECT doc_id, lower(trim(source)) AS a, uri AS k, sha256(concat_ws(chr(10), coalesce(sha256(text), ''), coalesce(kind, ''), coalesce(lang, ''))) AS ch, citation_label AS rid, sha256(text) AS rh, kind, recorded_at FROM documents)"""

SQL = {
    "record_commands": f"""WITH {_C}, l AS (SELECT a, k, first(ch ORDER BY doc_id) AS ch, first(rid ORDER BY doc_id) AS rid, first(rh ORDER BY doc_id) AS rh, first(recorded_at ORDER BY doc_id) AS ex FROM c GROUP BY a, k),
s AS (SELECT rid, min(rh) AS r0, max(rh) AS r1 FROM l WHERE rid IS NOT NULL GROUP BY rid),
x AS (SELECT CASE WHEN l.ch IS NOT NULL AND l.ex <= '{NOW}' THEN 'idempotency_expired' WHEN l.ch = c.ch THEN 'duplicate' WHEN l.ch IS NOT NULL THEN 'idempotency_conflict' WHEN r0 IS NOT NULL AND (r0 IS DISTINCT FROM c.rh OR r1 IS DISTINCT FROM c.rh) THEN 'record_identity_conflict' ELSE 'accepted' END AS status
FROM c LEFT JOIN l ON l.a = c.a AND l.k = c.k LEFT JOIN s ON s.rid = c.rid) SELECT status, count(*) AS commands FROM x GROUP BY 1""",
    "record_retention": "SELECT doc_id, CASE WHEN kind NOT IN ('prose', 'log', 'code') THEN 'retention_rejected' END AS status FROM documents",
    "record_get": f"""WITH {_F}, r AS (SELECT uri, lower(trim(source)) AS w FROM documents WHERE uri IS NOT NULL), w0 AS (SELECT min(w) AS w FROM r), a AS (SELECT DISTINCT uri FROM f WHERE uri IS NOT NULL)
SELECT uri AS record_id, CASE WHEN uri IN (SELECT uri FROM r, w0 WHERE r.w IS NULL OR r.w = w0.w) THEN 'found' WHEN uri IN (SELECT uri FROM r) THEN 'scope_denied' ELSE 'not_found' END AS status FROM a""",
    "record_resolve": f"""WITH {_F}, dt AS (SELECT uri, 'sha256:' || sha256(first(text ORDER BY doc_id)) AS dg FROM documents WHERE uri IS NOT NULL GROUP BY uri),
s AS (SELECT CASE WHEN content_ref.expires_at <= '{NOW}' THEN 'expired' WHEN dt.uri IS NULL THEN 'not_found' WHEN content_digest IS DISTINCT FROM dg THEN 'mismatch' ELSE 'resolved' END AS status FROM f LEFT JOIN dt ON dt.uri = coalesce(content_ref.uri, f.uri) WHERE content_ref IS NOT NULL) SELECT status, count(*) AS requests FROM s GROUP BY 1""",
    "record_attestations": f"""WITH {_F}, s AS (SELECT DISTINCT p.digest AS dg, p.by AS k, recorded_at AS issued, p.uri AS uri FROM (SELECT recorded_at, unnest(provenance) AS p FROM f) WHERE p.digest IS NOT NULL),
n AS (SELECT dg, count(*) AS n, count(*) FILTER (k IS NULL OR (issued >= '2026-01-01T00:00:00Z' AND issued < '{NOW}')) AS v FROM s GROUP BY 1)
SELECT frame_no AS record_id, content_digest AS record_hash, coalesce(n, 0) AS attestations, coalesce(v, 0) AS valid FROM f LEFT JOIN n ON n.dg = content_digest WHERE content_digest IS NOT NULL""",
    "query_filters": f"WITH {_F} SELECT frame_no FROM f WHERE starts_with(uri, 'file:///') AND kind = 'doc'",
    "use_reconciliation": f"""WITH {_F}, u AS (SELECT e.frame.frame_id AS id, true AS s, bool_or(coalesce(e.representation, 'full') <> 'reference') AS r, bool_or(NOT ({_BLANK.format('e.citation_label')})) AS c FROM (SELECT unnest(frames) AS e FROM journal) WHERE e.frame.frame_id IS NOT NULL GROUP BY 1),
k AS (SELECT frame_id AS id, bool_or(coalesce(representation, 'full') <> 'reference') AS r, bool_or(NOT ({_BLANK.format('citation_label')})) AS c FROM f WHERE frame_id IS NOT NULL GROUP BY 1)
SELECT u.id IS NOT NULL AS in_report, k.id IS NOT NULL AS in_records, coalesce(u.r = k.r AND u.c = k.c, false) AS same, count(*) AS frames FROM u FULL JOIN k ON u.id = k.id GROUP BY ALL""",
    "normalised_frames": f"WITH {_F} SELECT frame_no, coalesce(len(provenance), 0)::INT AS links, coalesce(len(relations), 0)::INT AS relations FROM f",
    "neighbors_by_relation": f"""WITH {_F}, {_Q}, s AS (SELECT DISTINCT query_id, unnest(q_anchors) AS uri FROM q), e AS (SELECT DISTINCT frame_no, r.target_uri AS target FROM (SELECT frame_no, unnest(relations) AS r FROM f) WHERE r.rel IN ('code.calls', 'doc.documents')),
a AS (SELECT s.query_id, frame_no FROM f JOIN s USING (uri) UNION SELECT s.query_id, frame_no FROM e JOIN s ON s.uri = e.target),
ends AS (SELECT a.query_id, uri FROM a JOIN f USING (frame_no) WHERE uri IS NOT NULL UNION SELECT a.query_id, target FROM a JOIN e USING (frame_no)),
b AS (SELECT ends.query_id, frame_no FROM f JOIN ends USING (uri) UNION SELECT ends.query_id, frame_no FROM e JOIN ends ON ends.uri = e.target)
SELECT query_id, frame_no, 1::INT AS hops FROM a UNION ALL SELECT query_id, frame_no, 2::INT FROM b WHERE (query_id, frame_no) NOT IN (SELECT (query_id, frame_no) FROM a)""",
}
