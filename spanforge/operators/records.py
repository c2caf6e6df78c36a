"""Content-addressed records: envelope checks, lineage, idempotent append, visibility, resolution.

Records with null keys never match another; the newest of a lineage is the latest ``observed_at`` (text order), then the greatest key.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import expr as X
from spanforge.functions import jcs
from spanforge.operators.shred import load_json

#: fixed values
ORIGINS = ["observed", "derived", "declared", "imported"]
KINDS = ["observation", "knowledge", "memory", "directive", "record_proposal", "evidence", "artifact_contract", "contract_validation", "outcome_assessment", "promotion_event", "context_use", "context_use_feedback"]
SCHEMA_VERSION = "lifecycle/1.0-draft"
SCOPE_KEYS = ["user_id", "organization_id", "repository_id", "workspace_id", "environment_id", "session_id", "task_id"]
#: the members of a body by kind, besides ``statement``
BODIES = {
    "observation": ["subject_ref"],
    "knowledge": ["knowledge_kind"],
    "memory": ["salience"],
    "directive": ["directive_kind", "constraint_effect", "enforcement", "procedure_steps"],
    "record_proposal": ["proposed_kind", "rationale"],
    "evidence": ["evidence_kind"],
    "artifact_contract": ["contract_name", "requirements"],
    "contract_validation": ["contract_ref", "outcome", "requirement_results"],
    "outcome_assessment": ["subject_ref", "assessment", "rating"],
    "promotion_event": ["subject_ref", "from_status", "to_status"],
    "context_use": ["used_record_ref", "selected", "rendered", "cited", "task_ref"],
    "context_use_feedback": ["context_use_ref", "feedback", "rating"],
}
#: what a body of each kind cannot do without
REQUIRED = {
    "observation": ["statement"],
    "knowledge": ["knowledge_kind", "statement"],
    "memory": ["statement"],
    "directive": ["directive_kind", "statement"],
    "record_proposal": ["proposed_kind", "rationale"],
    "evidence": ["statement"],
    "artifact_contract": ["contract_name"],
    "contract_validation": ["contract_ref", "outcome"],
    "outcome_assessment": ["subject_ref", "assessment"],
    "promotion_event": ["subject_ref", "to_status"],
    "context_use": ["used_record_ref", "selected", "rendered", "cited"],
    "context_use_feedback": ["context_use_ref", "feedback"],
}
_TYPES = {"salience": "double", "rating": "double", "selected": "boolean", "rendered": "boolean", "cited": "boolean", "procedure_steps": "array<string>", "requirements": "array<struct<requirement_kind:string,description:string,execution_approval_ref:string>>", "requirement_results": "array<struct<requirement_kind:string,outcome:string>>"}
BODY = ", ".join(f"{m} {_TYPES.get(m, 'string')}" for m in dict.fromkeys(m for ms in BODIES.values() for m in ms))
ENVELOPE = (
    "record_kind string, statement string, origin string, observed_at string, valid_from string, confidence double, record_id string, lineage_id string, schema_version string, record_hash string, record_status string, "
    + "sharing_scope string, sensitivity string, scope struct<" + ",".join(f"{k}:string" for k in SCOPE_KEYS) + ">, provenance struct<origin_provider_id:string,origin_authority_id:string,producer_kind:string,producer_ref:string,derivation_kind:string,source_refs:array<string>>, "
    + "evidence_links array<string>, record_links array<struct<rel:string,target_record_id:string>>, " + BODY
)


def embedded(documents: DataFrame) -> DataFrame:
    """(doc_id, uri, loaded_at, ENVELOPE…) of the texts that are one JSON record: the envelope and the members of all kinds of body, flat."""
    r = F.from_json("text", ENVELOPE, {"mode": "PERMISSIVE"})
    return documents.where(F.coalesce(F.ltrim("text").startswith("{"), F.lit(False)) & F.regexp_replace("text", r"\s+$", "").endswith("}") & F.try_parse_json("text").isNotNull()).select("doc_id", "uri", "loaded_at", r.alias("r")).select("doc_id", "uri", "loaded_at", "r.*").where("record_kind IS NOT NULL")


def problems(schema_version: str = SCHEMA_VERSION):
    """All broken rules of a record, in the order in which a reader meets them: first what cannot be decoded, then the envelope's own rules."""
    c = F.col
    missing = F.lit(False)
    for kind, members in REQUIRED.items():
        absent = F.lit(False)
        for m in members:
            absent = absent | c(m).isNull()
        missing = missing | ((c("record_kind") == kind) & absent)
    derived = c("provenance.derivation_kind").isNotNull()
    rules = {
        "unknown kind": ~c("record_kind").isin(KINDS),
        "unknown origin": c("origin").isNull() | ~c("origin").isin(ORIGINS),
        "body lacks a member": missing,
        "schema version": ~c("schema_version").eqNullSafe(F.lit(schema_version)),
        "bad record hash": ~F.coalesce(X.is_digest("record_hash"), F.lit(False)),
        "bad confidence": F.coalesce(~c("confidence").between(0, 1), F.lit(False)),
        "bad instant": ~F.coalesce(X.is_instant("observed_at"), F.lit(False)) | ~F.coalesce(X.is_instant("valid_from"), F.lit(True)),
        "derivation of what is not derived": c("origin").isin("observed", "declared") & derived,
        "derived without derivation": (c("origin") == "derived") & ~derived,
        "constraint without effect": (c("record_kind") == "directive") & (c("directive_kind") == "constraint") & c("constraint_effect").isNull(),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items())))


def problem(schema_version: str = SCHEMA_VERSION):
    """The first broken rule of a record, or null."""
    return F.try_element_at(problems(schema_version), F.lit(1))


def latest(records: DataFrame, lineage: str, key: str, observed: str = "observed_at") -> DataFrame:
    """The newest record of each lineage."""
    best = records.where(F.col(lineage).isNotNull()).groupBy(lineage).agg(F.max(F.struct(F.coalesce(observed, F.lit("")), key))[key].alias(key))
    return records.join(best.select(key), key, "left_semi")


def append(records: DataFrame, key: list[str], digest: str, order: list[str]) -> DataFrame:
    """``status`` of each record appended in ``order``: accepted, duplicate (same key, same digest as the first) or conflict."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    first = records.where(whole).groupBy(*key).agg(F.min(F.struct(*order, F.col(digest).alias("_digest"))).alias("_first"))  # combined before its shuffle, whatever the key
    rows = records.join(first, key, "left")
    same = F.lit(True)
    for o in order:
        same = same & F.col(o).eqNullSafe(F.col(f"_first.{o}"))
    return rows.withColumn("status", F.when(F.col("_first").isNull() | same, "accepted").when(F.col(digest).eqNullSafe(F.col("_first._digest")), "duplicate").otherwise("conflict")).drop("_first")


def append_commands(commands: DataFrame, ledger: DataFrame, now: str) -> DataFrame:
    """``status`` of each command to append a record: accepted, duplicate, idempotency_conflict, idempotency_expired or record_identity_conflict.

    Commands and ledger have authority_id, client_id, operation, idempotency_key, command_hash, record_id, record_hash; the ledger also
    expires_at of its keys (none: never). Looked up by key first; a record known under another hash is a conflict, whatever the key.
    """
    key = ["authority_id", "client_id", "operation", "idempotency_key"]
    known = ledger.groupBy(*key).agg(F.max_by(F.struct("command_hash", "expires_at"), F.coalesce("expires_at", F.lit("9999"))).alias("k"))
    stored = ledger.where("record_id IS NOT NULL").groupBy("record_id").agg(F.min("record_hash").alias("stored_hash"), F.max("record_hash").alias("other_hash"))
    found = commands.join(known, key, "left").join(stored, "record_id", "left")
    status = (
        F.when(F.expr(f"k IS NOT NULL AND k.expires_at <= '{now}'"), "idempotency_expired")
        .when(F.expr("k IS NOT NULL AND k.command_hash = command_hash"), "duplicate")
        .when(F.col("k").isNotNull(), "idempotency_conflict")
        .when(F.expr("stored_hash IS NOT NULL AND (stored_hash IS DISTINCT FROM record_hash OR other_hash IS DISTINCT FROM record_hash)"), "record_identity_conflict")
        .otherwise("accepted")
    )
    return found.withColumn("status", status).select(*commands.columns, "status")


def command_hash(record_hash="record_hash", retention="requested_retention", options="options"):
    """Digest over the record's hash, the retention asked for and the options that change what is done; absent ones count as empty."""
    parts = [F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (record_hash, retention, options)]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256))


def retention_gate(commands: DataFrame, classes: list[str]) -> DataFrame:
    """``status``: retention_rejected where a class of retention is asked for that is not honoured, before anything is stored; else null."""
    asked = F.col("requested_retention")
    return commands.withColumn("status", F.when(asked.isNotNull() & ~asked.isin(classes), "retention_rejected"))


def get(requests: DataFrame, records: DataFrame, principal: dict[str, str | None], scopes: list[str] = SCOPE_KEYS) -> DataFrame:
    """``status`` of each request for a record_id: found, scope_denied (there, but not the principal's) or not_found."""
    allowed = visible(records, principal, scopes).select("record_id", F.lit(True).alias("allowed")).distinct()
    found = requests.join(records.select("record_id", F.lit(True).alias("there")).distinct(), "record_id", "left").join(allowed, "record_id", "left")
    return found.withColumn("status", F.when(F.col("allowed"), "found").when(F.col("there"), "scope_denied").otherwise("not_found")).select(*requests.columns, "status")


def attested(records: DataFrame, attestations: DataFrame, keys: DataFrame) -> DataFrame:
    """(record_id, record_hash, attestations, valid): attestations signed over each record's hash, and those issued while their key held.

    ``keys``: key_id, valid_from, valid_to; instants compare as text, an absent end is open. Signatures are not checked.
    """
    a = attestations.dropDuplicates().join(keys.dropDuplicates(["key_id"]), "key_id", "left")
    held = F.expr("coalesce(issued_at >= valid_from, valid_from IS NULL) AND coalesce(issued_at < valid_to, valid_to IS NULL)")
    by = a.groupBy(F.col("signed_record_hash").alias("record_hash")).agg(F.count("*").alias("attestations"), F.count_if(held).alias("valid"))
    return records.select("record_id", "record_hash").join(by, "record_hash", "left").select("record_id", "record_hash", F.coalesce("attestations", F.lit(0)).alias("attestations"), F.coalesce("valid", F.lit(0)).alias("valid"))


def filtered(rows: DataFrame, filters: dict[str, str], known: dict[str, str], unknown: str = "reject") -> DataFrame:
    """Rows that every filter lets through: ``known`` maps a filter's key to a column; values match whole, ``**`` any characters, ``*`` any but '/'.

    An unknown key is an error, unless ``unknown`` is 'ignore': a filter that is dropped in silence gives more than was asked for.
    """
    for key, value in filters.items():
        if key not in known:
            if unknown != "ignore":
                raise ValueError(f"bad_request: unknown filter {key}")
            continue
        pattern = "".join(".*" if part == "**" else "[^/]*" if part == "*" else "\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E" for part in re.split(r"(\*\*|\*)", value) if part)
        rows = rows.where(F.coalesce(F.col(known[key]).rlike(f"(?s)\\A(?:{pattern})\\z"), F.lit(False)))
    return rows


def reconciled(uses: DataFrame, records: DataFrame) -> DataFrame:
    """(used_record_ref, in_report, in_records, same): reported uses (used_record_ref, selected, rendered, cited) against records of kind context_use."""
    flags = ["selected", "rendered", "cited"]
    report = uses.groupBy("used_record_ref").agg(*(F.bool_or(f).alias(f) for f in flags))
    kept = records.where("record_kind = 'context_use'").groupBy("used_record_ref").agg(*(F.bool_or(f).alias(f"r_{f}") for f in flags), F.lit(True).alias("r"))
    same = F.lit(True)
    for f in flags:
        same = same & F.col(f).eqNullSafe(F.col(f"r_{f}"))
    joined = report.withColumn("u", F.lit(True)).join(kept, "used_record_ref", "full")
    return joined.select("used_record_ref", F.col("u").isNotNull().alias("in_report"), F.col("r").isNotNull().alias("in_records"), (F.col("u").isNotNull() & F.col("r").isNotNull() & same).alias("same"))


def normalised(rows: DataFrame, lists: list[str]) -> DataFrame:
    """``rows`` with empty lists in place of absent ones."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in lists})


def visible(records: DataFrame, principal: dict[str, str | None], scopes: list[str]) -> DataFrame:
    """Records each of whose scope keys is absent or the principal's."""
    for s in scopes:
        records = records.where(F.col(s).isNull() | (F.coalesce(F.col(s) == F.lit(principal.get(s)), F.lit(False))))
    return records


def resolve(requests: DataFrame, artifacts: DataFrame, now: str) -> DataFrame:
    """``status`` of each request (uri, digest, expires_at): resolved, expired, not_found or mismatch."""
    found = requests.join(artifacts.select("uri", F.col("digest").alias("actual"), F.lit(True).alias("there")), "uri", "left")
    return found.select("uri", "digest", F.expr(f"CASE WHEN expires_at <= '{now}' THEN 'expired' WHEN there IS NULL THEN 'not_found' WHEN digest IS DISTINCT FROM actual THEN 'mismatch' ELSE 'resolved' END").alias("status"))


def canonical_hashes(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, hash): the canonical hash of each JSON object in ``column``; null where it is none."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                node = load_json(text)
                try:
                    out.append(jcs.record_hash(node) if isinstance(node, dict) else None)
                except (ValueError, OverflowError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "hash"])

    return df.select(key, column).mapInArrow(run, f"`{key}` long, hash string")
