"""Closed and open vocabularies as column expressions: error codes, egress scopes, outcomes, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import expr as X

#: fixed values: what a host does on each error code
REACTIONS = {
    "bad_request": "do_not_retry",
    "unsupported_kind": "narrow_or_skip",
    "unsupported_representation": "narrow_or_skip",
    "incompatible_version": "drop_provider",
    "budget_unsatisfiable": "raise_budget_or_skip",
    "unavailable": "retry_with_backoff",
    "shutting_down": "respawn",
    "internal": "report_and_count",
}
RETRIED = ["retry_with_backoff", "respawn"]
#: fixed values: error codes of the record operations, and what a host does on each
RECORD_REACTIONS = {
    "unsupported_capability": "renegotiate",
    "unsupported_representation": "request_full_or_skip",
    "unsupported_record_kind": "narrow_or_skip",
    "invalid_record": "do_not_retry",
    "idempotency_conflict": "do_not_retry",
    "idempotency_expired": "retry_with_fresh_key",
    "record_identity_conflict": "mint_new_record_id",
    "retention_rejected": "lower_retention_or_skip",
    "consent_required": "obtain_consent",
    "scope_denied": "do_not_retry",
    "sharing_denied": "do_not_retry",
    "reference_not_found": "drop",
    "reference_expired": "query_again",
    "content_hash_mismatch": "reject_and_report",
    "payload_too_large": "split_and_retry",
    "batch_too_large": "split_and_retry",
    "partial_failure": "act_per_item",
    "unavailable": "retry_with_backoff",
    "internal": "report_and_count",
}
#: fixed values: the label of each outcome of a leg
OUTCOMES = {"frames": "frames", "budget_lie": "dropped_budget_lie", "frame_flood": "dropped_frame_flood", "needs_consent": "consent_required", "needs_receipts": "consent_scope_required"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def looked_up(key: Column, table: dict[str, str], other: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, other)


def error_code(code) -> Column:
    """The code as sent; an absent one is ``internal``; unknown ones stay as they are."""
    return F.coalesce(_c(code), F.lit("internal"))


def is_recognized(code) -> Column:
    return error_code(code).isin(list(REACTIONS))


def reaction(code, table: dict[str, str] = REACTIONS) -> Column:
    """What a host does; unknown codes are taken as ``internal``."""
    return looked_up(error_code(code), table, F.lit("report_and_count"))


def is_retryable(code) -> Column:
    return reaction(code).isin(RETRIED)


def scope_class(scope) -> Column:
    """A base scope's name, or ``custom``."""
    return F.when(_c(scope).isin(X.SCOPES), _c(scope)).when(_c(scope).isNotNull(), F.lit("custom"))


def outcome_label(outcome) -> Column:
    return looked_up(_c(outcome), OUTCOMES, F.lit("failed"))


def data_flow(remote, scope) -> Column:
    """What a bridge declares: a remote server's content leaves the machine, a local one's does not."""
    away = _c(remote)
    return F.struct(F.lit(True).alias("reads"), F.lit(False).alias("writes"), away.alias("egress"), F.array(F.when(away, _c(scope)).otherwise(F.lit("local-only"))).alias("egress_scopes"))


def summary(frames, consumed, requested) -> Column:
    return F.format_string("Retrieved %d context frame(s), %d/%d budget tokens.", _c(frames), _c(consumed), _c(requested))


def fingerprints_match(host, provider) -> Column:
    """Whether embeddings of the host may go to a provider: equal and not empty."""
    return F.coalesce((_c(host) != "") & (_c(host) == _c(provider)), F.lit(False))


def stale_digest(digest) -> Column:
    """The digest with its last digit changed."""
    d = _c(digest)
    return F.concat(F.substring(d, F.lit(1), F.length(d) - 1), F.when(d.endswith("0"), F.lit("1")).otherwise(F.lit("0")))


def fenced_between(block, needle, opening: str = "<frame ", closing: str = "</frame>") -> Column:
    """Whether ``needle`` stands after the line that opens a fence and before its close."""
    b = _c(block)
    opened, line_end, at, from_end = F.instr(b, opening), F.instr(b, "\n"), F.locate(needle, b), F.locate(closing[::-1], F.reverse(b))
    return (opened > 0) & (line_end > opened) & (at > line_end) & (from_end > 0) & (at < F.length(b) - from_end - len(closing) + 2)


def verification(digest) -> Column:
    return F.when(_c(digest).isNotNull(), F.lit("verifiable")).otherwise(F.lit("unverifiable"))
