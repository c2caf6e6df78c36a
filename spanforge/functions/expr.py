"""Column expressions over frames, digests, instants, scopes and prompts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the grammars of digests and instants, the closed vocabularies
DIGEST = r"\Asha256:[0-9a-f]{64}\z"
INSTANT = r"\A[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)([.][0-9]+)?Z\z"
RELATIONS = ["code.calls", "code.imports", "code.defines", "code.references", "doc.documents", "episode.follows"]
SCOPES = ["local-only", "org-tenant", "third-party-index", "third-party-model"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def budget_tokens(content) -> Column:
    """ceil(UTF-8 bytes / 4); null content costs 0."""
    return F.floor((F.octet_length(F.coalesce(_c(content), F.lit(""))) + 3) / 4).cast("long")


def budget_from_model_tokens(tokens, factor) -> Column:
    return F.when(_c(factor) <= 0, _c(tokens)).otherwise(F.floor(_c(tokens) / _c(factor))).cast("long")


def is_instant(text) -> Column:
    """Strict RFC 3339 in UTC with a real calendar day; null stays null."""
    t = _c(text)
    year, month, day = (F.substring(t, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return t.rlike(INSTANT) & (day <= length)


def format_instant(seconds) -> Column:
    return F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_digest(text) -> Column:
    return _c(text).rlike(DIGEST)


def digest_of(content) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_c(content).cast("binary"), 256))


def short_hash(digest) -> Column:
    return F.substring(_c(digest), 8, 12)


def same_family(a, b) -> Column:
    return F.substring_index(_c(a), ".", 1) == F.substring_index(_c(b), ".", 1)


def fingerprint_dimensions(fingerprint) -> Column:
    return F.try_element_at(F.split(_c(fingerprint), "/"), F.lit(2)).try_cast("int")


def valid_score(score) -> Column:
    return F.coalesce(_c(score).between(0, 1), F.lit(False))


def is_blank(text) -> Column:
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\s  -     　 \u0085]", "") == ""


def citation(label, title) -> Column:
    """The label as it is, or the title where the label is blank."""
    return F.when(is_blank(label), _c(title)).otherwise(_c(label))


def escape_attribute(text) -> Column:
    out = _c(text)
    for old, new in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.translate(out, "\n\r", "  ")


def neutralize_fences(text) -> Column:
    """A backslash into every ``<frame`` and ``</frame``, in any letter case, so that content cannot close its fence."""
    return F.regexp_replace(_c(text), r"(?i)<(?=/?frame)", r"<\\")


def render(provider, frame_id, kind, cite, content) -> Column:
    attr = [escape_attribute(F.coalesce(_c(x), F.lit(""))) for x in (provider, frame_id, kind, cite)]
    return F.concat(F.lit('<frame provider="'), attr[0], F.lit('" id="'), attr[1], F.lit('" kind="'), attr[2], F.lit('" cite="'), attr[3], F.lit('">\n'), neutralize_fences(F.coalesce(_c(content), F.lit(""))), F.lit("\n</frame>\n"))


def basename(uri) -> Column:
    """The last part of a URI that is not empty, or the URI itself."""
    return F.coalesce(F.try_element_at(F.filter(F.split(_c(uri), "[/#?]"), lambda x: x != ""), F.lit(-1)), _c(uri))


def frame_id_for(uri) -> Column:
    return F.concat(F.lit("frm_mcp_"), F.regexp_replace(basename(uri), "[^A-Za-z0-9]", "_"))


def terms(*texts) -> Column:
    """ASCII words of three letters or more, lower case, repeated ones kept."""
    joined = F.lower(F.concat_ws(" ", *(_c(t) for t in texts)))
    return F.filter(F.split(joined, "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def grep_terms(query_text, goal) -> Column:
    """Words of three letters or digits or more of the query's text, or of its goal where it has none; lower case, sorted, each once."""
    words = F.filter(F.split(F.coalesce(_c(query_text), _c(goal), F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_distinct(F.transform(words, F.lower)))


def relevance(words, title, content) -> Column:
    """0.5 and half the share of terms that occur in title or content; 0.5 without terms."""
    hay = F.lower(F.concat_ws(" ", _c(title), _c(content)))
    n = F.size(words)
    hits = F.size(F.filter(words, lambda w: F.contains(hay, w)))
    return F.when(n == 0, F.lit(0.5)).otherwise(F.lit(0.5) + F.lit(0.5) * hits / F.nullif(n, F.lit(0)))


def off_machine(scopes) -> Column:
    return F.filter(F.coalesce(_c(scopes), F.array().cast("array<string>")), lambda s: s != "local-only")


def is_scope(scope) -> Column:
    """One of the four base scopes, or a name of one's own: a namespace, a colon, a name."""
    return _c(scope).isin(SCOPES) | _c(scope).rlike(r"(?s)^[^:]+:.+$")


def first_supported(preferences, supported) -> Column:
    """The first preference the provider offers; both default to ``full``; null if none is."""
    full = F.array(F.lit("full"))
    prefs = F.when(F.size(F.coalesce(_c(preferences), F.array().cast("array<string>"))) == 0, full).otherwise(_c(preferences))
    sup = F.when(F.size(F.coalesce(_c(supported), F.array().cast("array<string>"))) == 0, full).otherwise(_c(supported))
    return F.try_element_at(F.filter(prefs, lambda p: F.coalesce(F.array_contains(sup, p), F.lit(False))), F.lit(1))


def representations_consistent(representations, resolve) -> Column:
    """A provider that cannot resolve must not offer what needs resolving."""
    needs = F.coalesce(F.arrays_overlap(_c(representations), F.array(F.lit("compact"), F.lit("reference"))), F.lit(False))
    return F.coalesce(_c(resolve), F.lit(False)) | ~needs


def representation_problem(representation, content, content_digest, content_ref) -> Column:
    """The first broken rule of a frame's representation, or null."""
    r = F.coalesce(_c(representation), F.lit("full"))
    has = lambda x: _c(x).isNotNull()
    return (
        F.when(r.isin("full", "compact") & ~has(content), F.concat(r, F.lit(" without content")))
        .when((r == "compact") & ~has(content_digest), F.lit("compact without content digest"))
        .when((r == "compact") & ~has(content_ref), F.lit("compact without content reference"))
        .when((r == "reference") & has(content), F.lit("reference with content"))
        .when((r == "reference") & ~has(content_ref), F.lit("reference without content reference"))
        .when((r == "reference") & has(content_digest), F.lit("reference with content digest"))
    )


def edge_position(rank, n) -> Column:
    """Where the frame of value rank 0, 1, 2, … goes in a prompt of n: top, bottom, below the top, …"""
    r, n = _c(rank), _c(n)
    return F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - F.floor((r + 1) / 2)).cast("long")


def refused_transport(url) -> Column:
    """Plain http to another machine: only localhost, 127/8 and ::1 may do without TLS."""
    host = F.lower(F.regexp_extract(_c(url), r"^[A-Za-z]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:]*)", 1))
    here = host.isin("localhost", "[::1]") | host.rlike(r"^127(\.[0-9]{1,3}){3}$")
    return F.lower(_c(url)).startswith("http://") & ~here


def held_verdict(digest, full, inline) -> Column:
    """Of a block held with ``digest``: valid for either rendering that is served, else stale, unknown without a digest."""
    return F.when(_c(digest).isNull(), "unknown").when(F.coalesce((_c(digest) == _c(full)) | (_c(digest) == _c(inline)), F.lit(False)), "valid").otherwise("stale")
