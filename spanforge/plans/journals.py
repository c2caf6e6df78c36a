"""Queries of the journal checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import expr as X
from spanforge.operators import journal as J
from spanforge.plans.frames import _BLANK, _ok
from spanforge.sources.tables import materialise, table


def _events(spark, d):
    return J.recorded(table(spark, d, "journal"))


def _query(check):
    return lambda spark, d: check(_events(spark, d))


def journal_report(spark, d):
    """All checks of all sessions; the recording is written once, as eight checks read it."""
    return J.report(materialise(_events(spark, d), "recorded"))


def journal_tally(spark, d):
    return journal_report(spark, d).groupBy("check", "status").agg(F.count("*").alias("sessions"))


QUERIES = {
    "journal_sequence": _query(J.sequence),
    "journal_turn_loop": _query(J.turn_loop),
    "journal_assembly": _query(J.assembly),
    "journal_staleness": _query(J.staleness),
    "journal_citations": _query(J.citations),
    "journal_determinism": _query(J.determinism),
    "journal_effects": _query(J.effects),
    "journal_resumes": _query(J.resumes),
    "journal_report": journal_report,
    "journal_tally": journal_tally,
}

_R = "r AS (SELECT * REPLACE (lower(trim(event)) AS event) FROM journal WHERE session IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, seq ORDER BY received_at, delivery_id) = 1)"
_W = "WINDOW w AS (PARTITION BY session ORDER BY seq)"
_L = f"l AS (SELECT *, lag(seq) OVER w AS previous, max(CASE WHEN event = 'session_end' THEN 1 END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM r {_W})"
_U = "u AS (SELECT session, seq, i - 1 AS pos, frames[i] AS x FROM r, LATERAL (SELECT unnest(range(1, len(frames) + 1)) AS i) WHERE event = 'prompt_assembled')"

_TURN_LOOP = f"""WITH RECURSIVE {_R}, o AS MATERIALIZED (SELECT session, seq, event, turn, outcome, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM r),
t AS (SELECT session, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::BIGINT AS open, 0::BIGINT AS high, NULL::VARCHAR AS p1, NULL::VARCHAR AS p2 FROM (SELECT DISTINCT session FROM o)
UNION ALL SELECT o.session, o.i, o.seq,
CASE WHEN event = 'turn_start' AND turn IS NOT NULL AND open IS NULL THEN turn WHEN event = 'resume' OR (event = 'turn_end' AND turn = open) THEN NULL ELSE open END,
CASE WHEN event = 'turn_start' AND turn IS NOT NULL AND open IS NULL THEN greatest(turn, high) ELSE high END,
CASE event WHEN 'turn_start' THEN CASE WHEN turn IS NULL THEN 'turn_start names no turn' WHEN open IS NOT NULL THEN 'turn started inside a turn' WHEN turn <= high THEN 'turn does not increase' END
WHEN 'turn_end' THEN CASE WHEN coalesce(turn <> open, true) THEN 'turn_end of another turn' END
ELSE CASE WHEN event IN ('resume', 'session_start', 'session_end') THEN CASE WHEN turn IS NOT NULL THEN event || ' carries a turn' END WHEN turn IS DISTINCT FROM open THEN 'event of another turn' END END,
CASE WHEN event = 'session_end' AND outcome = 'completed' AND open IS NOT NULL THEN 'completed with a turn open' END
FROM t JOIN o ON o.session = t.session AND o.i = t.i + 1),
s AS (SELECT session, seq, event, tool_calls, call_id, outcome, count(*) FILTER (event IN ('resume', 'prompt_assembled')) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS span FROM r),
q AS (SELECT session, seq, span, tool_calls[i] AS call, i, row_number() OVER (PARTITION BY session, tool_calls[i] ORDER BY seq, i) AS n FROM s, LATERAL (SELECT unnest(range(1, len(tool_calls) + 1)) AS i) WHERE event = 'model_response'),
f AS (SELECT * FROM q WHERE n = 1),
ans AS (SELECT f.session, f.call, min(s.seq) AS answered FROM f JOIN s ON s.session = f.session AND s.event = 'tool_result' AND s.call_id IS NOT DISTINCT FROM f.call AND s.seq > f.seq AND s.span = f.span GROUP BY ALL),
ran AS (SELECT f.session, f.call, min(s.seq) AS ran FROM f JOIN s ON s.session = f.session AND s.event = 'tool_call' AND s.call_id IS NOT DISTINCT FROM f.call AND s.seq > f.seq AND s.span = f.span LEFT JOIN ans ON ans.session = f.session AND ans.call IS NOT DISTINCT FROM f.call WHERE coalesce(s.seq < answered, true) GROUP BY ALL)
SELECT session, seq, p1 AS problem FROM t WHERE p1 IS NOT NULL UNION ALL SELECT session, seq, p2 FROM t WHERE p2 IS NOT NULL
UNION ALL SELECT session, seq, 'call asked for again' FROM q WHERE n > 1
UNION ALL SELECT s.session, s.seq, CASE WHEN ran < s.seq THEN 'call executed again' WHEN answered < s.seq THEN 'call executed after its result' ELSE 'call never asked for' END FROM s LEFT JOIN ran ON ran.session = s.session AND ran.call IS NOT DISTINCT FROM s.call_id
LEFT JOIN ans ON ans.session = s.session AND ans.call IS NOT DISTINCT FROM s.call_id WHERE event = 'tool_call' AND ran IS DISTINCT FROM s.seq
UNION ALL SELECT s.session, s.seq, CASE WHEN answered < s.seq THEN 'second result' ELSE 'result of no call' END FROM s LEFT JOIN ans ON ans.session = s.session AND ans.call IS NOT DISTINCT FROM s.call_id WHERE event = 'tool_result' AND answered IS DISTINCT FROM s.seq
UNION ALL SELECT DISTINCT s.session, s.seq, CASE WHEN s.event = 'session_end' THEN 'completed' ELSE 'prompt' END || ' with calls unresolved' FROM s JOIN f ON f.session = s.session AND f.span = s.span AND f.seq < s.seq LEFT JOIN ans ON ans.session = f.session AND ans.call IS NOT DISTINCT FROM f.call
WHERE (s.event = 'prompt_assembled' OR (s.event = 'session_end' AND s.outcome = 'completed')) AND coalesce(answered > s.seq, true)"""

SQL = {
    "journal_turn_loop": _TURN_LOOP,
    "journal_sequence": f"""WITH {_R}, {_L} SELECT session, seq, 'first seq is not 1' AS problem FROM l WHERE previous IS NULL AND seq <> 1
UNION ALL SELECT session, seq, 'no session_start at first' FROM l WHERE previous IS NULL AND event <> 'session_start'
UNION ALL SELECT session, seq, 'gap' FROM l WHERE seq <> previous + 1
UNION ALL SELECT session, seq, 'second session_start' FROM l WHERE previous IS NOT NULL AND event = 'session_start'
UNION ALL SELECT session, seq, 'after session_end' FROM l WHERE ended IS NOT NULL
UNION ALL SELECT session, seq, 'bad instant' FROM l WHERE NOT coalesce({_ok('at_utc')}, false)""",
    "journal_assembly": f"""WITH {_R}, p AS (SELECT session, seq, budget_tokens, declared_total_tokens, coalesce(list_sum([coalesce(f.token_cost, 0) FOR f IN frames]), 0) AS itemized, coalesce(len([1 FOR f IN frames IF f.representation = 'reference' AND f.token_cost > 0]), 0) > 0 AS charged FROM r WHERE event = 'prompt_assembled')
SELECT session, seq, 'declared total differs' AS problem FROM p WHERE itemized IS DISTINCT FROM declared_total_tokens
UNION ALL SELECT session, seq, 'over budget' FROM p WHERE itemized > budget_tokens
UNION ALL SELECT session, seq, 'reference costs tokens' FROM p WHERE charged""",
    "journal_staleness": f"""WITH {_R}, {_U}, uses AS (SELECT session, seq, pos, x.frame AS f FROM u WHERE x.frame IS NOT NULL), looks AS (SELECT session, seq, frame AS f, verdict.status AS status FROM r WHERE event = 'verify_observed' AND frame IS NOT NULL AND verdict.status IS NOT NULL),
a AS (SELECT uses.session, uses.seq, uses.pos, uses.f, arg_max(status, looks.seq) AS last FROM uses JOIN looks ON looks.session = uses.session AND looks.f IS NOT DISTINCT FROM uses.f AND looks.seq < uses.seq GROUP BY ALL)
SELECT session, seq, last || ' ' || coalesce(f.provider_id, '') || '/' || coalesce(f.frame_id, '') AS problem FROM a WHERE last IN ('stale', 'gone')""",
    "journal_citations": f"WITH {_R}, {_U} SELECT session, seq, 'no label at ' || pos AS problem FROM u WHERE x.frame IS NOT NULL AND {_BLANK.format('x.citation_label')}",
    "journal_determinism": f"""WITH {_R}, k AS (SELECT session, seq, composition_digest AS dg, array_to_string([concat_ws(chr(1), coalesce(f.frame.provider_id, ''), coalesce(f.frame.frame_id, ''), coalesce(f.frame.content_digest, ''), coalesce(f.representation, 'full')) FOR f IN frames], chr(2)) AS key FROM r WHERE event = 'prompt_assembled' AND composition_digest IS NOT NULL)
SELECT session, seq, 'another digest' AS problem FROM k QUALIFY dg <> first_value(dg) OVER (PARTITION BY session, key ORDER BY seq)""",
    "journal_effects": f"""WITH {_R}, s AS (SELECT session, seq, event, effect_id, max(CASE WHEN event = 'resume' THEN seq END) OVER (PARTITION BY session ORDER BY seq) AS resumed FROM r), e AS (SELECT *, min(seq) OVER (PARTITION BY session, effect_id) AS first FROM s WHERE event = 'side_effect' AND effect_id IS NOT NULL)
SELECT session, seq, effect_id || CASE WHEN resumed > first THEN ' across a resume' ELSE ' in one run' END AS problem FROM e WHERE seq > first""",
    "journal_resumes": f"""WITH {_R}, {_L} SELECT session, seq, CASE WHEN previous IS NULL THEN 'nothing to resume' WHEN last_seq_seen > previous THEN 'recovered what was not recorded' ELSE 'lost ' || (previous - last_seq_seen) END AS problem FROM l
WHERE event = 'resume' AND (previous IS NULL OR last_seq_seen <> previous)""",
}


def _union(name: str) -> str:
    return f"SELECT session, '{name}' AS \"check\", count(*) AS violations FROM ({SQL['journal_' + name]}) GROUP BY session"


_REPORT = f"""SELECT t.session, k.c AS "check", CASE WHEN v.violations > 0 THEN 'fail' WHEN list_contains(told, k.c) THEN 'pass' ELSE 'skipped' END AS status, coalesce(v.violations, 0)::BIGINT AS violations FROM
(WITH {_R} SELECT session, ['sequence', 'turn_loop', 'assembly', 'citations', 'effects'] || CASE WHEN bool_or(coalesce(event = 'verify_observed', false)) THEN ['staleness'] ELSE [] END || CASE WHEN bool_or(coalesce(event = 'prompt_assembled' AND composition_digest IS NOT NULL, false)) THEN ['determinism'] ELSE [] END
|| CASE WHEN bool_or(coalesce(event = 'resume', false)) THEN ['resumes'] ELSE [] END AS told FROM r GROUP BY session) t
CROSS JOIN (VALUES ('sequence'), ('turn_loop'), ('assembly'), ('staleness'), ('citations'), ('determinism'), ('effects'), ('resumes')) k(c)
LEFT JOIN ({' UNION ALL '.join(map(_union, J.CHECKS))}) v ON v.session = t.session AND v."check" = k.c"""
SQL["journal_report"] = _REPORT
SQL["journal_tally"] = f'SELECT "check", status, count(*) AS sessions FROM ({_REPORT}) GROUP BY ALL'
