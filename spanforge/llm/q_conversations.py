"""Queries on conversations and their SQL."""

from __future__ import annotations

from spanforge.llm import conversations


def p1_found(spark, sf_dir):
    return conversations.conversations(spark, f"{sf_dir}/journal.parquet")


def p1_verdicts(spark, sf_dir):
    return conversations.verdicts(spark, f"{sf_dir}/journal.parquet")


_JUDGED = """r AS (SELECT session, seq, turn, lower(trim(event)) AS event, call_id, tool_calls FROM
(SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY received_at, delivery_id) AS n FROM journal WHERE session IS NOT NULL AND seq IS NOT NULL) WHERE n = 1),
s AS (SELECT *, max(turn) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn_before FROM r),
pr AS (SELECT session, event, lead(event) OVER (PARTITION BY session ORDER BY seq) AS then_said FROM r WHERE event IN ('prompt_assembled', 'model_response')),
asked AS (SELECT session, call_id, min(seq) AS seq FROM (SELECT session, seq, unnest(tool_calls) AS call_id FROM r WHERE event = 'model_response') WHERE call_id IS NOT NULL GROUP BY ALL),
called AS (SELECT session, call_id, min(seq) AS seq FROM r WHERE event = 'tool_call' GROUP BY ALL),
answered AS (SELECT session, call_id, min(seq) AS seq FROM r WHERE event = 'tool_result' GROUP BY ALL),
broken AS (SELECT session FROM r GROUP BY session HAVING min(seq) <> 1 OR max(seq) <> count(*)
UNION SELECT session FROM r WHERE seq = 1 AND event IS DISTINCT FROM 'session_start'
UNION SELECT session FROM s WHERE turn < turn_before
UNION SELECT c.session FROM called c LEFT JOIN asked a ON a.session = c.session AND a.call_id = c.call_id WHERE a.seq IS NULL OR a.seq >= c.seq
UNION SELECT t.session FROM answered t LEFT JOIN called c ON t.session = c.session AND t.call_id = c.call_id WHERE c.seq IS NULL OR c.seq >= t.seq),
missing AS (SELECT session FROM pr WHERE event = 'prompt_assembled' AND then_said IS DISTINCT FROM 'model_response'
UNION SELECT a.session FROM asked a LEFT JOIN called c ON a.session = c.session AND a.call_id = c.call_id LEFT JOIN answered t ON t.session = a.session AND t.call_id = a.call_id WHERE c.seq IS NULL OR t.seq IS NULL),
m AS (SELECT session, seq, CASE event WHEN 'prompt_assembled' THEN 'user' WHEN 'tool_result' THEN 'tool' ELSE 'assistant' END AS msg_role FROM r
WHERE event IN ('prompt_assembled', 'model_response', 'tool_call', 'tool_result'))"""

QUERIES = {"p1_found": p1_found, "p1_verdicts": p1_verdicts}

SQL = {
    "p1_found": f"""WITH {_JUDGED} SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) AS msg_no, seq, msg_role FROM m
WHERE session NOT IN (SELECT session FROM broken) AND session NOT IN (SELECT session FROM missing)""",
    "p1_verdicts": f"""WITH {_JUDGED} SELECT session, session IN (SELECT session FROM broken) AS broken, session NOT IN (SELECT session FROM m) AS empty,
session IN (SELECT session FROM missing) AS missing_replies FROM (SELECT DISTINCT session FROM r)""",
}
