"""Queries on texts and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import expr as X
from spanforge.operators import ingest, records, scan
from spanforge.plans.frames import _ok
from spanforge.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents")


def ingest_blocks(spark, d):
    return ingest.ingest(_docs(spark, d))


def ingest_segments(spark, d):
    """The blocks of each text, what each was taken for, its digest and cost."""
    return ingest_blocks(spark, d).select("doc_id", "block", "kind", "first_line", "lines", "digest", "tokens")


def ingest_kinds(spark, d):
    served = F.sum(F.coalesce("compact_tokens", "tokens"))
    return ingest_blocks(spark, d).groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"), served.alias("served"))


def ingest_artifacts(spark, d):
    """One artifact per distinct block content: the first document that has it, and how many blocks repeat it."""
    b = ingest_blocks(spark, d).where("kind <> 'path'")
    return b.groupBy("digest").agg(F.min(F.struct("doc_id", "block")).alias("first"), F.count("*").alias("copies"), F.first("kind").alias("kind")).select(F.concat(F.lit("frm_"), X.short_hash("digest")).alias("frame_id"), "digest", "first.doc_id", "copies", "kind")


def table_types(spark, d):
    return ingest_blocks(spark, d).where("kind = 'table'").select("doc_id", "block", F.posexplode("columns").alias("pos", "c")).select("doc_id", "block", "pos", F.regexp_extract("c", "^(.*):([a-z]+[?]?)$", 1).alias("name"), F.regexp_extract("c", "^(.*):([a-z]+[?]?)$", 2).alias("type"))


def grep_lines(spark, d):
    return scan.grep(_docs(spark, d), ["budget", "provider"])


def match_places(spark, d):
    """Where the texts speak of budgets or providers: by expression, or by walking the lines where that finds nothing."""
    docs = _docs(spark, d)
    return scan.matches(scan.lines(docs).where(F.col("line").rlike(r"(?i)budget|provider")), scan.grep(docs, ["budget", "provider"]))


def first_lines(spark, d):
    return scan.first_lines(_docs(spark, d))


def line_runs(spark, d):
    return scan.runs(_docs(spark, d))


def definitions(spark, d):
    return scan.definitions(_docs(spark, d)).drop("line")


def calls(spark, d):
    return scan.calls(_docs(spark, d)).select("doc_id", "name")


def imports(spark, d):
    return scan.imports(_docs(spark, d))


def record_problems(spark, d):
    return records.embedded(_docs(spark, d)).select("doc_id", "record_kind", records.problem().alias("first"), F.array_join(records.problems(), ", ").alias("problems"))


def lineage_latest(spark, d):
    """Documents as records of the lineage of their uri: the newest of each."""
    return records.latest(_docs(spark, d).select("doc_id", "uri", F.col("recorded_at").alias("observed_at")), "uri", "doc_id").select("doc_id", "uri")


def idempotent_append(spark, d):
    """Documents appended by (uri, citation label) in order of loading: accepted, duplicates, conflicts."""
    rows = _docs(spark, d).select("doc_id", "uri", "citation_label", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return records.append(rows, ["uri", "citation_label"], "digest", ["doc_id"]).select("doc_id", "status")


def record_hashes(spark, d):
    return records.canonical_hashes(table(spark, d, "wire_messages").dropDuplicates(["msg_id"]), "msg_id", "payload")


QUERIES = {f.__name__: f for f in (ingest_blocks, ingest_segments, ingest_kinds, ingest_artifacts, table_types, grep_lines, match_places, first_lines, line_runs, definitions, imports, calls, record_problems, lineage_latest, idempotent_append, record_hashes)}

_LINES = "l AS (SELECT doc_id, i AS line_no, CASE WHEN i < n AND suffix(ls[i], chr(13)) THEN left(ls[i], length(ls[i]) - 1) ELSE ls[i] END AS line, ls[i] || CASE WHEN i < n THEN chr(10) ELSE '' END AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, n + CASE WHEN ls[n] = '' THEN 0 ELSE 1 END)) AS i))"
_QUALIFIED = "^\\s*(?:pub\\(crate\\) |pub )?(?:async )?"
_DEF = _QUALIFIED + "(fn|struct|enum|trait|mod|type|const) ([\\p{L}\\p{N}_]+)"
_USE = "(?s)" + _QUALIFIED + "use (.*)$"

_WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_NWS = _WS.replace("[", "[^", 1)
_CLOCK_RE = "[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?"
_STAMP_RE = f"^\\[?(?:[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}[T ]{_CLOCK_RE}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +[0-9]{{1,2}} {_CLOCK_RE}|{_CLOCK_RE})"
_LEVEL_RE = "(?i)(?:^|[^A-Za-z0-9])(?:ERROR|ERR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL|CRITICAL|CRIT|PANIC|PANICKED|SEVERE|NOTICE)(?:[^A-Za-z0-9]|$)"
_FRAME_RE = f"^(?:{_WS}*(?:at |File \"|from .*:|[0-9]+: )|\\t.*\\.go:)"
_HEADER_RE = f"^(?:Traceback \\(most recent call last\\)|thread ''|Caused by|goroutine .*\\[running\\]|.*panicked at|(?:{_NWS}+{_WS}+)?{_NWS}*(?:Error|Exception)(?::|$))"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


def _message(c: str, times: int = 4) -> str:
    """A line's message: what stands before it is taken off, at most so many times."""
    if not times:
        return _strip(c)
    rest = _message(c, times - 1)
    return f"(SELECT CASE WHEN regexp_matches(m, '^{_NWS}+{_WS}') AND (regexp_matches(m, '{_STAMP_RE}') OR starts_with(m, '[') OR regexp_matches(regexp_extract(m, '^{_NWS}+'), '{_LEVEL_RE}')) THEN regexp_replace(m, '^{_NWS}+{_WS}+', '') ELSE m END FROM (SELECT {rest} AS m))"


_EXTENSIONS = ", ".join(f"'{x}'" for x in ("rs", "ts", "tsx", "js", "jsx", "py", "go", "rb", "java", "kt", "c", "h", "cc", "cpp", "hpp", "cs", "md", "toml", "json", "yaml", "yml", "txt", "sh", "sql", "lock", "cfg", "ini"))
_STARTS = " OR ".join(f"starts_with(t, '{x}')" for x in ("fn ", "def ", "class ", "import ", "const ", "let ", "var ", "pub ", "function ", "#include", "package ", "func ", "return ", "if ", "for ", "while ", "@"))
_MARKS = " OR ".join(f"starts_with(lt, '{x}')" for x in ("at ", 'File "', "Traceback", "panicked at", "-->", "Caused by", "thread ''"))


def _agreed(name: str, column: str) -> str:
    """Blocks in which at least seven of ten lines have the same number above ``least``."""
    return f"{name} AS (SELECT doc_id, g, max(v) AS v FROM (SELECT doc_id, g, {column} AS v, count(*) AS n, any_value(size) AS size FROM t GROUP BY doc_id, g, {column}) WHERE n * 10 >= size * 7 GROUP BY doc_id, g)"


_SEGMENTS = f"""WITH {_LINES}, a AS (SELECT *, regexp_matches(line, '^{_WS}*```') AS fence, regexp_matches(line, '^{_WS}*$') AS blank FROM l),
b AS (SELECT *, count(*) FILTER (fence) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 1 AS inside FROM a),
c AS (SELECT *, count(*) FILTER (fence OR (blank AND NOT inside)) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM b),
d AS (SELECT * FROM c WHERE NOT fence AND NOT (blank AND NOT inside)),
t AS (SELECT doc_id, g, line_no, line, inside, blank, count(*) OVER (PARTITION BY doc_id, g) AS size, {_strip('line')} AS t, regexp_replace(line, '^{_WS}+', '') AS lt,
length(line) - length(replace(line, '|', '')) AS bars, length(line) - length(replace(line, chr(9), '')) AS tabs, length(line) - length(replace(line, ',', '')) AS commas,
list_transform(list_filter(string_split_regex({_strip('line')}, ' {{2,}}'), lambda x: NOT regexp_matches(x, '^{_WS}*$')), lambda x: {_strip('x')}) AS cells FROM d),
{_agreed('ab', 'bars')}, {_agreed('at_', 'tabs')}, {_agreed('ac', 'commas')}, {_agreed('al', 'len(cells)')},
k AS (SELECT doc_id, g, min(line_no) - 1 AS first_line, count(*) AS lines, bool_or(inside) AS fenced, count(*) FILTER (NOT blank) AS filled, string_agg(line, chr(10) ORDER BY line_no) AS txt, any_value(t) AS one,
count(*) FILTER (NOT blank AND regexp_matches(line, '{_FRAME_RE}')) AS frames, bool_or(NOT blank AND regexp_matches({_message('line')}, '{_HEADER_RE}')) AS header, count(*) FILTER (NOT blank AND regexp_matches(lt, '{_STAMP_RE}')) AS stamped, bool_or(regexp_matches(line, '{_LEVEL_RE}')) AS leveled,
count(*) FILTER (starts_with(line, chr(9))) AS tabbed, bool_and(len(list_filter(string_split(line, ','), lambda x: len(list_filter(string_split_regex(x, '{_WS}+'), lambda w: w <> '')) > 4)) = 0) AS short_commas,
bool_and(len(list_filter(cells, lambda x: len(list_filter(string_split_regex(x, '{_WS}+'), lambda w: w <> '')) > 4)) = 0) AS short_cells,
count(*) FILTER (NOT blank AND ({_MARKS} OR regexp_matches(lt, '{_LEVEL_RE}') OR regexp_matches(lt, '{_STAMP_RE}') OR regexp_matches(regexp_extract(lt, '^{_NWS}+'), '^(?:\\[|[0-9]{_NWS}*[:-])'))) AS logs,
count(*) FILTER ({_STARTS} OR regexp_matches(line, '(?:;|\\{{|\\}}|=>|\\):){_WS}*$')) AS coded FROM t GROUP BY doc_id, g HAVING bool_or(NOT blank)),
s AS (SELECT k.*, CASE WHEN fenced THEN 'code'
WHEN lines = 1 AND NOT regexp_matches(one, '{_WS}') AND NOT starts_with(one, 'http://') AND NOT starts_with(one, 'https://') AND (starts_with(one, 'file://') OR regexp_matches(one, '^(?:\\./|\\.\\./|~/|/)') OR regexp_extract(one, '\\.([^./]*)$', 1) IN ({_EXTENSIONS}) OR regexp_matches(one, '^[^./]*/')) THEN 'path'
WHEN frames >= 2 AND frames * 4 >= filled AND header THEN 'trace' WHEN stamped * 2 >= filled AND leveled THEN 'log'
WHEN lines >= 2 AND (coalesce(ab.v, 0) >= 1 OR (coalesce(at_.v, 0) >= 1 AND tabbed * 10 < lines * 7) OR (coalesce(ac.v, 0) >= 1 AND lines >= 3 AND short_commas)) THEN 'table'
WHEN logs * 2 >= filled THEN 'log' WHEN lines >= 3 AND coalesce(al.v, 0) >= 2 AND short_cells THEN 'table' WHEN lines >= 3 AND coded * 2 >= lines THEN 'code' ELSE 'prose' END AS kind
FROM k LEFT JOIN ab USING (doc_id, g) LEFT JOIN at_ USING (doc_id, g) LEFT JOIN ac USING (doc_id, g) LEFT JOIN al USING (doc_id, g))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS block, kind, first_line, lines, 'sha256:' || sha256(txt) AS digest, ((strlen(txt) + 3) // 4)::BIGINT AS tokens FROM s"""

_ALERT_RE = "(?i)(?:^|[^A-Za-z0-9])(?:ERROR|ERR|WARN|WARNING|FATAL|CRITICAL|CRIT|PANIC|PANICKED|SEVERE)(?:[^A-Za-z0-9]|$)"
_DATED_RE = f"^\\[?([0-9]{{4}})[-/]([0-9]{{2}})[-/]([0-9]{{2}})[T ]({_CLOCK_RE})\\]?{_WS}*(Z|UTC|GMT|[+-][0-9]{{2}}:?[0-9]{{2}})?"
_NUMBER_RE = "[+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)"
_MONEY_RE = f"^[+-]?(?:[$€£¥₹₽]{_WS}*{_NUMBER_RE}(?:\\.[0-9]+)?|{_NUMBER_RE}(?:\\.[0-9]+)?{_WS}*[$€£¥₹₽]|{_NUMBER_RE}(?:\\.[0-9]+)? [A-Z]{{3}})$"


def _instant(c: str) -> str:
    lead = f"regexp_replace({c}, '^{_WS}+', '')"
    part = lambda i: f"regexp_extract({lead}, '{_DATED_RE}', {i})"
    return f"CASE WHEN regexp_matches({lead}, '{_DATED_RE}') AND {part(5)} IN ('', 'Z', 'UTC', 'GMT', '+00:00', '-00:00', '+0000', '-0000') THEN {part(1)} || '-' || {part(2)} || '-' || {part(3)} || 'T' || replace({part(4)}, ',', '.') || 'Z' END"


def _is(test: str) -> str:
    """Whether all values of a column pass."""
    return f"count(*) FILTER (has AND NOT ({test})) = 0"


_BLOCKS = _SEGMENTS[: _SEGMENTS.rindex("SELECT doc_id, row_number()")] + f""", sg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS block, ((strlen(txt) + 3) // 4)::BIGINT AS tokens FROM s),
x AS (SELECT t.*, sg.kind, row_number() OVER (PARTITION BY t.doc_id, t.g ORDER BY t.line_no) - 1 AS i FROM t JOIN sg USING (doc_id, g)),
r0 AS (SELECT *, CASE WHEN lag(line) OVER w = line THEN 0 ELSE 1 END AS new FROM x WHERE kind = 'log' WINDOW w AS (PARTITION BY doc_id, g ORDER BY line_no)),
r1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, g ORDER BY line_no) - 1 AS run FROM r0),
r2 AS (SELECT doc_id, g, run, any_value(line) AS line, count(*) AS n, any_value(size) AS size, regexp_matches(any_value(line), '{_ALERT_RE}') AS alert FROM r1 GROUP BY ALL),
r3 AS (SELECT *, max(run) OVER b AS final, bool_or(alert) OVER b AS alerts, sum(CASE WHEN alert THEN n ELSE 0 END) OVER b AS alerted, sum(n) OVER (PARTITION BY doc_id, g ORDER BY run) AS upto, bool_or(alert) OVER (PARTITION BY doc_id, g ORDER BY run ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM r2 WINDOW b AS (PARTITION BY doc_id, g)),
r4 AS (SELECT *, lag(run, 1, -1) OVER w AS before, lag(upto, 1, 0) OVER w AS seen FROM r3 WHERE run = 0 OR run = final OR CASE WHEN alerts THEN near ELSE run < 8 OR run > final - 4 END WINDOW w AS (PARTITION BY doc_id, g ORDER BY run)),
logs AS (SELECT doc_id, g, '[' || any_value(size) || '-line log' || CASE WHEN any_value(alerts) THEN ', ' || any_value(alerted) || ' error/warn line(s)' ELSE '' END || ']' || chr(10) || string_agg(CASE WHEN run > before + 1 THEN '… (' || (upto - n - seen) || ' line' || CASE WHEN upto - n - seen = 1 THEN '' ELSE 's' END || ' elided) …' || chr(10) ELSE '' END || line || CASE WHEN n > 1 THEN chr(10) || '… (×' || n || ')' ELSE '' END, chr(10) ORDER BY run) AS short FROM r4 GROUP BY doc_id, g),
f0 AS (SELECT *, CASE WHEN regexp_matches(line, '{_FRAME_RE}') THEN count(*) FILTER (regexp_matches(line, '{_FRAME_RE}')) OVER (PARTITION BY doc_id, g ORDER BY i) END AS nth FROM x WHERE kind = 'trace'),
f1 AS (SELECT *, max(nth) OVER b AS frames, min(CASE WHEN nth = 9 THEN i END) OVER b AS cut, max(CASE WHEN nth IS NOT NULL THEN i END) OVER b AS final FROM f0 WINDOW b AS (PARTITION BY doc_id, g)),
traces AS (SELECT doc_id, g, string_agg(CASE WHEN i = cut THEN '… (' || (frames - 8) || ' more frame' || CASE WHEN frames = 9 THEN '' ELSE 's' END || ')' ELSE line END, chr(10) ORDER BY i) AS short FROM f1 WHERE cut IS NULL OR i <= cut OR i > final GROUP BY doc_id, g),
codes AS (SELECT doc_id, g, string_agg(CASE WHEN size > 28 AND i = 20 THEN '… (' || (size - 28) || ' line' || CASE WHEN size = 29 THEN '' ELSE 's' END || ' elided) …' ELSE line END, chr(10) ORDER BY i) AS short FROM x WHERE kind = 'code' AND (size <= 28 OR i <= 20 OR i >= size - 8) GROUP BY doc_id, g),
m0 AS (SELECT sg.doc_id, sg.g, CASE WHEN coalesce(ab.v, 0) >= 1 THEN '|' WHEN coalesce(at_.v, 0) >= 1 AND tabbed * 10 < lines * 7 THEN chr(9) WHEN coalesce(ac.v, 0) >= 1 AND lines >= 3 AND short_commas THEN ',' ELSE '  ' END AS mark FROM sg LEFT JOIN ab USING (doc_id, g) LEFT JOIN at_ USING (doc_id, g) LEFT JOIN ac USING (doc_id, g) WHERE kind = 'table'),
m1 AS (SELECT x.doc_id, x.g, x.i, mark, CASE mark WHEN '  ' THEN cells WHEN '|' THEN string_split(t, '|') ELSE string_split(line, mark) END AS raw FROM x JOIN m0 USING (doc_id, g)),
m2 AS (SELECT doc_id, g, i, mark, CASE WHEN mark = '|' AND len(raw) > 1 AND regexp_matches(raw[1], '^{_WS}*$') THEN raw[2:] ELSE raw END AS raw FROM m1),
m3 AS (SELECT doc_id, g, i, list_transform(CASE WHEN mark = '|' AND len(raw) > 1 AND regexp_matches(raw[len(raw)], '^{_WS}*$') THEN raw[:len(raw) - 1] ELSE raw END, lambda x: {_strip('x')}) AS cs FROM m2),
m4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) - 1 AS rw FROM m3 WHERE len(list_filter(cs, lambda x: NOT regexp_full_match(x, '[-:]+'))) > 0),
hd AS (SELECT doc_id, g, cs AS head FROM m4 WHERE rw = 0), dr AS (SELECT doc_id, g, count(*) AS n, string_agg(list_aggregate(cs, 'string_agg', ' | '), chr(10) ORDER BY rw) FILTER (rw <= 5) AS sample FROM m4 WHERE rw > 0 GROUP BY doc_id, g),
cl AS (SELECT hd.doc_id, hd.g, p, hd.head[p] AS name, m4.rw AS rw, coalesce(m4.cs[p], '') AS c FROM hd, LATERAL (SELECT unnest(range(1, len(hd.head) + 1)) AS p) LEFT JOIN m4 ON m4.doc_id = hd.doc_id AND m4.g = hd.g AND m4.rw > 0),
cv AS (SELECT *, rw IS NOT NULL AND lower(c) NOT IN ('', 'null', 'nil', 'none', 'n/a', 'na', 'nan', '-', '—') AS has, CASE WHEN starts_with(c, '(') AND suffix(c, ')') THEN c[2:length(c) - 1] ELSE c END AS bare FROM cl),
ct AS (SELECT doc_id, g, p, any_value(name) AS name, CASE WHEN count(*) FILTER (has) = 0 THEN 'empty' ELSE CASE WHEN {_is("suffix(c, '%') AND regexp_matches(c, '^" + _NUMBER_RE + "(?:\\.[0-9]+)?" + _WS + "*%$')")} THEN 'percent' WHEN {_is("regexp_matches(bare, '" + _MONEY_RE + "')")} THEN 'currency' WHEN {_is("regexp_matches(c, '^" + _NUMBER_RE + "$')")} THEN 'int'
WHEN {_is("regexp_matches(c, '^" + _NUMBER_RE + "(?:\\.[0-9]+)?$')")} THEN 'float' WHEN {_is("lower(c) IN ('true', 'false')")} THEN 'bool' WHEN {_is("length(c) >= 8 AND regexp_matches(c, '^[0-9]{4}-')")} THEN 'timestamp' ELSE 'text' END || CASE WHEN count(*) FILTER (has) < count(rw) THEN '?' ELSE '' END END AS type FROM cv GROUP BY doc_id, g, p),
cc AS (SELECT doc_id, g, string_agg(name || ' (' || type || ')', ', ' ORDER BY p) AS told, list(name || ':' || type ORDER BY p) AS columns FROM ct GROUP BY doc_id, g),
tables AS (SELECT hd.doc_id, hd.g, columns, '[' || coalesce(n, 0) || ' rows × ' || len(head) || ' columns]' || chr(10) || 'columns: ' || told || chr(10) || 'sample:' || chr(10) || list_aggregate(head, 'string_agg', ' | ') || coalesce(chr(10) || sample, '') || CASE WHEN n > 5 THEN chr(10) || '… (' || (n - 5) || ' more rows)' ELSE '' END AS short FROM hd JOIN cc USING (doc_id, g) LEFT JOIN dr USING (doc_id, g)),
ends AS (SELECT doc_id, g, {_instant("first(line ORDER BY i)")} AS a, {_instant("last(line ORDER BY i)")} AS z FROM x WHERE kind IN ('log', 'trace') GROUP BY doc_id, g),
bl AS (SELECT sg.doc_id, block, kind, first_line, lines, 'sha256:' || sha256(txt) AS digest, tokens, CASE WHEN tokens > 64 THEN CASE kind WHEN 'log' THEN logs.short WHEN 'trace' THEN traces.short WHEN 'code' THEN codes.short WHEN 'table' THEN tables.short END END AS short,
CASE WHEN kind = 'trace' THEN a WHEN a IS NOT NULL AND z IS NOT NULL THEN least(a, z) ELSE a END AS valid_from, CASE WHEN kind = 'trace' THEN a WHEN a IS NOT NULL AND z IS NOT NULL THEN greatest(a, z) ELSE z END AS valid_to, tables.columns AS columns, txt
FROM sg LEFT JOIN logs USING (doc_id, g) LEFT JOIN traces USING (doc_id, g) LEFT JOIN codes USING (doc_id, g) LEFT JOIN tables USING (doc_id, g) LEFT JOIN ends USING (doc_id, g)),
bk AS (SELECT doc_id, block, kind, first_line, lines, digest, tokens, CASE WHEN (strlen(short) + 3) // 4 < tokens THEN short END AS compact, CASE WHEN (strlen(short) + 3) // 4 < tokens THEN ((strlen(short) + 3) // 4)::BIGINT END AS compact_tokens, valid_from, valid_to, columns, txt FROM bl)
"""

SQL = {
    "ingest_segments": _SEGMENTS,
    "ingest_blocks": _BLOCKS + "SELECT * EXCLUDE (txt) FROM bk",
    "ingest_kinds": _BLOCKS + "SELECT kind, count(*) AS blocks, sum(tokens)::BIGINT AS tokens, sum(coalesce(compact_tokens, tokens))::BIGINT AS served FROM bk GROUP BY kind",
    "ingest_artifacts": _BLOCKS + "SELECT 'frm_' || substr(digest, 8, 12) AS frame_id, digest, first(doc_id ORDER BY doc_id, block) AS doc_id, count(*) AS copies, any_value(kind) AS kind FROM bk WHERE kind <> 'path' GROUP BY digest",
    "table_types": _BLOCKS + "SELECT doc_id, block, (i - 1)::INT AS pos, regexp_extract(columns[i], '(?s)^(.*):([a-z]+[?]?)$', 1) AS name, regexp_extract(columns[i], '(?s)^(.*):([a-z]+[?]?)$', 2) AS type FROM bk, LATERAL (SELECT unnest(range(1, len(columns) + 1)) AS i) WHERE kind = 'table'",
    "grep_lines": f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE contains(lower(line), 'budget') OR contains(lower(line), 'provider')",
    "match_places": f"WITH {_LINES} SELECT doc_id, line_no FROM l WHERE contains(lower(line), 'budget') OR contains(lower(line), 'provider')",
    "first_lines": f"WITH {_LINES} SELECT doc_id, arg_min(line, line_no) AS line, min(line_no) AS line_no FROM l WHERE trim(translate(line, chr(9) || chr(13), '  '), ' ') <> '' GROUP BY doc_id",
    "line_runs": f"WITH {_LINES}, m AS (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) = line THEN 0 ELSE 1 END AS new FROM l), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM m) SELECT doc_id, min(line_no) AS line_no, min(line) AS line, count(*) AS repeats FROM r GROUP BY doc_id, run",
    "definitions": f"WITH {_LINES} SELECT doc_id, line_no, regexp_extract(line, '{_DEF}', 1) AS keyword, regexp_extract(line, '{_DEF}', 2) AS name FROM l WHERE regexp_matches(line, '{_DEF}')",
    "imports": f"WITH {_LINES}, i AS (SELECT doc_id, line_no, trim(rtrim(trim(regexp_extract(line, '{_USE}', 1), ' ' || chr(9)), ';'), ' ' || chr(9)) AS name FROM l WHERE regexp_matches(line, '{_USE}')) SELECT * FROM i WHERE name <> ''",
    "calls": f"""WITH {_LINES}, df AS (SELECT doc_id, line_no, regexp_extract(line, '{_DEF}', 2) AS name FROM l WHERE regexp_extract(line, '{_DEF}', 1) = 'fn')
SELECT DISTINCT df.doc_id, df.name FROM df JOIN l ON l.doc_id = df.doc_id AND contains(l.line, df.name || '(') WHERE l.line_no <> df.line_no""",
    "lineage_latest": "SELECT doc_id, uri FROM documents WHERE uri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uri ORDER BY coalesce(recorded_at, '') DESC, doc_id DESC) = 1",
    "idempotent_append": """SELECT doc_id, CASE WHEN uri IS NULL OR citation_label IS NULL OR row_number() OVER w = 1 THEN 'accepted' WHEN sha256(text) IS NOT DISTINCT FROM first_value(sha256(text)) OVER w THEN 'duplicate' ELSE 'conflict' END AS status
FROM documents WINDOW w AS (PARTITION BY uri, citation_label ORDER BY doc_id)""",
    "record_problems": f"""WITH j AS (SELECT doc_id, CAST(text AS JSON) AS j FROM documents WHERE text IS NOT NULL AND starts_with(ltrim(text), '{{') AND json_valid(text)),
r AS (SELECT doc_id, j, j ->> '$.record_kind' AS k, j ->> '$.origin' AS origin, j ->> '$.observed_at' AS observed_at, j ->> '$.valid_from' AS valid_from, try_cast(j ->> '$.confidence' AS DOUBLE) AS confidence, j ->> '$.statement' AS st, j ->> '$.provenance.derivation_kind' AS dk FROM j),
p AS (SELECT doc_id, k AS record_kind, list_filter([CASE WHEN k NOT IN ('observation', 'knowledge', 'memory', 'directive', 'record_proposal', 'evidence', 'artifact_contract', 'contract_validation', 'outcome_assessment', 'promotion_event', 'context_use', 'context_use_feedback') THEN 'unknown kind' END,
CASE WHEN coalesce(origin NOT IN ('observed', 'derived', 'declared', 'imported'), true) THEN 'unknown origin' END,
CASE WHEN (k IN ('observation', 'memory', 'evidence') AND st IS NULL) OR (k = 'knowledge' AND (st IS NULL OR j ->> '$.knowledge_kind' IS NULL)) OR (k = 'directive' AND (st IS NULL OR j ->> '$.directive_kind' IS NULL)) OR (k = 'record_proposal' AND (j ->> '$.proposed_kind' IS NULL OR j ->> '$.rationale' IS NULL))
OR (k = 'artifact_contract' AND j ->> '$.contract_name' IS NULL) OR (k = 'contract_validation' AND (j ->> '$.contract_ref' IS NULL OR j ->> '$.outcome' IS NULL)) OR (k = 'outcome_assessment' AND (j ->> '$.subject_ref' IS NULL OR j ->> '$.assessment' IS NULL))
OR (k = 'promotion_event' AND (j ->> '$.subject_ref' IS NULL OR j ->> '$.to_status' IS NULL)) OR (k = 'context_use' AND (j ->> '$.used_record_ref' IS NULL OR j ->> '$.selected' IS NULL OR j ->> '$.rendered' IS NULL OR j ->> '$.cited' IS NULL)) OR (k = 'context_use_feedback' AND (j ->> '$.context_use_ref' IS NULL OR j ->> '$.feedback' IS NULL)) THEN 'body lacks a member' END,
CASE WHEN j ->> '$.schema_version' IS DISTINCT FROM 'lifecycle/1.0-draft' THEN 'schema version' END, CASE WHEN NOT coalesce(regexp_matches(j ->> '$.record_hash', '^sha256:[0-9a-f]{{64}}$'), false) THEN 'bad record hash' END,
CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'bad confidence' END, CASE WHEN NOT coalesce({_ok("observed_at")}, false) OR (valid_from IS NOT NULL AND NOT {_ok("valid_from")}) THEN 'bad instant' END,
CASE WHEN origin IN ('observed', 'declared') AND dk IS NOT NULL THEN 'derivation of what is not derived' END, CASE WHEN origin = 'derived' AND dk IS NULL THEN 'derived without derivation' END,
CASE WHEN k = 'directive' AND j ->> '$.directive_kind' = 'constraint' AND j ->> '$.constraint_effect' IS NULL THEN 'constraint without effect' END], lambda x: x IS NOT NULL) AS ps FROM r WHERE k IS NOT NULL)
SELECT doc_id, record_kind, ps[1] AS first, array_to_string(ps, ', ') AS problems FROM p""",
}
