"""Pasted text into typed blocks with compact renderings.

A text is cut at blank lines and fences; each block gets a kind from its shape (path, stack trace, log, table, code, prose), a digest
and, where that is shorter, a compact rendering: logs keep their ends and alerts, traces their first frames, tables their columns'
types and a sample, long code its head and tail. Blocks depend on their own text only, so all of it is one narrow pass over
Arrow batches, without a shuffle. Null, empty and blank texts have no blocks; texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: fixed values
PATH_EXTENSIONS = ["rs", "ts", "tsx", "js", "jsx", "py", "go", "rb", "java", "kt", "c", "h", "cc", "cpp", "hpp", "cs", "md", "toml", "json", "yaml", "yml", "txt", "sh", "sql", "lock", "cfg", "ini"]
LEVELS = ["ERROR", "ERR", "WARN", "WARNING", "INFO", "DEBUG", "TRACE", "FATAL", "CRITICAL", "CRIT", "PANIC", "PANICKED", "SEVERE", "NOTICE"]
ALERTS = ["ERROR", "ERR", "WARN", "WARNING", "FATAL", "CRITICAL", "CRIT", "PANIC", "PANICKED", "SEVERE"]
TRACE_MARKS = ["at ", 'File "', "Traceback", "panicked at", "-->", "Caused by", "thread '"]
CODE_STARTS = ["fn ", "def ", "class ", "import ", "const ", "let ", "var ", "pub ", "function ", "#include", "package ", "func ", "return ", "if ", "for ", "while ", "@"]
CODE_ENDS = (";", "{", "}", "=>", "):")
NO_VALUE = {"", "null", "nil", "none", "n/a", "na", "nan", "-", "—"}
COMPACT_OVER, CONTEXT, HEAD, TAIL, SAMPLE, CELL_WORDS, FRAMES, CODE_HEAD, CODE_TAIL = 64, 2, 8, 4, 5, 4, 8, 20, 8


def _word(names: list[str]) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(names)})(?![A-Za-z0-9])", re.I)


_LEVEL, _ALERT = _word(LEVELS), _word(ALERTS)
_CLOCK = r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
_DATED = re.compile(rf"\[?(\d{{4}})[-/](\d{{2}})[-/](\d{{2}})[T ]({_CLOCK})\]?\s*(Z|UTC|GMT|[+-]\d{{2}}:?\d{{2}})?")
_STAMP = re.compile(rf"\[?(?:\d{{4}}[-/]\d{{2}}[-/]\d{{2}}[T ]{_CLOCK}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d{{1,2}} {_CLOCK}|{_CLOCK})")
_LOGGISH = re.compile(r"\[|\d\S*[:-]")
_FRAME = re.compile(r'\s*(?:at |File "|from .*:|\d+: )|\t.*\.go:')
_HEADER = re.compile(r"Traceback \(most recent call last\)|thread '|Caused by|goroutine .*\[running\]|.*panicked at|(?:\S+\s+)?\S*(?:Error|Exception)(?=:|$)")
_PATHISH = re.compile(r"(?:\./|\.\./|~/|/)")
_NUMBER = re.compile(r"[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(\.\d+)?$")
_MONEY = re.compile(r"[+-]?(?:[$€£¥₹₽]\s*(?P<a>\S+)|(?P<b>\S+)\s*[$€£¥₹₽]|(?P<c>\S+) [A-Z]{3})$")


def text_lines(text: str | None) -> list[str]:
    """Lines end at a line feed, with or without a carriage return before it, and at nothing else."""
    pieces = (text or "").split("\n")
    last = pieces.pop()
    return [p[:-1] if p.endswith("\r") else p for p in pieces] + ([last] if last else [])


def split_blocks(text: str | None) -> list[tuple[bool, int, list[str]]]:
    """(fenced, number of the first line, lines) of each block; an unclosed fence runs to the end."""
    out, held, start, fenced = [], [], 0, False

    def flush():
        nonlocal held
        if any(line.strip() for line in held):
            out.append((fenced, start, held))
        held = []

    for i, line in enumerate(text_lines(text)):
        if line.lstrip().startswith("```"):
            flush()
            fenced = not fenced
        elif not fenced and not line.strip():
            flush()
        else:
            if not held:
                start = i
            held.append(line)
    flush()
    return out


def looks_like_path(line: str) -> bool:
    s = line.strip()
    if not s or re.search(r"\s", s) or s.startswith(("http://", "https://")):
        return False
    if s.startswith("file://"):
        return True
    rooted = bool(_PATHISH.match(s))
    name = s.rsplit("/", 1)[-1]
    known = "." in name and name.rsplit(".", 1)[1] in PATH_EXTENSIONS
    return rooted or known or ("/" in s and "." not in s.split("/", 1)[0])


def message_of(line: str) -> str:
    """A log line without the stamps, levels and brackets before its message, at most four of them."""
    rest = line.strip()
    for _ in range(4):
        first = rest.split(None, 1)
        if len(first) < 2 or not (_STAMP.match(rest) or rest.startswith("[") or _LEVEL.search(first[0])):
            break
        rest = first[1]
    return rest


def is_log_line(line: str) -> bool:
    t = line.lstrip()
    return bool(t) and (t.startswith(tuple(TRACE_MARKS)) or bool(_LEVEL.search(t) or _STAMP.match(t) or _LOGGISH.match(t.split(None, 1)[0])))


def row_cells(line: str, mark: str) -> list[str]:
    if mark == "|":
        cells = line.strip().split("|")
        cells = cells[1 if not cells[0].strip() and len(cells) > 1 else 0 :]
        return [c.strip() for c in (cells[:-1] if len(cells) > 1 and not cells[-1].strip() else cells)]
    if mark == "  ":
        return [c.strip() for c in re.split(r" {2,}", line.strip()) if c.strip()]
    return [c.strip() for c in line.split(mark)]


def agreed(counts: list[int]) -> int:
    """The most frequent count (the first seen among equals) if at least 7 in 10 have it, else 0."""
    if not counts:
        return 0
    top, n = Counter(counts).most_common(1)[0]
    return top if n * 10 >= len(counts) * 7 else 0


def delimiter(lines: list[str], aligned: bool) -> str | None:
    """``|``, tab, comma, or (``aligned``) runs of blanks, if the lines are the rows of a table."""
    short = lambda mark: all(len(c.split()) <= CELL_WORDS for line in lines for c in row_cells(line, mark))
    if aligned:
        return "  " if len(lines) >= 3 and agreed([len(row_cells(x, "  ")) for x in lines]) >= 2 and short("  ") else None
    if len(lines) < 2:
        return None
    for mark in "|\t,":
        if agreed([x.count(mark) for x in lines]) < 1:
            continue
        if mark == "\t" and sum(x.startswith("\t") for x in lines) * 10 >= len(lines) * 7:
            continue
        if mark == "," and (len(lines) < 3 or not short(",")):
            continue
        return mark
    return None


def classify(fenced: bool, lines: list[str]) -> str:
    if fenced:
        return "code"
    if len(lines) == 1 and looks_like_path(lines[0]):
        return "path"
    full = [x for x in lines if x.strip()]
    frames = sum(bool(_FRAME.match(x)) for x in full)
    if frames >= 2 and frames * 4 >= len(full) and any(_HEADER.match(message_of(x)) for x in full):
        return "trace"
    if sum(bool(_STAMP.match(x.lstrip())) for x in full) * 2 >= len(full) and any(_LEVEL.search(x) for x in full):
        return "log"
    if delimiter(lines, False):
        return "table"
    if sum(map(is_log_line, full)) * 2 >= len(full):
        return "log"
    if delimiter(lines, True):
        return "table"
    code = sum(x.rstrip().endswith(CODE_ENDS) or x.strip().startswith(tuple(CODE_STARTS)) for x in lines)
    return "code" if len(lines) >= 3 and code * 2 >= len(lines) else "prose"


def cell_type(cells: list[str]) -> str:
    """int, float, percent, currency, bool, timestamp, text or empty; ``?`` where cells are missing."""
    values = [c.strip() for c in cells if c.strip().lower() not in NO_VALUE]
    if not values:
        return "empty"

    def money(c: str) -> bool:
        m = _MONEY.match(c[1:-1] if c.startswith("(") and c.endswith(")") else c)
        return bool(m) and bool(_NUMBER.match((m["a"] or m["b"] or m["c"]).strip()))

    tests = {
        "percent": lambda c: c.endswith("%") and bool(_NUMBER.match(c[:-1].strip())),
        "currency": money,
        "int": lambda c: bool(m := _NUMBER.match(c)) and not m[1],
        "float": lambda c: bool(_NUMBER.match(c)),
        "bool": lambda c: c.lower() in ("true", "false"),
        "timestamp": lambda c: len(c) >= 8 and bool(re.match(r"\d{4}-", c)),
    }
    base = next((name for name, ok in tests.items() if all(map(ok, values))), "text")
    return base + "?" * (len(values) < len(cells))


def plural(n: int, noun: str) -> str:
    return f"{n} {noun}{'s' * (n != 1)}"


def compact_log(lines: list[str]) -> str:
    runs = [(line, len(list(same))) for line, same in groupby(lines)]
    alerts = [i for i, (line, _) in enumerate(runs) if _ALERT.search(line)]
    keep = {0, len(runs) - 1}
    keep |= {j for i in alerts for j in range(max(0, i - CONTEXT), min(len(runs), i + CONTEXT + 1))} if alerts else {*range(min(HEAD, len(runs))), *range(max(0, len(runs) - TAIL), len(runs))}
    note = f", {sum(runs[i][1] for i in alerts)} error/warn line(s)" if alerts else ""
    out, last = [f"[{len(lines)}-line log{note}]"], -1
    for i in sorted(keep):
        if i > last + 1:
            out.append(f"… ({plural(sum(n for _, n in runs[last + 1 : i]), 'line')} elided) …")
        out.append(runs[i][0])
        if runs[i][1] > 1:
            out.append(f"… (×{runs[i][1]})")
        last = i
    return "\n".join(out)


def compact_trace(lines: list[str]) -> str:
    at = [i for i, x in enumerate(lines) if _FRAME.match(x)]
    if len(at) <= FRAMES:
        return "\n".join(lines)
    cut, last = at[FRAMES], at[-1]
    return "\n".join([*lines[:cut], f"… ({plural(len(at) - FRAMES, 'more frame')})", *lines[last + 1 :]])


def table_columns(lines: list[str]) -> tuple[list[str], list[str], list[list[str]]]:
    """Names and types of the columns, and the rows."""
    full = [x for x in lines if x.strip()]
    mark = delimiter(full, False) or delimiter(full, True) or ("|" if any("|" in x for x in full) else "\t")
    rows = [r for r in (row_cells(x, mark) for x in full) if not all(re.fullmatch(r"[-:]+", c) for c in r)]
    if not rows:
        return [], [], []
    head, data = rows[0], rows[1:]
    return head, [cell_type([r[i] if i < len(r) else "" for r in data]) for i in range(len(head))], data


def compact_table(lines: list[str]) -> str:
    head, kinds, data = table_columns(lines)
    if not head:
        return "\n".join(lines)
    out = [f"[{len(data)} rows × {len(head)} columns]", "columns: " + ", ".join(f"{n} ({k})" for n, k in zip(head, kinds)), "sample:", " | ".join(head), *(" | ".join(r) for r in data[:SAMPLE])]
    return "\n".join([*out, f"… ({len(data) - SAMPLE} more rows)"] if len(data) > SAMPLE else out)


def compact_code(lines: list[str]) -> str:
    cut = len(lines) - CODE_HEAD - CODE_TAIL
    return "\n".join([*lines[:CODE_HEAD], f"… ({plural(cut, 'line')} elided) …", *lines[-CODE_TAIL:]]) if cut > 0 else "\n".join(lines)


COMPACT = {"log": compact_log, "trace": compact_trace, "table": compact_table, "code": compact_code}


def tokens(text: str) -> int:
    return (len(text.encode("utf-8", "replace")) + 3) // 4


def instant(line: str) -> str | None:
    """The instant at the head of a line, if its zone is UTC or not given."""
    m = _DATED.match(line.lstrip())
    if not m or (m[5] and m[5] not in ("Z", "UTC", "GMT", "+00:00", "-00:00", "+0000", "-0000")):
        return None
    return f"{m[1]}-{m[2]}-{m[3]}T{m[4].replace(',', '.')}Z"


def blocks(text: str | None):
    """(block, kind, first_line, lines, digest, tokens, compact, compact_tokens, valid_from, valid_to, columns) of each block."""
    for *row, _ in whole_blocks(text):
        yield tuple(row)


def whole_blocks(text: str | None):
    """As ``blocks``, with each block's own text at the end."""
    for n, (fenced, start, lines) in enumerate(split_blocks(text)):
        kind, full = classify(fenced, lines), "\n".join(lines)
        short = COMPACT[kind](lines) if kind in COMPACT and tokens(full) > COMPACT_OVER else None
        if short is not None and tokens(short) >= tokens(full):
            short = None
        ends = [instant(lines[0]), instant(lines[-1])] if kind == "log" else [instant(lines[0])] * 2 if kind == "trace" else [None, None]
        if all(ends):
            ends.sort()
        columns = [f"{a}:{k}" for a, k in zip(*table_columns(lines)[:2])] if kind == "table" else None
        digest = "sha256:" + hashlib.sha256(full.encode("utf-8", "replace")).hexdigest()
        yield n, kind, start, len(lines), digest, tokens(full), short, tokens(short) if short is not None else None, *ends, columns, full


SCHEMA = "block long, kind string, first_line long, lines long, digest string, tokens long, compact string, compact_tokens long, valid_from string, valid_to string, columns array<string>"


def ingest(documents: DataFrame, key: str = "doc_id", with_content: bool = False) -> DataFrame:
    """One row per block of every document, with its key, and its own text as ``content`` if asked for."""
    schema = SCHEMA + ", content string" * with_content
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches):
        for b in batches:
            rows = [(i, *row) for i, text in enumerate(b.column(1).to_pylist()) for row in whole_blocks(text)]
            got = list(zip(*rows)) if rows else [[]] * 13
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(got[0], pa.int64())), *(pa.array(g, k) for g, k in zip(got[1 : len(names) + 1], kinds))], names=[key, *names])

    return documents.select(key, "text").mapInArrow(run, f"`{key}` long, {schema}")
