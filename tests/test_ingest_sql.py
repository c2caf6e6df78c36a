"""Blocks of random pastes against SQL: the shapes that the tables have few or none of."""

import random

import duckdb
import pytest

from spanforge.operators import ingest
from spanforge.plans import texts


def _line(rng):
    stamp = rng.choice(["2026-07-20T18:00:01Z", "[2026/07/20 18:00:01,250]", "18:00:01.5", "Jul  2 08:00:00", "2026-07-20 18:00:01 +02:00", "2026-07-20T18:00:01 UTC"])
    level = rng.choice(["INFO", "ERROR", "warn:", "[debug]", "Panicked", "errand"])
    return rng.choice([f"{stamp} {level} step {rng.randrange(4)}", f"{level} {stamp} done", "plain words here", "at com.x.Y(Z.java:1)", "[worker] item", "10:20 start"])


def _trace(rng):
    head = rng.choice(["Traceback (most recent call last):", "2026-07-20T18:00:01Z ERROR ValueError: no", "thread 'main' panicked at x.rs", "goroutine 7 [running]:", "java.lang.Exception: no", "no header", "[a] [b] WARN Caused by"])
    frames = [rng.choice(['  File "a.py", line %d', "    at f.g(%d)", "  %d: core::x", "from lib.rb:%d"]) % i for i in range(rng.choice([1, 2, 5, 8, 9, 14]))]
    return [head, *frames, *rng.choice([[], ["ValueError: bad"], ["tail one", "tail two", "tail three"]])]


def _table(rng):
    mark = rng.choice(["|", ",", "\t", "    "])
    value = lambda: rng.choice(["1", "2.5", "1,200", "$3", "4 USD", "(7 €)", "50%", "true", "FALSE", "2026-01-02", "", "n/a", "-", "word", "two words", "five whole words in here"])
    columns = [rng.sample(["a", "b c", "x:y", "Total", "—"], k=rng.choice([2, 3]))]
    kinds = [rng.choice([value, lambda: str(rng.randrange(99)), lambda: f"{rng.randrange(99)}%", lambda: rng.choice(["", "3.5"])]) for _ in columns[0]]
    rows = columns + [[k() for k in kinds] for _ in range(rng.choice([1, 2, 4, 7, 30]))]
    if rng.random() < 0.3:
        rows.insert(1, ["---"] * len(rows[0]))
    edge = "|" if mark == "|" and rng.random() < 0.5 else ""
    return [edge + mark.join(r) + edge for r in rows]


def _paste(rng):
    blocks = []
    for _ in range(rng.randrange(1, 5)):
        shape = rng.choice(["log", "trace", "table", "code", "prose", "path", "fence"])
        if shape == "log":
            lines = [_line(rng) for _ in range(rng.choice([1, 3, 12, 40]))]
            lines = [x for x in lines for _ in range(rng.choice([1, 1, 1, 3]))]
        elif shape == "trace":
            lines = _trace(rng)
        elif shape == "table":
            lines = _table(rng)
        elif shape == "code":
            lines = [rng.choice(["fn f() {", "}", "return x;", "let y = 2", "x += 1;", "# note"]) for _ in range(rng.choice([2, 3, 27, 28, 29, 60]))]
        elif shape == "prose":
            lines = [rng.choice(["A sentence, with commas, in it.", "words", "é ü 日本"]) for _ in range(rng.randrange(1, 4))]
        elif shape == "path":
            lines = [rng.choice(["src/a.rs", "./x", "~/y z", "http://a/b", "file:///q", "a.b/c", "x.lock", "dir/name", "/", "1.5", "x.tar.gz"])]
        else:
            lines = ["```rust", *rng.choice([[], [""], ["a", "", "b", ""]]), *(["```"] if rng.random() < 0.8 else [])]
        blocks.append(lines)
    between = lambda: rng.choice(["\n\n", "\n", "\r\n\r\n", "\n \t\n", "\n\n\n"])
    return "".join(x for b in blocks for x in (rng.choice(["\n", "\n", "\r\n"]).join(b), between()))


@pytest.mark.parametrize("seed", range(4))
def test_blocks_against_sql(seed):
    rng = random.Random(seed)
    pastes = [_paste(rng) for _ in range(250)] + ["", " ", None, "\n", "x\x0cy\x85z", "a\r"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(pastes)))
    got = {(i, b[0]): (pastes[i], *b[1:]) for i, text in enumerate(pastes) for b in ingest.blocks(text)}
    want = {(r[0], r[1]): (pastes[r[0]], *r[2:]) for r in con.sql(texts.SQL["ingest_blocks"]).fetchall()}
    assert {r[1] for r in got.values()} == {"log", "trace", "table", "code", "prose", "path"}
    for key in sorted(got | want):
        assert got.get(key) == want.get(key), key
