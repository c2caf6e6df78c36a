"""Conversations from streams of several batches, against SQL on random journals, and with rows that come late."""

import datetime
import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import rows

from spanforge.llm import conversations, q_conversations

EVENTS = ["prompt_assembled", "model_response", "tool_call", "tool_result", "turn_start", "session_end"]
KINDS = {"delivery_id": pa.int64(), "batch_no": pa.int64(), "received_at": pa.timestamp("us"), "session": pa.string(), "seq": pa.int64(), "turn": pa.int64(), "event": pa.string(), "tool_calls": pa.list_(pa.string()), "call_id": pa.string()}
DAY = datetime.datetime(2026, 7, 1)


def _journal(rng, sessions):
    """Sessions that are mostly whole, some with an event changed, lost or sent again, in random order of arrival within ten days."""
    out = []
    for s in range(sessions):
        events, turn = [("session_start", None, None)], 1
        for k in range(rng.choice([0, 1, 2, 6])):
            events.append(("prompt_assembled", None, None))
            ids = [f"c{k}.{i}" for i in range(rng.choice([0, 0, 1, 3]))]
            events.append(("model_response", ids or None, None))
            events += [(e, None, c) for c in ids for e in ("tool_call", "tool_result")]
            if ids:
                events.append(("model_response", rng.choice([[], [None], ids]), None))  # may ask again for what was answered
        if rng.random() < 0.8:
            events.append(("session_end", None, None))
        if rng.random() < 0.4 and len(events) > 2:
            at = rng.randrange(len(events))
            events[at] = (rng.choice(EVENTS), rng.choice([None, ["c0.0"], ["x"]]), rng.choice([None, "c0.0", "c1.0", "x"]))
        if rng.random() < 0.2 and len(events) > 3:
            a, b = rng.sample(range(1, len(events)), 2)
            events[a], events[b] = events[b], events[a]
        lost = rng.randrange(1, len(events) + 1) if rng.random() < 0.1 else None
        start = DAY + datetime.timedelta(hours=rng.randrange(24 * 60))
        for seq, (event, calls, call) in enumerate(events, 1):
            turn += rng.random() < 0.2
            if seq == lost:
                continue
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                when = start + datetime.timedelta(minutes=rng.randrange(24 * 60 * 6))
                out.append([0, 0, when, f"s{s}", seq, rng.choice([None, turn, turn, turn - (rng.random() < 0.05)]), rng.choice([event, f" {event.upper()} "]), calls, call])
    out.sort(key=lambda r: r[2])
    for i, r in enumerate(out):
        r[0] = i
    return out


def _write(path, chunks):
    os.makedirs(path)
    for i, chunk in enumerate(chunks):
        name = f"{path}/part-{i:05d}.parquet"
        pq.write_table(pa.table({c: pa.array([r[k] for r in chunk], t) for k, (c, t) in enumerate(KINDS.items())}), name)
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def _same(spark, path, block, files):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW journal AS SELECT * FROM '{path}/*.parquet'")
    got = conversations.replay(spark, path, block, files)
    for name, df in (("p1_found", conversations.messages(*got)), ("p1_verdicts", conversations.judged(*got))):
        want = con.sql(q_conversations.SQL[name])
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall()), name


@pytest.mark.parametrize("seed, block, batches", [(1, 512, 1), (2, 3, 1), (3, 5, 4), (4, 512, 6)])
def test_random_journals(spark, tmp_path, seed, block, batches):
    out = _journal(random.Random(seed), 150)
    size = -(-len(out) // batches)
    _same(spark, _write(f"{tmp_path}/journal.parquet", [out[i : i + size] for i in range(0, len(out), size)]), block, 1 if batches > 1 else 0)


def test_rows_that_come_late_over_more_than_a_hundred_batches(spark, tmp_path):
    out = _journal(random.Random(9), 40)
    late = [r for r in out if r[3] in ("s1", "s2") and r[4] == 2]
    assert late and out[-1][2] - min(r[2] for r in late) > datetime.timedelta(days=21)
    rest = [r for r in out if r not in late]
    size = -(-len(rest) // 102)
    chunks = [rest[i : i + size] for i in range(0, len(rest), size)]
    chunks.insert(len(chunks) - 1, late)
    assert len(chunks) > 100
    _same(spark, _write(f"{tmp_path}/journal.parquet", chunks), 4, 1)


def test_a_row_after_closure_makes_another_version(spark, tmp_path):
    talk = ["session_start", "prompt_assembled", "model_response", "session_end", "prompt_assembled"]
    out = [[i, 0, DAY + datetime.timedelta(minutes=i), "s", i + 1, None, e, None, None] for i, e in enumerate(talk)]
    path = _write(f"{tmp_path}/journal.parquet", [out[:4], out[4:]])
    records, _ = conversations.replay(spark, path, 512, 1)
    assert sorted((r.version, r.closed, r.codes) for r in records.collect()) == [(1, True, "spre"), (2, False, "sprep")]
    _same(spark, path, 512, 1)
    assert conversations.conversations(spark, path, 512, 1).count() == 0
