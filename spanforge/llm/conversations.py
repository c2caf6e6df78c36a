"""Conversations put together again from message rows.

Method: keyed streaming state with event-time watermarks, in two stateful operators, one behind the other.

``block_records`` is keyed by a shard of the sessions and by block of ``BLOCK`` consecutive ``seq`` values, so that no session, however
long, is held by one task or one state, and a call of Python serves several short sessions. The state buffers the rows of each session's
block, first copy of each ``seq``, in whatever order and batch they come. The block is judged and numbered there: speaker codes in order,
holes, turns, open prompts, and its calls, each settled (asked for, made and answered in this order) or open. It is emitted on *closure*
(every ``seq`` is there, or the rows are dense from the block's start to a session_end) and else on *timeout*, when the watermark has
passed its last arrival by ``TIMEOUT_MS``. Until then a row that changes an emitted block makes another version of it.

``conversation_verdicts`` is keyed by a shard of the sessions and holds one summary per block. It emits a session's verdict and the
number of messages before each of its blocks, on closure (dense blocks, the last with a session_end) or timeout, again in versions.

Open calls whose parts lie in several blocks meet in the second state. Where one stays open (its session is then most likely broken or
lacks a reply), the calls of that session are looked at once more over all blocks by (session, call_id), as a call may also have been
settled in a block of its own.

Lateness: ``replay`` drains a stored journal in about ``BATCHES`` micro-batches of whole files. Rows behind the watermark, which Spark
drops and counts, and blocks that come again after their timeout are noticed, over however many batches, and then the replay is done
again as one batch, in which no row is late: no row is ever lost.

Defined cases: rows with null session or seq belong to no conversation; of rows with equal (session, seq) the first received counts
(null ``received_at`` last, then least ``delivery_id``); event names are compared trimmed and in lower case; null names in
``tool_calls`` ask for nothing; a null turn is unknown; an empty table gives no conversations; other columns are not read.
"""

from __future__ import annotations

import json
import pickle

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.sources.tables import scratch, stream_parquet

BLOCK, SHARDS, ROWS_PER_SHARD, BATCHES = 512, 4096, 3000, 4
DAY_MS = 24 * 3600 * 1000
LATENESS, TIMEOUT_MS = "7 days", 14 * DAY_MS
#: a record is emitted no earlier than the watermark of its batch, so the second watermark, kept a day further back, passes none
VERDICT_LATENESS, VERDICT_TIMEOUT_MS = "8 days", DAY_MS
FLUSH, FLUSH_AT, VERDICT_FLUSH_AT = "\0flush", "2250-01-01", "2255-01-01"
#: milliseconds of 2249-12-01 and 2254-12-01: no key waits for longer, so the flush rows' watermarks pass every deadline
LAST_DEADLINE, LAST_VERDICT_DEADLINE = 8_833_276_800_000, 8_991_043_200_000
#: letters of the events that matter; all others are 'o'
CODES = {"session_start": "s", "session_end": "e", "prompt_assembled": "p", "model_response": "r", "tool_call": "c", "tool_result": "t"}
LAST, NO_TURN = (1 << 63) - 1, -(1 << 62)
SUMMARY = "version long, closed boolean, ends boolean, n long, lo long, hi long, messages long, turn_lo long, turn_hi long, bad boolean, unanswered boolean, said_first string, said_last string, open_calls string"
RECORD = f"session string, block long, emitted long, {SUMMARY}, codes string, settled string"
VERDICT = "session string, version long, block long, block_version long, before long, broken boolean, empty boolean, missing_replies boolean, calls_open boolean"


def message_rows(journal: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """What the first state needs of each journal row."""
    event = F.lower(F.trim(F.col("event")))
    code = F.coalesce(*(F.when(event == name, letter) for name, letter in CODES.items()), F.lit("o"))
    return journal.where("session is not null and seq is not null").select(
        F.when(F.col("received_at").between("1700-01-01", FLUSH_AT), F.col("received_at").cast("timestamp")).alias("arrived"),  # Python holds nanoseconds
        F.when(F.col("session") == FLUSH, -1).otherwise(F.pmod(F.xxhash64("session"), F.lit(shards))).cast("int").alias("shard"),
        "session",
        F.floor((F.col("seq") - 1) / block).cast("long").alias("block"),
        "seq",
        F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(LAST)).alias("received"),
        F.coalesce("delivery_id", F.lit(LAST)).alias("delivery_id"),
        code.alias("code"),
        F.coalesce("turn", F.lit(NO_TURN)).cast("long").alias("turn"),
        F.when(code.isin("c", "t"), F.col("call_id")).alias("call_id"),
        F.when((code == "r") & (F.size("tool_calls") > 0), F.to_json("tool_calls")).alias("asked"),
    )


def is_closed(seqs: list[int], last_is_end: bool, block: int, width: int) -> bool:
    """``seqs`` sorted: a full block, or dense from the block's start to a session_end."""
    start = block * width + 1
    if not seqs or seqs[0] != start or seqs[-1] - start + 1 != len(seqs):
        return False
    return len(seqs) == width or last_is_end


def settled(call: list) -> bool:
    asked, made, answered = call
    return asked is not None and made is not None and answered is not None and asked < made < answered


def add_call(calls: dict, name: str, at: int, seq: int | None) -> None:
    """The least seq at which a call is asked for (0), made (1) and answered (2)."""
    mine = calls.setdefault(name, [None, None, None])
    if seq is not None and (mine[at] is None or seq < mine[at]):
        mine[at] = seq


def judged_block(rows: dict[int, tuple], block: int, width: int) -> dict:
    """A block's record (without its session, version and time) from its rows: seq to (received, delivery_id, code, turn, call_id, asked)."""
    seqs = sorted(rows)
    held = [rows[s] for s in seqs]
    codes = "".join([r[2] for r in held])
    turns = [r[3] for r in held if r[3] != NO_TURN]
    said = codes.translate(_SAID)
    calls: dict[str, list] = {}
    bad = (seqs[0] == 1 and codes[0] != "s") or any(a > b for a, b in zip(turns, turns[1:]))
    for seq, (_, _, code, _, call, asked) in zip(seqs, held):
        if code == "r":
            for name in json.loads(asked) if asked else ():
                if name is not None:
                    add_call(calls, name, 0, seq)
        elif code == "c" or code == "t":
            if call is None:
                bad = True
            else:
                add_call(calls, call, 1 if code == "c" else 2, seq)
    done = {k: v for k, v in calls.items() if settled(v)}
    ends = codes[-1] == "e"
    return {
        "closed": is_closed(seqs, ends, block, width), "ends": ends, "n": len(seqs), "lo": seqs[0], "hi": seqs[-1], "messages": sum(map(codes.count, "prct")),
        "turn_lo": min(turns, default=LAST), "turn_hi": max(turns, default=NO_TURN), "bad": bad, "unanswered": "pp" in said, "said_first": said[:1], "said_last": said[-1:],
        "open_calls": json.dumps([[k, *v] for k, v in calls.items() if k not in done]) if len(done) < len(calls) else None,
        "codes": codes, "settled": json.dumps([[k, *v] for k, v in done.items()]) if done else None,
    }


_SAID = {ord(c): None for c in "seoct"}


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def buffer_block(width: int, timeout_ms: int):
    """The first stateful step: (shard, block), arriving rows, state to records. The state has of each open session its deadline, rows, version, and whether rows changed since."""
    names = _columns(RECORD)

    def step(key, frames, state):
        shard, block = key
        if shard < 0:
            return
        held = pickle.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs()
        out: list[dict] = []

        def emit(session):
            mine = held[session]
            mine[2], mine[3] = mine[2] + 1, False
            latest = max((r[0] for r in mine[1].values() if r[0] < LAST), default=0) // 1000
            out.append(judged_block(mine[1], block, width) | {"session": session, "block": block, "version": mine[2], "emitted": min(max(latest, now, 0), LAST_DEADLINE)})

        if state.hasTimedOut:
            for session in [s for s, mine in held.items() if mine[0] <= now]:
                if held[session][3]:
                    emit(session)
                del held[session]
        else:
            touched = set()
            for pdf in frames:
                for session, seq, *row in zip(*(pdf[c].tolist() for c in ("session", "seq", "received", "delivery_id", "code", "turn", "call_id", "asked"))):
                    mine = held.get(session)
                    if mine is None:
                        mine = held[session] = [0, {}, 0, False]
                    old = mine[1].get(seq)
                    if old is None or (row[0], row[1]) < (old[0], old[1]):
                        mine[1][seq] = tuple(row)
                        mine[3] = mine[3] or old is None or tuple(row[2:]) != old[2:]
                    touched.add(session)
            for session in sorted(touched):
                mine = held[session]
                latest = max((r[0] for r in mine[1].values() if r[0] < LAST), default=0)
                mine[0] = min(max(latest // 1000, now) + timeout_ms, LAST_DEADLINE)
                rows = mine[1]
                if mine[3] and (len(rows) == width or any(r[2] == "e" for r in rows.values())):
                    seqs = sorted(rows)
                    if is_closed(seqs, rows[seqs[-1]][2] == "e", block, width):
                        emit(session)
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(min(mine[0] for mine in held.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({c: [r[c] for r in out] for c in names})

    return step


def block_records(stream: DataFrame, block: int = BLOCK, shards: int = SHARDS, lateness: str = LATENESS, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Streaming: the journal as judged blocks (RECORD). Use on any source; ``replay`` drains a stored journal through it."""
    return (
        message_rows(stream, block, shards)
        .withWatermark("arrived", lateness)
        .groupBy("shard", "block")
        .applyInPandasWithState(buffer_block(block, timeout_ms), RECORD, "buffer binary", "append", "EventTimeTimeout")
    )


def judged_session(blocks: dict[int, dict], version: int) -> list[tuple]:
    """The rows of VERDICT (without the session) of a session's block summaries: one with block -1 and, unless something but calls is wrong, one per block."""
    order = sorted(blocks)
    broken = blocks[order[0]]["lo"] != 1 or sum(b["n"] for b in blocks.values()) != blocks[order[-1]]["hi"]
    highest, said, before, missing = NO_TURN, "", 0, False
    calls: dict[str, list] = {}
    rows = []
    for at in order:
        b = blocks[at]
        broken |= b["bad"] or b["turn_lo"] < highest
        missing |= b["unanswered"] or (said == "p" and b["said_first"] == "p")
        highest, said = max(highest, b["turn_hi"]), b["said_last"] or said
        rows.append((version, at, b["version"], before, False, False, False, False))
        before += b["messages"]
        for name, *seqs in json.loads(b["open_calls"]) if b["open_calls"] else ():
            for k, seq in enumerate(seqs):
                add_call(calls, name, k, seq)
    missing |= said == "p"
    still_open = any(not settled(c) for c in calls.values())
    return [(version, -1, 0, 0, bool(broken), before == 0, bool(missing), still_open), *(rows if not (broken or missing or before == 0) else [])]


def judge_sessions(timeout_ms: int):
    """The second stateful step: shard, block summaries, state to verdicts. The state has of each open session its deadline, summaries, version, and whether they changed since."""
    fields, names = _columns(SUMMARY), _columns(VERDICT)

    def step(key, frames, state):
        if key[0] < 0:
            return
        held = pickle.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs()
        out: list[tuple] = []

        def emit(session):
            mine = held[session]
            mine[2], mine[3] = mine[2] + 1, False
            out.extend((session, *row) for row in judged_session(mine[1], mine[2]))

        if state.hasTimedOut:
            for session in [s for s, mine in held.items() if mine[0] <= now]:
                if held[session][3]:
                    emit(session)
                del held[session]
        else:
            touched = set()
            for pdf in frames:
                for session, block, emitted, *row in zip(*(pdf[c].tolist() for c in ("session", "block", "emitted", *fields))):
                    summary = dict(zip(fields, row))
                    mine = held.setdefault(session, [0, {}, 0, False])
                    mine[0] = max(mine[0], min(max(emitted, now) + timeout_ms, LAST_VERDICT_DEADLINE))
                    if block not in mine[1] or mine[1][block]["version"] < summary["version"]:
                        mine[1][block], mine[3] = summary, True
                    touched.add(session)
            for session in sorted(touched):
                blocks = held[session][1]
                if held[session][3] and 0 in blocks and max(blocks) == len(blocks) - 1 and blocks[len(blocks) - 1]["ends"] and all(b["closed"] for b in blocks.values()):
                    emit(session)
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(min(mine[0] for mine in held.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(dict(zip(names, zip(*out))))

    return step


def conversation_verdicts(records: DataFrame, shards: int = SHARDS, lateness: str = VERDICT_LATENESS, timeout_ms: int = VERDICT_TIMEOUT_MS) -> DataFrame:
    """Streaming: judged blocks (RECORD) as verdicts of sessions (VERDICT). Of several versions of a session the greatest holds."""
    shard = F.when(F.col("session") == FLUSH, -1).otherwise(F.pmod(F.xxhash64("session"), F.lit(shards))).cast("int")
    return (
        records.select(F.timestamp_millis("emitted").alias("arrived"), shard.alias("shard"), "session", "block", "emitted", *_columns(SUMMARY))
        .withWatermark("arrived", lateness)
        .groupBy("shard")
        .applyInPandasWithState(judge_sessions(timeout_ms), VERDICT, "buffer binary", "append", "EventTimeTimeout")
    )


def _one_row(spark: SparkSession, schema: T.StructType, **values) -> DataFrame:
    return spark.range(1).select(*((F.lit(values[f.name]) if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def _drain(spark: SparkSession, make, source: DataFrame, flush: DataFrame, base: str, at_once: bool, batches: int) -> int:
    """Run ``make`` over a stream and a last row of the far future, which lets every open key time out; gives the number of rows that came too late."""
    end = f"{base}/end"
    (flush if at_once else flush.limit(0)).write.parquet(end)  # in one batch nothing is late, so the last row may come along
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, 4 * batches + 100)  # the progress of every batch is looked at
    try:
        query = make(source.unionByName(stream_parquet(spark, end, flush.schema))).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").start()
        try:
            query.processAllAvailable()
            if not at_once:
                flush.write.mode("append").parquet(end)
                query.processAllAvailable()
            return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
        finally:
            query.stop()
    finally:
        spark.conf.set(kept, before)


def replay(spark: SparkSession, path: str, block: int = BLOCK, files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, verdicts): what the two streams emit for a stored journal. ``files_per_trigger`` 0 takes all files as one batch; None makes about ``BATCHES`` batches."""
    journal = spark.read.parquet(path)
    files, shards = len(journal.inputFiles()), max(64, journal.count() // ROWS_PER_SHARD)
    step = -(-files // BATCHES) if files_per_trigger is None else files_per_trigger
    at_once = step == 0 or files <= step
    base = scratch(spark, "conversations")
    flush = _one_row(spark, journal.schema, session=FLUSH, seq=0, received_at=FLUSH_AT)
    rows = stream_parquet(spark, path, journal.schema, None if at_once else step)
    late = _drain(spark, lambda s: block_records(s, block, shards), rows, flush, f"{base}/blocks", at_once, files)
    records = spark.read.schema(RECORD).parquet(f"{base}/blocks/out")
    if not at_once and (late or not records.where("version = 1").groupBy("session", "block").count().where("count > 1").isEmpty()):
        return replay(spark, path, block, 0)
    schema = T._parse_datatype_string(RECORD)
    flush = _one_row(spark, schema, session=FLUSH, block=0, version=0, emitted=F.unix_millis(F.lit(VERDICT_FLUSH_AT).cast("timestamp")))
    if _drain(spark, lambda s: conversation_verdicts(s, max(16, shards // 8)), stream_parquet(spark, f"{base}/blocks/out", schema), flush, f"{base}/verdicts", True, 1):
        raise RuntimeError("a judged block came behind the second watermark")
    verdicts = spark.read.schema(VERDICT).parquet(f"{base}/verdicts/out")
    last = verdicts.where("block = -1").groupBy("session").agg(F.max("version").alias("version"))
    return records, verdicts.join(last, ["session", "version"], "left_semi")


def call_problems(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, bad_call, no_answer) of ``sessions``, from all calls of all their blocks."""
    newest = records.join(sessions.select("session"), "session", "left_semi").groupBy("session", "block").agg(F.max_by(F.struct("open_calls", "settled"), "version").alias("r"))
    parsed = [F.coalesce(F.from_json(F.col(f"r.{c}"), "array<array<string>>"), F.array().cast("array<array<string>>")) for c in ("open_calls", "settled")]
    calls = newest.select("session", F.explode(F.concat(*parsed)).alias("x")).groupBy("session", F.col("x")[0].alias("call_id"))
    first = calls.agg(*(F.min(F.col("x")[i + 1].cast("long")).alias(c) for i, c in enumerate(("asked", "called", "answered"))))
    return first.groupBy("session").agg(
        F.bool_or(F.expr("(called IS NOT NULL AND coalesce(asked >= called, true)) OR (answered IS NOT NULL AND coalesce(called >= answered, true))")).alias("bad_call"),
        F.bool_or(F.expr("asked IS NOT NULL AND (called IS NULL OR answered IS NULL)")).alias("no_answer"),
    )


def judged(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(session, broken, empty, missing_replies) of every session."""
    whole = verdicts.where("block = -1")
    problems = call_problems(records, whole.where("calls_open"))
    return whole.join(problems, "session", "left").select(
        "session", (F.col("broken") | F.coalesce("bad_call", F.lit(False))).alias("broken"), "empty", (F.col("missing_replies") | F.coalesce("no_answer", F.lit(False))).alias("missing_replies")
    )


def messages(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(session, msg_no, seq, msg_role) of every whole conversation."""
    wrong = call_problems(records, verdicts.where("calls_open")).where("bad_call OR no_answer")
    kept = verdicts.where("block >= 0").join(wrong, "session", "left_anti").select("session", "block", F.col("block_version").alias("version"), "before")
    said = F.expr("filter(transform(split(codes, ''), (e, i) -> struct(lo + i AS seq, e)), x -> x.e IN ('p', 'r', 'c', 't'))")
    return kept.join(records.select("session", "block", "version", "lo", "codes"), ["session", "block", "version"]).select("session", "before", F.posexplode(said).alias("at", "m")).select(
        "session",
        (F.col("before") + F.col("at") + 1).cast("long").alias("msg_no"),
        F.col("m.seq").alias("seq"),
        F.expr("CASE m.e WHEN 'p' THEN 'user' WHEN 't' THEN 'tool' ELSE 'assistant' END").alias("msg_role"),
    )


def conversations(spark: SparkSession, path: str, block: int = BLOCK, files_per_trigger: int | None = None) -> DataFrame:
    """The messages of every whole conversation of the journal stored at ``path``."""
    return messages(*replay(spark, path, block, files_per_trigger))


def verdicts(spark: SparkSession, path: str, block: int = BLOCK, files_per_trigger: int | None = None) -> DataFrame:
    """(session, broken, empty, missing_replies) of every session of the journal stored at ``path``."""
    return judged(*replay(spark, path, block, files_per_trigger))
