"""Exactly one copy of each message that was delivered at least once.

Method: exact quotient hash tables. An identifier is written injectively into a fixed width, a keyed Feistel network permutes
that width, the leading bits of the result (the quotient) name the shard, and the shard's table stores the complete remainder.
The permutation is a bijection, so two identifiers meet in one slot with equal remainders only if they are equal: there are no
false matches, whatever the data. Identifiers longer than a width go to the next one, each width with a table of its own.

Scale: the permutation spreads skewed keys (one session may hold a third of all rows) evenly over the shards. Copies of one
identifier are combined inside each Arrow batch before the shuffle, so a message delivered very often reaches its shard about
once a batch. The number of shards follows the number of rows; one shard is about ``rows_per_shard`` rows. Batches that come one
after the other are inserted into stored tables (``insert_batch``).

Defined cases: a null identifier is never surplus; a null order column sorts last; rows that tie in all order columns keep one;
an empty input gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.sources.tables import materialise

LAST = np.iinfo(np.int64).max
ROWS_PER_SHARD = 32_768


def message_identifier(session: str = "session", seq: str = "seq", effect_id: str = "effect_id") -> Column:
    """(session, effect_id) where there is an effect, else (session, seq), as one string from which both can be read back; null if a part is."""
    head = F.concat(F.length(session).cast("string"), F.lit(":"), F.col(session))
    return F.when(F.col(effect_id).isNotNull(), F.concat(F.lit("e"), head, F.col(effect_id))).otherwise(
        F.concat(F.lit("s"), head, F.col(seq).cast("string"))
    )


def fixed_width(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: int) -> np.ndarray:
    """Rows of bytes as ``lanes`` 64-bit words each: the bytes, zeros, and the length in the last four bytes."""
    width = lanes * 8
    out = np.zeros((len(starts), width), np.uint8)
    total = int(lengths.sum())
    row = np.repeat(np.arange(len(starts)), lengths)
    within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, within] = data[np.repeat(starts, lengths) + within]
    out[:, -4:] = lengths.astype(np.uint32).view(np.uint8).reshape(-1, 4)
    return out.view(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sweeps(n: int, rounds: int):
    """(word to change, word it is changed by, key) of each step: forth and back over the words, so that the first depends on all."""
    for r in range(rounds):
        yield from ((k, k - 1, 2 * r) for k in range(1, n))
        yield from ((k, k + 1, 2 * r + 1) for k in range(n - 2, -1, -1))


def permute(words: np.ndarray, rounds: int = 2) -> np.ndarray:
    """A bijection of rows of words in time linear in their number: each step xors one word with a mix of its neighbour."""
    w = words.T.copy()
    for k, j, key in _sweeps(len(w), rounds):
        w[k] ^= _mix(w[j] + np.uint64(0xD6E8FEB86659FD93 + key))
    return w.T.copy()


def unpermute(words: np.ndarray, rounds: int = 2) -> np.ndarray:
    """The inverse of ``permute``."""
    w = words.T.copy()
    for k, j, key in reversed(list(_sweeps(len(w), rounds))):
        w[k] ^= _mix(w[j] + np.uint64(0xD6E8FEB86659FD93 + key))
    return w.T.copy()


def first_of_runs(words: np.ndarray, order: list[np.ndarray]) -> np.ndarray:
    """True for the row of each distinct ``words`` that is least in ``order``."""
    at = np.lexsort([*reversed(order), *words.T[::-1]])
    head = np.ones(len(at), bool)
    if len(at) > 1:
        s = words[at]
        head[1:] = (s[1:] != s[:-1]).any(axis=1)
    first = np.zeros(len(at), bool)
    first[at[head]] = True
    return first


def insert_once(remainders: np.ndarray, order: list[np.ndarray]) -> np.ndarray:
    """Insert the rows, least in ``order`` first, into an open table; True for the rows that went in, i.e. met no equal remainder.

    The home slot is taken from the remainder's leading word, slots hold complete remainders, collisions probe the next slot.
    """
    n = len(remainders)
    ranked = np.lexsort(list(reversed(order)))
    words = remainders[ranked]
    bits = max(4, int(n * 2 - 1).bit_length())
    mask = np.int64((1 << bits) - 1)
    slot = ((words[:, 0] ^ (words[:, -1] << np.uint64(1))) >> np.uint64(3)).astype(np.int64) & mask
    owner = np.full(1 << bits, -1, np.int64)
    went_in = np.zeros(n, bool)
    pending = np.arange(n)
    while len(pending):
        free = pending[owner[slot[pending]] < 0]
        at, first = np.unique(slot[free], return_index=True)
        owner[at] = free[first]
        went_in[free[first]] = True
        held = owner[slot[pending]]
        done = (held == pending) | (words[held] == words[pending]).all(axis=1)
        pending = pending[~done]
        slot[pending] = (slot[pending] + 1) & mask
    out = np.zeros(n, bool)
    out[ranked] = went_in
    return out


def _scatter(shard_bits: int):
    """Arrow batches (id, o1, o2, row) to (shard, rem, o1, o2, row, surplus)."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            n = b.num_rows
            if n == 0:
                continue
            offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + n + 1].astype(np.int64)
            data = np.frombuffer(ids.buffers()[2] or b"", np.uint8)
            known = np.asarray(ids.is_valid())
            lengths = np.diff(offsets)
            o1, o2 = (np.asarray(b.column(i).fill_null(LAST)) for i in (1, 2))
            row = np.asarray(b.column(3).fill_null(0))
            surplus = np.zeros(n, bool)
            shard = (row & ((1 << shard_bits) - 1)).astype(np.int32)  # rows that need no table just pass on
            rem: list = [None] * n
            lanes = np.maximum(2, (lengths + 4 + 7) // 8)
            for k in np.unique(lanes[known]):
                at = np.flatnonzero(known & (lanes == k))
                words = permute(fixed_width(data, offsets[:-1][at], lengths[at], int(k)))
                first = first_of_runs(words, [o1[at], o2[at]])
                surplus[at[~first]] = True
                words, at = words[first], at[first]
                shard[at] = (words[:, 0] >> np.uint64(64 - shard_bits)).astype(np.int32)
                words[:, 0] &= np.uint64((1 << (64 - shard_bits)) - 1)
                raw = words.tobytes()
                size = int(k) * 8
                for j, i in enumerate(at.tolist()):
                    rem[i] = raw[j * size : (j + 1) * size]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(rem, pa.binary()), b.column(1), b.column(2), b.column(3), pa.array(surplus)],
                names=["shard", "rem", "o1", "o2", "row", "surplus"],
            )

    return run


def _gather(t: pa.Table) -> pa.Table:
    rem = t.column("rem").combine_chunks()
    if isinstance(rem, pa.ChunkedArray):
        rem = pa.concat_arrays(rem.chunks)
    surplus = np.array(t.column("surplus"), bool)
    o1, o2 = (np.asarray(t.column(c).fill_null(LAST)) for c in ("o1", "o2"))
    known = np.asarray(rem.is_valid())
    sizes = np.asarray(rem.cast(pa.binary()).fill_null(b"").to_numpy(zero_copy_only=False), object)
    lengths = np.fromiter(map(len, sizes), np.int64, len(sizes))
    for size in np.unique(lengths[known]):
        at = np.flatnonzero(known & (lengths == size))
        words = np.frombuffer(b"".join(sizes[at]), np.uint64).reshape(len(at), -1)
        surplus[at[~insert_once(words, [o1[at], o2[at]])]] = True
    return pa.table({"row": t.column("row"), "surplus": pa.array(surplus)})


def mark_surplus(df: DataFrame, identifier: Column, row: str, order: list[Column], rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(row, surplus): every row of ``df`` by its bigint ``row`` column; surplus for all but the first of each identifier.

    ``order``: two bigint columns, least first.
    """
    bits = max(4, int(max(1, df.count() // rows_per_shard)).bit_length())
    keyed = df.select(identifier.cast("binary").alias("id"), order[0].cast("long").alias("o1"), order[1].cast("long").alias("o2"), F.col(row).alias("row"))
    spread = keyed.mapInArrow(_scatter(bits), "shard int, rem binary, o1 long, o2 long, row long, surplus boolean")
    return spread.groupBy("shard").applyInArrow(_gather, "row long, surplus boolean")


def _met():
    """A shard's new rows against what its table has stored: (row, surplus, shard, rem)."""

    def run(new: pa.Table, stored: pa.Table) -> pa.Table:
        marked = _gather(new)
        known = set(stored.column("rem").to_pylist())
        rem, surplus = new.column("rem"), np.array(marked.column("surplus"), bool)
        if known:
            surplus |= np.fromiter((r is not None and r in known for r in rem.to_pylist()), bool, len(rem))
        return pa.table({"row": new.column("row"), "surplus": pa.array(surplus), "shard": new.column("shard"), "rem": rem})

    return run


def insert_batch(batch: DataFrame, identifier: Column, row: str, order: list[Column], store: str, shards: int = 4096) -> DataFrame:
    """(row, surplus) of a batch of rows against all batches before it, whose identifiers ``store`` (a folder) holds; those of this batch are added.

    What came in an earlier batch came first. ``shards`` (a power of two) is that of the store and must stay; a shard's task holds the
    remainders of its shard, so it should be about the expected identifiers by ``ROWS_PER_SHARD``. If a run is lost before the end,
    nothing of it is in the store.
    """
    spark = batch.sparkSession
    keyed = batch.select(identifier.cast("binary").alias("id"), order[0].cast("long").alias("o1"), order[1].cast("long").alias("o2"), F.col(row).alias("row"))
    new = keyed.mapInArrow(_scatter(shards.bit_length() - 1), "shard int, rem binary, o1 long, o2 long, row long, surplus boolean")
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    stored = spark.read.schema("shard int, rem binary").parquet(store) if exists else spark.createDataFrame([], "shard int, rem binary")
    marked = materialise(new.groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(_met(), "row long, surplus boolean, shard int, rem binary"), "delivered")
    marked.where("NOT surplus AND rem IS NOT NULL").select("shard", "rem").write.mode("append").parquet(store)
    return marked.select("row", "surplus")


def journal_surplus(journal: DataFrame) -> DataFrame:
    """(row, surplus) of the journal's deliveries: messages by (session, seq), side effects by (session, effect_id)."""
    return mark_surplus(journal, message_identifier(), "delivery_id", [F.unix_micros(F.col("received_at").cast("timestamp")), F.col("delivery_id")])


def journal_batch(batch: DataFrame, store: str) -> DataFrame:
    """As ``journal_surplus``, for one batch of the journal against the batches before it."""
    return insert_batch(batch, message_identifier(), "delivery_id", [F.unix_micros(F.col("received_at").cast("timestamp")), F.col("delivery_id")], store, 64)


def deliver_once(journal: DataFrame) -> DataFrame:
    """The first delivery of each message, whole rows; rows whose identifier has a null all stay."""
    surplus = journal_surplus(journal).where("surplus").select(F.col("row").alias("delivery_id"))
    return journal.join(surplus, "delivery_id", "left_anti")
