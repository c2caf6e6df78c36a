"""Sources mixed to target shares of the total size.

Method: each source's documents, one after the other, are cut into blocks of ``BLOCK`` tokens (the last of a source in an input task may
be shorter). The total is the largest at which every source that has documents reaches its share without a block being taken more than
``max_repeats`` times (or a smaller one that is asked for). Each output shard of ``SHARD_BLOCKS`` blocks draws its source counts from a multinomial over what is still to be placed:
the shards are halved again and again, each half drawing from what its parent has, so that shards differ at random, totals come out
exactly, and a task finds the draws of its shards alone, in steps as many as their number has digits. A source's slots are numbered
through all shards; slot j takes, in repetition j div n, the block that a pseudorandom permutation of the source's n blocks gives for
j mod n, and slots and blocks are joined by (source, block).

Scale: blocks are cut where the texts are read, without a shuffle, so a source of a third of all documents meets no single task; the
blocks taken are shuffled once, to their places. The driver holds one row per source; shards grow in number, not in size, and are
drawn and filled with slots in the tasks.

Defined cases: sources are compared trimmed and in lower case; documents of null or untargeted sources, and with no tokens, take no
part; a source without documents gets nothing and is reported, the others keep their proportions; the report names the source that bounds
the total (``bounds``: no larger mixture keeps all shares within its repeats); a zero ``target_share`` or
``max_repeats`` takes nothing; repeated documents count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm import token_ids
from spanforge.sources.tables import materialise

BLOCK, SHARD_BLOCKS, SEED = 256, 256, 17


def token_blocks(documents: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, block_no, ids): the tokens of each targeted source in blocks; written to the shared folder.

    Each task cuts what it reads; blocks are numbered through all tasks by one row per task and source.
    """
    name = F.lower(F.trim("source"))
    wanted = targets.select(name.alias("source")).where("source is not null").distinct()
    own = documents.select(name.alias("source"), "text").join(F.broadcast(wanted), "source")  # a row per target, which the driver holds too
    cut = materialise(_cut(own, block), "mixture-blocks")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    made = cut.groupBy("source", "part").agg(F.count("*").alias("n"))
    starts = made.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return cut.join(starts, ["source", "part"]).select("source", (F.col("start") + F.col("at")).alias("block_no"), "ids")


def _cut(own: DataFrame, block: int) -> DataFrame:
    make = token_ids.compile_encoder(own)

    def run(batches):
        encoder, part = make(), TaskContext.get().partitionId()
        held: dict[str, np.ndarray] = {}
        made: dict[str, int] = {}

        def out(cuts: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
            """Of each source's tokens as many blocks as they have, the last one as it is."""
            source, at, sizes = [], [], []
            for name, ids in cuts:
                n = -(-len(ids) // block)
                first = made.get(name, 0)
                made[name] = first + n
                source += [name] * n
                at.append(np.arange(first, first + n))
                sizes.append(np.minimum(block, len(ids) - block * np.arange(n)))
            flat = np.concatenate([ids for _, ids in cuts]) if cuts else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], *map(np.asarray, sizes)]).cumsum().astype(np.int32)
            numbers = np.concatenate(at) if at else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(np.full(len(source), part, np.int32)), pa.array(numbers.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["source", "part", "at", "ids"])

        for b in batches:
            ids = encoder.batch(b.column("text").to_pylist())
            values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            rows: dict[str, list[np.ndarray]] = {}
            for i, name in enumerate(b.column("source").to_pylist()):
                if offsets[i + 1] > offsets[i]:
                    rows.setdefault(name, []).append(values[offsets[i] : offsets[i + 1]])
            cuts = []
            for name, pieces in rows.items():
                tokens = np.concatenate([held.get(name, values[:0]), *pieces])
                whole = len(tokens) // block * block
                held[name] = tokens[whole:].copy()
                cuts.append((name, tokens[:whole]))
            yield out(cuts)
        yield out([(name, tokens) for name, tokens in held.items() if len(tokens)])

    return own.mapInArrow(run, "source string, part int, at long, ids array<int>")


def bound(tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int]) -> tuple[str | None, float]:
    """The source that bounds the mixture (ties: first by name), and the tokens at which it does."""
    can = {s: tokens[s] * max(0, repeats[s] or 0) for s in shares if (shares[s] or 0) > 0 and tokens.get(s)}
    weight = sum(shares[s] for s, n in can.items() if n > 0)
    most, source = min(((n * weight / shares[s], s) for s, n in can.items() if n > 0), default=(0.0, None))
    return source, most


def block_counts(blocks: dict[str, int], tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """How many blocks of each source: the most tokens at which all sources with blocks keep their shares, or ``total`` tokens if that is less."""
    can = {s: tokens[s] * max(0, repeats[s] or 0) for s in shares if (shares[s] or 0) > 0 and tokens.get(s)}
    can = {s: n for s, n in can.items() if n > 0}
    if not can:
        return {}
    weight = sum(shares[s] for s in can)
    most = bound(tokens, shares, repeats)[1]
    if total is not None:
        most = min(most, total)
    return {s: min(blocks[s] * repeats[s], round(most * shares[s] / weight * blocks[s] / tokens[s])) for s in can}


def drawn(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """``size`` of ``left``, multinomially, never more of a source than there is."""
    out = np.zeros(len(left), np.int64)
    rest = left.astype(np.int64)
    while size > 0 and rest.sum() > 0:
        got = np.minimum(rng.multinomial(min(size, int(rest.sum())), rest / rest.sum()), rest)
        out, rest, size = out + got, rest - got, size - int(got.sum())
    return out


def shard_draws(counts: np.ndarray, shards: int, begin: int, end: int, seed: int = SEED):
    """(shard, slots of each source, first slot of each source) of the shards from ``begin`` to before ``end`` of all ``shards``."""
    total = int(counts.sum())
    start = lambda shard: total * shard // shards
    todo = [(0, shards, np.asarray(counts, np.int64), np.zeros(len(counts), np.int64))]
    while todo:
        lo, hi, held, first = todo.pop()
        if hi <= begin or lo >= end:
            continue
        if hi - lo == 1:
            yield lo, held, first
            continue
        mid = (lo + hi) // 2
        left = drawn(np.random.default_rng([seed, lo, hi]), held, start(mid) - start(lo))
        todo += [(mid, hi, held - left, first + left), (lo, mid, left, first)]


def permuted(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 at ``index``: a Feistel network on the next even number of bits, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(rounds):
            h = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % (1 << 64))) * np.uint64(0x94D049BB133111EB)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). The mixture: (shard, pos, source, block_no, repetition, n_tokens, ids); the report: one row per target with the share reached."""
    spark = documents.sparkSession
    blocks = token_blocks(documents, targets, block)
    goals = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats")).where("source is not null").dropDuplicates(["source"])
    stock = blocks.groupBy("source").agg(F.count("*").alias("blocks"), F.sum(F.size("ids")).cast("long").alias("tokens"))
    rows = goals.join(stock, "source", "left").na.fill(0, ["blocks", "tokens"]).collect()  # one row per target
    sizes = {r.source: r.blocks for r in rows}
    counts = block_counts(sizes, {r.source: r.tokens for r in rows}, {r.source: r.target_share for r in rows}, {r.source: r.max_repeats for r in rows}, total_tokens)
    names = sorted(s for s in counts if counts[s])
    wanted, stock_of = np.array([counts[s] for s in names], np.int64), np.array([sizes[s] for s in names], np.int64)
    total = int(wanted.sum())
    shards = -(-total // SHARD_BLOCKS)

    def place(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for at in range(0, len(ids), 64):
                part = ids[at : at + 64]
                yield _placed(list(shard_draws(wanted, shards, int(part[0]), int(part[-1]) + 1, seed)), names, stock_of, seed)

    parts = max(1, min(shards, max(4 * spark.sparkContext.defaultParallelism, shards // 1024)))
    chosen = spark.range(0, shards, 1, parts).mapInArrow(place, "shard long, pos long, source string, repetition long, block_no long")
    mixture = chosen.join(blocks, ["source", "block_no"]).select("shard", "pos", "source", "block_no", "repetition", F.size("ids").alias("n_tokens"), "ids")
    taken = chosen.join(blocks.select("source", "block_no", F.size("ids").alias("n_tokens")), ["source", "block_no"]).groupBy("source").agg(F.sum("n_tokens").cast("long").alias("taken_tokens"), (F.max("repetition") + 1).alias("repeats"))
    least = bound({r.source: r.tokens for r in rows}, {r.source: r.target_share for r in rows}, {r.source: r.max_repeats for r in rows})[0]
    everything = Window.partitionBy()
    report = goals.join(stock, "source", "left").join(taken, "source", "left").na.fill(0, ["blocks", "tokens", "taken_tokens", "repeats"])
    report = report.withColumn("bounds", F.col("source").eqNullSafe(F.lit(least)))
    return mixture, report.withColumn("actual_share", F.coalesce(F.col("taken_tokens") / F.nullif(F.sum("taken_tokens").over(everything), F.lit(0)), F.lit(0.0)))


def _placed(draws, names: list[str], stock: np.ndarray, seed: int) -> pa.RecordBatch:
    """The slots of some shards, in random order within each, with the blocks they take."""
    shard, pos, number, slot = [], [], [], []
    for at, held, first in draws:
        n = int(held.sum())
        shard.append(np.full(n, at))
        pos.append(np.random.default_rng([seed, at]).permutation(n))
        number.append(np.repeat(np.arange(len(held)), held))
        slot.append(np.concatenate([np.arange(a, a + k) for a, k in zip(first, held)]) if n else np.zeros(0, np.int64))
    shard, pos, number, slot = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (shard, pos, number, slot))
    turn = slot // stock[number]
    block = np.zeros(len(slot), np.int64)
    for source, t in np.unique(np.stack([number, turn]), axis=1).T if len(slot) else ():
        mine = np.flatnonzero((number == source) & (turn == t))
        n = int(stock[source])
        block[mine] = permuted(slot[mine] % n, n, seed * 1_000_003 + int(source) * 1009 + int(t))
    source = pa.array(names, pa.string()).take(pa.array(number))
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(pos), source, pa.array(turn), pa.array(block)], names=["shard", "pos", "source", "repetition", "block_no"])
