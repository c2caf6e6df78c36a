"""Items of varying length put into containers of fixed capacity.

Method: non-negative least squares over the histogram of lengths. For each group, shallow combinations of lengths (up to
``DEPTH``) that fill a window below the capacity are enumerated; non-negative least squares finds how often to repeat each so that the
histogram is used up; the counts are rounded and applied where enough items are left; what remains is packed greedily, largest
first, into the fullest container that has room. A group of more than ``STRATUM`` distinct lengths is solved in strata, every k-th
length from the longest in one, so that each length takes part and the work grows with their number. The solution is rounded to
the nearest and down, and the better plan is kept; packing by the greedy step alone is the measure, and where it needs fewer
containers (many lengths that occur once or twice leave little to repeat) its plan is the one that holds: no group does worse.
All of it works on (length, count), never on single items: a plan says "the items 0 to 5,999 of length 300 go to containers 17 to 2,016, three each".

Worth: of items of one length, those of more worth (in steps of 1/32 of a worth from 0 to 1; unknown worth counts 0) go to the containers
of lower number. Which lengths share a container is decided by length alone, as any other choice leaves more room over.

Scale: an item finds its container by its rank among the items of its group and length. Ranks are taken in two steps over
sub-blocks by worth and hash, so neither a group nor a length of a third of all rows meets one task; a group's plan is bounded by its
distinct lengths, which are fewer than its capacity. Plans are made one group at a time, spread over all cores.

An item larger than the capacity is split: full containers of its own, and a rest that is packed like an item. Lengths are never
split otherwise.

Defined cases: items with a null length or without a known capacity go nowhere (null container); so do positive lengths where the
capacity is zero or less; zero and negative lengths take no room and go to the first container; exact duplicate rows count
once; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.sources.tables import materialise

DEPTH, WINDOW, STRATUM, PER_SIZE, TRIES = 4, 0.03, 96, 6, 400


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with all unknowns at least 0, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * n):  # the bound of the method; it ends when no gradient is left
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            ap = a[:, p]
            s = np.linalg.lstsq(ap.T @ ap, ap.T @ b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[p] = s
                break
            neg = s <= 0
            step = np.min(x[p][neg] / np.maximum(x[p][neg] - s[neg], 1e-300))
            x[p] += step * (s - x[p])
            passive[p[x[p] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def combinations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Multisets of at most DEPTH sizes (descending) whose sum lies in the window below the capacity, tightest first.

    Every size is the largest of at most PER_SIZE of them, the tightest of those met in TRIES steps.
    """
    low = capacity - max(1, int(capacity * WINDOW))
    up = sizes[::-1]
    have = dict(zip(sizes, counts))
    found: list[tuple[int, ...]] = []
    tries = 0

    def extend(chosen: tuple[int, ...], total: int, start: int):
        nonlocal tries
        room = capacity - total
        if len(chosen) + 1 == DEPTH:  # the last one is looked up
            at = bisect_left(up, max(low - total, 1))
            tries += 1
            if at < len(up) and (s := up[at]) <= room and s <= chosen[-1] and chosen.count(s) < have[s]:
                found.append((*chosen, s))
            return
        for at in range(start, len(sizes)):
            s = sizes[at]
            if s > room or chosen.count(s) >= have[s]:
                continue
            if total + s * (DEPTH - len(chosen)) < low or tries > TRIES:
                break
            tries += 1
            if total + s >= low:
                found.append((*chosen, s))
            else:
                extend((*chosen, s), total + s, at)

    out = []
    for at, s in enumerate(sizes):
        if s > capacity:
            continue
        found, tries = [], 0
        if s >= low:
            found.append((s,))
        elif s * DEPTH >= low:
            extend((s,), s, at)
        out += sorted(found, key=lambda c: (-sum(c), c))[:PER_SIZE]
    return sorted(out, key=lambda c: (-sum(c), c))


def repeats(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """Combinations of sizes with the number of times that least squares would repeat each, most often first."""
    order = [s for s in left if 0 < s <= capacity]
    out = []
    strata = -(-len(order) // STRATUM)
    for k in range(strata):
        sizes = order[k::strata]
        patterns = combinations(sizes, [left[s] for s in sizes], capacity)
        if not patterns:
            continue
        row = {s: i for i, s in enumerate(sizes)}
        a = np.zeros((len(sizes), len(patterns)))
        for j, p in enumerate(patterns):
            for s in p:
                a[row[s], j] += 1
        weight = np.sqrt(np.array(sizes, float))[:, None]  # a long item left over costs more than a short one
        x = nnls(a * weight, np.array([left[s] for s in sizes], float) * weight[:, 0])
        out += [(p, float(x[j])) for j, p in enumerate(patterns) if x[j] > 0]
    return sorted(out, key=lambda r: (-r[1], tuple(-s for s in r[0])))


def apply(patterns: list[tuple[tuple[int, ...], float]], left: dict[int, int], up: float) -> tuple[list[tuple[int, int, int, int]], int]:
    """Containers filled by the patterns as often as said (a part of ``1 - up`` and more rounded up) and as ``left``, which is used up, allows."""
    segments: list[tuple[int, int, int, int]] = []
    made = 0
    for pattern, x in patterns:
        need = {s: pattern.count(s) for s in pattern}
        times = min(int(x + up), *(left[s] // k for s, k in need.items()))
        if times > 0:
            for s, k in need.items():
                segments.append((s, made, times, k))
                left[s] -= k * times
            made += times
    return segments, made


def fill_up(segments: list[tuple[int, int, int, int]], made: int, left: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """What is left, largest first, each into the fullest container with room for it."""
    segments = list(segments)
    room: list[tuple[int, int, int]] = []  # (room, first container, containers) of all containers with room
    used: dict[int, int] = {}
    spans: dict[int, int] = {}
    for s, p0, times, k in segments:
        used[p0] = used.get(p0, 0) + s * k
        spans[p0] = times
    for p0, total in used.items():
        if total < capacity:
            insort(room, (capacity - total, p0, spans[p0]))
    for s, n in left.items():
        if n <= 0:
            continue
        if s <= 0:
            segments.append((s, 0, 1, n))
            made = max(made, 1)
            continue
        while n > 0:
            at = bisect_left(room, (s, -1, -1))
            if at < len(room):
                free, p0, span = room.pop(at)
            else:
                fit = capacity // s
                free, p0, span = capacity, made, -(-n // fit)
                made += span
            each = free // s
            full = min(span, n // each)
            if full:
                segments.append((s, p0, full, each))
                n -= full * each
                if free - each * s:
                    insort(room, (free - each * s, p0, full))
            rest = span - full
            if rest and n > 0:
                segments.append((s, p0 + full, 1, n))
                insort(room, (free - n * s, p0 + full, 1))
                n, full, rest = 0, full + 1, rest - 1
            if rest:
                insort(room, (free, p0 + full, rest))
    return segments, made


def plan(sizes: list[int], counts: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """Segments (size, first container, containers, items in each), the number of containers, and how many the greedy step alone would need."""
    items = dict(sorted(zip(sizes, counts), reverse=True))
    alone = fill_up([], 0, items, capacity)
    if alone[1] <= 1:
        return *alone, alone[1]
    patterns = repeats(items, capacity)
    plans = []
    for up in (0.5, 1e-9):
        left = dict(items)
        plans.append(fill_up(*apply(patterns, left, up), left, capacity))
    best = min(plans, key=lambda p: p[1])
    return *(best if best[1] <= alone[1] else alone), alone[1]


def numbered(df: DataFrame, keys: list[str], order: str, weight: Column, name: str, blocks: int = 32, first: Column | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over the rows of the same keys that come before, in some fixed order: by the small number ``first`` if given.

    In two steps over ``blocks`` hashed sub-blocks of each key (and ``first``), so that no key is ordered by one task.
    """
    block = F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int")
    rows = df.withColumn("_block", block if first is None else first.cast("int") * blocks + block).withColumn("_weight", weight)
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_within", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
        .join(starts, [*keys, "_block"])
        .withColumn(name, (F.col("_start") + F.col("_within")).cast("long"))
        .drop("_block", "_weight", "_within", "_start")
    )


PLAN = "grp long, size long, capacity long, containers long, greedy long, segments array<struct<start: long, first: long, times: long, each: long>>"


def _planned(batches):
    """Plans of a sorted histogram (grp, capacity, size, n), one group at a time."""
    names = ("grp", "size", "capacity", "containers", "greedy", "segments")
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "first", "times", "each")]))

    def made(key, sizes, counts):
        segments, containers, greedy = plan(sizes, counts, key[1])
        by: dict[int, list] = {}
        for s, first, times, each in sorted(segments, key=lambda x: x[1]):
            mine = by.setdefault(s, [])
            start = mine[-1]["start"] + mine[-1]["times"] * mine[-1]["each"] if mine else 0
            mine.append({"start": start, "first": first, "times": times, "each": each})
        return [(key[0], s, key[1], containers, greedy, mine) for s, mine in by.items()]

    key, sizes, counts = None, [], []
    for b in batches:
        rows: list[tuple] = []
        for *at, size, n in zip(*(b.column(c).to_pylist() for c in ("grp", "capacity", "size", "n"))):
            if tuple(at) != key:
                rows += made(key, sizes, counts) if sizes else []
                key, sizes, counts = tuple(at), [], []
            sizes.append(size)
            counts.append(n)
        yield _plan_batch(rows, names, kind)
    if sizes:
        yield _plan_batch(made(key, sizes, counts), names, kind)


def _plan_batch(rows, names, kind) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kind if n == "segments" else pa.int64()) for c, n in zip(columns, names)], names=list(names))


def plans_of(whole: DataFrame) -> DataFrame:
    """PLAN rows of items (grp, capacity, size), written to the shared folder."""
    histogram = whole.groupBy("grp", "capacity", "size").agg(F.count("*").alias("n"))
    parts = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * whole.sparkSession.sparkContext.defaultParallelism)
    ready = histogram.select("grp", "capacity", "size", "n").repartition(parts, "grp", "capacity").sortWithinPartitions("grp", "capacity", F.desc("size"))
    return materialise(ready.mapInArrow(_planned, PLAN), "container-plans")


def _items(items: DataFrame, group: str, item: str, size: str, capacity: str, worth: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row once; those that fit somewhere; and what of them is packed by size (whole items, rests of split ones)."""
    worth_of = F.lit(0.0) if worth is None else F.when(F.isnan(F.col(worth).cast("double")), 0.0).otherwise(F.coalesce(F.col(worth).cast("double"), F.lit(0.0)))
    rows = items.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(size).alias("length"), F.col(capacity).alias("capacity"), worth_of.alias("worth")).dropDuplicates()
    known = F.col("length").isNotNull() & F.col("capacity").isNotNull() & F.col("grp").isNotNull() & ((F.col("capacity") > 0) | (F.col("length") <= 0))
    rows = rows.withColumn("known", F.coalesce(known, F.lit(False)))
    over = F.greatest(F.col("length"), F.lit(0)) > F.col("capacity")
    fit = rows.where("known").withColumn("split", over & (F.col("capacity") > 0))
    whole = fit.withColumn("size", F.when(F.col("split"), F.col("length") % F.col("capacity")).otherwise(F.greatest("length", F.lit(0)))).where("NOT split OR size > 0")
    return rows, fit, whole


def pack(items: DataFrame, group: str, item: str, size: str, capacity: str, worth: str | None = None) -> DataFrame:
    """(group, item, container, part, part_size, parts): where each item goes; split items have a row for their containers of their own and one for the rest.

    ``items`` has bigint columns of those names, and a number for ``worth``. A split item's containers of its own are ``container`` and
    the ``parts - 1`` after it (``part`` 0); its rest is ``part`` 1.
    """
    rows, fit, whole = _items(items, group, item, size, capacity, worth)
    plans = plans_of(whole)
    unworthy = F.least(F.lit(31), F.greatest(F.lit(0), F.floor((F.lit(1.0) - F.col("worth")) * 32)))
    ranked = numbered(whole, ["grp", "capacity", "size"], "item", F.lit(1), "rank", 32, None if worth is None else unworthy)
    placed = (
        ranked.join(plans, ["grp", "capacity", "size"])
        .withColumn("s", F.expr("element_at(filter(segments, s -> s.start <= rank), -1)"))
        .withColumn("container", F.expr("s.first + (rank - s.start) div s.each"))
    )
    made = plans.groupBy("grp", "capacity").agg(F.max("containers").alias("containers"))
    large = numbered(fit.where("split").withColumn("full", F.expr("length div capacity")), ["grp", "capacity"], "item", F.col("full"), "before")
    own = large.join(made, ["grp", "capacity"], "left").withColumn("container", F.coalesce("containers", F.lit(0)) + F.col("before"))
    parts = F.when(F.col("split"), F.ceil(F.col("length") / F.col("capacity"))).otherwise(1).cast("long").alias("parts")
    out = ["grp", "item", "container"]
    nowhere = rows.where("NOT known")
    too_large = F.coalesce(F.col("length") > F.col("capacity"), F.lit(False))
    result = (
        placed.select(*out, F.col("split").cast("int").alias("part"), F.col("size").alias("part_size"), parts)
        .unionByName(own.select(*out, F.lit(0).alias("part"), (F.col("full") * F.col("capacity")).alias("part_size"), parts))
        .unionByName(nowhere.select("grp", "item", F.lit(None).cast("long").alias("container"), F.lit(0).alias("part"), F.col("length").alias("part_size"), F.when(too_large, 0).otherwise(1).cast("long").alias("parts")))
    )
    return result.withColumnsRenamed({"grp": group, "item": item})


def fill_report(items: DataFrame, group: str, item: str, size: str, capacity: str) -> DataFrame:
    """(group, capacity, containers, least, greedy): of each group, the containers its plan takes, the least there could be, and how many the greedy step alone takes.

    Without the full containers of split items, which are the same whatever the plan.
    """
    _, _, whole = _items(items, group, item, size, capacity, None)
    sums = whole.groupBy("grp", "capacity").agg(F.sum("size").alias("total"))
    made = plans_of(whole).groupBy("grp", "capacity").agg(F.max("containers").alias("containers"), F.max("greedy").alias("greedy"))
    least = F.greatest(F.lit(1), F.expr("(total + capacity - 1) div capacity"))
    return made.join(sums, ["grp", "capacity"]).select(F.col("grp").alias(group), "capacity", "containers", least.cast("long").alias("least"), "greedy")


def offered(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """The frames with the ``max_tokens`` of their query as ``capacity``."""
    capacity = queries.select("query_id", F.col("max_tokens").cast("long").alias("capacity")).where("query_id IS NOT NULL").dropDuplicates()
    return frames.select(F.col("query_id").cast("long").alias("query_id"), "frame_no", F.col("token_cost").cast("long").alias("token_cost"), "score").join(capacity, "query_id", "left")


def prompts(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, frame_no, container, part, part_size, parts): the frames of each query packed into prompts of its ``max_tokens``; of equal frames the better scored first."""
    return pack(offered(frames, queries), "query_id", "frame_no", "token_cost", "capacity", "score")
