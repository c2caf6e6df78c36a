"""Composition of a prompt: duplicates out, packed by value, placed at the edges, rendered, with every frame accounted for.

Frames of one query are duplicates if they share a digest or cite the same file region. The scan that finds them takes frames in identity
order and keeps the best of each cluster, which depends on that order; it runs inside connected components of the evidence graph,
whose edges are stars (each frame to the least frame with its key), never all pairs. Components come from what each task can join by
itself and min-label rounds over the rest; a component is scanned as a sorted stream.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import expr as X
from spanforge.operators.retrieve import UNLIMITED, fold_budget
from spanforge.sources.tables import materialise


def identity_order() -> list:
    return [F.asc_nulls_first("provider_id"), F.asc_nulls_first("frame_id"), F.asc_nulls_first("content_digest"), F.asc("arrival"), F.asc("frame_no")]



def by_identity(offers: DataFrame) -> DataFrame:
    """The first arrival of each (provider, frame, digest) in a query."""
    w = Window.partitionBy("query_id", "provider_id", "frame_id", "content_digest").orderBy("arrival", "frame_no")
    return offers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evidence_keys(offers: DataFrame) -> DataFrame:
    """(query_id, frame_no, key): a digest, or the place in a file that a provenance link names (an absent range is a value)."""
    digest = offers.where("content_digest IS NOT NULL").select("query_id", "frame_no", F.concat(F.lit("d"), "content_digest").alias("key"))
    link = offers.select("query_id", "frame_no", F.explode("provenance").alias("p")).where("p.type = 'file' AND p.uri IS NOT NULL")
    region = link.select("query_id", "frame_no", F.concat(F.lit("f"), "p.uri", F.lit("\1"), F.coalesce(F.concat(F.lit("r"), "p.range"), F.lit("-"))).alias("key"))
    return digest.unionByName(region).distinct()


def _least(batches):
    """The nodes of a task's edges (query_id, a, b), each with the least node it hangs together with by them."""
    parent: dict[tuple[int, int], int] = {}

    def root(q: int, x: int) -> int:
        top = x
        while (up := parent.get((q, top), top)) != top:
            top = up
        while (up := parent.get((q, x), x)) != top:
            parent[q, x], x = top, up
        return top

    for b in batches:
        for q, x, y in zip(*(b.column(c).to_pylist() for c in ("query_id", "a", "b"))):
            x, y = root(q, x), root(q, y)
            parent.setdefault((q, x), x)
            parent.setdefault((q, y), y)
            parent[q, max(x, y)] = min(x, y)
    nodes = list(parent)
    columns = ([q for q, _ in nodes], [x for _, x in nodes], [root(q, x) for q, x in nodes])
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "a", "b"])


def components(keys: DataFrame, parts: int = 16) -> DataFrame:
    """(query_id, frame_no, component) of all frames that share a key with another.

    Each task first joins what hangs together by its own edges (a query's edges lie in up to ``parts`` tasks, so that a hot query
    meets no single one); then min-label rounds with pointer jumping over what is left, only of labels that still change, until none does.
    """
    w = Window.partitionBy("query_id", "key")
    stars = keys.withColumn("hub", F.min("frame_no").over(w)).where("hub <> frame_no").select("query_id", F.col("frame_no").alias("a"), F.col("hub").alias("b")).distinct()
    spread = stars.withColumn("_part", F.pmod(F.xxhash64("b"), F.lit(parts))).repartition("query_id", "_part").select("query_id", "a", "b")
    near = materialise(spread.mapInArrow(_least, "query_id long, a long, b long"), "evidence-near")
    # a node that lies in several tasks ties their roots together; all others have their label but for what its root becomes
    tied = near.groupBy("query_id", "a").agg(F.min("b").alias("low"), F.collect_set("b").alias("roots")).where("size(roots) > 1")
    edges = materialise(tied.select("query_id", "low", F.explode("roots").alias("b")).where("low <> b").distinct(), "evidence-ties")
    both = edges.select("query_id", F.col("b").alias("a"), F.col("low").alias("b")).unionByName(edges.select("query_id", F.col("low").alias("a"), "b")).distinct()
    label = both.groupBy("query_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
    label = materialise(label, "labels")
    while True:
        seen = both.join(label.select("query_id", F.col("a").alias("b"), F.col("to").alias("c")), ["query_id", "b"]).groupBy("query_id", "a").agg(F.min("c").alias("c"))
        lower = label.join(seen, ["query_id", "a"]).select("query_id", "a", F.col("to").alias("old"), F.least("to", "c").alias("to"))
        jump = lower.select("query_id", F.col("a").alias("to"), F.col("to").alias("further"))
        new = materialise(lower.join(jump, ["query_id", "to"], "left").select("query_id", "a", "old", F.least("to", F.coalesce("further", "to")).alias("to")), "labels")
        label = new.drop("old")
        if new.where("old <> to").isEmpty():
            break
    own = near.groupBy("query_id", "a").agg(F.min("b").alias("b"))
    found = own.join(label.withColumnsRenamed({"a": "b"}), ["query_id", "b"], "left")
    return found.select("query_id", F.col("a").alias("frame_no"), F.coalesce("to", "b").alias("component"))


def leaders(offers: DataFrame) -> DataFrame:
    """(query_id, frame_no, kept): the frame that stands for each; itself if it is kept.

    In identity order, a frame joins the first cluster whose present representative has its digest or a file region of its provenance
    so far; a higher score takes the representative's place, and regions are united.
    """
    keys = evidence_keys(offers)
    comp = components(keys)
    member = offers.join(comp, ["query_id", "frame_no"], "left").withColumn("component", F.coalesce("component", "frame_no"))
    regions = F.expr("transform(filter(coalesce(provenance, array()), p -> p.type = 'file' AND p.uri IS NOT NULL), p -> concat(p.uri, '\\u0001', coalesce(concat('r', p.range), '-')))")
    ready = member.select("query_id", "component", "frame_no", "provider_id", "frame_id", "content_digest", "arrival", F.coalesce("score", F.lit(0)).cast("float").alias("score"), regions.alias("regions"))
    ready = ready.repartition("query_id", "component").sortWithinPartitions("query_id", "component", *identity_order())

    def run(batches):
        group, clusters, queue, by_digest, by_region = None, [], [], {}, {}

        def flush():
            for frame, cluster in queue:
                yield group[0], frame, cluster["kept"]

        def out(rows):
            got = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()) for g in got], names=["query_id", "frame_no", "kept"])

        for b in batches:
            done = []
            for q, c, frame, digest, score, regs in zip(*(b.column(k).to_pylist() for k in ("query_id", "component", "frame_no", "content_digest", "score", "regions"))):
                if (q, c) != group:
                    done += flush()
                    group, clusters, queue, by_digest, by_region = (q, c), [], [], {}, {}
                regs = set(regs or ())
                found = [by_region[r] for r in regs if r in by_region]
                if digest is not None and by_digest.get(digest):
                    found.append(min(by_digest[digest]))
                at = min(found, default=len(clusters))
                if at == len(clusters):
                    clusters.append({"kept": frame, "digest": digest, "score": score})
                    by_digest.setdefault(digest, set()).add(at)
                elif score > clusters[at]["score"]:
                    by_digest[clusters[at]["digest"]].discard(at)
                    clusters[at] |= {"kept": frame, "digest": digest, "score": score}
                    by_digest.setdefault(digest, set()).add(at)
                for r in regs:
                    by_region[r] = min(at, by_region.get(r, at))
                queue.append((frame, clusters[at]))
            yield out(done)
        if group is not None:
            yield out(list(flush()))

    return ready.mapInArrow(run, "query_id long, frame_no long, kept long")


def packed(offers: DataFrame) -> DataFrame:
    """(query_id, frame_no, rank, cost, keep, remaining): greedy by score over canonical costs; a reference costs nothing."""
    cost = F.when(F.col("representation") == "reference", 0).otherwise(X.budget_tokens("content"))
    ready = offers.withColumn("canonical", cost).withColumn("q_frames", F.lit(UNLIMITED))
    return fold_budget(ready, [F.desc_nulls_last("score"), *identity_order()], "canonical", [])


def placed(pack: DataFrame) -> DataFrame:
    """Kept frames with their ``position`` in the prompt: best at the top, next at the bottom, and so on inwards."""
    w = Window.partitionBy("query_id")
    kept = pack.where("keep").withColumn("value_rank", F.row_number().over(w.orderBy("rank")) - 1).withColumn("n", F.count("*").over(w))
    return kept.withColumn("position", X.edge_position("value_rank", "n"))


def audit(offers: DataFrame) -> DataFrame:
    """(query_id, frame_no, fate, other): one row per offered frame: included, duplicate (of ``other``) or over_budget."""
    lead = leaders(offers)
    best = lead.where("frame_no = kept").select("query_id", "frame_no")
    pack = packed(offers.join(best, ["query_id", "frame_no"], "left_semi")).select("query_id", "frame_no", F.when(F.col("keep"), "included").otherwise("over_budget").alias("fate"), F.lit(None).cast("long").alias("other"))
    return lead.where("frame_no <> kept").select("query_id", "frame_no", F.lit("duplicate").alias("fate"), F.col("kept").alias("other")).unionByName(pack)
