"""Documents that a registry answers with by their first lines: what is served, and that not every pair of a query and a document is made for it."""

import os
import random
import re

from conftest import SF

from spanforge.operators import registry
from spanforge.plans import conformance

QUERY = "query_id long, goal string, query_text string, kinds array<string>, anchors array<string>, max_frames long, max_tokens long, as_of string"


def expected(docs, queries):
    """(query_id, frame_id, rank): documents by the text of their ids, until one exceeds what the query allows."""
    out = set()
    for q in queries:
        wanted = {w.lower() for w in re.split(r"[\W_]+", q[2] or q[1]) if len(w) >= 3}
        n = used = 0
        for frame_id, line in sorted((f"doc_{i}", next(x for x in text.split("\n") if x.strip())) for i, text in docs if text and text.strip()):
            if wanted & set(re.split(r"[\W_]+", line.lower())):
                n, used = n + 1, used + (len(line.encode()) + 3) // 4
                if n > (1 << 62 if q[5] is None else q[5]) or used > (1 << 62 if q[6] is None else q[6]):
                    break
                out.add((q[0], frame_id, n))
    return out


def test_titles_meet_queries_as_far_as_their_budgets_reach(spark, tmp_path, monkeypatch):
    draw = random.Random(7)
    words = ["tide", "harbour", "ledger", "Übung", "crane", "salt"]
    docs = [(i, f" \nThe {' '.join(draw.sample(words, draw.randint(0, 3)))} page{' long' * draw.choice([0, 0, 1, 40])}\nledger") for i in range(400)] + [(900, None), (901, "\n"), (902, "no word of theirs")]
    limits = [(5, 1000), (8, 40), (50, 60), (20, 7), (None, 90), (3, None), (0, 100), (5, 0), (5, -1), (17, 100000), (16, 100000), (33, 100000)]
    queries = [(k, "the goal", draw.choice([None, "the page on salt", f"{draw.choice(words)}, {draw.choice(words)} and crane"]), None, None, *limits[k % len(limits)], None) for k in range(60)]
    queries.append((99, "tide", None, [], [], None, None, None))
    d = str(tmp_path)
    spark.createDataFrame(queries, QUERY).write.parquet(f"{d}/queries.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    os.symlink(f"{SF}/frames.parquet", f"{d}/frames.parquet")

    made, served, serve = {}, {}, registry.serve

    def watched(candidates, asked, provider_id):
        made[provider_id] = candidates
        served[provider_id] = serve(candidates, asked, provider_id)
        return served[provider_id]

    monkeypatch.setattr(registry, "serve", watched)
    legs = {(r.provider_id, r.outcome): r.legs for r in conformance.registry_answers(spark, d).collect()}
    assert legs == {("tables", "frames"): 61, ("titles", "frames"): 61, ("away", "needs_consent"): 61, ("broken", "failed"): 61}
    want = expected(docs, queries)
    assert {tuple(r) for r in served["titles"].select("query_id", "frame_id", "rank").collect()} == want and len(want) > 500
    per = {r[0]: r[1] for r in made["titles"].groupBy("query_id").count().collect()}
    assert all(per.get(q[0], 0) <= 4 * min(x for x in (q[5], max(0, q[6] or 0) + 1 if q[6] is not None else None) if x is not None) for q in queries[:-1])
