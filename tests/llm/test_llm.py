"""Operators for training text on small fixtures and brute force."""

import datetime
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same

from spanforge.llm import containers, conversations, lexicon, mixture, q_containers, q_conversations, subjects, token_ids

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p1_found", "p1_verdicts", "p4_found", "p4_fill"])
def test_against_sql(spark, duck, name):
    module = q_conversations if name.startswith("p1") else q_containers
    same(spark, duck, module.QUERIES[name], module.SQL[name], SF)


# conversations

JOURNAL = "delivery_id long, batch_no long, received_at timestamp, session string, seq long, turn long, event string, tool_calls array<string>, call_id string, session_end string"
GOOD = [("session_start", None, None), ("prompt_assembled", None, None), ("model_response", ["c1"], None), (" Tool_Call ", None, "c1"), ("tool_result", None, "c1"), ("prompt_assembled", None, None), ("model_response", [], None), ("session_end", None, None)]


def _rows(session, events, start=0, first=1):
    day = datetime.datetime(2026, 7, 1)
    return [(start + i, 0, day + datetime.timedelta(seconds=i), session, first + i, None, e, q, c, None) for i, (e, q, c) in enumerate(events)]


def _write(spark, tmp_path, rows, parts=1):
    path = str(tmp_path / "journal.parquet")
    spark.createDataFrame(rows, JOURNAL).repartition(parts).write.parquet(path)
    return path


def _cases():
    rows = _rows("good", GOOD)
    rows += [(100 + r[0], *r[1:]) for r in _rows("good", GOOD)]  # delivered twice
    rows += _rows("no end", GOOD[:-1], 200)
    rows += _rows("hole", GOOD[:3], 300) + _rows("hole", GOOD[4:], 350, 5)
    rows += _rows("late start", GOOD[1:], 400)
    rows += _rows("empty", [GOOD[0], GOOD[-1]], 500)
    rows += _rows("unanswered", GOOD[:6], 600)
    rows += _rows("no result", GOOD[:4], 700)
    rows += _rows("unasked", [GOOD[0], GOOD[1], ("model_response", None, None), GOOD[3]], 800)
    rows += _rows("null call", [GOOD[0], GOOD[1], ("model_response", None, None), ("tool_call", None, None)], 900)
    rows += [(1000, 0, None, None, 1, None, "session_start", None, None, None), (1001, 0, None, "x", None, None, None, None, None, None)]
    back = _rows("turns", GOOD, 1100)
    rows += [(*r[:5], {2: 2, 5: 1}.get(i), *r[6:]) for i, r in enumerate(back)]
    long = [GOOD[0], *[GOOD[1], ("model_response", None, None)] * 40, GOOD[-1]]
    return rows + _rows("long", long, 2000)


@pytest.mark.parametrize("parts, files, block", [(1, None, 512), (3, 1, 512), (2, None, 7)])
def test_conversations(spark, tmp_path, parts, files, block):
    rows = _cases()
    random.Random(parts).shuffle(rows)
    got = conversations.conversations(spark, _write(spark, tmp_path, rows, parts), block, files).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.session, r.msg_no)):
        by.setdefault(r.session, []).append((r.msg_no, r.seq, r.msg_role))
    assert set(by) == {"good", "no end", "long"}
    assert by["good"] == [(1, 2, "user"), (2, 3, "assistant"), (3, 4, "assistant"), (4, 5, "tool"), (5, 6, "user"), (6, 7, "assistant")]
    assert [m for m, _, _ in by["long"]] == list(range(1, 81)) and [s for _, s, _ in by["long"]] == list(range(2, 82))


def test_no_rows(spark, tmp_path):
    assert conversations.conversations(spark, _write(spark, tmp_path, [])).count() == 0


# containers


@given(st.dictionaries(st.integers(0, 60), st.integers(1, 30), min_size=1, max_size=12), st.integers(60, 120))
@settings(max_examples=80, deadline=None)
def test_plans_place_each_item_once_and_never_overfill(lengths, capacity):
    segments, made, greedy = containers.plan(list(lengths), list(lengths.values()), capacity)
    assert made <= greedy
    load, seen = [0] * made, dict.fromkeys(lengths, 0)
    for size, first, times, each in segments:
        seen[size] += times * each
        for k in range(first, first + times):
            load[k] += size * each
    assert seen == lengths and max(load, default=0) <= capacity
    least = -(-sum(s * n for s, n in lengths.items()) // capacity)
    assert made <= max(1, 2 * least)


def test_nnls_finds_the_solution():
    a = np.array([[2.0, 1, 0], [0, 1, 3], [1, 0, 0]])
    assert np.allclose(containers.nnls(a, a @ np.array([3.0, 0, 2])), [3, 0, 2])


def test_huge_counts_stay_cheap():
    segments, made, _ = containers.plan([700, 300], [10**9, 10**9], 1000)
    assert made == 10**9 and len(segments) < 10


def test_every_length_takes_part_however_many_there_are():
    rng = random.Random(3)
    for n, low in ((97, 200), (400, 100), (1500, 30)):
        sizes = rng.sample(range(low, 2000), n)
        counts = [rng.randrange(1, 40) for _ in sizes]
        patterns = containers.repeats(dict(sorted(zip(sizes, counts), reverse=True)), 2000)
        met = {s for p, _ in patterns for s in p}
        assert len(met) > 0.7 * n
        segments, made, greedy = containers.plan(sizes, counts, 2000)
        load = np.zeros(made, np.int64)
        for size, first, times, each in segments:
            load[first : first + times] += size * each
        assert load.max() <= 2000 and load.sum() == sum(s * c for s, c in zip(sizes, counts)) and made <= greedy


def test_the_worthier_of_equal_items_come_first(spark):
    rows = [(1, i, 500, 1000, None if i % 7 == 0 else (i % 10) / 10) for i in range(200)] + [(1, 900, 500, 1000, float("nan"))]
    df = spark.createDataFrame(rows, "query_id long, frame_no long, size long, capacity long, score double")
    got = containers.pack(df, "query_id", "frame_no", "size", "capacity", "score").join(df.select("frame_no", "score"), "frame_no").orderBy("container").collect()
    worth = [0.0 if r.score is None or r.score != r.score else r.score for r in got]
    assert len(got) == 201 and all(b <= a + 1 / 32 for a, b in zip(worth[::2], worth[2::2]))
    report = containers.fill_report(df, "query_id", "frame_no", "size", "capacity").collect()
    assert [tuple(r) for r in report] == [(1, 1000, 101, 101, 101)]


def test_pack(spark):
    rows = [(1, i, 400, 1000) for i in range(10)] + [(1, 100, 2500, 1000), (1, 101, 3000, 1000), (1, 102, None, 1000), (2, 103, 5, None), (3, 104, 5, 0), (1, 105, 0, 1000), (1, 0, 400, 1000), (None, 106, 1, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "query_id long, frame_no long, size long, capacity long, container string")
    got = containers.pack(df.drop("container"), "query_id", "frame_no", "size", "capacity").collect()
    placed = [r for r in got if r.container is not None]
    assert {r.frame_no for r in got if r.container is None} == {102, 103, 104, 106}
    assert {r.frame_no for r in got if r.parts != 1} == {100, 101, 104}
    assert sum(r.part_size for r in placed) == 4000 + 2500 + 3000
    used = {}
    for r in placed:
        for k in range(r.container, r.container + (r.part_size // 1000 if r.part == 0 and r.parts > 1 else 1)):
            used[k] = used.get(k, 0) + (1000 if r.part == 0 and r.parts > 1 else r.part_size)
    assert max(used.values()) <= 1000 and len(used) == 11
    assert containers.pack(df.where("false"), "query_id", "frame_no", "size", "capacity").count() == 0


# token ids


@pytest.fixture(scope="module")
def ranks():
    with open(token_ids.tokenizer_file(), "rb") as f:
        return token_ids.read_ranks(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 50000), max_size=3), max_size=40), st.lists(st.binary(max_size=6), max_size=20))
@settings(max_examples=60, deadline=None)
def test_lexicon_round_trip(tmp_path_factory, entries, others):
    path = tmp_path_factory.mktemp("lexicon") / "l.bin"
    path.write_bytes(lexicon.to_bytes(lexicon.build(entries)))
    found = lexicon.Lexicon(str(path))
    for word in [*entries, *others]:
        assert found.get(word) == entries.get(word)


def test_lexicon_shares_suffixes():
    built = lexicon.build({w: [i] for i, w in enumerate([b"walking", b"talking", b"balking"])})
    assert len(built["final"]) == 8


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 700, "é日本" * 200, "x" * 99 + "ing", "=" * 333])
def test_merges_of_long_words(ranks, library, text):
    split = token_ids.Splitter(token_ids.Characters())
    assert [i for w in split(text) for i in token_ids.merge(w.encode(), ranks)] == library(text)


def test_texts_are_split_as_by_unicode_classes():
    import regex

    split, rng = token_ids.Splitter(token_ids.Characters()), random.Random(8)
    pool = "ab Z09_'-.,\n\t\r\x0b\x1c\x1f\x85\xa0é½²Ⅷ٣日本\u0301\u2028\u3000🙂\u200b𝟘ª'lltsd"
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(30)))
        assert split(text) == regex.findall(token_ids.PATTERN, text), ascii(text)


def test_no_token_goes_over_a_single_blank():
    split, rng = token_ids.Splitter(token_ids.Characters()), random.Random(9)
    pool, whole = "ab 9 _'.\n\t\x1c\xa0é½日 sl  ", 0
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 20)))
        if token_ids.single_blanks(text):
            words = text.split(" ")
            assert [w for i, part in enumerate(words) for w in split(" " * (i > 0) + part)] == split(text), ascii(text)
            whole += len(words) > 1
    assert whole > 100


def test_ids_are_the_library_s(spark, library):
    texts = [None, "", " ", "Hello  world's\n\n\t don't", "<|endoftext|> x", "͸Ᲊ   a", "1234 ½ ²", "a" * 20000, "Ünïcödé 日本語 🙂", "x\r\n y", "<|endoftext|>"] + ["same text"] * 3
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in token_ids.encode(df).collect()}
    assert got == {i: library(t) if t else [] for i, t in enumerate(texts)}
    assert token_ids.encode(df.where("false")).count() == 0


def test_a_stored_lexicon_serves_other_texts(spark, library, tmp_path, monkeypatch):
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = f"{tmp_path}/lexicon.bin"
    token_ids.compile_encoder(docs("some words to know", None), store=store)
    monkeypatch.setattr(token_ids, "word_counts", None)
    texts = ["other words  entirely", "some words", ""]
    got = token_ids.encode(docs(*texts), make=token_ids.compile_encoder(docs(*texts), store=store)).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [library(t) if t else [] for t in texts]


# mixture


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutations(n):
    got = mixture.permuted(np.arange(n), n, 5)
    assert sorted(got.tolist()) == list(range(n))


@pytest.mark.parametrize("shards", [1, 9, 5000])
def test_draws_add_up(shards):
    counts = np.array([1000 * shards, 77, 3])
    draws = list(mixture.shard_draws(counts, shards, 0, shards))
    assert [d[0] for d in draws] == list(range(shards)) and {int(n.sum()) - counts.sum() // shards for _, n, _ in draws} <= {0, 1}
    assert (sum(n for _, n, _ in draws) == counts).all() and np.array_equal(np.cumsum([n for _, n, _ in draws], axis=0)[:-1], np.array([f for _, _, f in draws])[1:].reshape(-1, 3))
    part = list(mixture.shard_draws(counts, shards, shards // 3, shards // 2 + 1))  # a task's part is the same part of the whole
    assert all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(part, draws[shards // 3 :]))


def test_block_counts():
    assert mixture.block_counts({"a": 100, "b": 10}, {"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5, "none": 0.1}, {"a": 1, "b": 3, "none": 4}) == {"a": 30, "b": 30}
    assert mixture.block_counts({}, {}, {"a": 1.0}, {"a": 1}) == {}


def test_mixture(spark, library):
    docs = [(i, f"document {i} of the large source " * 40, "Big ") for i in range(40)] + [(100 + i, f"small {i} " * 60, "small") for i in range(3)] + [(200, None, "small"), (201, "x", None), (202, "y", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    goals = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats long")
    mixed, report = mixture.mix(df, goals, block=32)
    rows, told = mixed.collect(), {r.source: r for r in report.collect()}
    taken = {}
    for r in rows:
        taken[r.source, r.block_no] = taken.get((r.source, r.block_no), 0) + 1
        assert r.n_tokens == len(r.ids) <= 32
    assert max(n for (s, _), n in taken.items() if s == "big") == 1 and max(n for (s, _), n in taken.items() if s == "small") <= 3
    assert told["absent"].taken_tokens == 0 and abs(told["big"].actual_share - 7 / 9) < 0.02 and abs(told["small"].actual_share - 2 / 9) < 0.02
    blocks = {(r.source, r.block_no): r.ids for r in mixture.token_blocks(df, goals, 32).collect()}
    flat = [i for k in sorted(k for k in blocks if k[0] == "small") for i in blocks[k]]
    assert len(flat) == sum(len(library(t)) for i, t, s in docs if s == "small" and t)
    assert all(blocks[r.source, r.block_no] == r.ids for r in rows)


# subjects


def _corpus(rng, n):
    words = {"law": ["tort claim", "plaintiff", "bond hearing", "court of appeal", "affidavit"], "sport": ["tennis court", "penalty kick", "relay baton", "goalkeeper", "lap record"], "music": ["record sleeve", "violin bow", "key signature", "bass line", "encore"]}
    docs, truth = [], []
    for i in range(n):
        true = rng.sample(sorted(words), rng.choice([0, 1, 1, 1, 2]))
        text = []
        for s in true * 4:
            a, b = rng.sample(words[s], 2)
            text.append(rng.choice([f"See section {rng.randrange(99)} for {a} and {b}.", f"The note on {a} was checked against {b}.", f"- {a}s (Vessby, May)\n"]))
        text += rng.sample(["The digest was verified on Friday.", "The provider declared 9 tokens.", "Ask again with a narrower goal."], 2)
        if rng.random() < 0.3:
            text.append(f"(The thread wandered off to {rng.choice(words[rng.choice(sorted(words))])} for one line.)")
        docs.append((i, " ".join(text), rng.choice(["en", "EN", None])))
        truth.append(set(true))
    return docs, truth


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(5)
    docs, truth = _corpus(rng, 400)
    docs += [(1000, None, "en"), (1001, "", "en"), (1002, "  \n", None)]
    labels = [(i, rng.choice([s, s.upper(), f" {s} "])) for i in range(120) for s in truth[i]] + [(7777, "law"), (3, None), (4, "unknown")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    names = spark.createDataFrame([(s, s) for s in ("law", "sport", "music")], "subject string, about string")
    got = {}
    for r in subjects.subject_areas(df, names, spark.createDataFrame(labels, "doc_id long, subject string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == truth[i] for i in range(120, 400))
    assert right >= 0.9 * 280 and not {1000, 1001, 1002} & set(got)
    assert subjects.subject_areas(df, names, spark.createDataFrame([], "doc_id long, subject string")).count() == 0


def test_parts_have_the_words_of_their_segments():
    rng, parts = random.Random(12), subjects.Parts()
    pool = ["fooBar", "x_y", "Ends.", "(so)", "it's", "\n", "\\n", " ", "  ", "\t", "a.b", "Cafés;", "9a", "\u00a0", "&amp;", "é", "why?\n", "!", "HTTPServer"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))
        got = [[]]
        for i in parts.ids(text):
            if i == subjects.START:
                got.append([])
            else:
                got[-1].append(i)
        assert [x for x in got if x] == [[subjects.word_id(w) for w in s] for s in subjects.segments(text)], ascii(text)


def test_segments():
    assert subjects.segments("Build_pipeline hashMaps.\nCafé &amp; bar ") == [["build", "pipeline", "hash", "map"], ["cafe", "bar"]]
    assert subjects.segments(None) == subjects.segments(" ") == []
    assert json.dumps(subjects.segments("x" * 100000)[0])[:5] == '["xxx'
