"""What a review found missing in the operators for training text, each on a small case."""

import datetime
import itertools

from spanforge.llm import conversations, subjects


def _backgrounds(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    return subjects.background_counts(subjects.word_table(df, spark.createDataFrame([], "doc_id long, known array<int>")))


def test_all_ngrams_of_the_corpus_are_counted(spark):
    words = ["".join(x) + "q" for x in itertools.islice(itertools.product("abcdefghij", repeat=6), 201_000)]
    _, counts = _backgrounds(spark, [("en", " ".join(words[i : i + 1000])) for i in range(0, len(words), 1000)] * 2)
    assert len(counts.n) == len(words) and set(counts.n) == {2}


def _languages(spark, rows):
    languages, counts = _backgrounds(spark, rows)
    return {name: {(a, w): n for a, w, n in zip(*(x.tolist() for x in counts.of(i)[1:]))} for i, name in enumerate(languages)}


def _pair(a, b):
    return subjects.START if a == "^" else subjects.word_id(subjects.normal(a)), subjects.word_id(subjects.normal(b))


def test_texts_of_unknown_language_count_in_the_language_they_read_like(spark):
    known = [("en", "the court heard the claim of the tenant"), ("FR", "le tribunal a entendu la demande du locataire")] * 3
    unknown = [(None, "le tribunal a entendu la demande du voisin"), ("un", "the court heard the claim of the neighbour"), ("xx", "the court heard the claim of the neighbour"), (" ", "le tribunal a entendu la demande du voisin")]
    got = _languages(spark, known + unknown)
    assert set(got) == {"en", "fr"} and got["fr"][_pair("du", "voisin")] == 2 and got["en"][_pair("the", "neighbour")] == 2 and _pair("the", "tribunal") not in got["en"]
    assert got["en"][_pair("^", "the")] == 5 and got["fr"][_pair("le", "tribunal")] == 5


def test_every_language_has_a_model_however_few_texts_it_has(spark):
    large = [("en", f"the court heard the claim of the tenant number {i % 7} and the landlord") for i in range(1200)]
    small = [("it", "il giudice ha sentito la domanda del vicino")] * 2
    other_name = [("ba", "the court heard the claim of the tenant and the landlord")] * 3
    got = _languages(spark, large + small + other_name)
    assert set(got) == {"en", "it"} and got["it"][_pair("giudice", "ha")] == 2
    assert got["en"][_pair("court", "heard")] == 1203  # a name for a language that has another is no language


def test_open_conversations_of_the_far_future_time_out(spark, tmp_path):
    days = [datetime.datetime(2026, 7, 1), datetime.datetime(2249, 12, 30), datetime.datetime(2260, 1, 1)]
    rows = [(i, 0, day, f"s{i}", 1, None, "session_start", None, None) for i, day in enumerate(days)]
    path = str(tmp_path / "journal.parquet")
    spark.createDataFrame(rows, "delivery_id long, batch_no long, received_at timestamp, session string, seq long, turn long, event string, tool_calls array<string>, call_id string").write.parquet(path)
    assert {r.session for r in conversations.verdicts(spark, path).collect()} >= {"s0", "s1", "s2"}
