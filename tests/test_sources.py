"""Sources on small files: NDJSON, file trees, byte ranges, addresses."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanforge.operators import symbols
from spanforge.sources import files, ndjson


def test_envelopes_round_trip(spark, tmp_path):
    lines = ['{"type":"query","id":"q1","query":{"goal":"g","max_frames":3},"extra":1}', "", "{cut", '{"type":"shutdown"}']
    (tmp_path / "in.ndjson").write_text("\n".join(lines))
    rows = ndjson.read_envelopes(spark, str(tmp_path / "in.ndjson"))
    assert sorted((r.type or "", r.broken) for r in rows.collect()) == [("", "{cut"), ("query", None), ("shutdown", None)]
    ndjson.write_ndjson(rows.where("type = 'query'"), str(tmp_path / "out"), ["type", "id", "query"])
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"type": "query", "id": "q1", "query": {"goal": "g", "max_frames": 3}}


def test_journals_are_strict(spark, tmp_path):
    good = '{"seq":1,"at":"2026-07-01T00:00:00Z","session":"s","event":"session_start"}'
    (tmp_path / "good").write_text(good + "\n\n")
    (tmp_path / "bad").write_text(good + "\nnot json\n")
    (tmp_path / "none").write_text("\n")
    assert ndjson.read_journal(spark, str(tmp_path / "good")).count() == 1
    for name in ("bad", "none"):
        with pytest.raises(ValueError):
            ndjson.read_journal(spark, str(tmp_path / name))


def test_tree(spark, tmp_path):
    for name in ("a.md", "src/b.rs", "target/c.rs", ".git/d.md", "e.bin", "node_modules/x/f.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r.rel for r in files.tree(spark, str(tmp_path)).collect()) == ["a.md", "src/b.rs"]


def test_addresses(spark):
    cases = {"file:///a%20b+c/d": "/a b+c/d", "file://localhost/x": "/x", "file://host/x": None, "http://a/b": None, "/plain": None}
    df = spark.createDataFrame([(u,) for u in cases], "uri string")
    assert {r.uri: r.p for r in df.select("uri", files.file_path(F.col("uri")).alias("p")).collect()} == cases


def test_line_ranges_and_digests(spark):
    text = "one\ntwo\nthree"
    digest = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    cases = [("file", "u", None, digest(text), "verified"), ("file", "u", "L2-3", digest("two\nthree"), "verified"), ("file", "u", "L1", digest("one\n"), "verified"), ("file", "u", "L2-9", digest("two\nthree"), "verified"), ("file", "u", "L2-1", digest(""), "unreadable"), ("file", "u", "L7-8", digest(""), "unreadable"), ("file", "u", "L0-1", digest(""), "unreadable"), ("file", "u", "L1", digest("x"), "mismatch"), ("file", "gone", None, digest(text), "unreadable"), ("import", "u", None, None, "not_file"), (None, "u", None, None, "not_file")]
    links = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i long, type string, uri string, range string, digest string")
    docs = spark.createDataFrame([("u", text)], "uri string, text string")
    assert {r.i: r.status for r in files.provenance_status(links, docs).collect()} == {i: c[4] for i, c in enumerate(cases)}


def test_symbols(spark):
    code = "use std::io;\npub fn alpha(x: u8) {}\nasync fn beta() { alpha(1); }\nstruct Gamma;\n"
    df = spark.createDataFrame([(1, code), (2, None), (3, "prose")], "doc_id long, text string")
    assert symbols.graph_summaries(df).collect() == [(1, "defines alpha, beta, Gamma; imports std::io; calls alpha")]
    got = symbols.symbol_frames(df).orderBy("line_no").collect()
    assert [(r.title, round(r.score, 2)) for r in got] == [("fn alpha", 0.9), ("fn beta", 0.88), ("struct Gamma", 0.86)]
    assert symbols.grep_frames(df, ["ALPHA"]).count() == 2 and symbols.grep_frames(df, ["nothing"]).count() == 2
