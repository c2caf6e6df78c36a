"""Token ids of whole corpora by a public byte-level BPE tokenizer.

Method: minimal acyclic transducer lexicon. Words of the corpus are counted in one pass; the most frequent (``lexicon_size``, a
bound on the file that is shipped, not on the result) are compiled with their ids into a shared-suffix transducer
(``lexicon``), which every executor fetches once and maps into memory. A second pass splits each text, looks its words up and merges
unseen words exactly, so the ids do not depend on what the lexicon holds. Each Python process remembers words it has met.

Texts are cut at single blanks first, which is cheap: no word of the tokenizer goes over such a blank, as a word has one only
at its start or among other blanks. What stands between two is split into words where it is met first, and remembered as a whole.

The vocabulary file's place is a parameter (``SPANFORGE_TOKENIZERS`` or /opt/tokenizers); its content travels with the lexicon.

Scale: no shuffle but that of the word counts, which are combined per task first; texts are taken batch by batch and whole.

Defined cases: an empty and a null text both give the empty list; strings of special tokens are ordinary text; texts are split by
Python's own engine, but those with characters that it puts into another class than the tokenizer does are split by Unicode classes,
and those with characters on whose class even these tables disagree by the tokenizer's own splitter; one very long word is merged with
a heap in n log n; repeated documents come out as often as they come in; extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import lexicon
from spanforge.sources.tables import read_file, ship_file, write_file

#: fixed value: how the tokenizer splits text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same in the terms of Python's own engine, for texts without the characters that it sees otherwise
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
LEXICON_SIZE = 50_000
REMEMBERED = 300_000


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(os.environ.get("SPANFORGE_TOKENIZERS", "/opt/tokenizers"), name)


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Characters:
    """``doubtful``: those whose class as letter or number differs between the tables of ``regex`` and of Python; ``odd``: these, those that ``re`` sees otherwise, and all beyond the first plane."""

    def __init__(self):
        import regex

        letter, number, space = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\p{White_Space}")
        plain_letter, plain_number, plain_space = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"\s")
        doubtful, odd = [], []
        for code in chain(range(0xD800), range(0xE000, 0x33500)):
            c = chr(code)
            kind = unicodedata.category(c)[0]
            is_letter, is_number = letter.match(c) is not None, number.match(c) is not None
            if code >= 0x80 and (is_letter != (kind == "L") or is_number != (kind == "N")):
                doubtful.append(c)
            elif (is_letter, is_number, space.match(c) is not None) == tuple(x.match(c) is not None for x in (plain_letter, plain_number, plain_space)):
                continue
            odd.append(c)
        self.doubtful, self.odd = frozenset(doubtful), "".join(c for c in odd if c < "\U00010000")


class Splitter:
    def __init__(self, characters: Characters):
        import regex

        self.plain, self.find, self.doubtful, self.own = re.compile(PLAIN).findall, regex.compile(PATTERN).findall, characters.doubtful, None
        self.odd = re.compile(f"[{re.escape(characters.odd)}\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        if self.odd(text) is None:
            return self.plain(text)
        if self.doubtful.isdisjoint(text):
            return self.find(text)
        if self.own is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.own = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]


_SPACES = [pair for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f" for pair in (f" {c}", f"{c} ")]
_BESIDE = re.compile(r" \s|\s |^\s|\s\Z").search


def single_blanks(text: str) -> bool:
    """Whether each blank of a text has something other than white space on both sides, and neither end is white space."""
    if not text.isascii():
        return _BESIDE(text) is None
    return not (text[0].isspace() or text[-1].isspace() or any(pair in text for pair in _SPACES))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: pairs are merged, lowest rank first, leftmost first among equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 100:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(ranks[word[i : i + 2]], i, 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size or ranks.get(part[i] + part[j]) != rank:
            continue
        part[i] += part[j]
        part[j] = None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
    return [ranks[p] for p in part if p is not None]


def word_counts(texts: DataFrame, characters: Characters) -> DataFrame:
    """(word, n) over all texts; one column ``text``."""

    def count(batches):
        split, seen, after_blank = Splitter(characters), Counter(), Counter()

        def out():
            for part, n in after_blank.items():
                for word in split(" " + part):
                    seen[word] += n
            found = pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace") for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            after_blank.clear()
            return found

        for b in batches:
            for text in b.column(0).to_pylist():
                if text and single_blanks(text):
                    parts = text.split(" ")
                    seen.update(split(parts[0]))
                    after_blank.update(parts[1:])
                elif text:
                    seen.update(split(text))
            if len(seen) + len(after_blank) > 200_000:
                yield out()
        yield out()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Remembered(dict):
    """Texts to ids in one Python process, found by ``find`` at first."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, text: str) -> list[int]:
        ids = self.find(text)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(text) <= 64:
            self[text] = ids
        return ids


class Encoder:
    """Words by the transducer, else merged; parts after a blank by their words; both remembered."""

    def __init__(self, lexicon_name: str, ranks_name: str, characters: Characters):
        split, known = Splitter(characters), lexicon.Lexicon(SparkFiles.get(lexicon_name))
        with open(SparkFiles.get(ranks_name), "rb") as f:
            ranks = read_ranks(f.read())

        def word_ids(word: str) -> list[int]:
            raw = word.encode("utf-8", "replace")
            ids = known.get(raw)
            return merge(raw, ranks) if ids is None else ids

        self.split, self.words = split, Remembered(word_ids)
        self.after_blank = Remembered(lambda part: [i for w in split(" " + part) for i in self.words[w]])

    def batch(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        split, word, after_blank = self.split, self.words.__getitem__, self.after_blank.__getitem__
        found: list[list[int]] = []
        sizes = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if single_blanks(text):
                first, *rest = text.split(" ")
                ids = [*map(word, split(first)), *map(after_blank, rest)]
            else:
                ids = list(map(word, split(text)))
            sizes[i + 1] = sum(map(len, ids))
            found += ids
        offsets = np.cumsum(sizes)
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


_ENCODERS: dict[str, Encoder] = {}


def compile_encoder(documents: DataFrame, vocabulary: str | None = None, lexicon_size: int = LEXICON_SIZE, store: str | None = None):
    """Count the corpus's words, compile and ship the lexicon; gives a function that makes the encoder inside a task.

    With ``store``, a path, a lexicon that is there is used as it is and no words are counted (ids do not depend on what it holds, only on
    the vocabulary, which must be the same); else the one that is made is put there.
    """
    spark = documents.sparkSession
    with open(vocabulary or tokenizer_file(), "rb") as f:
        content = f.read()
    ranks, characters = read_ranks(content), Characters()
    compiled = None if store is None else read_file(spark, store)
    if compiled is None:
        frequent = word_counts(documents.select("text"), characters).orderBy(F.desc("n"), "word").limit(lexicon_size).collect()
        compiled = lexicon.to_bytes(lexicon.build({bytes(r.word): merge(bytes(r.word), ranks) for r in frequent}))
        if store is not None:
            write_file(spark, store, compiled)
    names = ship_file(spark, "lexicon", compiled), ship_file(spark, "ranks", content)

    def make() -> Encoder:
        if names[0] not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[names[0]] = Encoder(*names, characters)
        return _ENCODERS[names[0]]

    return make


def encode(documents: DataFrame, key: str = "doc_id", make=None) -> DataFrame:
    """(key, ids array<int>) of every row of ``documents``."""
    make = make or compile_encoder(documents)

    def run(batches):
        encoder = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), encoder.batch(b.column(1).to_pylist())], names=[key, "ids"])

    return documents.select(key, "text").mapInArrow(run, f"`{key}` long, ids array<int>")
