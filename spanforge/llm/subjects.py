"""Subject areas of documents.

Method: subject-specific interpolated n-gram language models. Texts are cut into segments (lines, sentences); each subject has a model of
words given the word before, interpolated with its word frequencies and with a background model of all texts. A segment's
per-token cross-entropies are compared with the background's; its gain goes to the subjects in proportion to how well they
explain it, so "vaccination record" adds nothing to music. A further pair of models tells passing mentions from talk about
the matter by the words around the subject's terms, learnt from labelled documents where a segment speaks of none of their subjects.
A document has each subject whose evidence passes a threshold in nats and a share of all evidence. Both are calibrated on labels held
out from the models that judge them (in ``FOLDS`` parts); a subject has a threshold of its own where the held-out labels say so.

Training: labels of at most ``MAX_LABELLED`` documents (a documented bound on the fit; lowest hash first); names are compared trimmed
and in lower case, doubled labels count once, and wrong ones are outvoted. The first models come from documents with one label; the second from
all of them, each segment going to the label that explains it, and, ``ROUNDS`` times, from all other documents of the corpus that the
models are sure of, so that terms which no label covers are learnt from their company. Model tables keep n-grams seen at least
``MIN_SEEN`` times, however many they are. Background counts cover all texts, by language: every language that a text states has one
(names for one language, which share their words, are taken together), and texts that state none count in the one they read like.

Scale: words are normalised once, to 64-bit ids in a table in the shared folder; every further pass is a narrow scan of that table with
counts combined per batch before the shuffle, all on whole arrays. The models are one file of arrays, which each executor fetches once and
maps into memory. The driver holds the counts of n-grams that recur while it makes the models.

Defined cases: null, empty and blank texts have no subject; labels of unknown documents or subjects are ignored; with no usable
label at all there are no models and no rows; very long texts are read whole; repeated documents are each judged.
"""

from __future__ import annotations

import html
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.arrays import Index, mapped, mixed, to_bytes
from spanforge.sources.tables import materialise, ship_file

MAX_LABELLED, MIN_SEEN, ROUNDS, FOLDS = 20_000, 2, 2, 3
M1, M2, FLOOR, DISTINCT = 150.0, 10.0, 0.2, 1.0
ASIDE, REAL = "-aside", "-real"
#: languages whose word frequencies are so alike (cosine) are one
ONE_LANGUAGE = 0.6
#: nats below which a segment says nothing of any subject; from where a segment's aside reading discounts it; what a lone segment counts
NOISE, ASIDE_AT, LONE = 1.5, 2.0, 0.4
#: evidence in nats and shares from which the models are sure of a document
SURE, SURE_SHARE, SURE_ALL = 15.0, 0.2, 0.8
#: words looked at in one step
CHUNK = 400_000

_TOKEN = re.compile(r"\n|\\n|(?<=[.;!?)])\s+|[^\W\d_]+(?:'[^\W\d_]+)?")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile("[​-‏⁠﻿­‪-‮⁦-⁩]")


def readable(text: str | None) -> str:
    """A text with entities, broken encoding, odd forms of letters and hidden characters put right."""
    if not text or not text.strip():
        return ""
    if "&" in text:
        text = html.unescape(text)
    if "Ã" in text or "â€" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return text


def tokens(text: str) -> list[str]:
    """Words as written, those of compounds of code apart, and between segments what ends them."""
    return _TOKEN.findall(_CAMEL.sub(" ", text))


def is_cut(token: str) -> bool:
    return token[0] == "\\" or token[0].isspace()


def normal(word: str) -> str:
    """A word without case, accents and the plural of English."""
    w = word.lower()
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    return w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w


def segments(text: str | None) -> list[list[str]]:
    """The normalised words of each line or sentence."""
    out: list[list[str]] = [[]]
    for token in tokens(readable(text)):
        if is_cut(token):
            out.append([])
        else:
            out[-1].append(normal(token))
    return [words for words in out if words]


def word_id(word: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(word.encode("utf-8", "replace")), "little", signed=True)


START, TERM = word_id("^"), word_id("_")


class Words(dict):
    """Tokens to ids, START for what ends a segment; remembered."""

    def __missing__(self, token: str) -> int:
        found = START if is_cut(token) else word_id(normal(token))
        if len(self) >= 1_000_000:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found


class Parts(dict):
    """What stands between two blanks to its words' ids; remembered. A blank after the end of a sentence is a cut, no word goes over one."""

    def __init__(self):
        self.words = Words()

    def __missing__(self, part: str) -> tuple[int, ...]:
        found = tuple(map(self.words.__getitem__, tokens(part)))
        if part and part[-1] in ".;!?)":
            found += (START,)
        if len(self) >= 300_000:
            self.clear()
        if len(part) <= 64:
            self[part] = found
        return found

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, readable(text).split(" "))))


def word_table(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, stated, known, ids): each document's words as ids, START before each segment; its stated language and labels, null without."""

    def run(batches):
        parts = Parts()
        for b in batches:
            found, sizes = [], np.zeros(b.num_rows + 1, np.int64)
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = parts.ids(text)
                if ids:
                    found.append(START)
                    found += ids
                    sizes[i + 1] = len(ids) + 1
            ids, doc = np.array(found, np.int64), np.repeat(np.arange(b.num_rows), sizes[1:])
            start = ids == START
            last = np.append(doc[1:] != doc[:-1], True) if len(ids) else start
            empty = start & (np.append(start[1:], True) | last) if len(ids) else start  # cuts without words after them
            kept = np.bincount(doc[~empty], minlength=b.num_rows)
            offsets = np.concatenate([[0], np.cumsum(kept)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("stated"), b.column("known"), pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids[~empty])).cast(pa.list_(pa.int64()))], names=["doc_id", "stated", "known", "ids"])

    stated = F.substring(F.lower(F.trim(F.coalesce("lang", F.lit("")))), 1, 2)
    marked = documents.select("doc_id", F.when(stated.isin("", "un"), "").otherwise(stated).alias("stated"), "text").join(F.broadcast(known), "doc_id", "left")  # known has at most MAX_LABELLED rows
    return materialise(marked.select("doc_id", "stated", "known", "text").mapInArrow(run, "doc_id long, stated string, known array<int>, ids array<long>"), "subject-words")


class Flat:
    """The words of a batch of documents as arrays: ``word``, the one ``before`` it, its segment ``seg``; ``doc`` of each segment and word."""

    def __init__(self, ids: pa.Array):
        lengths = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        values = np.asarray(ids.flatten())
        self.n = len(lengths)
        start = values == START
        place = np.flatnonzero(~start)
        doc = np.repeat(np.arange(self.n), lengths)
        self.seg = (np.cumsum(start) - 1)[place]
        self.doc_of_seg = doc[start]
        self.doc = doc[place]
        self.word, self.before = values[place], values[place - 1]


def summed(rows: np.ndarray, owner: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` owners the sum of the table's rows at ``rows``; ``owner`` grows, rows below 0 count nothing."""
    out = np.zeros((n, table.shape[1]), np.float64)
    for at in range(0, len(rows), CHUNK):
        r, o = rows[at : at + CHUNK], owner[at : at + CHUNK]
        r, o = r[r >= 0], o[r >= 0]
        if len(r):
            first = np.flatnonzero(np.diff(o, prepend=-1))
            out[o[first]] += np.add.reduceat(table[r], first, axis=0)
    return out


class Counts:
    """n-grams as columns: class, language (both numbers), a, w, n."""

    def __init__(self, table: pa.Table):
        self.cls, self.lang, self.a, self.w, self.n = (np.asarray(table.column(c)) for c in ("class", "language", "a", "w", "n"))

    def of(self, language: int) -> tuple[np.ndarray, ...]:
        mine = self.lang == language
        return tuple(x[mine] for x in (self.cls, self.a, self.w, self.n))

    def plus(self, other: Counts) -> Counts:
        out = Counts.__new__(Counts)
        out.cls, out.lang, out.a, out.w, out.n = (np.concatenate([x, y]) for x, y in ((self.cls, other.cls), (self.lang, other.lang), (self.a, other.a), (self.w, other.w), (self.n, other.n)))
        return out


def _at(index: Index, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted keys, 0 for unknown ones."""
    places = index.places(wanted)
    return np.where(places >= 0, values[np.maximum(places, 0)], 0.0) if len(values) else np.zeros(len(wanted))


def language_arrays(counts: tuple[np.ndarray, ...], background: tuple[np.ndarray, ...], n_classes: int) -> dict[str, np.ndarray]:
    """The models of all classes in one language: a table of gains, a row for each word and each word after a word that a class has."""
    k = n_classes - 2
    cls, a, w, n = counts
    _, ba, bw, bn = background
    key, first, of_key = np.unique(mixed(a, w), return_index=True, return_inverse=True)
    n2 = np.zeros((len(key), n_classes))
    np.add.at(n2, (of_key, cls), n)
    words, of_word = np.unique(w[first], return_inverse=True)
    contexts, of_context = np.unique(a[first], return_inverse=True)
    n1, context = np.zeros((len(words), n_classes)), np.zeros((len(contexts), n_classes))
    np.add.at(n1, of_word, n2)
    np.add.at(context, of_context, n2)
    bwords, of_bword = np.unique(bw, return_inverse=True)
    bcontexts, of_bcontext = np.unique(ba, return_inverse=True)
    bword_n, bcontext_n = np.bincount(of_bword, bn, len(bwords)), np.bincount(of_bcontext, bn, len(bcontexts))
    total = bword_n.sum() + len(bwords) + 1.0
    bg1 = ((_at(Index(bwords), bword_n, words) + 1.0) / total).reshape(-1, 1)
    own = (n1 + M1 * bg1) / (n1.sum(axis=0) + M1)
    pair_n, context_n = _at(Index(mixed(ba, bw)), bn, key).reshape(-1, 1), _at(Index(bcontexts), bcontext_n, contexts)[of_context].reshape(-1, 1)
    bg2 = (pair_n + M2 * bg1[of_word]) / (context_n + M2)
    after = (n2 / bg2 + M2 * (own / bg1)[of_word]) / (context[of_context] + M2)
    gain = np.log(np.maximum(np.concatenate([own / bg1, after]), FLOOR))
    if k > 0 and len(gain):  # the subjects' about their median; nothing where no subject stands out
        gain[:, :k] -= np.median(gain[:, :k], axis=1, keepdims=True)
        gain[gain[:, :k].max(axis=1) < DISTINCT, :k] = 0.0
    return {"words": words, "pairs": key, "gain": gain.astype(np.float32).reshape(-1, n_classes)}


def telling_arrays(background: Counts, n_languages: int) -> dict[str, np.ndarray]:
    """For telling languages apart: the words of all, and what each says for each language."""
    words, of_word = np.unique(background.w, return_inverse=True)
    n = np.zeros((len(words), n_languages))
    np.add.at(n, (of_word, background.lang), background.n)
    return {"told": words, "telling": np.log(n / (n.sum(axis=0) + 1.0) * 1e7 + 1.0).astype(np.float32).reshape(-1, max(1, n_languages))}


class Models:
    """Interpolated bigram models by class and language, from a file of arrays."""

    def __init__(self, path: str):
        arrays, notes = mapped(path)
        self.languages, self.k, self.asides = notes["languages"], notes["classes"], notes["asides"]
        self.told, self.telling = Index(arrays["told"]), arrays["telling"]
        self.by_language = [(Index(arrays[f"{i}.words"]), Index(arrays[f"{i}.pairs"]), arrays[f"{i}.gain"]) for i in range(len(self.languages)) if f"{i}.gain" in arrays]

    def language(self, f: Flat) -> np.ndarray:
        """The language each document reads like; of equal ones the last by name."""
        score = summed(self.told.places(f.word), f.doc, self.telling, f.n)
        return score.shape[1] - 1 - np.argmax(score[:, ::-1], axis=1)

    def rows(self, f: Flat, language: np.ndarray) -> np.ndarray:
        """The row of each word in its language's table, by the word before it if known so, else on its own; -1 for unknown words."""
        out, spoken = np.full(len(f.word), -1, np.int64), language[f.doc]
        for i, (words, pairs, _) in enumerate(self.by_language):
            mine = np.flatnonzero(spoken == i)
            if len(mine) and len(words.keys):
                found = pairs.places(mixed(f.before[mine], f.word[mine]))
                alone = np.flatnonzero(found < 0)
                found = np.where(found >= 0, found + len(words.keys), -1)
                found[alone] = words.places(f.word[mine[alone]])
                out[mine] = found
        return out

    def evidence(self, f: Flat, language: np.ndarray, rows: np.ndarray) -> Evidence:
        total = np.zeros((len(f.doc_of_seg), self.k + 2))
        spoken = language[f.doc]
        for i, (_, _, gain) in enumerate(self.by_language):
            mine = np.flatnonzero(spoken == i)
            if len(mine):
                total += summed(rows[mine], f.seg[mine], gain, len(total))
        prior = np.zeros((f.n, self.k))
        np.add.at(prior, f.doc_of_seg, np.maximum(total[:, : self.k], 0.0))
        prior = np.maximum(prior, 0.1)
        return Evidence(total[:, : self.k], 0.5 * np.log(prior / prior.sum(axis=1, keepdims=True))[f.doc_of_seg], total[:, self.k] - total[:, self.k + 1] if self.asides else np.zeros(len(total)))


class Evidence:
    """Of each segment: the log-likelihood ``s`` under each class less that under the background, the document's ``prior``, and how much it reads like a passing mention (``aside``)."""

    def __init__(self, s: np.ndarray, prior: np.ndarray, aside: np.ndarray):
        self.s, self.prior, self.aside = s, prior, aside

    def best(self, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each segment's best class (of those ``among``, a row of flags per segment), or -1, and the gain that goes to it."""
        if not self.s.size:
            return np.full(len(self.s), -1), np.zeros(len(self.s))
        t = self.s + self.prior if among is None else np.where(among, self.s + self.prior, -np.inf)
        best = np.argmax(t, axis=1)
        at = np.arange(len(best))
        ok = (self.s[at, best] >= NOISE) & np.isfinite(t[at, best])
        with np.errstate(invalid="ignore"):
            share = np.exp(t - t[at, best][:, None]).sum(axis=1)
        return np.where(ok, best, -1), np.where(ok, self.s[at, best] / np.where(ok, share, 1.0), 0.0)


def document_evidence(m: Models, f: Flat, e: Evidence) -> np.ndarray:
    """Evidence of each class in each document. Segments that read like passing mentions are left out; what one segment alone says counts LONE."""
    best, gain = e.best()
    told = (best >= 0) & (e.aside < ASIDE_AT)
    out, times = np.zeros((f.n, m.k)), np.zeros((f.n, m.k), np.int64)
    np.add.at(out, (f.doc_of_seg[told], best[told]), gain[told])
    np.add.at(times, (f.doc_of_seg[told], best[told]), 1)
    return np.where(times > 1, out, LONE * out)


class Acceptance:
    """From which nats on, by class, and from which share of all evidence a document has a subject."""

    def __init__(self, nats: np.ndarray, share: float):
        self.nats, self.share = nats, share

    def __call__(self, e: np.ndarray) -> np.ndarray:
        return (e >= self.nats) & (e >= self.share * e.sum(axis=1, keepdims=True)) & (e > 0)


def calibrate(e: np.ndarray, y: np.ndarray) -> Acceptance:
    """The acceptance with the best F1 over evidence and true classes; then, by class, other nats where they make at least two decisions more right."""
    k = e.shape[1]
    if not len(e):
        return Acceptance(np.full(k, 12.0), 0.08)
    best = (-1.0, 12.0, 0.08)
    for nats in np.arange(3, 31, 1.0):
        for part in (0.0, 0.03, 0.05, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25):
            p = Acceptance(np.full(k, nats), part)(e)
            f1 = 2 * (p & y).sum() / max(1, p.sum() + y.sum())
            if f1 > best[0] + 1e-9:
                best = (f1, float(nats), part)
    out = Acceptance(np.full(k, best[1]), best[2])
    right = (out(e) == y).sum(axis=0)
    for nats in sorted(np.arange(3, 31, 1.0), key=lambda x: abs(x - best[1])):
        other = (Acceptance(np.full(k, nats), best[2])(e) == y).sum(axis=0)
        better = other >= right + 2
        out.nats = np.where(better, nats, out.nats)
        right = np.where(better, other, right)
    return out


_MODELS: dict[str, Models] = {}


def _load(name: str) -> Models:
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Models(SparkFiles.get(name))
    return _MODELS[name]


KEYS = ["class", "language", "a", "w"]


def counted(table: DataFrame, columns: list[str], count, least: int) -> pa.Table:
    """Add up what ``count`` says of each batch, (class, language, a, w) of single n-grams; all that are seen at least ``least`` times."""

    def run(batches):
        for b in batches:
            cls, lang, a, w = count(b)
            key, first, n = np.unique(mixed(cls, lang, a, w), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first].astype(t)) for x, t in zip((cls, lang, a, w), (np.int32, np.int32, np.int64, np.int64))), pa.array(n.astype(np.int64))], names=[*KEYS, "n"])

    seen = table.select(columns).mapInArrow(run, "class int, language int, a long, w long, n long")
    return seen.groupBy(KEYS).agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()


def background_counts(table: DataFrame) -> tuple[list[str], Counts]:
    """Languages, and the counts of all texts in each; a single one without a name where no text says its language."""
    names = sorted(r.stated for r in table.select("stated").distinct().collect())  # two letters each
    number = {s: i for i, s in enumerate(names)}
    no_class = lambda lang: np.zeros(len(lang), np.int32)

    def as_stated(b):
        f = Flat(b.column("ids"))
        lang = np.array([number[s] for s in b.column("stated").to_pylist()], np.int32)[f.doc]
        return no_class(lang), lang, np.full(len(lang), START), f.word  # words alone tell languages apart

    stated = Counts(counted(table, ["stated", "ids"], as_stated, MIN_SEEN))
    to = _one_name(names, stated)
    languages = sorted({names[i] for i in to.values()})
    if not languages:
        return [""], Counts(counted(table, ["stated", "ids"], lambda b: (lambda f: (no_class(f.word), no_class(f.word), f.before, f.word))(Flat(b.column("ids"))), MIN_SEEN))
    new = {i: languages.index(names[j]) for i, j in to.items()}
    mine = np.isin(stated.lang, list(to))
    known = Counts(pa.table({"class": stated.cls[mine], "language": np.array([new[x] for x in stated.lang[mine].tolist()], np.int32), "a": stated.a[mine], "w": stated.w[mine], "n": stated.n[mine]}))
    first = ship_file(table.sparkSession, "subjects", to_bytes(telling_arrays(known, len(languages)), languages=languages, classes=0, asides=False))

    def told_apart(b):
        f, m = Flat(b.column("ids")), _load(first)
        lang = np.array([new.get(number[s], -1) for s in b.column("stated").to_pylist()], np.int32)
        lang = np.where(lang >= 0, lang, m.language(f)).astype(np.int32)[f.doc]
        return no_class(lang), lang, f.before, f.word

    return languages, Counts(counted(table, ["stated", "ids"], told_apart, MIN_SEEN))


def _one_name(names: list[str], counts: Counts) -> dict[int, int]:
    """Each stated language that has counts to the one whose name it goes by: itself, or the one with most words among those that share its words."""
    words, of_word = np.unique(counts.w, return_inverse=True)
    weight = np.zeros((len(names), len(words)))
    np.add.at(weight, (counts.lang, of_word), counts.n)
    size = weight.sum(axis=1)
    norm = np.sqrt((weight**2).sum(axis=1))
    out: dict[int, int] = {}
    for i in sorted((i for i, s in enumerate(names) if s and size[i] > 0), key=lambda i: (-size[i], names[i])):
        alike = [j for j in set(out.values()) if weight[i] @ weight[j] >= ONE_LANGUAGE * norm[i] * norm[j]]
        out[i] = max(alike, key=lambda j: (size[j], names[j])) if alike else i
    return out


def _flags(known: list, k: int) -> np.ndarray:
    out = np.zeros((len(known), k), bool)
    for i, mine in enumerate(known):
        out[i, mine or []] = True
    return out


def _single(model: str):
    """Documents with one label: all they say."""

    def count(b):
        f, m = Flat(b.column("ids")), _load(model)
        known = b.column("known").to_pylist()
        only = np.array([x[0] if len(x) == 1 else -1 for x in known], np.int64)[f.doc]
        one = only >= 0
        return only[one], m.language(f)[f.doc][one], f.before[one], f.word[one]

    return count


def _framed(f: Flat, told: np.ndarray, is_term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, before, word) of the words of the segments ``told``, with TERM for each run of terms."""
    kept = np.flatnonzero(told[f.seg])
    seg, term = f.seg[kept], is_term[kept]
    again = np.append(False, term[:-1] & (seg[1:] == seg[:-1])) & term if len(kept) else term
    kept, seg, term = kept[~again], seg[~again], term[~again]
    word = np.where(term, TERM, f.word[kept])
    first = np.append(True, seg[1:] != seg[:-1]) if len(kept) else term
    return kept, np.where(first, START, np.roll(word, 1)), word


def _assigned(model: str):
    """Labelled documents: each segment to the label that explains it, and its frame to passing or real talk."""

    def count(b):
        f, m = Flat(b.column("ids")), _load(model)
        language = m.language(f)
        rows = m.rows(f, language)
        e = m.evidence(f, language, rows)
        known = _flags(b.column("known").to_pylist(), m.k)
        own, gain = e.best(known[f.doc_of_seg])
        free, free_gain = e.best()
        agreed = np.where((own >= 0) & ((own == free) | (gain > 0.5 * free_gain)), own, -1)[f.seg]
        mine = agreed >= 0
        is_term = np.zeros(len(f.word), bool)
        spoken, best = language[f.doc], free[f.seg]
        for i, (_, _, gains) in enumerate(m.by_language):
            at = np.flatnonzero((spoken == i) & (rows >= 0) & (best >= 0))
            is_term[at] = gains[rows[at], best[at]] > 1.0
        place, before, word = _framed(f, free >= 0, is_term)
        real = known[f.doc[place], best[place]]
        return (
            np.concatenate([agreed[mine], np.where(real, m.k + 1, m.k)]),
            np.concatenate([spoken[mine], spoken[place]]),
            np.concatenate([f.before[mine], before]),
            np.concatenate([f.word[mine], word]),
        )

    return count


def _confident(model: str):
    """Documents that the models are sure of: the segments that speak of their subjects."""

    def count(b):
        f, m = Flat(b.column("ids")), _load(model)
        language = m.language(f)
        e = m.evidence(f, language, m.rows(f, language))
        best, gain = e.best()
        told = best >= 0
        total = np.zeros((f.n, m.k))
        np.add.at(total, (f.doc_of_seg[told], best[told]), gain[told])
        everything = total.sum(axis=1)
        sure = (total >= SURE) & (total >= SURE_SHARE * everything[:, None])
        sure &= (np.where(sure, total, 0.0).sum(axis=1) >= SURE_ALL * everything)[:, None]
        take = np.where(told & (e.aside < ASIDE_AT) & sure[f.doc_of_seg, np.maximum(best, 0)], best, -1)[f.seg]
        mine = take >= 0
        return take[mine], language[f.doc][mine], f.before[mine], f.word[mine]

    return count


class Fitted:
    def __init__(self, classes: list[str], model: str, accept: Acceptance, words: DataFrame):
        self.classes, self.model, self.accept, self.words = classes, model, accept, words


def train(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> Fitted | None:
    """Fit the models and calibrate their acceptance; None where no label is usable."""
    spark = documents.sparkSession
    classes = sorted({r.subject for r in subjects.select("subject").where("subject is not null").collect()})
    number = {c.strip().lower(): i for i, c in enumerate(classes)}
    names = spark.createDataFrame([(k, i) for k, i in number.items()], "name string, number int")
    known = (
        labels.select("doc_id", F.lower(F.trim("subject")).alias("name"))
        .where("doc_id IS NOT NULL")
        .join(names, "name")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("number")).alias("known"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    known = materialise(known, "labels")
    if not classes or known.isEmpty():
        return None
    words = word_table(documents, known)
    labelled = materialise(words.where("known IS NOT NULL").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))).repartition(max(2, spark.sparkContext.defaultParallelism)), "labelled")
    if labelled.isEmpty():
        return None
    languages, background = background_counts(words)
    k = len(classes)
    telling = telling_arrays(background, len(languages))
    mine = [background.of(i) for i in range(len(languages))]

    def ship(found: Counts | None) -> str:
        arrays = dict(telling)
        for i, bg in enumerate(mine):
            counts = found.of(i) if found else (np.zeros(0, np.int64),) * 4
            arrays |= {f"{i}.{name}": a for name, a in language_arrays(counts, bg, k + 2).items()}
        return ship_file(spark, "subjects", to_bytes(arrays, languages=languages, classes=k, asides=bool(found and (found.cls == k).any())))

    told = lambda table, model: Counts(counted(table, ["known", "ids"], _assigned(model), 1))
    model = ship(None)
    model = ship(Counts(counted(labelled, ["known", "ids"], _single(model), 1)))
    for round_ in range(ROUNDS + 1):
        last, found, sure = model, told(labelled, model), None
        if round_:
            sure = Counts(counted(words.where("known IS NULL"), ["ids"], _confident(model), MIN_SEEN))
            found = found.plus(sure)
        model = ship(found)
    held_out = []
    for fold in range(FOLDS):
        others = told(labelled.where(F.col("fold") != fold), last)
        held_out.append(judged(labelled.where(F.col("fold") == fold), ship(others.plus(sure) if sure else others)))
    e, y = (np.concatenate([h[i] for h in held_out]) for i in (0, 1))
    return Fitted(classes, model, calibrate(e, y), words)


def judged(labelled: DataFrame, model: str) -> tuple[np.ndarray, np.ndarray]:
    """(evidence, true classes) of labelled documents; bounded by MAX_LABELLED."""

    def judge(batches):
        m = _load(model)
        for b in batches:
            f = Flat(b.column("ids"))
            language = m.language(f)
            e = document_evidence(m, f, m.evidence(f, language, m.rows(f, language)))
            yield pa.RecordBatch.from_arrays([pa.array(e.tolist(), pa.list_(pa.float64())), pa.array(_flags(b.column("known").to_pylist(), m.k).tolist(), pa.list_(pa.bool_()))], names=["evidence", "true"])

    got = labelled.select("known", "ids").mapInArrow(judge, "evidence array<double>, true array<boolean>").collect()
    k = len(got[0].evidence) if got else 0
    return np.array([r.evidence for r in got]).reshape(-1, k), np.array([r.true for r in got], bool).reshape(-1, k)


def subject_areas(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, nats, share): the subjects each document is about."""
    schema = "doc_id long, subject string, nats double, share double"
    fitted = train(documents, subjects, labels)
    if fitted is None:
        return documents.sparkSession.createDataFrame([], schema)
    model, accept, classes = fitted.model, fitted.accept, fitted.classes

    def run(batches):
        m = _load(model)
        for b in batches:
            f = Flat(b.column("ids"))
            language = m.language(f)
            e = document_evidence(m, f, m.evidence(f, language, m.rows(f, language)))
            doc, cls = np.nonzero(accept(e))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(classes, pa.string()).take(pa.array(cls)), pa.array(e[doc, cls]), pa.array(e[doc, cls] / e.sum(axis=1)[doc])], names=["doc_id", "subject", "nats", "share"])

    return fitted.words.select("doc_id", "ids").mapInArrow(run, schema)
