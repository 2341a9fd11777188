"""Language identification by words first, with backoff to character n-grams.

A known word scores by its log frequency in each language. A word that training did not keep falls back: at
each position the longest known n-gram, of five characters down to one, scores by its log frequency; a word
starts and ends with a mark, so that endings count. Where even the single character is unknown, nothing is
learned from it. The document's score sums over its words, and the language is the one of the highest
posterior under equal priors; score is that posterior.

Training counts words and n-grams of labelled rows in Spark. It uses a hash sample of at most about
sample_rows labelled rows of each language, and every language that is named; totals are those of all entries
of the sample, and the top_entries most frequent of a language and length are kept. The model is a few arrays:
64-bit keys of entries, and for each the languages that know it. Two entries share a key in one case of 10 ** 7.
Everything is scored, whatever its length.

Defined results: a null text, or one without letters, is `und` with score 0; repeated rows are judged alike;
without any labelled row every text is `und`; an empty table gives an empty result; other columns are ignored.
Neither the language column nor source or doc_id enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.common import crc_remainder, drawn_share, give_back, make_room, materialize, ship_package

UNDETERMINED = "und"
LONGEST_GRAM = 5
#: Numbers in a task's table of words it has already scored: words times languages.
MAX_REMEMBERED = 800_000
#: A word: letters, with the marks that stand within words.
LETTERS = r"[^\W\d_]+"
LETTERS_SQL = r"\p{L}+"


def _fold(h: np.ndarray, code_points: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that are one character longer."""
    x = (h ^ code_points.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_keys(grams: list[str], length: int) -> np.ndarray:
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
    h = np.full(len(grams), length, np.uint64)
    for k in range(length):
        h = _fold(h, points[:, k])
    return h


def word_keys(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


@dataclass
class Level:
    """Words, or n-grams of one length: sorted 64-bit keys, and for each the languages that know it with their gains, in one array each."""

    keys: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    gains: np.ndarray
    floor: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, languages: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> Level:
        """From an entry a language; an entry that a language doesn't know counts half there."""
        order = np.argsort(keys, kind="stable")
        distinct, starts = np.unique(keys[order], return_index=True)
        return Level(distinct, np.append(starts, len(keys)), languages[order].astype(np.int32), np.log(2 * counts[order]).astype(np.float32), np.log(0.5 / totals))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, scores: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Add the log frequencies of entries at to rows of scores."""
        n = self.starts[at + 1] - self.starts[at]
        k = np.repeat(self.starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat = np.repeat(rows, n) * scores.shape[1] + self.languages[k]
        scores += np.bincount(flat, self.gains[k], scores.size).reshape(scores.shape)
        scores += np.bincount(rows, minlength=len(scores))[:, None] * self.floor


@dataclass
class Model:
    """Languages in order, and the levels: words, then n-grams of 1 to LONGEST_GRAM characters."""

    languages: list[str]
    levels: list[Level] = field(default_factory=list)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log frequencies (words x languages): of a known word, else of the longest known n-gram at each position."""
        scores = np.zeros((len(words), len(self.languages)))
        at, known = self.levels[0].find(word_keys(words))
        self.levels[0].add(scores, np.flatnonzero(known), at[known])
        unseen = np.flatnonzero(~known)
        if len(unseen):
            marked = [f"^{words[k]}$" for k in unseen]
            points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = np.fromiter(map(len, marked), np.int64)
            row = np.repeat(unseen, sizes)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters up to the word's end
            longest, place = np.zeros(len(points), np.int8), np.zeros(len(points), np.int64)
            for n in range(1, LONGEST_GRAM + 1):
                at = np.flatnonzero(left >= n)
                h = np.full(len(at), n, np.uint64)
                for k in range(n):
                    h = _fold(h, points[at + k])
                found, known = self.levels[n].find(h)
                longest[at[known]], place[at[known]] = n, found[known]
            for n in range(1, LONGEST_GRAM + 1):
                at = np.flatnonzero(longest == n)
                self.levels[n].add(scores, row[at], place[at])
        return scores


class Remembered(dict):
    """Rows of a table of word scores by word; unseen words get a row at once and their scores with the next settle()."""

    def __init__(self, model: Model):
        self.model, self.waiting = model, []
        self.table = np.zeros((0, len(model.languages)), np.float32)
        self.most = max(1000, MAX_REMEMBERED // max(1, len(model.languages)))

    def __missing__(self, word: str) -> int:
        self.waiting.append(word)
        self[word] = k = len(self)
        return k

    def settle(self) -> None:
        step = max(1, MAX_REMEMBERED // (4 * max(1, len(self.model.languages))))
        new = [self.model.score_words(self.waiting[k : k + step]).astype(np.float32) for k in range(0, len(self.waiting), step)]
        self.table = np.concatenate([self.table, *new])
        self.waiting = []

    def forget(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.table = self.table[:0]


def _words(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case, of a long one so many at a time."""
    if len(text) < 1 << 20:
        yield re.findall(LETTERS, text.lower())
        return
    found = (m[0].lower() for m in re.finditer(LETTERS, text))
    while part := list(islice(found, 50_000)):
        yield part


def score_texts(texts: list[str | None], model: Model, memory: Remembered) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        totals, lettered = np.zeros((len(part), len(model.languages))), [False] * len(part)
        waiting: list[tuple[int, np.ndarray]] = []
        for k, t in enumerate(part):
            for words in _words(t) if t and model.languages else ():
                # digits such as fractions and superscripts pass for letters in the pattern
                lettered[k] = lettered[k] or any(c.isalpha() for w in words for c in w)
                waiting.append((k, np.fromiter(map(memory.__getitem__, words), np.int64, len(words))))
                if len(words) >= 50_000:
                    memory.settle()
                    totals[k] += memory.table[waiting.pop()[1]].sum(axis=0, dtype=np.float64)
        memory.settle()
        for k, rows in waiting:
            totals[k] += memory.table[rows].sum(axis=0, dtype=np.float64)
        memory.forget()
        for k, total in enumerate(totals):
            best = int(total.argmax()) if lettered[k] else -1
            names.append(model.languages[best] if lettered[k] else UNDETERMINED)
            scores.append(float(1.0 / np.exp(total - total[best]).sum()) if lettered[k] else 0.0)
    return names, scores


def train(labelled: DataFrame, sample_rows: int = 1500, top_entries: int = 20_000, model_entries: int = 4_000_000) -> Model:
    """A model from rows (doc_id, text, lang).

    sample_rows bounds the labelled rows of a language that are learned from, top_entries the words and the
    n-grams of each length that a language keeps, and model_entries all of them: beyond 33 languages they share it.
    """
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = materialize(labelled.groupBy("lang").count(), "languages")
    rows = sizes.orderBy("lang").collect()  # a row a language
    languages = [r["lang"] for r in rows]
    if not languages:
        return Model([])
    top = max(1, min(top_entries, model_entries // (len(languages) * (LONGEST_GRAM + 1))))
    # Spark knows the size of the table of languages and chooses the join by it
    sample = labelled.join(sizes, "lang").filter(drawn_share(F.xxhash64(F.lit("language"), "doc_id", "text"), sample_rows / F.col("count")))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS_SQL), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = materialize(words, "language-words")
    grams = words.select("lang", "n", F.concat(F.lit("^"), "word", F.lit("$")).alias("m"))
    starts = F.sequence(F.lit(1), F.length("m"))

    def cut(g: int):
        inside = F.filter(starts, lambda i: i <= F.length("m") - (g - 1))
        return F.transform(inside, lambda i: F.struct(F.lit(g).alias("g"), F.substring(F.col("m"), i, F.lit(g)).alias("word")))

    pieces = F.flatten(F.array(*[cut(g) for g in range(1, LONGEST_GRAM + 1)]))
    grams = grams.select("lang", "n", F.explode(pieces).alias("p")).groupBy("lang", F.col("p.g").alias("g"), F.col("p.word").alias("word")).agg(F.sum("n").alias("n"))
    counts = materialize(words.select("lang", F.lit(0).alias("g"), "word", "n").union(grams.select("lang", "g", "word", "n")), "language-counts")
    order = W.partitionBy("lang", "g").orderBy(F.desc("n"), "word")
    kept = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")
    at = {x: k for k, x in enumerate(languages)}
    totals = np.ones((LONGEST_GRAM + 1, len(languages)))
    for r in counts.groupBy("lang", "g").agg(F.sum("n").alias("n")).collect():
        totals[r["g"], at[r["lang"]]] = r["n"]
    found = kept.toArrow().sort_by([("g", "ascending"), ("word", "ascending"), ("lang", "ascending")])  # model_entries at most
    g, n = found["g"].to_numpy(), found["n"].to_numpy()
    lang = np.fromiter((at[x] for x in found["lang"].to_pylist()), np.int64, found.num_rows)
    levels = []
    for k in range(LONGEST_GRAM + 1):
        own = np.flatnonzero(g == k)
        entries = found["word"].take(pa.array(own)).to_pylist()
        levels.append(Level.of(gram_keys(entries, k) if k else word_keys(entries), lang[own], n[own], totals[k]))
    return Model(languages, levels)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs (doc_id, text)."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("language_id")
        memory = Remembered(shared.value)
        for b in slices(batches):
            names, scores = score_texts(b["text"].to_pylist(), shared.value, memory)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def _held_out(docs: DataFrame, divisor: int, fold: int):
    return F.coalesce(crc_remainder(F.col("doc_id"), divisor) == fold, F.lit(False))


def language_of(docs: DataFrame, divisor: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from rows outside the held-out fold only."""
    held = _held_out(docs, divisor, fold)
    model = train(docs.filter(~held))
    return identify(docs, model).withColumn("held_out", _held_out(docs, divisor, fold)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of docs in a determined language with at least this score, with all columns, in one pass over the texts."""
    model = train(docs.filter(~_held_out(docs, 4, 2)))
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("language_id")
        memory = Remembered(shared.value)
        for b in slices(batches):
            names, scores = score_texts(b["text"].to_pylist(), shared.value, memory)
            yield b.filter(pa.array([n != UNDETERMINED and s >= least_score for n, s in zip(names, scores)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, schema)
