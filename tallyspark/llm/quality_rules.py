"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Statistics are JVM expressions over the words of a row. The texts of most rows have no repeated window of five
words, which one hash set over 64-bit hashes shows; only the others sort (words, position) pairs, whose equal
neighbours are the windows that count. Work and memory are n log n in the words of a text, and nothing is
shuffled.

Defined results: a null or empty text has zeros everywhere and fails the base rule; windows of fewer than five
words do not exist; repeated rows are judged alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent short words of the languages at hand.
STOP_WORDS = {
    "en": "the of and to a in is that it was for on as with be by this are from at not or an",
    "fr": "le la les de des un une et est que qui en du au aux dans pour par sur pas elle il avec",
    "de": "der die das und ist nicht ein eine mit zu den dem von auf für im sich auch es",
    "es": "el la los las de que y en un una es por con para se del no al lo su",
}


class Rule(NamedTuple):
    """A text is dropped when the measure lies outside of [least, most]; texts under from_words words are spared."""

    measure: str
    least: float | None
    most: float | None
    from_words: int = 0


#: The threshold table; measures are columns of text_statistics() and their ratios.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("dup_line_ratio", None, 0.30),
    Rule("short_line_ratio", None, 0.90, 200),
    Rule("stop_word_ratio", 0.02, None, 50),
)


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, each word counted once."""

    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))

    def windows(hashes: Column) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))

    def covered() -> Column:
        # words hold no blanks, so the joined words are equal only where all words are
        pairs = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("k"), i.alias("i"))))

        def positions(p: Column) -> Column:
            last = F.size(p) - 1
            twice = F.filter(p, lambda x, i: ((i > 0) & (p[F.greatest(i - 1, F.lit(0))]["k"] == x["k"])) | ((i < last) & (p[F.least(i + 1, last)]["k"] == x["k"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def cover(at: Column) -> Column:
            step = F.transform(at, lambda x, i: F.when(i == F.size(at) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), at[F.least(i + 1, F.size(at) - 1)] - x)))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, positions), cover)

    def count(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered())

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def text_statistics(text: Column) -> Column:
    """A struct of counts of one text, computed in one projection."""
    text = F.coalesce(text, F.lit(""))
    has_word = "[^\\x20\\x09-\\x0D]"
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word))

    def of(words: Column) -> Column:
        return let(
            lines,
            lambda ls: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
                F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.size(F.filter(ls, lambda x: F.length(x) < 10)).cast("long").alias("n_short_lines"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
            ),
        )

    return let(words_of(text), of)


def measures(stats: Column) -> dict[str, Column]:
    words, lines = F.greatest(stats["n_words"], F.lit(1)), F.greatest(stats["n_lines"], F.lit(1))
    return {
        "n_words": stats["n_words"],
        "mean_word_chars": stats["word_chars"] / words,
        "symbol_ratio": stats["n_symbols"] / F.greatest(stats["word_chars"], F.lit(1)),
        "dup_line_ratio": stats["n_dup_lines"] / lines,
        "short_line_ratio": stats["n_short_lines"] / lines,
        "stop_word_ratio": stats["n_stop_words"] / words,
    }


def compile_rules(rules: tuple[Rule, ...], stats: Column) -> Column:
    """True where no rule drops the text."""
    by_name, fine = measures(stats), F.lit(True)
    for r in rules:
        value = by_name[r.measure]
        inside = F.lit(True)
        if r.least is not None:
            inside = inside & (value >= r.least)
        if r.most is not None:
            inside = inside & (value <= r.most)
        fine = fine & ((stats["n_words"] < r.from_words) | inside)
    return fine


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for each row of docs (doc_id, text)."""
    rows = docs.select("doc_id", text_statistics(F.col("text")).alias("s"))
    s = F.col("s")
    failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[s[c].alias(c) for c in base], failed.alias("base_failed"), (~failed & compile_rules(rules, s)).alias("kept"))
