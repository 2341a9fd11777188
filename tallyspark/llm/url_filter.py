"""URL filters: rules on host and path, and a character language-model ratio for the URLs that no rule fits.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each URL two log
likelihoods; their difference divided by the length is the score, and a score above a calibrated threshold
blocks. Contexts of up to ORDER characters are interpolated from the shortest to the longest by Witten-Bell:
a context hands as many shares to the shorter one as it has seen different characters.

Accepted URLs are those that a rule allows, rejected ones those that a rule blocks; rejected URLs that are known
from elsewhere can be added. The models see the whole URL without its scheme, in lower case, with all digits as
one character, so they carry over to other URLs what distinguishes the two sides: parts of hosts, of paths and
of queries. All URLs of both sides are learned from, whole, and every URL is scored whole.

The models never leave Spark's tables, so nothing needs to bound them. Each distinct text is cut into the strings of
ORDER + 1 characters that end at its characters. Counts of all shorter strings are sums of theirs, probabilities
of strings of n characters come from those of n - 1 by joins, and a score is the sum of its strings' values. Values
are whole numbers of 2 ** -36 nats, so sums don't depend on their order.

The threshold is calibrated on a fifth of the texts of both sides that counting didn't see: the least score from
which, with both sides weighing the same, min_precision of what lies above is rejected, and no more than 1 -
pass_share of the accepted side is. Where no score reaches that, the sides can't be told apart by their
characters, and nothing but rules blocks.

Defined results: host and path of a null URL, or of one without `://`, are empty, no rule fits, and the models
judge the empty text, which is allowed (also a URL without a host); the longest fitting rule wins; repeated rows are judged alike; without
URLs on either side nothing but rules blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import join_counted, materialize

ORDER = 4
START, END = "\x02", "\x03"
#: Steps of the score, in nats a character, at which a threshold may lie.
STEP = 0.01
#: Values of strings are whole numbers of this part of a nat.
UNIT = 2.0**-36
#: Characters of a text that are cut into strings at once, as a substring is found by counting from the start.
PIECE = 100


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def model_text(url: Column) -> Column:
    """What the models see of a URL: all after its scheme, or all of it if it has none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_replace(url, r"(?s)^.*?://(.*)$", "$1")), "[0-9]", "0"), F.lit(""))


class MarkovModel:
    """The model in one process, from counts of strings of up to ORDER + 1 characters; string_values() says the same of tables."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.seen: dict[str, tuple[int, int]] = {}
        for gram, n in counts.items():
            total, kinds = self.seen.get(gram[:-1], (0, 0))
            self.seen[gram[:-1]] = (total + n, kinds + 1)
        self.memory: dict[str, float] = {}

    def _probability(self, gram: str) -> float:
        p = 1.0 / 256
        for k in range(len(gram) - 1, -1, -1):
            known = self.seen.get(gram[k:-1])
            if known is None:
                break
            p = (self.counts.get(gram[k:], 0) + known[1] * p) / (known[0] + known[1])
        return p

    def log_likelihood(self, text: str) -> float:
        text, total = START * ORDER + text + END, 0.0
        for k in range(ORDER, len(text)):
            gram = text[k - ORDER : k + 1]
            log = self.memory.get(gram)
            if log is None:
                if len(self.memory) > 500_000:
                    self.memory.clear()
                log = self.memory[gram] = math.log(self._probability(gram))
            total += log
        return total


def strings_of(texts: DataFrame) -> DataFrame:
    """url, accepted, rejected and gram, the strings of ORDER + 1 characters that end at each character and at the end, of texts (url, text, accepted, rejected)."""
    padded = F.concat(F.lit(START * ORDER), F.col("text"), F.lit(END))
    pieces = F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(PIECE)), lambda i: F.substring(padded, i + 1, F.lit(PIECE + ORDER)))
    cut = F.transform(F.sequence(F.lit(1), F.length("piece") - ORDER), lambda i: F.substring(F.col("piece"), i, F.lit(ORDER + 1)))
    each = texts.select("url", "accepted", "rejected", F.explode(pieces).alias("piece"))
    return each.select("url", "accepted", "rejected", F.explode(cut).alias("gram"))


def string_values(strings: DataFrame) -> DataFrame:
    """gram, value (the log of its last character's probability as rejected minus that as accepted, in UNITs) and uses of strings (gram, accepted, rejected, uses), one row each.

    Every string of n characters has its context, the n - 1 before its last, and its end of n - 1 among the
    strings of n - 1 characters; no key has more rows than there are characters.
    """
    shorter = None
    for n in range(1, ORDER + 2):
        sums = [F.sum(c).alias(c) for c in ("accepted", "rejected", "uses")]
        level = strings.groupBy(F.substring("gram", ORDER + 2 - n, n).alias("gram")).agg(*sums)
        level = level.withColumn("context", F.substring("gram", 1, n - 1)).withColumn("end", F.substring("gram", 2, n - 1))
        seen = [x for c in ("accepted", "rejected") for x in (F.sum(c).alias(f"{c}_total"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))]
        level = level.join(level.groupBy("context").agg(*seen), "context")
        if shorter is None:
            level = level.withColumns({f"p_{c}": F.lit(1.0 / 256) for c in ("accepted", "rejected")})
        else:
            level = level.join(shorter.withColumnRenamed("gram", "end"), "end")
        for c in ("accepted", "rejected"):
            kinds, total, p = (F.col(x) for x in (f"{c}_kinds", f"{c}_total", f"p_{c}"))
            level = level.withColumn(f"p_{c}", F.when(total > 0, (F.col(c) + kinds * p) / (total + kinds)).otherwise(p))
        shorter = level.select("gram", "p_accepted", "p_rejected")
    value = F.rint((F.log("p_rejected") - F.log("p_accepted")) / UNIT).cast("long")
    return level.select("gram", value.alias("value"), "uses")


def score_texts(texts: DataFrame) -> DataFrame:
    """url and score, the rejected model's log likelihood minus the accepted one's, divided by the length, of texts (url, text, accepted, rejected), which is a written table.

    accepted and rejected say how often a text is learned from on either side.
    """
    cut = materialize(strings_of(texts), "url-strings")
    strings = materialize(cut.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.count(F.lit(1)).alias("uses")), "distinct-url-strings")
    values = materialize(string_values(strings), "values-of-url-strings")
    each = join_counted(cut.select("url", "gram"), values, "gram", "uses")
    return each.groupBy("url").agg((F.sum("value") * UNIT / F.count(F.lit(1))).alias("score"))


def calibrate(scored: DataFrame, min_precision: float, pass_share: float) -> float | None:
    """The threshold, from scored (score, accepted, rejected), with counts of both sides; None if there is none."""
    bins = scored.groupBy(F.floor(F.col("score") / STEP).alias("bin")).agg(F.sum("rejected").alias("bad"), F.sum("accepted").alias("good"))
    found = bins.orderBy(F.desc("bin")).collect()  # a probability of n counts lies above (256 n ** 5) ** -1, so there are some 25,000 bins at most
    n_bad, n_good = sum(r["bad"] for r in found), sum(r["good"] for r in found)
    bad = good = 0
    threshold = None
    for r in found if n_bad and n_good else ():
        bad, good = bad + r["bad"], good + r["good"]
        caught, hurt = bad / n_bad, good / n_good
        if caught and caught >= min_precision * (caught + hurt) and hurt <= 1 - pass_share:
            threshold = r["bin"] * STEP
    return threshold


def filter_urls(pages: DataFrame, rules: Sequence[Rule], known_rejected: DataFrame | None = None, min_precision: float = 0.95, pass_share: float = 0.99) -> DataFrame:
    """page_id, host, path, rule, verdict and score for each row of pages (page_id, url); known_rejected: more URLs (url) to learn from."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("text", model_text(F.col("url")))
    rows = materialize(rows.select(F.col("page_id").cast("long").alias("id"), "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"), "text"), "urls")
    sides = rows.select("text", "verdict", F.lit(1).alias("page"))
    if known_rejected is not None:
        more = known_rejected.select(model_text(F.col("url")).alias("text"), F.lit("block").alias("verdict"), F.lit(0).alias("page"))
        sides = sides.union(more.filter("text != ''"))
    counts = [F.count_if(F.col("verdict") == verdict).alias(side) for side, verdict in (("accepted", "allow"), ("rejected", "block"))]
    texts = sides.groupBy("text").agg(*counts, F.sum("page").alias("copies"))
    texts = materialize(texts.withColumn("url", F.monotonically_increasing_id()), "url-texts")
    held = F.crc32(F.col("text").cast("binary")) % 5 == 0
    learned = [F.when(held, 0).otherwise(F.col(side)).alias(side) for side in ("accepted", "rejected")]
    scored = materialize(texts.join(score_texts(texts.select("url", "text", *learned)), "url"), "scored-urls")
    threshold = calibrate(scored.filter(held & (F.col("accepted") + F.col("rejected") > 0)), min_precision, pass_share)
    blocks = F.lit(False) if threshold is None else (F.col("score") >= threshold)
    verdict = F.coalesce("verdict", F.when(blocks, "block").otherwise("allow"))
    return join_counted(rows, scored.select("text", "copies", "score"), "text", "copies").select(F.col("id").alias("page_id"), "host", "path", "rule", verdict.alias("verdict"), "score")
