"""Personal data: candidates from high-recall patterns, chosen by gradient-boosted trees, in DataFrame operations only.

Strict patterns give the base spans, which always stay: e-mail addresses, IPv4 addresses, payment cards and
phone numbers. Loose patterns propose more, over the text with the base spans of all kinds blanked out: spelled-out addresses,
colon addresses, cards in groups, numbers without a country code, and secrets, which have no strict pattern;
strict matches that failed their test are candidates as well. Candidates may overlap. Each has yes-or-no features
of its format and of the characters around it. Boosted trees of depth two score the candidates, and those above a
threshold calibrated for each kind join the base spans.

Training is by distant supervision that isn't the base test. In a hash sample of about sample_docs documents (20 values each),
values made from a hash of the document are planted between the document's own words: as positives, addresses,
cards, numbers and keys in the forms that strict patterns miss; as negatives, what looks like them, such as words
with a bracketed word between, cards with a wrong digit, rows of numbers, times and hardware addresses, and words
joined by dashes. Strict matches that failed are negatives too. So how often such things occur in the corpus does
not move a threshold. Spark counts the candidates by their combination of features, and what the boosting on the
driver sees is a table bounded by the number of combinations. One document in four is for calibration: the
threshold of a kind is the least score at which the share of positives among the candidates above reaches
min_precision, and at least even odds. The trees become one column expression.

Positions come from splitting a text at the matches: prefix sums over the lengths of the pieces, in blocks, so
that a text with very many matches costs little more than one with few. Patterns are written so that a failed
try costs no backtracking over long runs; they match what the plain patterns match.

Defined results: a null text counts as empty; positions are code points, the end excluded; repeated rows are
judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import drawn_by, let, materialize, words_of

#: Kinds with strict patterns, and all.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

_LOCAL = "[A-Za-z0-9._%+-]"
#: What each plain pattern matches, leftmost and without overlap.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\})\s?[a-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[a-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[.\x20_/-]{0,3}[0-9]{4}){2}[.\x20_/-]{0,3}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[0-9]{1,3}[\x20./-]?)?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{12,}+=*+",
}
#: A cheap test without which no pattern of the kind can match.
NEEDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@") | t.rlike(r"(?i)[(\[{](?:at)[)\]}]"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:"),
    "card": lambda t: t.rlike("[0-9]{4}|[0-9][\x20-][0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]|[0-9]{2}\)?[\x20./-]{1,2}[0-9]{3}"),
    "secret": lambda t: t.rlike(r"[0-9][A-Za-z0-9+/_-]*[A-Za-z]|[A-Za-z][A-Za-z0-9+/_-]*[0-9]"),
}
KEYWORDS = {
    "email": r"(?i)(mail|contact|write|kontakt|correo)[^a-z]{0,4}$",
    "ip": r"(?i)\b(ip|host|server|addr\w*)[^a-z]{0,4}$",
    "card": r"(?i)(card|visa|master|amex|karte|carte|tarjeta)[^a-z]{0,4}$",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell)[^a-z]{0,4}$",
    "secret": r"(?i)(pass\w*|pwd|token|secret|key|auth|bearer|credential\w*)[\"'\x20]{0,3}[=:]{0,2}[\x20\"']{0,3}$",
}
#: Characters of context on each side.
CONTEXT = 16
FEATURES = ("loose", "plus", "paren", "blank", "digits_9", "digits_13", "digits_16", "luhn", "octets", "glued_before", "glued_after", "keyword", "assigned", "decimal", "numbers_near", "domain", "groups_8", "wide_group", "upper", "hex", "long_20", "prefix", "wordlike")


def prefix_sums(values: Column, block: int = 32, levels: int = 3) -> Column:
    """Inclusive prefix sums of an array of numbers, in blocks, whose own sums are summed likewise."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def of(v: Column) -> Column:
        if levels == 1:
            return F.transform(v, lambda _, i: total(F.slice(v, F.lit(1), i + 1)))
        blocks = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(blocks, lambda b: total(F.slice(v, b * block + 1, block)))

        def inside(p: Column) -> Column:
            nth = lambda i: F.floor(i / block).cast("int")
            return F.transform(v, lambda _, i: F.when(i >= block, p[F.greatest(nth(i) - 1, F.lit(0))]).otherwise(0) + total(F.slice(v, nth(i) * block + 1, i % block + 1)))

        return let(prefix_sums(sums, block, levels - 1), inside)

    return let(values, of)


def _around(gaps: Column, ms: Column) -> Column:
    """For each match the CONTEXT characters of the whole text on each side, neighbouring matches included.

    Pieces that reach from one match to the next are joined in twos, three times: eight pieces of a match each,
    of two characters at least, are CONTEXT characters.
    """
    last = F.size(ms) - 1
    near = F.transform(ms, lambda _, i: F.struct(F.right(gaps[i], F.lit(CONTEXT)).alias("before"), F.left(gaps[i + 1], F.lit(CONTEXT)).alias("after")))
    first = F.transform(
        ms,
        lambda _, i: F.struct(
            F.right(F.concat(F.when(i > 0, ms[F.greatest(i - 1, F.lit(0))]).otherwise(""), gaps[i]), F.lit(CONTEXT)).alias("before"),
            F.left(F.concat(gaps[i + 1], F.when(i < last, ms[F.least(i + 1, last)]).otherwise("")), F.lit(CONTEXT)).alias("after"),
        ),
    )

    def joined(pieces: Column, step: int) -> Column:
        return F.transform(
            pieces,
            lambda x, i: F.struct(
                F.right(F.concat(F.when(i >= step, pieces[F.greatest(i - step, F.lit(0))]["before"]).otherwise(""), x["before"]), F.lit(CONTEXT)).alias("before"),
                F.left(F.concat(x["after"], F.when(i + step <= last, pieces[F.least(i + step, last)]["after"]).otherwise("")), F.lit(CONTEXT)).alias("after"),
            ),
        )

    wide = let(first, lambda a: let(joined(a, 1), lambda b: let(joined(b, 2), lambda c: joined(c, 4))))
    # gaps that are long enough, as most are, hold the context by themselves
    between = F.slice(gaps, 2, F.greatest(F.size(gaps) - 2, F.lit(0)))
    return F.when(F.exists(between, lambda g: F.length(g) < CONTEXT), wide).otherwise(near)


def matches(text: Column, pattern: str) -> Column:
    """All matches in a text: start, end, m, and the characters before and after."""

    def of(gaps: Column) -> Column:
        def with_matches(ms: Column) -> Column:
            steps = F.transform(ms, lambda m, i: (F.length(gaps[i]) + F.when(i > 0, F.length(ms[F.greatest(i - 1, F.lit(0))])).otherwise(0)).cast("long"))
            return let(
                F.struct(prefix_sums(steps).alias("starts"), _around(gaps, ms).alias("around")),
                lambda at: F.transform(ms, lambda m, i: F.struct(at["starts"][i].alias("start"), (at["starts"][i] + F.length(m)).alias("end"), m.alias("m"), at["around"][i]["before"].alias("before"), at["around"][i]["after"].alias("after"))),
            )

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_matches)

    return let(F.split(text, pattern, -1), of)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def passes(kind: str, m: Column) -> Column:
    """Does a strict match pass its kind's test?"""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return (n >= 13) & (n <= 19) & F.call_function("luhn_check", _digits(m))
    return (n >= 9) & (n <= 15)


def features(kind: str, loose: bool, c: Column) -> Column:
    m, before, after = c["m"], c["before"], c["after"]
    n = F.length(_digits(m))
    values = {
        "loose": F.lit(loose),
        "plus": m.startswith("+"),
        "paren": m.contains("("),
        "blank": m.contains(" "),
        "digits_9": n >= 9,
        "digits_13": n >= 13,
        "digits_16": n == 16,
        "luhn": (n >= 13) & F.call_function("luhn_check", _digits(m)),
        "octets": m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "glued_before": before.rlike(r"[\p{L}0-9_]$"),
        "glued_after": after.rlike(r"^[\p{L}0-9_]"),
        "keyword": before.rlike(KEYWORDS[kind]),
        "assigned": before.rlike(r"[=:\"'#/]\s*$"),
        "decimal": before.rlike(r"[0-9][.,]$") | after.rlike(r"^[.,][0-9]"),
        "numbers_near": before.rlike(r"[0-9][\x20,;:.]{1,2}$") | after.rlike(r"^[\x20,;:]{1,2}[0-9]"),
        "domain": m.rlike(r"(?i)(?:\.|\(dot\)|\[dot\]|\{dot\})\s?(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl)$"),
        "groups_8": m.rlike(r"^(?:[0-9A-Fa-f]+:){7}[0-9A-Fa-f]+$"),
        "wide_group": m.rlike(r"(?:^|:)[0-9A-Fa-f]{3,4}(?::|$)"),
        "upper": m.rlike(r"^[A-Z0-9]+$"),
        "hex": m.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "long_20": F.length(m) >= 18,
        "prefix": m.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|sk[_-]|xox[abp]-|AIza|eyJ)"),
        "wordlike": m.rlike(r"[a-z]{2}[g-z][a-z]{2}|[A-Za-z]{2}[ghijlmnoprstuvy][a-z]{2}-"),
    }
    return F.aggregate(F.array(*[F.when(values[f], 1 << k).otherwise(0) for k, f in enumerate(FEATURES)]), F.lit(0), lambda a, x: a + x)


SPANS = "array<struct<start:bigint,end:bigint>>"
CELLS = "array<struct<start:bigint,end:bigint,code:int>>"
#: Takes the place of each character of a base span; no pattern matches it.
BLANK = "\x01"


def _blanked(text: Column, kind: str) -> Column:
    """The text with what passes the strict test blanked out, at the same length."""

    def of(gaps: Column) -> Column:
        def with_matches(ms: Column) -> Column:
            cover = lambda m: F.when(passes(kind, m), F.repeat(F.lit(BLANK), F.length(m))).otherwise(m)
            return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.when(i < F.size(ms), cover(ms[F.least(i, F.size(ms) - 1)])).otherwise(""))), "")

        return let(F.regexp_extract_all(text, F.lit(STRICT[kind]), F.lit(0)), with_matches)

    return let(F.split(text, STRICT[kind], -1), of)


def _cell(kind: str, loose: bool) -> Callable[[Column], Column]:
    return lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), features(kind, loose, c).alias("code"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, and by kind base (arrays of start and end) and more (arrays of start, end, code of features) of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = F.col("text")

    def of(kind: str) -> Column:
        none = F.struct(F.array().cast(SPANS).alias("base"), F.array().cast(CELLS).alias("more"))

        def both(strict: Column) -> Column:
            base = F.transform(F.filter(strict, lambda c: passes(kind, c["m"])), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
            failed = F.transform(F.filter(strict, lambda c: ~passes(kind, c["m"])), _cell(kind, False))
            return F.struct(base.alias("base"), F.concat(failed, loose()).alias("more"))

        def loose() -> Column:
            return F.when(F.col("rest").rlike(LOOSE[kind]), F.transform(matches(F.col("rest"), LOOSE[kind]), _cell(kind, True))).otherwise(F.array().cast(CELLS))

        if kind not in BASE:
            found = F.struct(F.array().cast(SPANS).alias("base"), loose().alias("more"))
        else:
            found = let(matches(t, STRICT[kind]), both)
        return F.when(NEEDS[kind](t), found).otherwise(none)

    rows = rows.withColumn("rest", t)
    for kind in BASE:
        rows = rows.withColumn("rest", F.when(NEEDS[kind](t), _blanked(F.col("rest"), kind)).otherwise(F.col("rest")))
    return rows.select("doc_id", *[of(k).alias(k) for k in KINDS])


# --- planted examples ---------------------------------------------------------------------------------------


def _picked(options: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(by, F.lit(len(options))) + 1).cast("int"))


def _number(h: str, k: int, size: int) -> Column:
    """So many digits of a hash."""
    return F.lpad(F.pmod(F.xxhash64(h, F.lit(k)), F.lit(10**size)).cast("string"), size, "0")


def planted(docs: DataFrame) -> DataFrame:
    """h (a hash of the document), kind, code and good: candidates in values planted between words of docs (doc_id, text)."""
    words = F.slice(words_of(F.substring("text", 1, 2000)), 1, 60)  # words to stand around the values; what is judged is the whole text
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), words.alias("w")).filter("size(w) >= 8")
    word = lambda k: F.element_at("w", (F.pmod(F.xxhash64("h", F.lit(k)), F.size("w")) + 1).cast("int"))
    plain = lambda k: F.regexp_replace(F.lower(word(k)), "[^\\p{L}]", "")
    ascii_ = lambda k: F.concat(F.lit("x"), F.regexp_replace(F.lower(word(k)), "[^a-z]", ""))
    pick = lambda k: F.pmod(F.xxhash64("h", F.lit(k)), F.lit(1 << 30))
    at, dot = _picked([" (at) ", "(at)", " [at] ", "[at]", " {at} "], pick(1)), _picked([".", " (dot) ", "(dot)", " [dot] "], pick(2))
    digits = F.concat(_picked(["4", "5", "37", "6011"], pick(3)), _number("h", 4, 12))
    body = F.rpad(digits, 15, "7")
    endings = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string")))
    luhn = F.filter(endings, lambda x: F.call_function("luhn_check", x))[0]
    wrong = F.filter(endings, lambda x: ~F.call_function("luhn_check", x))[(pick(5) % 9).cast("int")]
    gap = _picked([".", " / ", "/", "_", " - "], pick(6))

    def in_groups(x: Column) -> Column:
        return F.concat(F.substring(x, 1, 4), gap, F.substring(x, 5, 4), gap, F.substring(x, 9, 4), gap, F.substring(x, 13, 4))

    area, mid, end = F.concat(F.lit("0"), _number("h", 7, 3)), F.concat(F.lit("5"), _number("h", 8, 2)), _number("h", 9, 4)
    sep = _picked([" ", "-", ".", "/"], pick(10))
    group = lambda k, size: F.substring(F.sha1(F.concat_ws(":", F.col("h").cast("string"), F.lit(str(k)))), 3, size)
    base36 = F.upper(F.translate(F.substring(F.sha2(F.col("h").cast("string"), 256), 1, 16), "0123abc", "QZX9KJW"))
    # words such as `de` and `es` are domains as well, so a negative's last word is made longer
    values = [
        ("email", True, F.concat(ascii_(11), F.lit("."), _number("h", 12, 2), at, ascii_(13), dot, _picked(["com", "org", "net", "de", "fr", "es"], pick(14)))),
        ("email", False, F.concat(plain(15), at, plain(16), F.lit(". "), plain(17), F.lit("na"))),
        ("email", False, F.concat(plain(18), at, plain(19), dot, plain(20), F.lit("na"))),
        ("ip", True, F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[group(k, 4) for k in range(6)])),
        ("ip", True, F.concat_ws(":", F.lit("fe80"), F.lit("0"), F.lit("0"), F.lit("0"), *[group(k, 3) for k in range(4)])),
        ("ip", False, F.concat_ws(":", *[group(k, 2) for k in range(6)])),
        ("ip", False, F.concat_ws(":", *[_number("h", 20 + k, 2) for k in range(4)])),
        ("card", True, in_groups(luhn)),
        ("card", False, in_groups(wrong)),
        ("card", False, F.concat(_number("h", 30, 4), F.lit(" "), _number("h", 31, 4), F.lit(" "), _number("h", 32, 4), F.lit(" "), _number("h", 33, 4), F.lit(" "), _number("h", 34, 4))),
        ("phone", True, F.concat(F.lit("("), F.substring(area, 2, 3), F.lit(") "), mid, F.lit("-"), end)),
        ("phone", True, F.concat(area, sep, mid, sep, end)),
        ("phone", False, F.concat(_number("h", 40, 3), F.lit(" "), _number("h", 41, 3), F.lit(" "), _number("h", 42, 3), F.lit(" "), _number("h", 43, 3), F.lit(" "), _number("h", 44, 2))),
        ("phone", False, F.concat(_number("h", 45, 2), F.lit("."), _number("h", 46, 3), F.lit("."), _number("h", 47, 3), F.lit(","), _number("h", 48, 2))),
        ("secret", True, F.concat(_picked(["token = \"", "password=", "secret: ", "api_key=\""], pick(50)), F.substring(F.sha2(F.col("h").cast("string"), 256), 1, 18), F.lit("\""))),
        ("secret", True, F.concat(_picked(["token = \"", "", "bearer ", ""], pick(51)), F.sha1(F.col("h").cast("string")))),
        ("secret", True, F.concat(_picked(["AKIA", "AKIA", "ghp_", "sk-"], pick(52)), base36)),
        ("secret", False, F.concat(plain(53), F.lit("-"), plain(54), F.lit("-"), plain(55), F.lit("-"), _number("h", 56, 4))),
        ("secret", False, F.concat(plain(57), plain(58), plain(59), _number("h", 60, 2))),
        ("secret", False, F.concat(_number("h", 61, 4), F.lit("-"), _number("h", 62, 2), F.lit("-"), _number("h", 63, 2), F.lit("T"), _number("h", 64, 6))),
    ]
    # a number with a neighbour, so that neighbours alone do not decide
    beside = [("card", True, in_groups(luhn), in_groups(wrong)), ("card", False, in_groups(wrong), in_groups(luhn)), ("phone", True, F.concat(area, sep, mid, sep, end), _number("h", 65, 5))]
    values = [(*v, None) for v in values] + beside
    say = {"email": ["mail: ", "contact ", "", ""], "ip": ["host ", "ip: ", "", ""], "card": ["card ", "visa: ", "", ""], "phone": ["tel. ", "phone: ", "", ""], "secret": [""]}
    cells = [
        F.struct(F.lit(kind).alias("kind"), F.lit(good).alias("good"), F.concat(word(80 + k), F.lit(" "), _picked(say[kind], pick(70 + k)) if good else F.lit("")).alias("before"), value.alias("value"), F.concat(F.lit(" "), *([] if neighbour is None else [neighbour, F.lit(" ")]), word(120 + k)).alias("after"))
        for k, (kind, good, value, neighbour) in enumerate(values)
    ]
    each = rows.select("h", F.explode(F.array(*cells)).alias("x")).select("h", "x.*")
    text = F.concat("before", "value", "after")
    found = [F.when(F.col("kind") == kind, F.transform(matches(text, LOOSE[kind]), _cell(kind, True))) for kind in KINDS]
    first, last = F.length("before"), F.length("before") + F.length("value")
    inside = F.filter(F.coalesce(*found), lambda c: (c["end"] > first) & (c["start"] < last))
    return each.select("h", "kind", "good", F.explode(inside).alias("c")).select("h", "kind", "c.code", "good")


# --- boosting on counts -------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Sums of trees of depth two over feature bits: (first bit, second bit, values by both), and, where they stand for all kinds, trees and a threshold for each."""

    bias: float = 0.0
    trees: list[tuple[int, int, tuple[float, float, float, float]]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)
    by_kind: dict[str, Trees] = field(default_factory=dict)

    def score(self, code: int) -> float:
        return self.bias + sum(v[2 * (code >> a & 1) + (code >> b & 1)] for a, b, v in self.trees)

    def expression(self, code: Column) -> Column:
        bit = lambda k: F.shiftright(code, k).bitwiseAND(F.lit(1)) == 1
        total = F.lit(self.bias)
        for a, b, v in self.trees:
            total = total + F.when(bit(a), F.when(bit(b), v[3]).otherwise(v[2])).otherwise(F.when(bit(b), v[1]).otherwise(v[0]))
        return total


def boost(cells: list[tuple[int, int, int]], rounds: int = 40, rate: float = 0.3, shrink: float = 1.0) -> Trees:
    """Trees from (code, positives, negatives): Newton steps on the logistic loss."""
    good, bad = sum(p for _, p, _ in cells), sum(n for _, _, n in cells)
    model = Trees(math.log((good + 1) / (bad + 1)))
    raw = [model.bias] * len(cells)
    for _ in range(rounds if good and bad else 0):
        slopes = []
        for (code, p, n), r in zip(cells, raw):
            q = 1 / (1 + math.exp(-r))
            slopes.append((code, p - (p + n) * q, max(1e-9, (p + n) * q * (1 - q))))
        best = None
        for a in range(len(FEATURES)):
            for b in range(a + 1, len(FEATURES)):
                g, h = [0.0] * 4, [0.0] * 4
                for code, s, w in slopes:
                    k = 2 * (code >> a & 1) + (code >> b & 1)
                    g[k] += s
                    h[k] += w
                gain = sum(x * x / (y + shrink) for x, y in zip(g, h))
                if best is None or gain > best[0]:
                    best = (gain, a, b, tuple(rate * x / (y + shrink) for x, y in zip(g, h)))
        if best is None or best[0] < 1e-6:
            break
        model.trees.append(best[1:])
        _, a, b, v = best
        raw = [r + v[2 * (c[0] >> a & 1) + (c[0] >> b & 1)] for r, c in zip(raw, cells)]
    return model


def train(docs: DataFrame, sample_docs: int = 4_000, min_precision: float = 0.95) -> Trees:
    """Trees and thresholds from values planted in a sample of docs (doc_id, text), and its strict matches that failed."""
    sample = docs.select("doc_id", "text").filter(drawn_by(F.xxhash64(F.lit("personal data"), "doc_id", "text"), sample_docs, docs.count()))
    t = F.coalesce(F.col("text"), F.lit(""))
    refused = lambda k: F.when(NEEDS[k](t), F.transform(F.filter(matches(t, STRICT[k]), lambda c: ~passes(k, c["m"])), lambda c: _cell(k, False)(c)["code"])).otherwise(F.array().cast("array<int>"))
    failed = sample.select(F.xxhash64("doc_id").alias("h"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), refused(k).alias("codes")) for k in BASE])).alias("x"))
    failed = failed.select("h", "x.kind", F.explode("x.codes").alias("code"), F.lit(False).alias("good"))
    each = planted(sample).unionByName(failed).withColumn("check", F.pmod("h", F.lit(4)) == 0)
    # at most two halves times the kinds times the combinations of features
    counts = each.groupBy("check", "kind", "code").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("check", "kind", "code").collect()
    model = Trees()
    for kind in KINDS:
        own = boost([(r["code"], r["good"], r["bad"]) for r in counts if not r["check"] and r["kind"] == kind])
        model.by_kind[kind] = own
        good = bad = 0
        for s, g, b in sorted(((own.score(r["code"]), r["good"], r["bad"]) for r in counts if r["check"] and r["kind"] == kind), reverse=True):
            good, bad = good + g, bad + b
            if s >= 0 and good and good >= min_precision * (good + bad):
                model.thresholds[kind] = s
    return model


def find_personal_data(docs: DataFrame, min_precision: float = 0.95) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256, spans, and the numbers of all spans and of secrets for each row of docs (doc_id, text)."""
    model = train(docs, min_precision=min_precision)
    return chosen_spans(materialize(candidates(docs), "pii-candidates"), model)


def chosen_spans(found: DataFrame, model: Trees) -> DataFrame:
    """What find_personal_data() returns, from candidates() and a model."""

    # a span as one number, which Spark's array functions hash; of structs they compare all pairs
    number = lambda c: c["start"] * (1 << 32) + c["end"]

    def written(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), F.shiftright(x, 32).cast("string"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("string")))

    def chosen(kind: str) -> Column:
        """Base spans and the added ones, in order of start and end."""
        base = F.transform(F.col(f"{kind}.base"), number)
        if kind not in model.thresholds:
            return base
        added = F.filter(F.col(f"{kind}.more"), lambda c: model.by_kind[kind].expression(c["code"]) >= model.thresholds[kind] - 1e-9)  # sums differ in their last bits
        return F.array_sort(F.array_distinct(F.concat(base, F.transform(added, number))))

    base = F.array_join(F.concat(*[written(k, F.transform(F.col(f"{k}.base"), number)) for k in BASE]), ",")
    rows = found.select("doc_id", *[F.size(f"{k}.base").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), *[chosen(k).alias(f"all_{k}") for k in KINDS])
    every = F.array_join(F.concat(*[written(k, F.col(f"all_{k}")) for k in KINDS]), ",")
    total = F.size("all_email") + F.size("all_ip") + F.size("all_card") + F.size("all_phone") + F.size("all_secret")
    return rows.select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", every.alias("spans"), total.cast("long").alias("n_spans"), F.size("all_secret").cast("long").alias("n_secret"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the spans of found (doc_id, spans) replaced by [kind] in their texts; overlapping spans become one."""
    spans = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("start"), F.split(s, ":")[2].cast("long").alias("end"), F.split(s, ":")[0].alias("kind")))
    marked = found.select(F.col("doc_id").alias("_id"), F.array_sort(spans).alias("_spans"))
    text = F.col("text")

    def paste(s: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
        step = lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(F.struct(x["end"].alias("at"), F.concat(a["parts"], F.when(x["start"] >= a["at"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.concat(F.lit("["), x["kind"], F.lit("]")))).otherwise(F.array().cast("array<string>"))).alias("parts")))
        return F.aggregate(s, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))

    joined = docs.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    new = F.when(F.size("_spans") > 0, paste(F.col("_spans"))).otherwise(text)
    return joined.select(*[new.alias("text") if c == "text" else F.col(c) for c in docs.columns])
