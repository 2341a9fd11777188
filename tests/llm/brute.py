"""Plain versions of what the operators compute, a document at a time or all pairs; for small tables only."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from xxhash import xxh64_intdigest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[k : k + shingle]).encode(), 42) for k in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values: dict[int, int], most_bits: int = 2) -> dict[int, int]:
    """The smallest key reachable over values that differ in at most so many bits, by comparing all pairs."""
    ids = sorted(values)
    prints = np.array([values[i] for i in ids], np.uint64)
    parent = {i: i for i in ids}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(prints[k + 1 :] ^ prints[k]) <= most_bits) + k + 1:
            a, b = find(i), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal_data(text: str | None) -> dict[str, list[tuple[int, int]]]:
    def fits(kind: str, m: str) -> bool:
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text or "") if fits(k, m[0])] for k, p in STRICT.items()}


def spans_digest(found: dict[str, list[tuple[int, int]]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, at in found.items() for a, b in at).encode()).hexdigest()


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows: dict[tuple[str, ...], list[int]] = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + d for at in windows.values() if len(at) > 1 for k in at for d in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Targets by handing the excess on until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**share, **fixed}
        fixed |= {s: float(most * sizes[s]) for s in over}


# --- similar texts ------------------------------------------------------------------------------------------


def shingles(text: str | None, n: int = 5) -> frozenset[str]:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def similar_roots(texts: dict[int, str | None], similarity: float = 0.8) -> dict[int, int]:
    """The smallest id reachable over pairs of texts with that Jaccard similarity, by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in sorted(texts.items())}
    having: dict[str, list[int]] = {}
    for i, found in sets.items():
        for g in found:
            having.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, found in sets.items():
        common: dict[int, int] = {}
        for g in found:
            for j in having[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        others = common.items() if found else [(j, 0) for j in sets if j < i and not sets[j]]
        for j, n in others:
            if n >= similarity * (len(found) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


# --- languages ----------------------------------------------------------------------------------------------


def languages(rows: list[tuple[str, str]], texts: list[str], most: int) -> list[tuple[str, float]]:
    """Language and posterior of texts, learned from rows (text, lang): dictionaries of counts, a word at a time."""
    import math
    from collections import Counter

    names = sorted({lang for _, lang in rows})
    counts = {(lang, g): Counter() for lang in names for g in range(6)}
    for text, lang in rows:
        counts[lang, 0].update(re.findall(r"[^\W\d_]+", text.lower()))
    for lang in names:
        for word, n in counts[lang, 0].items():
            marked = f"^{word}$"
            for g in range(1, 6):
                for k in range(len(marked) - g + 1):
                    counts[lang, g][marked[k : k + g]] += n
    totals = {k: sum(c.values()) for k, c in counts.items()}
    kept = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]) for k, c in counts.items()}
    known = [set().union(*(kept[lang, g] for lang in names)) for g in range(6)]

    def score(lang: str, g: int, entry: str) -> float:
        return math.log(kept[lang, g].get(entry, 0.5) / totals[lang, g])

    out = []
    for text in texts:
        sums = dict.fromkeys(names, 0.0)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            if word in known[0]:
                found = [(0, word)]
            else:
                marked = f"^{word}$"
                found = [next(((g, marked[k : k + g]) for g in range(5, 0, -1) if k + g <= len(marked) and marked[k : k + g] in known[g]), None) for k in range(len(marked))]
            for lang in names:
                sums[lang] += sum(score(lang, *x) for x in found if x)
        best = max(names, key=lambda x: sums[x])
        out.append((best, 1 / sum(math.exp(min(700, v - sums[best])) for v in sums.values())))
    return out


# --- URLs ---------------------------------------------------------------------------------------------------


def markov_log_likelihood(training: list[str], text: str, order: int = 4) -> float:
    """By Witten-Bell interpolation, counting occurrences in the training texts anew for each character."""
    import math

    padded = ["\x02" * order + t + "\x03" for t in training]
    after: dict[str, list[str]] = {}
    for t in padded:
        for k in range(order, len(t)):
            for n in range(order + 1):
                after.setdefault(t[k - n : k], []).append(t[k])
    total, text = 0.0, "\x02" * order + text + "\x03"
    for k in range(order, len(text)):
        p = 1 / 256
        for n in range(order + 1):
            seen = after.get(text[k - n : k])
            if not seen:
                break
            kinds = len(set(seen))
            p = (seen.count(text[k]) + kinds * p) / (len(seen) + kinds)
        total += math.log(p)
    return total


# --- pages --------------------------------------------------------------------------------------------------


def main_texts(pages: list[tuple[int, str | None, str | None]]) -> dict[int, str]:
    """Main texts by templates, a host at a time and with whole occurrence vectors. Only the reading of markup is shared with the operator."""
    from bisect import bisect_left

    from tallyspark.llm import html_extraction as H

    def host_of(url: str | None) -> str:
        m = re.match(r"(?s)^.*?://([^/?#]*)", url or "")
        return m[1].translate(LOWER) if m else ""

    hosts: dict[str, dict[str | None, list]] = {}
    for _, url, source in pages:
        hosts.setdefault(host_of(url), {})[source] = [("", True)] + H.Page(source or "").tokens  # the page itself is the first token
    template, kept, loose = {}, {}, {}
    for host, contents in hosts.items():
        sources = list(contents)
        counts: dict[str, list[int]] = {}
        first: dict[str, list[int]] = {}
        what: dict[str, object] = {}
        for k, source in enumerate(sources):
            for place, (token, kind) in enumerate(contents[source]):
                counts.setdefault(token, [0] * len(sources))[k] += 1
                if counts[token][k] == 1:
                    first.setdefault(token, []).append(place - 1)
                what[token] = kind if token not in what or isinstance(what[token], bool) is False else what[token] or kind
        n = len(sources)
        common = []
        for token, vector in counts.items():
            pages_of = sum(x > 0 for x in vector)
            if token == "" or (isinstance(what[token], bool) and (pages_of >= H.MIN_TAGS * n or what[token])) or (not isinstance(what[token], bool) and pages_of >= H.MIN_TEXT * n and pages_of >= H.FEW_PAGES):
                common.append(token)
        h = lambda token: 0 if token == "" else H.token_hash(token)
        mean = {t: sum(first[t]) / len(first[t]) for t in common}
        classes: dict[tuple, list[str]] = {}
        for t in common:
            classes.setdefault(tuple(counts[t]), []).append(t)
        ordered = [sorted(c, key=lambda t: (mean[t], h(t))) for c in classes.values()]
        ordered.sort(key=lambda c: ("" not in c, -sum(x > 0 for x in counts[c[0]]), -len(c), h(c[0])))
        borders: list[float] = []
        tags, texts_of = set(), {}
        for c in ordered:
            valid = "" in c or len(c) > 1 and len({bisect_left(borders, mean[t]) for t in c}) == 1
            own = [t for t in c if t and (valid or isinstance(what[t], bool))]
            tags |= {t for t in own if isinstance(what[t], bool)}
            if any(not isinstance(what[t], bool) for t in own):
                whole = True
                for source in sources:
                    seen = [t for t, _ in contents[source][1:] if t in own]
                    whole = whole and seen == own * (len(seen) // len(own)) if own else whole
                if whole:
                    texts_of |= dict.fromkeys(t for t in own if not isinstance(what[t], bool))
            if valid:
                borders = sorted(borders + [mean[t] for t in c])
        slots: dict[str, list] = {}
        for source in sources:
            slot, parts = "", {}
            for t, kind in contents[source][1:]:
                if isinstance(kind, bool):
                    slot = t if t in tags else slot
                elif t not in texts_of:
                    parts.setdefault(slot, []).append((t, kind))
            for s, blocks in parts.items():
                x = slots.setdefault(s, [0, 0, 0, 0, set()])
                for _, (text, links, side, main) in blocks:
                    for i, v in enumerate((len(text), links, len(text) * side, len(text) * main)):
                        x[i] += v
                x[4].add(tuple(t for t, _ in blocks))
        share = {s: [v / max(1, x[0]) for v in x[1:4]] for s, x in slots.items()}
        has_main = any(main >= 0.5 and side < 0.5 for _, side, main in share.values())
        score = {s: H.BASE + H.MAIN_SHARE * main + H.SIDE_SHARE * side + H.LINK_SHARE * links + (H.DIFFERS if len(slots[s][4]) > 1 or n == 1 else 0) for s, (links, side, main) in share.items()}
        loose[host] = {s for s, v in score.items() if v > 0}
        kept[host] = {s for s, v in score.items() if v + (H.OUTSIDE_MAIN if has_main and share[s][2] < 0.5 else 0) > 0}
        template[host] = tags, texts_of
    out = {}
    for i, url, source in pages:
        host = host_of(url)
        tags, texts_of = template[host]
        for good in (kept[host], loose[host]):
            slot, found = "", []
            for t, kind in hosts[host][source][1:]:
                if isinstance(kind, bool):
                    slot = t if t in tags else slot
                elif slot in good and t not in texts_of:
                    found.append(kind[0])
            if found:
                break
        out[i] = " ".join(found)
    return out
