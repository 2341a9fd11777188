"""SimHash near-duplicates by anchor-point covering.

A fingerprint bit is 1 if the bit is set in more than half of the hashes of a text's word shingles. Anchors are
the words of a covering code: each fingerprint has one home anchor, the nearest, and goes as a guest to every
anchor within the covering radius plus a threshold. Fingerprints are compared at each anchor, homes with homes
and with guests. The code is made of the perfect binary Golay code of 23 bits, of covering radius 3.

near_duplicates() links fingerprints of 64 bits at two differing bits or fewer. Its anchors are the product of
two Golay codes over the lowest 46 bits (radius 6). If y differs from x in t1 and t2 bits of the blocks, then
y lies within 3 + t1 and 3 + t2 of x's home; so y goes to every anchor that far, the two bits dealt over the
blocks in all ways, which is about 61 anchors. Each pair meets at the home of either side: nothing is missed.
From THIRD_BLOCK distinct fingerprints on, where lists at these 2 ** 24 anchors would grow long, the 18 bits that are
left are a third block, filled up with zeros: about 119 anchors of 2 ** 36, and the same links.

similar_documents() links texts whose sets of shingles have a Jaccard similarity of 0.8 or more. There two
fingerprints differ in about 15 of 100 bits, which no single anchor code of use covers for certain. So it takes
longer fingerprints, cut in as many tables of 23 bits (and some more bits matched exactly, where many texts
would else make long lists at an anchor) as leave at most MISSED of the pairs just at the similarity without a
common anchor, by a bound that counts one direction only; each table replicates to the anchors within radius
3 + 1. Pairs that meet are compared over 128 bits, at four standard deviations, and those within are checked by
their whole sets of shingles. A link is never made of fingerprints alone.

Texts of the same fingerprint (or the same set) are one node from the start, so copies cost nothing here, and a
third of all rows may share one. An anchor with more than SPLIT_HOMES homes is split: its homes are dealt over
salts and the other side goes to each salt. A task streams over rows sorted by anchor, homes first, and keeps no
more than one anchor's homes in memory. Of the links found it emits a spanning forest, shortest first, so that a
cluster of k nodes yields k - 1 edges and not k * k pairs; the components stay the same. Tasks don't know each
other's forests, so similar_documents() goes over its tables in two passes, and the second has only edges between
what the first has left apart. Where the exact check then breaks a component up, its parts are compared whole, block
by block, so no link is lost by the forest. Components are joined by alternating large-star and small-star steps on tables.

near_duplicates() compares each fingerprint with about 61 * n / 2 ** 24 others, and from THIRD_BLOCK on with about
119 * n / 2 ** 36; similar_documents() takes more exact bits and more tables as n grows and keeps the lists short.

Defined results: words are longest runs of anything but ASCII white space; a null text, or one without words,
has fingerprint zero and the empty set, and links like any other; a text of fewer words than a shingle has one
shingle, all its words; repeated rows are each returned; the component of rows whose doc_ids are all null is
null; an empty table gives an empty result; other columns are ignored. drop_near_duplicates() keeps exactly one
row of each component, the one with the smallest doc_id (null last), also where doc_ids are null or repeat.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import give_back, join_counted, make_room, materialize, numbered, ship_package

#: Length, generator polynomial and covering radius of the binary Golay code.
BLOCK, GENERATOR, RADIUS = 23, 0b110001110101, 3
THRESHOLD = 2
SEED = 42
#: An anchor with more homes than this is split.
SPLIT_HOMES = 4096
#: Distinct fingerprints from which near_duplicates() takes anchors over three blocks of bits.
THIRD_BLOCK = 1 << 24
#: Pairs compared at once.
CHUNK = 2_000_000
#: Of pairs just at the similarity, the share that may have no anchor in common, by the bound.
MISSED = 0.035
#: Homes that an anchor of similar_documents() has on average, at most.
MEAN_HOMES = 512
#: Nodes of a broken component that a task holds, twice.
BLOCK_NODES = 1_000


# --- fingerprints -------------------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one text in UTF-8, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes, both touch ASCII only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 100_000):
        part = words[at : at + 100_000 + shingle - 1] if n > 1 else words
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if n > 1 or len(words) == shingle else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row of docs (doc_id, text)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py() or b"", shingle) for t in b["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- the covering code --------------------------------------------------------------------------------------


def _remainders(words: np.ndarray) -> np.ndarray:
    """Of polynomials over GF(2), given as bits, by the generator."""
    rest = words.copy()
    for k in range(BLOCK - 1, 10, -1):
        rest = np.where((rest >> k) & 1, rest ^ (GENERATOR << (k - 11)), rest)
    return rest


@cache
def coset_patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of up to RADIUS + THRESHOLD bits, sorted by syndrome and excess over RADIUS; starts and counts by [excess, syndrome].

    A word minus a pattern of its own syndrome is a code word, at the distance of the pattern's bits.
    """
    patterns = np.array([sum(1 << k for k in bits) for n in range(RADIUS + THRESHOLD + 1) for bits in combinations(range(BLOCK), n)], np.int64)
    excess = np.maximum(np.bitwise_count(patterns).astype(np.int64) - RADIUS, 0)
    group = _remainders(patterns) * (THRESHOLD + 1) + excess
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=2048 * (THRESHOLD + 1))
    starts = np.cumsum(counts) - counts
    return patterns[order], starts.reshape(2048, -1).T.copy(), counts.reshape(2048, -1).T.copy()


def anchors(fps: np.ndarray, homes_only: bool = False, n_blocks: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of fps (uint64), anchors and whether the anchor is the home: every anchor within radius plus threshold, over so many blocks of bits, lowest first."""
    patterns, starts, counts = coset_patterns()
    blocks = [((fps >> np.uint64(BLOCK * k)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64) for k in range(n_blocks)]
    syndromes = [_remainders(x) for x in blocks]
    # three code words are told by their upper bits, of which there are 12 each
    drop, width = (0, BLOCK) if n_blocks == 2 else (11, BLOCK - 11)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for excess in product(range(THRESHOLD + 1), repeat=n_blocks):
        if sum(excess) > THRESHOLD or homes_only and any(excess):
            continue
        sizes = [counts[e][s] for e, s in zip(excess, syndromes)]
        each = np.prod(sizes, axis=0)
        rows = np.repeat(np.arange(len(fps)), each)
        k = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
        anchor = np.zeros(len(rows), np.int64)
        for b in reversed(range(n_blocks)):
            n = sizes[b][rows]
            word = blocks[b][rows] ^ patterns[starts[excess[b]][syndromes[b]][rows] + k % n]
            anchor |= word >> drop << (width * b)
            k //= n
        out.append((rows, anchor, np.full(len(rows), not any(excess))))
    return tuple(np.concatenate(x) for x in zip(*out))


def home_anchors(fps: DataFrame, n_blocks: int = 2) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anchors(b["fp"].to_numpy().view(np.uint64), True, n_blocks)[1])], ["anchor"])

    return fps.select("fp").mapInArrow(run, "anchor long")


def replicas(fps: DataFrame, n_blocks: int = 2) -> DataFrame:
    """anchor, guest (0 at the home) and fp for each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4000):
                part = fp[at : at + 4000]
                rows, anchor, home = anchors(part, False, n_blocks)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array((~home).astype(np.int8)), pa.array(part[rows].view(np.int64))], ["anchor", "guest", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, guest byte, fp long")


def dealt(rows: DataFrame, homes: DataFrame, node: str) -> DataFrame:
    """rows (anchor, guest, ...) with a salt, dealt by both and sorted; homes: an anchor for each home."""
    hot = homes.groupBy("anchor").count().filter(F.col("count") > SPLIT_HOMES)
    hot = materialize(hot.select("anchor", F.ceil(F.col("count") / SPLIT_HOMES).cast("int").alias("salts")), "hot-anchors")
    if hot.isEmpty():
        rows = rows.withColumn("salt", F.lit(0))
    else:
        # Spark knows the size of this table and chooses the join by it
        rows = rows.join(hot, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64(node), F.col("salts")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        # a home is also a guest of the other salts of its anchor
        rows = rows.withColumn("guest", F.when(F.col("salt") == F.col("own"), F.col("guest")).otherwise(1).cast("byte")).drop("salts", "own")
    return rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "guest")


# --- comparing ----------------------------------------------------------------------------------------------


def joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one of its component under the links u - v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for x in (u, v, label[u], label[v]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning(u: np.ndarray, v: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the links u - v make up a spanning forest, those of few bits first."""
    order = np.argsort(bits.astype(np.uint8), kind="stable")
    a, b = u[order], v[order]
    label = np.arange(int(max(u.max(), v.max())) + 1 if len(u) else 0)
    keep, live = np.zeros(len(u), bool), np.arange(len(u))
    while True:
        x, y = label[a[live]], label[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return np.sort(order[keep])
        best = np.full(len(label), len(u))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        chosen = np.unique(best[best < len(u)])
        keep[chosen] = True
        label = joined(len(label), label[a[chosen]], label[b[chosen]])[label]


#: The differing bits of pairs of rows, each a list of columns, and whether they may link.
Compare = Callable[[list[np.ndarray], list[np.ndarray]], tuple[np.ndarray, np.ndarray]]


def _links(key: np.ndarray, guest: np.ndarray, columns: list[np.ndarray], compare: Compare, all_links: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows u and v, and differing bits, of links between homes and all rows of each run of equal keys (homes first in a run)."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    homes = np.add.reduceat(guest == 0, starts)
    use = (homes > 0) & (sizes > 1)
    starts, sizes, homes = starts[use], sizes[use], homes[use]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
    bound = np.cumsum(homes)  # all homes in a row, each against its run
    total = int(bound[-1]) if len(bound) else 0
    at = 0
    while at < total:
        # as many homes as keep the pairs under CHUNK
        ends = np.searchsorted(bound, np.arange(at, min(total, at + 20_000)), side="right")
        gid = ends[: max(1, int(np.searchsorted(np.cumsum(sizes[ends]), CHUNK)))]
        row = starts[gid] + (np.arange(at, at + len(gid)) - (bound[gid] - homes[gid]))
        n = sizes[gid]
        left = np.repeat(row, n)
        right = np.repeat(starts[gid], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        bits, near = compare([c[left] for c in columns], [c[right] for c in columns])
        if near.any():
            found = left[near], right[near], bits[near]
            kept = slice(None) if all_links else spanning(*found)
            out.append(tuple(x[kept] for x in found))
        at += len(gid)
    return tuple(np.concatenate(x) for x in zip(*out))


def compared(rows: DataFrame, columns: list[str], compare: Compare, all_links: bool = False, part: int = 0) -> DataFrame:
    """u, v: spanning links, or all, of rows (anchor, salt, guest and columns, the first of them the node) as dealt() leaves them.

    part: which column the forest spans, if not the nodes but parts of connected ones; then with bits, part_u and part_v.
    """
    names = ["u", "v", "bits", "part_u", "part_v"] if part else ["u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] = []
        carry_key: tuple[int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            anchor, salt, guest = (b[c].to_numpy() for c in ("anchor", "salt", "guest"))
            values = [b[c].to_numpy() for c in columns]
            if carry_key == (anchor[0], salt[0]):
                n = len(carry[0])
                anchor, salt = np.concatenate([np.full(n, anchor[0]), anchor]), np.concatenate([np.full(n, salt[0]), salt])
                guest, values = np.concatenate([np.zeros(n, guest.dtype), guest]), [np.concatenate(x) for x in zip(carry, values)]
            changes = np.concatenate([[0], np.cumsum((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1]))])
            u, v, bits = _links(changes, guest, values, compare, all_links)
            if len(u):
                parts, at = np.unique(np.concatenate([values[part][u], values[part][v]]), return_inverse=True)
                kept = slice(None) if all_links else spanning(at[: len(u)], at[len(u) :], bits)
                u, v, bits = u[kept], v[kept], bits[kept].astype(np.int16)
                out = [values[0][u], values[0][v], bits, values[part][u], values[part][v]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out[: len(names)]], names)
            carry_key = (anchor[-1], salt[-1])
            last = (changes == changes[-1]) & (guest == 0)
            carry = [x[last] for x in values]
        give_back()

    return rows.mapInArrow(run, ", ".join(f"{c} {'short' if c == 'bits' else 'long'}" for c in names))


def _two_bits(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    # of signed numbers it would count the bits of the absolute value
    bits = np.bitwise_count((x[0] ^ y[0]).view(np.uint64))
    return bits, (bits <= THRESHOLD) & (bits > 0)


def spanning_edges(fps: DataFrame) -> DataFrame:
    """u, v: edges whose components are those of all links between the distinct fingerprints fps (fp)."""
    n = fps.count()
    fps = fps.repartition(max(1, n // 10_000))  # the rows are small, what is made of them isn't
    n_blocks = 3 if n > THIRD_BLOCK else 2
    return compared(dealt(replicas(fps, n_blocks), home_anchors(fps, n_blocks), "fp"), ["fp"], _two_bits)


# --- components ---------------------------------------------------------------------------------------------


def _settled(edges: DataFrame) -> bool:
    """Does every node have one edge, to a node that has none?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for each node of edges (u, v) but the roots, by large-star and small-star steps."""
    edges = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = materialize(small, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable, for each row of docs (doc_id, text)."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    roots = components(spanning_edges(firsts))
    # a node of the components is its own root if it is the smallest
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    by_fp = materialize(join_counted(rooted, ids, "root", "members").select("fp", "component_id", "copies"), "components-by-fingerprint")
    return join_counted(rows, by_fp, "fp", "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- by similarity of shingle sets --------------------------------------------------------------------------


@dataclass(frozen=True)
class Cover:
    """Tables of anchors, exact bits in each, and the most differing bits of 128, for a similarity and a number of texts."""

    tables: int
    exact_bits: int
    limit: int

    @staticmethod
    def of(similarity: float, n: int) -> Cover:
        # the angle between the sets' vectors gives the share of differing bits
        p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
        meet = 0.0
        for w in range(RADIUS + 1):  # bits between x and its home; in a perfect code every pattern is a leader once
            for kept in range(w + 1):  # of these so many still differ between y and x's home
                rest = sum(math.comb(BLOCK - w, k) * p**k * (1 - p) ** (BLOCK - w - k) for k in range(RADIUS + 1 - kept + 1))
                meet += math.comb(BLOCK, w) / 2048 * math.comb(w, kept) * (1 - p) ** kept * p ** (w - kept) * rest
        exact = max(0, math.ceil(math.log2(max(1, n) / MEAN_HOMES)) - 12)
        tables = max(1, math.ceil(math.log(MISSED) / math.log1p(-min(0.999999, meet * (1 - p) ** exact))))
        return Cover(tables, exact, min(127, math.floor(128 * p + 4 * math.sqrt(128 * p * (1 - p)))))

    @property
    def passes(self) -> list[range]:
        """The tables, few in the first pass and the rest in the second."""
        first = -(-self.tables // 10)
        return [r for r in (range(first), range(first, self.tables)) if r]

    @property
    def lanes(self) -> int:
        return max(2, -(-self.tables * (BLOCK + self.exact_bits) // 64))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Hashes (uint64) of the distinct shingles of a text in UTF-8, in order."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def node_of(found: np.ndarray) -> int:
    """A set of shingles as a signed long."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def long_fingerprint(found: np.ndarray, lanes: int) -> np.ndarray:
    """The fingerprint of a set of shingles: so many words of 64 bits."""
    ones = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(found), 20_000):
        part = found[at : at + 20_000]
        for k in range(lanes):  # a further lane takes the bits of the hash mixed with its number
            x = part + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            if k:
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
            ones[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found), axis=1, bitorder="little").view(np.uint64).ravel()


def _texts(docs: DataFrame, number: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame, number: str, shingle: int, lanes: int) -> DataFrame:
    """row, doc_id, node, size (of the set) and print, the long fingerprint, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("simhash")
        for b in batches:
            nodes, sizes, prints = [], [], []
            for t in b["text"]:
                found = shingle_set(t.as_py() or b"", shingle)
                nodes.append(node_of(found))
                sizes.append(len(found))
                prints.append(long_fingerprint(found, lanes).tobytes())
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary())], ["row", "doc_id", "node", "size", "print"])
        give_back()

    return _texts(docs, number).mapInArrow(run, "row binary, doc_id long, node long, size int, print binary")


def shingle_sets(docs: DataFrame, number: str, shingle: int) -> DataFrame:
    """node and hashes, its shingles, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                sets = [shingle_set(t.as_py() or b"", shingle) for t in b["text"].slice(at, 200)]
                ends = np.cumsum([0] + [len(s) for s in sets])
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["node", "hashes"])
        give_back()

    return _texts(docs, number).mapInArrow(run, "node long, hashes array<long>")


def table_anchors(prints: np.ndarray, cover: Cover, tables: range, homes_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of tables rows of prints (n, lanes), anchors and whether the anchor is the home."""
    patterns, starts, counts = coset_patterns()
    width = BLOCK + cover.exact_bits
    for table in tables:
        lane, shift = divmod(table * width, 64)
        word = prints[:, lane] >> np.uint64(shift)
        if shift + width > 64:
            word = word | prints[:, lane + 1] << np.uint64(64 - shift)
        word = (word & np.uint64((1 << width) - 1)).astype(np.int64)
        block, rest = word & ((1 << BLOCK) - 1), (word >> BLOCK << BLOCK) | table << 52
        syndrome = _remainders(block)
        for excess in range(1 if homes_only else 2):
            n = counts[excess][syndrome]
            rows = np.repeat(np.arange(len(prints)), n)
            k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            yield rows, (block[rows] ^ patterns[starts[excess][syndrome][rows] + k]) | rest[rows], np.full(len(rows), excess == 0)


def table_replicas(nodes: DataFrame, cover: Cover, tables: range, homes_only: bool = False) -> DataFrame:
    """anchor, guest (0 at the home), node, part, size and the first 128 bits for each of nodes (node, part, size, print)."""
    names = ["anchor", "guest", "node", "part", "size", "p0", "p1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                prints = np.frombuffer(b"".join(b["print"].to_pylist()), np.uint64).reshape(b.num_rows, -1)
                node, part, size = (b[c].to_numpy() for c in ("node", "part", "size"))
                p0, p1 = (prints[:, k].view(np.int64) for k in (0, 1))
                for rows, anchor, home in table_anchors(prints, cover, tables, homes_only):
                    if homes_only:
                        yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array((~home).astype(np.int8)), *(pa.array(x[rows]) for x in (node, part, size, p0, p1))], names)

    return nodes.select("node", "part", "size", "print").mapInArrow(run, "anchor long" if homes_only else "anchor long, guest byte, node long, part long, size int, p0 long, p1 long")


def candidates(nodes: DataFrame, cover: Cover, similarity: float) -> DataFrame:
    """u < v: few pairs that connect what all pairs of nodes (node, size, print) do that meet at an anchor, are within the limit and of sizes that allow the similarity.

    Each anchor has a spanning forest of its own, so all tables together would have as many pairs for a node of a
    large group as it has anchors. So what the first tables connect are parts, the other tables give only pairs
    between parts, and of two parts only the closest pair stays.
    """

    def compare(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        bits = np.bitwise_count((x[3] ^ y[3]).view(np.uint64)) + np.bitwise_count((x[4] ^ y[4]).view(np.uint64))
        near = (bits <= cover.limit) & (x[1] != y[1])
        return bits, near & (np.minimum(x[2], y[2]) >= similarity * np.maximum(x[2], y[2]))

    n = max(1, nodes.count() // 10_000)
    found = None
    for tables in cover.passes:
        each = nodes.withColumn("part", F.col("node"))
        if found is not None:
            each = nodes.join(_with_roots(found, "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        each = each.repartition(n)
        pairs = compared(dealt(table_replicas(each, cover, tables), table_replicas(each, cover, tables, homes_only=True), "node"), ["node", "part", "size", "p0", "p1"], compare, part=1)
        closest = F.min(F.struct("bits", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).alias("pair")
        pairs = pairs.groupBy(F.least("part_u", "part_v"), F.greatest("part_u", "part_v")).agg(closest)
        pairs = materialize(pairs.select("pair.u", "pair.v"), "pairs")
        found = pairs if found is None else found.union(pairs)
    return found


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v) whose sets are similar enough."""
    each = pairs.join(sets.toDF("v", "hv"), "v").join(sets.toDF("u", "hu"), "u")
    each = each.select("u", "v", (F.size("hu") + F.size("hv")).alias("both"), F.size(F.array_intersect("hu", "hv")).alias("common"))
    return each.filter(F.col("common") >= F.lit(similarity) * (F.col("both") - F.col("common"))).select("u", "v")


def links_between(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: spanning links between the parts (root) of broken components (group), of nodes open_ (group, node, root, size, print).

    A component's nodes are dealt to blocks of about BLOCK_NODES, and a task compares two blocks: first the
    long fingerprints, then the sets of the pairs within four standard deviations, nearest first, as long as
    the two are not connected. No pair leaves a task but as a link.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    sizes = materialize(open_.groupBy("group").agg(F.count(F.lit(1)).alias("nodes")), "open-groups")
    each = join_counted(open_, sizes, "group", "nodes").withColumn("blocks", F.ceil(F.col("nodes") / BLOCK_NODES).cast("int"))
    each = each.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "size", "print", "hashes")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, root, size, own = (t[c].to_numpy() for c in ("node", "root", "size", "own"))
        prints = np.frombuffer(b"".join(t["print"].to_pylist()), np.uint64).reshape(len(node), -1)
        limit = 64 * prints.shape[1] * p + 4 * math.sqrt(64 * prints.shape[1] * p * (1 - p))
        flat, ends = t["hashes"].chunk(0).values.to_numpy(), t["hashes"].chunk(0).offsets.to_numpy()
        members = [np.flatnonzero(own == t[c][0].as_py()) for c in ("i", "j")]
        found = []
        for at in range(0, len(members[0]), 200):
            a, b = members[0][at : at + 200], members[1]
            bits = np.bitwise_count(prints[a][:, None, :] ^ prints[b][None, :, :]).sum(axis=2, dtype=np.int32)
            near = (bits <= limit) & (root[a][:, None] != root[b][None, :]) & (node[a][:, None] != node[b][None, :])
            near &= np.minimum(size[a][:, None], size[b][None, :]) >= similarity * np.maximum(size[a][:, None], size[b][None, :])
            x, y = np.nonzero(near)
            found.append(np.stack([bits[x, y], a[x], b[y]]))
        parts = {r: r for r in root.tolist()}

        def part(r: int) -> int:
            while parts[r] != r:
                parts[r] = r = parts[parts[r]]
            return r

        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        u, v = [], []
        for _, x, y in pairs[:, np.argsort(pairs[0], kind="stable")].T.tolist():
            a, b = part(root[x].item()), part(root[y].item())
            if a == b:
                continue
            common = len(np.intersect1d(flat[ends[x] : ends[x + 1]], flat[ends[y] : ends[y + 1]], assume_unique=True))
            if common >= similarity * (int(size[x]) + int(size[y]) - common):
                parts[max(a, b)] = min(a, b)
                u.append(node[x].item())
                v.append(node[y].item())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return each.groupBy("group", "i", "j").applyInArrow(run, "u long, v long").distinct()


def _with_roots(edges: DataFrame, name: str) -> DataFrame:
    """node and its root under edges (u, v), roots included."""
    roots = components(edges).withColumnRenamed("root", name)
    return roots.union(roots.select(F.col(name).alias("node"), name).distinct())


def _similar(docs: DataFrame, number: str, shingle: int, similarity: float) -> DataFrame:
    """row, doc_id, component_id and best (the row that stays) for each row of docs."""
    cover = Cover.of(similarity, docs.count())
    rows = materialize(signatures(docs, number, shingle, cover.lanes), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = rows.groupBy("node").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("print").alias("print"))
    firsts = materialize(firsts, "distinct-sets")
    pairs = materialize(candidates(firsts, cover, similarity), "candidates")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(firsts, "node").select(F.col("first.row").alias(number))
    sets = materialize(shingle_sets(docs.join(wanted, number, "left_semi"), number, shingle), "shingle-sets")
    links = materialize(checked(pairs, sets, similarity), "links")
    linked = materialize(_with_roots(links, "root"), "linked")

    # a pair that failed may leave two parts of what was one component; only their texts are compared further
    failed = pairs.join(links, ["u", "v"], "left_anti")
    for c in ("u", "v"):
        of = linked.toDF(c, f"root_{c}")
        failed = failed.join(of, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    parted = materialize(failed.filter("root_u != root_v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v")).distinct(), "parted")
    if not parted.isEmpty():
        groups = materialize(_with_roots(parted, "group").withColumnRenamed("node", "root"), "groups")
        placed = firsts.select("node", "size", "print").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = materialize(placed.join(groups, "root"), "open")
        more = materialize(links_between(open_, sets, similarity), "links")
        if not more.isEmpty():
            linked = materialize(_with_roots(links.union(more), "root"), "linked")

    rooted = firsts.join(linked, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("members"))
    by_node = materialize(join_counted(rooted, best, "root", "members").select("node", "copies", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best")), "components-by-set")
    return join_counted(rows.select("row", "doc_id", "node"), by_node, "node", "copies").select("row", "doc_id", "component_id", "best")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over texts that are similar enough, for each row of docs (doc_id, text)."""
    rows, number = numbered(docs.select("doc_id", "text"))
    return _similar(rows, number, shingle, similarity).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of similar documents, the one with the smallest doc_id, with all columns."""
    rows, number = numbered(docs)
    gone = materialize(_similar(rows, number, shingle, similarity).filter("row != best").select(F.col("row").alias(number)), "near-copies")
    return rows.join(gone, number, "left_anti").drop(number)
