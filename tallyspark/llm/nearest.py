"""Approximate nearest neighbours by multi-index hashing, nearest by cosine.

Codes: unit vectors, centred, are projected on the main axes of a sample and turned by rotations that are learned
there (each alternates between signs and the rotation that brings the projections nearest to them); the signs are a
code of BITS bits. Learning reads at most about SAMPLE_VALUES components; every row is indexed. A code is cut
into substrings of 16 bits, each with a table of its own from value to rows. Two codes within Hamming distance r =
m * a + b, m being the number of substrings, agree up to a bits in one of the first b + 1 substrings or up to a - 1
in one of the others; so probing those values in the tables retrieves every code within r. What is retrieved
is ranked by the vectors themselves, in doubles.

The radius is measured: CALIBRATION queries are compared with all rows, one pass, and r is the distance that
WITHIN of their true neighbours have at most. Queries that find fewer than k rows within r ask again at twice
the radius, until that is all bits, so no query returns fewer than there are.

How it runs: rows are dealt to groups of at most about GROUP_ROWS, by a number of their own, so copies of a vector
spread evenly, and every query goes to each group. A task reads a group's rows, builds its tables, then streams
queries over them; it holds one group and BATCH queries. In a group copies of a vector keep their k + 1 smallest
ids, since no other copy can be in a result. Each group answers with k rows a query, and these are merged by query. Work
per query and group is what the probed buckets hold; on vectors without near neighbours, which need a large radius,
that is most of the group, and the whole then grows as queries times rows.

Defined results: vectors that are null, empty or zero, or hold a null, NaN or infinite component take no part;
neither do those of another length than most have (of equally frequent lengths the larger). Each row with a
divisible vec_id is a query of its own, also if ids repeat, and its own row is no candidate for it. A row without
vec_id can be found and is last among equals. Equal scores go by vec_id, then by row. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.common import drawn_by, give_back, materialize, ship_package

#: Bits of a code and of a substring.
BITS, SUBSTRING = 128, 16
#: Components that codes are learned from, and rounds of learning.
SAMPLE_VALUES, ROUNDS = 1_000_000, 30
#: Queries compared with all rows, and the share of their neighbours that the radius takes in.
CALIBRATION, WITHIN = 200, 0.97
GROUP_ROWS, LEAST_ROWS, BATCH = 131_072, 4_096, 256
LAST = (1 << 63) - 1


# --- codes --------------------------------------------------------------------------------------------------


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by a power of two first, so that no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -exponent[:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The cosine of each row with query, added up in the same order wherever a row stands, so that equal rows tie."""
    (rows, query) = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1]) for x in (rows, query))
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


@dataclass(frozen=True)
class Codes:
    """What turns vectors into codes: the sample's mean and the rotated axes."""

    mean: np.ndarray
    axes: np.ndarray

    @staticmethod
    def learn(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> Codes:
        u = unit(sample)
        mean = u.mean(axis=0)
        centred = u - mean
        _, main = np.linalg.eigh(centred.T @ centred)
        main = main[:, ::-1][:, : min(sample.shape[1], 64)]
        width, rng, turned = main.shape[1], np.random.default_rng(1), []
        for _ in range(-(-bits // width)):
            rotation, _ = np.linalg.qr(rng.normal(size=(width, width)))
            projected = centred @ main
            for _ in range(rounds):
                a, _, b = np.linalg.svd(projected.T @ np.where(projected @ rotation > 0, 1.0, -1.0))
                rotation = a @ b
            turned.append(main @ rotation)
        return Codes(mean, np.concatenate(turned, axis=1)[:, :bits])

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of rows, as bytes."""
        return np.packbits((unit(x) - self.mean) @ self.axes > 0, axis=1, bitorder="little")


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Differing bits of each code and one, in bytes."""
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


def probe_radii(radius: int, substrings: int) -> list[int]:
    """The bits to flip in each substring's table, -1 for none, so that every code within the radius is retrieved."""
    a, b = divmod(radius, substrings)
    return [a if k <= b else a - 1 for k in range(substrings)]


_VALUES = np.arange(1 << SUBSTRING, dtype=np.uint16)
#: All values of a substring, fewest bits first, and how many have up to 0, 1, ... bits.
FLIPS = _VALUES[np.argsort(np.bitwise_count(_VALUES), kind="stable")]
UP_TO = np.cumsum(np.bincount(np.bitwise_count(_VALUES), minlength=SUBSTRING + 1))


class Index:
    """The tables of one group."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int):
        kept = self._few_copies(numbers, ids, vectors, k + 1)
        self.numbers, self.ids, self.vectors, self.codes = numbers[kept], ids[kept], vectors[kept], np.ascontiguousarray(codes[kept])
        self.units = unit(self.vectors)
        self.tables = []
        for values in self.codes.view(np.uint16).T:
            starts = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << SUBSTRING))])
            self.tables.append((np.argsort(values, kind="stable"), starts))

    @staticmethod
    def _few_copies(numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
        # + 0.0 makes one zero of both
        rows = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, same = np.unique(rows, return_inverse=True)
        order = np.lexsort((numbers, ids, same))
        first = np.searchsorted(same[order], same[order])  # where the run of copies starts
        return order[np.arange(len(order)) - first < most]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes are within the radius."""
        hit = np.zeros(len(self.ids), bool)
        for (order, starts), value, flips in zip(self.tables, code.view(np.uint16), probe_radii(radius, len(self.tables))):
            if flips < 0:
                continue
            probed = FLIPS[: UP_TO[min(flips, SUBSTRING)]] ^ value
            begin, length = starts[probed], starts[probed.astype(np.int64) + 1] - starts[probed]
            begin, length = begin[length > 0], length[length > 0]
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
            hit[order[at]] = True
        found = np.flatnonzero(hit)
        return found[distances(self.codes[found], code) <= radius]

    def search(self, number: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k nearest of those retrieved, but the query's own."""
        found = self.within(code, radius)
        found = found[self.numbers[found] != number]
        if len(found) > k:
            near = self.units[found] @ unit(vector[None, :])[0]
            found = found[near >= np.partition(near, -k)[-k] - 1e-9]
        score = cosines(self.vectors[found], vector)
        best = np.lexsort((self.numbers[found], self.ids[found], -score))[:k]
        return found[best], score[best]


# --- on Spark -----------------------------------------------------------------------------------------------


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """number, vec_id and v of the rows that take part, as written, and how long their vectors are (0 if there are none)."""
    v, doubles = F.col("embedding"), F.col("embedding").cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(v.isNotNull() & ~bad & F.exists(doubles, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    most = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = most["n"] if most else 0
    return materialize(kept.filter(F.size("v") == length).withColumn("number", F.monotonically_increasing_id()), "vectors"), length


def drawn(wanted: int, of: int, seed: str) -> Column:
    """Is the row, by its number, in a sample of about so many?"""
    return drawn_by(F.xxhash64(F.lit(seed), "number"), wanted, of)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _pairs(queries: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], index: Index) -> pa.RecordBatch:
    rows = np.concatenate([f[0] for f in found])
    query = np.repeat(queries, [len(f[0]) for f in found])
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(index.numbers[rows]), pa.array(index.ids[rows]), pa.array(np.concatenate([f[1] for f in found]))], ["query", "number", "vec_id", "score"])


_PAIR_SCHEMA = "query long, number long, vec_id long, score double"


def merged(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with rank."""
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "number")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def measured_radius(index: DataFrame, codes: Codes, queries: list, k: int) -> int:
    """The distance of codes that WITHIN of the true k neighbours of queries (number, v) have at most. One pass over index; queries travel with it."""
    numbers, vectors = np.array([q["number"] for q in queries]), np.array([list(q["v"]) for q in queries], np.float64)
    units, of_queries = unit(vectors), codes.of(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(numbers), k), -np.inf)
        bits = np.zeros((len(numbers), k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _matrix(b["v"]), b["number"].to_numpy()
            score = units @ unit(x).T
            score[numbers[:, None] == own[None, :]] = -np.inf
            both = np.concatenate([best, score], axis=1)
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            made = codes.of(x)
            known = np.take_along_axis(np.concatenate([bits, np.stack([distances(made, c) for c in of_queries])], axis=1), top, axis=1)
            best, bits = np.take_along_axis(both, top, axis=1), known
        q, at = np.nonzero(best > -np.inf)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(bits[q, at]), pa.array(np.zeros(len(q), np.int64)), pa.array(best[q, at])], ["query", "number", "vec_id", "score"])
        give_back()

    bits = [r["number"] for r in merged(index.select("number", "v").mapInArrow(run, _PAIR_SCHEMA), k).select("number").collect()]  # k rows for each
    return int(np.quantile(bits, WITHIN, method="higher")) if bits else codes.axes.shape[1]


def found_within(index: DataFrame, queries: DataFrame, groups: int, codes: Codes, radius: int, k: int) -> DataFrame:
    """query, number, vec_id and score: for each of queries the best k of each group of index."""
    ship_package(index.sparkSession)
    columns = ["number", "vec_id", "v"]
    rows = index.select(F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("asks"), *columns)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("asks"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        group, index_ = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH * 16):
                b = whole.slice(at, BATCH * 16)
                of_group, asks = b["group"].to_numpy(), b["asks"].to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], (of_group[1:] != of_group[:-1]) | (asks[1:] != asks[:-1])]))
                for a, e in zip(cuts, np.append(cuts[1:], b.num_rows)):
                    part = b.slice(a, e - a)
                    number, ids, x = part["number"].to_numpy(), part["vec_id"].fill_null(LAST).to_numpy(), _matrix(part["v"])
                    if of_group[a] != group:
                        group, held, index_ = of_group[a], [], None
                    if not asks[a]:
                        held.append((number, ids, x))
                        continue
                    if index_ is None:
                        if not held:
                            continue
                        numbers, all_ids, vectors = (np.concatenate(y) for y in zip(*held))
                        held, index_ = [], Index(numbers, all_ids, vectors, codes.of(vectors), k)
                    for q in range(0, len(number), BATCH):
                        code = codes.of(x[q : q + BATCH])
                        found = [index_.search(n, v, c, radius, k) for n, v, c in zip(number[q : q + BATCH], x[q : q + BATCH], code)]
                        yield _pairs(number[q : q + BATCH], found, index_)
        give_back()

    return rows.unionByName(asked).repartition("group").sortWithinPartitions("group", "asks").mapInArrow(run, _PAIR_SCHEMA)


def nearest(rows: DataFrame, every: int = 50, k: int = 5, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found of each row of rows (vec_id, embedding) whose vec_id is divisible by every."""
    spark = rows.sparkSession
    index, length = usable(rows)
    total = index.count() if length else 0
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.filter(F.col("vec_id") % every == 0)
    sample = index.filter(drawn(max(2, SAMPLE_VALUES // length), total, "codes")).select("v").collect()  # bounded, see SAMPLE_VALUES
    codes = Codes.learn(np.array([list(r["v"]) for r in sample], np.float64) if sample else np.eye(length), bits)
    radius = measured_radius(index, codes, queries.filter(drawn(CALIBRATION, queries.count(), "radius")).select("number", "v").collect(), k)
    groups = max(-(-total // GROUP_ROWS), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_ROWS)))
    asking, done = queries, None
    while True:
        found = materialize(merged(found_within(index, asking, groups, codes, radius, k), k), "neighbours")
        done = found if done is None else done.unionByName(found)
        if radius >= bits:
            break
        radius = min(bits, 2 * radius + 1)
        full = found.groupBy("query").count().filter(F.col("count") >= min(k, total - 1)).select(F.col("query").alias("number"))
        short = materialize(asking.join(full, "number", "left_anti"), "short-of-neighbours")
        if short.isEmpty():
            break
        done = done.join(short.select(F.col("number").alias("query")), "query", "left_anti")
        asking = short
    named = queries.select(F.col("number").alias("query"), F.col("vec_id").alias("query_id"))
    ids = F.when(F.col("vec_id") < LAST, F.col("vec_id"))
    return done.join(named, "query").select("query_id", F.col("rank").cast("int").alias("rank"), ids.alias("vec_id"), "score")
