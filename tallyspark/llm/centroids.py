"""Centroid clustering by ball-tree filtering, in exact whole numbers.

A component x becomes floor(scale * x). Each task packs its vectors into blocks of BLOCK_ROWS and builds a metric
tree over each block: halves along the widest component, down to balls of LEAF_ROWS. A ball stores its centre's
radius, its count and the whole-number sum of its vectors. Blocks are written once, to the shared folder; vectors
are never shuffled. A round reads the blocks with the few centroids: a ball whose farthest point is nearer to one
centroid than its nearest point can be to any other goes to it whole, by count and sum; else its halves are asked,
with the centroids that are still possible; what is left at the leaves is compared exactly. Each task returns a
count and a sum for each centroid, and these are summed by centroid; one row a centroid meets on the driver. Equal
vectors make a ball of radius zero, so a vector that a third of all rows share costs one comparison a block.

Whole numbers: a block whose components are all under 2 ** EXACT_BITS is compared by products of doubles, which
are exact there; any other block by numbers of unbounded length, which is slower and gives the same. Sums travel
in limbs of LIMB_BITS bits, so none overflows. Bounds of balls are rounded outwards and ties decide nothing: a
ball goes whole only if it is strictly nearer.

Defined results: vectors that are null, of another number of components, or with a null, NaN or infinite component
are left out; a null vec_id is written as nothing where starts are drawn; rows of equal vec_id are ordered by
vector there, and equal rows are interchangeable; with fewer kept vectors than clusters each is a start; without
any the result is empty. A distance or an inertia beyond a long is the largest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import give_back, materialize, ship_package

#: Vectors of a block, and of a ball that is not halved further.
BLOCK_ROWS, LEAF_ROWS = 4_096, 32
#: Vectors of so many components at most, each under two to this power, have exact squared distances in doubles.
EXACT_BITS, EXACT_COMPONENTS = 22, 128
LIMB_BITS = 40
MOST = (1 << 63) - 1

_BLOCK_SCHEMA = "ids array<long>, vectors binary, wide array<string>, radii binary, counts binary, sums binary"


def kept_vectors(rows: DataFrame, components: int) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == components) & ~bad)


def floors(row: list[float], scale: int) -> list[int]:
    """floor(scale * x) of finite doubles, exact where the product is no double."""
    return [int(y // 1) if isfinite(y := scale * x) else int(x) * scale for x in row]


# --- trees --------------------------------------------------------------------------------------------------


def levels_of(n: int) -> int:
    """Levels of the tree over n vectors: one more for each halving until a ball has LEAF_ROWS at most."""
    levels = 1
    while n > LEAF_ROWS << (levels - 1):
        levels += 1
    return levels


def bounds(n: int, level: int) -> np.ndarray:
    """Where the balls of a level start, and n: 2 ** level runs of nearly equal length, each the union of two of the next level."""
    edges = np.array([0, n])
    for _ in range(level):
        edges = np.sort(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))
    return edges


def arranged(x: np.ndarray) -> np.ndarray:
    """The order of rows in which every ball of every level is one run."""
    order = np.arange(len(x))
    for level in range(levels_of(len(x)) - 1):
        edges = bounds(len(x), level)
        for a, b in zip(edges[:-1], edges[1:]):
            part = x[order[a:b]]
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order[a:b] = order[a:b][np.argpartition(part[:, widest], (b - a) // 2)]
    return order


def tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """radii, counts and sums of the balls over arranged rows x (int64), level after level; radii rounded outwards."""
    radii, counts, sums = [], [], []
    for level in range(levels_of(len(x))):
        edges = bounds(len(x), level)
        count = np.diff(edges)
        total = np.add.reduceat(x, edges[:-1], axis=0)
        from_centre = np.sqrt((((x - np.repeat(total / count[:, None], count, axis=0)) ** 2).sum(axis=1)))
        radii.append(np.maximum.reduceat(from_centre, edges[:-1]) * (1 + 1e-9) + 1e-6)
        counts.append(count)
        sums.append(total)
    return np.concatenate(radii), np.concatenate(counts), np.concatenate(sums)


def _packed(ids: list, rows: list[list[int]]) -> dict:
    exact = len(rows[0]) <= EXACT_COMPONENTS and all(-(1 << EXACT_BITS) < c < 1 << EXACT_BITS for r in rows for c in (min(r), max(r)))
    if not exact:  # no tree: whole numbers of any length, as text
        return {"ids": ids, "vectors": b"", "wide": [",".join(map(str, r)) for r in rows], "radii": b"", "counts": b"", "sums": b""}
    x = np.array(rows, np.int64)
    order = arranged(x)
    x = x[order]
    radii, counts, sums = tree(x)
    return {"ids": [ids[k] for k in order], "vectors": x.astype(np.int32).tobytes(), "wide": [], "radii": radii.tobytes(), "counts": counts.tobytes(), "sums": sums.tobytes()}


def ball_trees(kept: DataFrame, scale: int) -> DataFrame:
    """One row for each block of kept vectors: its ids and vectors as arranged, and its balls."""
    ship_package(kept.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list[list[int]] = []
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("wide", pa.list_(pa.string())), ("radii", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())])
        for b in batches:
            if not b.num_rows:
                continue
            values = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) * scale
            plain = np.abs(values).max(axis=1, initial=0) < 2.0**52
            whole = np.floor(np.where(plain[:, None], values, 0)).astype(np.int64)
            rows += [whole[k].tolist() if plain[k] else floors(b["v"][k].as_py(), scale) for k in range(b.num_rows)]
            ids += b["vec_id"].to_pylist()
            while len(ids) >= BLOCK_ROWS:
                yield pa.RecordBatch.from_pylist([_packed(ids[:BLOCK_ROWS], rows[:BLOCK_ROWS])], schema)
                ids, rows = ids[BLOCK_ROWS:], rows[BLOCK_ROWS:]
        if ids:
            yield pa.RecordBatch.from_pylist([_packed(ids, rows)], schema)
        give_back()

    return kept.mapInArrow(run, _BLOCK_SCHEMA)


# --- assignment ---------------------------------------------------------------------------------------------


def exactly_nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of whole numbers, smallest first of equals, and the squared distance."""
    if x.dtype != object and all(-(1 << EXACT_BITS) < v < 1 << EXACT_BITS for c in centroids for v in c):
        c = np.array(centroids, np.float64)
        y = x.astype(np.float64)
        d = (y * y).sum(axis=1)[:, None] - 2 * (y @ c.T) + (c * c).sum(axis=1)[None, :]
        best = np.argmin(d, axis=1)
        return best, d[np.arange(len(d)), best].astype(np.int64)
    best, least = [], []
    for row in x.tolist():
        d = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids]
        least.append(min(d))
        best.append(d.index(least[-1]))
    return np.array(best, np.int64), np.array([min(d, MOST) for d in least], np.int64)


def filtered(x: np.ndarray, radii: np.ndarray, counts: np.ndarray, sums: np.ndarray, centroids: list[list[int]]) -> tuple[list[tuple[int, int, np.ndarray]], list[tuple[int, np.ndarray]], np.ndarray]:
    """Centroid, count and sum of each ball that goes whole; the rows of each other leaf and their possible centroids; and each row's centroid, -1 at those leaves."""
    c = np.array(centroids, np.float64)
    levels = levels_of(len(x))
    whole: list[tuple[int, int, np.ndarray]] = []
    left: list[tuple[np.ndarray, np.ndarray]] = []
    owner = np.full(len(x), -1, np.int64)
    balls, possible = np.array([0]), np.ones((1, len(c)), bool)
    for level in range(levels):
        edges = bounds(len(x), level)
        at = (1 << level) - 1 + balls
        centre = sums[at] / counts[at][:, None]
        far = np.sqrt(np.maximum(((centre[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), 0))
        far[~possible] = np.inf
        nearest = far.min(axis=1)
        # by the triangle inequality no point of the ball can be nearer to the others
        possible = far * (1 - 1e-9) - radii[at][:, None] <= (nearest * (1 + 1e-9) + radii[at])[:, None]
        done = possible.sum(axis=1) == 1
        for k in np.flatnonzero(done):
            j = int(np.argmax(possible[k]))
            whole.append((j, int(counts[at[k]]), sums[at[k]]))
            owner[edges[balls[k]] : edges[balls[k] + 1]] = j
        balls, possible = balls[~done], possible[~done]
        if level == levels - 1:
            left = [(np.arange(edges[k], edges[k + 1]), np.flatnonzero(p)) for k, p in zip(balls, possible)]
        else:
            balls, possible = np.stack([2 * balls, 2 * balls + 1], axis=1).ravel(), np.repeat(possible, 2, axis=0)
    return whole, left, owner


def _limbs(value: int) -> list[int]:
    """A whole number in limbs of LIMB_BITS, lowest first, each of its sign."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest or not out:
        out.append(sign * (rest & ((1 << LIMB_BITS) - 1)))
        rest >>= LIMB_BITS
    return out


class Block:
    """A block as a task reads it."""

    def __init__(self, row: dict, components: int):
        self.ids = row["ids"]
        self.tree = not row["wide"]
        if self.tree:
            self.x = np.frombuffer(row["vectors"], np.int32).reshape(-1, components).astype(np.int64)
            self.radii, self.counts = np.frombuffer(row["radii"], np.float64), np.frombuffer(row["counts"], np.int64)
            self.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, components)
        else:
            self.x = np.array([[int(v) for v in r.split(",")] for r in row["wide"]], object)

    def _small(self, centroids: list[list[int]]) -> bool:
        return self.tree and all(-(1 << EXACT_BITS) < v < 1 << EXACT_BITS for c in centroids for v in c)

    def sums_by_centroid(self, centroids: list[list[int]]) -> tuple[list[int], list[list[int]]]:
        counts, sums = [0] * len(centroids), [[0] * len(centroids[0]) for _ in centroids]

        def add(j: int, count: int, total) -> None:
            counts[j] += count
            sums[j] = [a + int(b) for a, b in zip(sums[j], total)]

        if not self._small(centroids):
            best, _ = exactly_nearest(self.x, centroids)
            for j in np.unique(best):
                add(int(j), int((best == j).sum()), self.x[best == j].sum(axis=0))
            return counts, sums
        whole, left, _ = filtered(self.x, self.radii, self.counts, self.sums, centroids)
        for j, count, total in whole:
            add(j, count, total)
        if left:
            # leaves with the same possible centroids are compared together
            for rows, js in _by_choice(left):
                best = js[exactly_nearest(self.x[rows], [centroids[j] for j in js])[0]]
                for j in np.unique(best):
                    add(int(j), int((best == j).sum()), self.x[rows[best == j]].sum(axis=0))
        return counts, sums

    def assigned(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        if not self._small(centroids):
            return exactly_nearest(self.x, centroids)
        _, left, owner = filtered(self.x, self.radii, self.counts, self.sums, centroids)
        for rows, js in _by_choice(left):
            owner[rows] = js[exactly_nearest(self.x[rows], [centroids[j] for j in js])[0]]
        return owner, ((self.x - np.array(centroids, np.int64)[owner]) ** 2).sum(axis=1)


def _by_choice(left: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    alike: dict[bytes, list] = {}
    for rows, js in left:
        alike.setdefault(js.tobytes(), [js, []])[1].append(rows)
    for js, rows in alike.values():
        yield np.concatenate(rows), js


def partial_sums(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """cluster, limb, n and sums: what each task's balls and rows add to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centroids), [[0] * len(centroids[0]) for _ in centroids]
        for b in batches:
            for row in b.to_pylist():
                c, s = Block(row, len(centroids[0])).sums_by_centroid(centroids)
                counts = [x + y for x, y in zip(counts, c)]
                sums = [[x + y for x, y in zip(a, e)] for a, e in zip(sums, s)]
        out = []
        for j, n in enumerate(counts):
            limbs = [_limbs(v) for v in sums[j]] if n else []
            for k in range(max(map(len, limbs), default=0)):
                out.append({"cluster": j, "limb": k, "n": n if k == 0 else 0, "sums": [v[k] if k < len(v) else 0 for v in limbs]})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("cluster", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
        give_back()

    return blocks.mapInArrow(run, "cluster int, limb int, n long, sums array<long>")


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; the driver gets one row for each and limb."""
    parts = partial_sums(blocks, centroids)
    per = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(len(centroids[0]))]).alias("sums")).collect()
    counts, totals = [0] * len(centroids), [[0] * len(centroids[0]) for _ in centroids]
    for r in per:
        counts[r["cluster"]] += r["n"]
        totals[r["cluster"]] = [a + (b << (LIMB_BITS * r["limb"])) for a, b in zip(totals[r["cluster"]], r["sums"])]
    return [[v // n for v in t] if n else c for c, n, t in zip(centroids, counts, totals)]


def assignments(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, len(centroids[0]))
                cluster, distance = block.assigned(centroids)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])
        give_back()

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, clusters: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each kept row of rows (vec_id, embedding)."""
    spark = rows.sparkSession
    kept = kept_vectors(rows, components)
    blocks = materialize(ball_trees(kept, scale), "ball-trees")
    drawn = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = kept.select(drawn.alias("drawn"), "v").orderBy("drawn", "v").limit(clusters).collect()  # a row for each cluster
    centroids = [floors(list(r["v"]), scale) for r in starts]
    for _ in range(rounds if centroids else 0):
        centroids = moved(blocks, centroids)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = materialize(assignments(blocks, centroids), "assigned")
    per = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row for each cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame([(j, min(t, MOST), min(sum(per.values()), MOST), digests[j]) for j, t in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
