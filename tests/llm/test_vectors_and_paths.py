"""Clusters, the prefix trie and nearest neighbours against plain versions, on the driver's smallest tables and on odd rows."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import centroids, common, nearest, prefix_trie, queries

VECTORS = "vec_id long, embedding array<double>, label int, number long, v int, cluster string, asks int"
TURNS = "conv_id long, turn long, role string, text string, depth int, node string, row long"


# --- clusters -----------------------------------------------------------------------------------------------


def plain_clusters(rows: list[tuple[int | None, list[float] | None]], clusters: int = 16, rounds: int = 3, components: int = 64):
    kept = [(i, [math.floor(64 * x) if math.isfinite(64 * x) else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [list(v) for _, v in order[:clusters]]

    def assigned() -> list[tuple[int, int]]:
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        to = [j for _, j in assigned()]
        for j in set(to):
            mine = [v for (_, v), t in zip(kept, to) if t == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out, big = assigned(), centroids.MOST
    per = {}
    for d, j in out:
        per[j] = per.get(j, 0) + min(d, big)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, min(d, big), min(per[j], big), min(sum(per.values()), big), digest[j]) for (i, _), (d, j) in zip(kept, out)), key=repr)


def got_clusters(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_op11_against_plain_rounds(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got_clusters(queries.QUERIES["op11_centroid_clusters"](spark, sf_dir)) == plain_clusters(rows)


def groups_of_vectors(seed: int, n: int, width: float) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 64))
    return (centres[rng.integers(0, 7, n)] + width * rng.normal(size=(n, 64))).tolist()


@pytest.mark.parametrize("width", [0.01, 0.3])
def test_balls_that_go_whole(spark, monkeypatch, width):
    """Tight groups go by whole balls, loose ones by leaves; copies, ties and several blocks a task; the same result."""
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 150)
    vectors = groups_of_vectors(3, 500, width) + [[0.5] * 64] * 300 + [[-0.5] * 64] * 3
    rows = [(k // 2, v, 0, 0, 0, "x", 0) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(3, "vec_id")
    assert got_clusters(centroids.cluster(frame)) == plain_clusters([r[:2] for r in rows])
    x = np.array([centroids.floors(v, 64) for v in vectors[:400]], np.int64)
    x = x[centroids.arranged(x)]
    whole, left, owner = centroids.filtered(x, *centroids.tree(x), [x[k].tolist() for k in (5, 100, 350)])
    assert whole if width < 0.1 else left
    assert sum(n for _, n, _ in whole) + sum(len(r) for r, _ in left) == 400 and (owner >= 0).sum() == sum(n for _, n, _ in whole)


def test_vectors_that_are_odd(spark):
    ok = [(k, [((k * 7 + c) % 13) / 5 - 1 for c in range(64)]) for k in range(30)]
    odd = [(40, None), (41, []), (42, [1.0] * 63), (43, [1.0] * 63 + [None]), (44, [float("nan")] + [0.0] * 63), (45, [float("inf")] + [0.0] * 63), (46, [0.0] * 64), (None, [0.25] * 64), (None, [0.25] * 64), (5, [9.0] * 64)]
    for more in ([], [(50, [1e300] + [-1e12] * 63), (51, [1e15] * 64)]):
        rows = [(*r, 0, 0, 0, "x", 0) for r in ok + odd + more]
        assert got_clusters(centroids.cluster(spark.createDataFrame(rows, VECTORS))) == plain_clusters(ok + odd + more)
    few = spark.createDataFrame([(*r, 0, 0, 0, "x", 0) for r in ok[:3]], VECTORS)
    assert got_clusters(centroids.cluster(few)) == plain_clusters(ok[:3])
    assert centroids.cluster(few.limit(0)).collect() == []


# --- the trie -----------------------------------------------------------------------------------------------


def plain_trie(rows: list[tuple[int | None, int | None, str | None, str | None]]) -> list[tuple]:
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = sorted(own.get(c - int(math.fmod(c, 20)), []))
        paths[c] = [(t[2], t[4]) for t in base[:h] + sorted(own[c])[h:]]
    nodes: dict[tuple, list[int]] = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        saved = sum((len(nodes[q]) - 1) * len(common_words(q[-1][1])) for q in under if q)
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def common_words(text: str) -> list[str]:
    import re

    return re.findall(common.WORD, text)


def got_trie(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def test_op12_against_all_prefixes(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(queries.QUERIES["op12_prefix_trie"](spark, sf_dir)) == plain_trie(rows)


ODD_TURNS = (
    [(20, k, "user", f"shared words {k}") for k in range(3)]
    + [(c, k, "user" if k % 2 else None, f"turn {k} of {c % 4}") for c in range(20, 60) for k in range(2, 2 + c % 5)]
    + [(3, None, None, None), (3, None, None, None), (3, 1, "a", ""), (3, 1, "a", ""), (3, 1, "", "a"), (3, 0, "b", "x y"), (None, 0, "user", "lost"), (-7, 0, "user", "below zero"), (-7, 1, "user", "shared words 0"), (100, 0, "ab", "c"), (101, 0, "a", "bc"), (7, 5, "user", "long " * 50_000)]
)


@pytest.mark.parametrize("parts", ["1", "5"])
def test_trie_of_odd_turns(spark, monkeypatch, parts):
    """Ties, repeats, nulls, conversations without turns, and a conversation cut over ranges, with two ids to a piece."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    hot = [(200, k, "user", f"{k} of many") for k in range(60)]
    rows = [*ODD_TURNS, *hot, *[(300 + k, 0, "user", "the same first turn") for k in range(30)]]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([(*r, 9, "n", 1) for r in rows], TURNS).repartition(4)
        ranges = prefix_trie.rebuilt(frame).filter("conv_id = 200").select("part").distinct().count()
        assert ranges > 1 if parts != "1" else ranges == 1
        assert got_trie(prefix_trie.prefix_trie(frame)) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert prefix_trie.prefix_trie(frame.limit(0)).collect() == []


# --- neighbours ---------------------------------------------------------------------------------------------


def plain_neighbours(rows: list[tuple[int | None, list[float]]], every: int = 50, k: int = 5) -> dict[int, list[tuple[int | None, float]]]:
    x = np.array([v for _, v in rows])
    u = nearest.unit(x)
    found = {}
    for at, (i, _) in enumerate(rows):
        if i is not None and i % every == 0:
            score = u @ u[at]
            others = sorted((j for j in range(len(rows)) if j != at), key=lambda j: (-round(score[j], 12), nearest.LAST if rows[j][0] is None else rows[j][0]))
            found[at] = [(rows[j][0], score[j]) for j in others[:k]]
    return found


def test_op13_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {rows[at][0]: found for at, found in plain_neighbours(rows).items()}
    got: dict[int, list] = {}
    for r in queries.QUERIES["op13_nearest_neighbours"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    vectors = dict(rows)
    assert got.keys() == want.keys() and all([r["rank"] for r in g] == [1, 2, 3, 4, 5] for g in got.values())
    assert np.mean([len({r["vec_id"] for r in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
    for q, g in got.items():
        assert all(r["vec_id"] != q and abs(r["score"] - np.dot(vectors[q], vectors[r["vec_id"]]) / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[r["vec_id"]])) < 1e-9 for r in g)
        assert [(-r["score"], r["vec_id"]) for r in g] == sorted((-r["score"], r["vec_id"]) for r in g)


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 24))
    codes = nearest.Codes.learn(x, bits=64, rounds=5)
    made = codes.of(x)
    index = nearest.Index(np.arange(800), np.arange(800), x, made, 5)
    for radius in (0, 3, 4, 7, 13, 20, 64):
        for q in (0, 17, 400):
            want = [j for j in range(800) if int(np.unpackbits(made[j] ^ made[q]).sum()) <= radius]
            assert sorted(index.ids[index.within(made[q], radius)].tolist()) == want


def test_neighbours_of_clusters_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAST_ROWS", 40)
    rng = np.random.default_rng(2)
    near = [(k, v) for k, v in enumerate(groups_of_vectors(9, 300, 0.05))]
    copies = [(1000 + k, [1.0, -2.0] * 32) for k in range(60)]  # a group of copies; two queries among them
    odd = [(2000, None), (2050, []), (2100, [0.0] * 64), (2150, [1.0] * 63 + [None]), (2200, [float("nan")] * 64), (2250, [float("inf")] + [0.0] * 63), (2300, [1.0] * 5), (None, [1.0] * 64), (50, rng.normal(size=64).tolist()), (2350, [1e-200] * 64), (2400, [1e200] * 64)]
    rows = near + copies + odd
    frame = spark.createDataFrame([(*r, 0, 7, 7, "x", 1) for r in rows], VECTORS).repartition(5)
    usable = [r for r in near + copies + odd if r[1] and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    want = sorted(([usable[at][0], [round(s, 9) for _, s in f], [i for i, _ in f]] for at, f in plain_neighbours(usable).items()), key=repr)
    got: dict[tuple, list] = {}
    rows_ = nearest.nearest(frame).orderBy("query_id", "rank").collect()
    assert len(rows_) == 5 * len(want)
    hits = total = 0
    for q in {r["query_id"] for r in rows_} - {50}:  # 50 stands twice
        got = [r for r in rows_ if r["query_id"] == q]
        (w,) = [x for x in want if x[0] == q]
        hits += len({r["vec_id"] for r in got} & set(w[2]))
        total += 5
        if q in (1000, 1050):
            assert [r["vec_id"] for r in got] == [i for i in range(1000, 1006) if i != q][:5] and all(r["score"] == got[0]["score"] for r in got)
    assert hits / total >= 0.9 and sum(r["query_id"] == 50 for r in rows_) == 10
    few = frame.filter("vec_id < 3")
    assert [(r["query_id"], r["vec_id"]) for r in nearest.nearest(few).orderBy("rank").collect()] in ([(0, 1), (0, 2)], [(0, 2), (0, 1)])
    assert nearest.nearest(frame.filter("vec_id = 0")).collect() == [] and nearest.nearest(frame.limit(0)).collect() == []


def test_a_small_radius_grows_until_all_are_found(spark, monkeypatch):
    """Queries that find too few ask again; at all bits the result is that of comparing with every row."""
    monkeypatch.setattr(nearest, "measured_radius", lambda *_: 0)
    rows = [(k, v) for k, v in enumerate(np.random.default_rng(4).normal(size=(60, 64)).tolist())]
    got = nearest.nearest(spark.createDataFrame([(*r, 0, 7, 7, "x", 1) for r in rows], VECTORS), every=20)
    assert got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 5").count() == 3


def test_samples_of_large_tables(spark):
    """A share under a millionth still draws: the number of rows is only told here, not made."""
    rows = spark.range(200_000).withColumn("hashed", F.xxhash64("id"))
    of = 10**13
    assert 0 < rows.filter(common.drawn_by(F.col("hashed"), of // 1_000, of)).count() < 1_000
    assert rows.filter(common.drawn_by(F.col("hashed"), 20_000, 100)).count() == 200_000
    drawn = spark.range(1).select(common.drawn_by(F.lit(0).cast("long"), 1, 10**10).alias("least"), common.drawn_by(F.lit((1 << 63) // 10**10 * 2), 1, 10**10).alias("more")).first()
    assert (drawn["least"], drawn["more"]) == (True, False)
