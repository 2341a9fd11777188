"""Exact deduplication against a minimal perfect hash of historical digests.

The distinct digests of the history are dealt by their leading bytes to shards of bounded size. Each shard
gets a minimal perfect hash function by hash and displace: keys fall into small buckets, and buckets, largest
first, take the first seed that sends all their keys to free slots of a table with exactly as many slots as
keys. A slot holds the full 32-byte digest and the locator of the row that stays, with its count. A lookup
computes one slot and compares all digest bytes, so that a digest that is not in the history can't be taken
for a member. Members update their slot, nonmembers are grouped by digest among themselves.

Copies are counted before any shuffle (partial aggregation by digest), so a group that holds a third of all
rows costs one row a task. A shard's size follows from the number of distinct digests and never from copies.

Defined results: a null text counts as empty; all rows of equal texts form one group; the largest doc_id of
the group stays (null ids are smaller than any other); rows that repeat both text and doc_id are the same
document and get equal answers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import join_counted, materialize, numbered, ship_package

#: Distinct digests that a shard holds on average; its memory is about 100 bytes for each.
SHARD_KEYS = 40_000
#: Keys in a bucket of the displacement table, on average.
BUCKET_KEYS = 4

GROUP_SCHEMA = "digest binary, keep_id long, group_size long"
INDEX_SCHEMA = "shard int, seeds binary, digests binary, winners binary, counts binary"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 as 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _mix(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    x = x ^ (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _lanes(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit parts of each digest, from its end: the beginning has chosen the shard."""
    parts = digests.view(np.uint64).reshape(-1, 4)
    return parts[:, 2].copy(), parts[:, 3].copy()


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by bucket, and each key's slot, for distinct digests of shape (n, 32): slots are 0 to n - 1."""
    n = len(digests)
    buckets = max(1, -(-n // BUCKET_KEYS))
    first, second = _lanes(digests)
    home = (first % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    sizes = np.bincount(home, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    seeds, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        keys = order[starts[b] : starts[b + 1]]
        block, seed = 64, 1
        while True:  # blocks of seeds at once; the last buckets need about n tries
            tries = np.arange(seed, seed + block, dtype=np.uint64)
            at = (_mix(second[keys][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            ok = ~taken[at].any(axis=1)
            if len(keys) > 1:
                by = np.sort(at, axis=1)
                ok &= (by[:, 1:] != by[:, :-1]).all(axis=1)
            if ok.any():
                hit = int(ok.argmax())
                seeds[b], slots[keys] = seed + hit, at[hit]
                taken[at[hit]] = True
                break
            seed, block = seed + block, min(block * 4, 1 << 16)
    return seeds, slots


def find_slots(seeds: np.ndarray, n: int, digests: np.ndarray) -> np.ndarray:
    """The one slot where each digest would be."""
    first, second = _lanes(digests)
    seed = seeds[(first % np.uint64(len(seeds))).astype(np.int64)]
    return (_mix(second, seed) % np.uint64(n)).astype(np.int64)


def _array(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32).copy()


def _longs(values: pd.Series) -> np.ndarray:
    """Locators as longs; a missing one is the smallest long."""
    return values.fillna(np.iinfo(np.int64).min).astype(np.int64).to_numpy()


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _array(pdf["digest"])
    seeds, slots = build_mph(digests)
    winners, counts = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
    winners[slots], counts[slots] = _longs(pdf["keep_id"]), pdf["group_size"].to_numpy(np.int64)
    placed = np.empty_like(digests)
    placed[slots] = digests
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "seeds": [seeds.tobytes()], "digests": [placed.tobytes()], "winners": [winners.tobytes()], "counts": [counts.tobytes()]})


def _look_up(index: pd.DataFrame, incoming: pd.DataFrame) -> pd.DataFrame:
    """All groups of a shard: its slots after the members of incoming are added, and the nonmembers."""
    if len(index):
        row = index.iloc[0]
        slots = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, counts = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
        seeds = np.frombuffer(row["seeds"], np.uint32)
    else:
        slots, winners, counts, seeds = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    new, new_ids, new_counts = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(incoming):
        keys, ids, sizes = _array(incoming["digest"]), _longs(incoming["keep_id"]), incoming["group_size"].to_numpy(np.int64)
        member = np.zeros(len(keys), bool)
        if len(slots):
            at = find_slots(seeds, len(slots), keys)
            member = (slots[at] == keys).all(axis=1)  # byte by byte
            np.maximum.at(winners, at[member], ids[member])
            np.add.at(counts, at[member], sizes[member])
        new, new_ids, new_counts = keys[~member], ids[~member], sizes[~member]
    ids = pd.Series(np.concatenate([winners, new_ids])).astype("Int64")
    ids = ids.mask(ids == np.iinfo(np.int64).min)
    return pd.DataFrame({"digest": [x.tobytes() for x in (*slots, *new)], "keep_id": ids, "group_size": np.concatenate([counts, new_counts])})


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row for each digest of (digest, locator): the winner so far and the number of copies."""
    return rows.groupBy("digest").agg(F.max("locator").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % shards).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard: displacement seeds, and by slot the digest, the winner and the count.

    history: rows of distinct_digests().
    """
    return _sharded(history, shards).groupBy("shard").applyInPandas(_index_shard, INDEX_SCHEMA)


def look_up(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """All groups (digest, keep_id, group_size) of index and incoming, rows of distinct_digests()."""
    return index.groupBy("shard").cogroup(_sharded(incoming, shards).groupBy("shard")).applyInPandas(lambda a, b: _look_up(a, b), GROUP_SCHEMA)


def groups_of(rows: DataFrame) -> DataFrame:
    """digest, keep_id (the largest locator) and group_size for each digest of rows (digest, locator).

    The history is the half of the rows whose locator has an even crc32; the other half is looked up.
    """
    ship_package(rows.sparkSession)
    historical = F.coalesce(F.crc32(F.col("locator").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    shards = max(1, -(-rows.count() // SHARD_KEYS))
    index = materialize(build_index(distinct_digests(rows.filter(historical)), shards), "exact-index")
    return materialize(look_up(index, distinct_digests(rows.filter(~historical)), shards), "exact-groups")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text)."""
    rows = materialize(docs.select(F.col("doc_id").alias("locator"), text_digest(F.col("text")).alias("digest")), "exact-digests")
    found = join_counted(rows, groups_of(rows), "digest", "group_size")
    return found.select(F.col("locator").alias("doc_id"), "keep_id", "group_size", F.col("locator").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """Of the rows of docs with equal texts the one with the largest doc_id (null first), with all columns: exactly one, also where doc_ids are null or repeat.
    """
    rows, number = numbered(docs)
    digests = materialize(rows.select(number, "doc_id", text_digest(F.col("text")).alias("digest")), "exact-digests")
    winners = groups_of(digests.select("digest", F.col("doc_id").alias("locator")))
    # of rows that share text and doc_id the one with the smallest number stays
    ties = digests.groupBy("digest", "doc_id").agg(F.min(number).alias("stays"), F.count(F.lit(1)).alias("rows"))
    ties = join_counted(ties, winners, "digest", "group_size").filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("stays")
    gone = materialize(digests.select(number).join(ties, F.col(number) == F.col("stays"), "left_anti"), "exact-copies")
    return rows.join(gone, number, "left_anti").drop(number)
