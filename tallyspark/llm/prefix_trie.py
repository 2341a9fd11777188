"""The prefix trie of rebuilt conversations, by smallest-member ownership.

A conversation c is rebuilt as the first h turns of the conversation it branched from, c - c % group, and then its
own turns after its first h; h is crc32 of c in decimal, modulo heads + 1. Each distinct sequence of first d turns
is a node; its members are the conversations that start with it, and its smallest member owns it. On its path each
conversation owns a suffix, since a node's members are also members of the node above: what it doesn't own it
shares with a smaller one. So the tokens that storing the trie instead of the conversations saves under a node are,
over its members, those of the occurrences from that depth on minus those of the owned nodes; a node is childless
once, at its owner's last turn, if all its members end there.

How it runs: turns become a digest and a word count at once, and no text is shuffled. Rows are sorted into ranges
by (conv_id, turn), so a conversation with a third of all turns is cut over many tasks. Windows run within a
conversation and range, and a row for each conversation that goes on over a border, fewer than there are ranges,
carries the rest: positions, words before a turn, and the digest of a prefix, which is the exclusive or of 128 bits
for each of its turns and places and so can be added up in parts. Owners are minima by a group-by with map-side
combine, as a window over a node would bring a first turn that a third of all conversations share into one task;
an owner's first owned depth then goes to its occurrences, dealt over salts where a conversation is hot. One
group-by over prefixes makes all sums. The ids behind ends_sha256 are sorted in ranges, joined in pieces of at most
PIECE_IDS by tasks, and a node's pieces, in order, are fed to one hash: it needs every id in order, so the task
that hashes a hot node streams its pieces and holds one at a time.

Defined results: turns of a conversation go by turn (null first), then role, then MD5 of the text; null role or
text is empty; equal rows each count as a turn; rows without conv_id belong to no conversation and are left out; a
rebuilt conversation may have no turns and then is a member of the root alone; an empty table has no root, so no
rows. Other columns are ignored. Two different prefixes are taken for one if their 128 bits agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.common import give_back, join_counted, materialize, ship_package, words_of

#: Ids joined to one piece of text before it is hashed.
PIECE_IDS = 4_096
NOTHING = hashlib.sha256(b"").hexdigest()


def head_length(conv_id: Column, heads: int) -> Column:
    """How many turns a conversation takes from the one it branched from."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (heads + 1)).cast("long")


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n_words and row, a number of its own, of rows (conv_id, turn, role, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.md5(text.cast("binary")).alias("digest"), F.size(words_of(F.col("text").cast("string"))).cast("long").alias("n_words"))
    return turns.withColumn("row", F.monotonically_increasing_id())


def in_ranges(rows: DataFrame, label: str, *order: Column) -> DataFrame:
    """rows written in ranges of (conv_id, order), with part, the number of the range."""
    key = [F.col("conv_id"), *order]
    return materialize(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), label)


def with_borders(ranged: DataFrame, totals: dict[str, Column], combine) -> DataFrame:
    """ranged (conv_id, part) with before_<name> for each of totals: its value over the same conversation's earlier ranges, null if there are none.

    Only conversations that lie in several ranges are in the table that is broadcast: one row at most for each range but two at its borders.
    """
    per = ranged.groupBy("conv_id", "part").agg(*[v.alias(n) for n, v in totals.items()])
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    cut = per.withColumn("parts_", F.count(F.lit(1)).over(W.partitionBy("conv_id"))).filter("parts_ > 1")
    cut = cut.select("conv_id", "part", *[combine[n](F.col(n)).over(earlier).alias(f"before_{n}") for n in totals])
    return ranged.join(F.broadcast(materialize(cut, "borders")), ["conv_id", "part"], "left")


def rebuilt(rows: DataFrame, group: int = 20, heads: int = 3) -> DataFrame:
    """conv_id, depth (from 1; 0 for the conversation itself), role, digest, n_words and last_depth of every rebuilt conversation, as written."""
    turns = in_ranges(materialize(turns_of(rows), "turns"), "turns-in-order", F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row"))
    turns = with_borders(turns, {"n": F.count(F.lit(1))}, {"n": F.sum})
    order = [F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    placed = turns.withColumn("position", F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order)) + F.coalesce("before_n", F.lit(0)))
    placed = materialize(placed.select("conv_id", "position", "role", "digest", "n_words"), "turns-placed")
    convs = placed.groupBy("conv_id").agg(F.max("position").alias("own"))
    convs = convs.withColumn("h", head_length(F.col("conv_id"), heads)).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = materialize(convs.withColumn("last_depth", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "conversations")
    # a group has few conversations and a head few turns, whatever the size of either conversation
    head = placed.filter(F.col("position") <= heads).filter(F.col("conv_id") % group == 0)
    branched = convs.filter("taken > 0").select(F.col("conv_id").alias("to"), F.col("base").alias("conv_id"), "taken", "last_depth")
    taken = head.join(branched, "conv_id").filter("position <= taken").select(F.col("to").alias("conv_id"), F.col("position").cast("long").alias("depth"), "role", "digest", "n_words", "last_depth")
    own = join_counted(placed, convs.select("conv_id", "h", "taken", "last_depth", "own"), "conv_id", "own").filter("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), "role", "digest", "n_words", "last_depth")
    none = F.lit("")
    starts = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), none.alias("role"), none.alias("digest"), F.lit(0).cast("long").alias("n_words"), "last_depth")
    return in_ranges(taken.unionByName(own).unionByName(starts), "rebuilt", F.col("depth"))


def occurrences(path: DataFrame) -> DataFrame:
    """conv_id, depth, last_depth, node and above (its parent), n_words and words_before of each turn of the rebuilt conversations path."""
    # one lane's seed before the content, so that the two lanes are independent; the start of a path has no bits
    for lane in (1, 2):
        path = path.withColumn(f"own{lane}", F.when(F.col("depth") > 0, F.xxhash64(F.lit(lane), "role", "digest", "depth")).otherwise(0))
    path = with_borders(path, {"words": F.sum("n_words"), "lane1": F.bit_xor("own1"), "lane2": F.bit_xor("own2")}, {"words": F.sum, "lane1": F.bit_xor, "lane2": F.bit_xor})
    upto = W.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    words = F.sum("n_words").over(upto) + F.coalesce("before_words", zero) - F.col("n_words")
    path = path.select(
        "conv_id", "depth", "last_depth", "n_words", "own1", "own2", words.alias("words_before"),
        *[F.bit_xor(f"own{k}").over(upto).bitwiseXOR(F.coalesce(f"before_lane{k}", zero)).alias(f"lane{k}") for k in (1, 2)])
    node = F.struct(F.col("depth").alias("d"), F.col("lane1").alias("a"), F.col("lane2").alias("b"))
    above = F.struct((F.col("depth") - 1).alias("d"), F.col("lane1").bitwiseXOR(F.col("own1")).alias("a"), F.col("lane2").bitwiseXOR(F.col("own2")).alias("b"))
    return path.select("conv_id", "depth", "last_depth", "n_words", "words_before", node.alias("node"), above.alias("above"))


def _owned_suffixes(seen: DataFrame) -> DataFrame:
    """conv_id, turns, owned_from (past the end if it owns nothing), shared_words (before that) and leaf (1 if its last node is childless and its own)."""
    ends = F.sum((F.col("depth") == F.col("last_depth")).cast("int"))
    owners = seen.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("words_before").alias("words_before"), (ends == F.count(F.lit(1))).alias("childless"))
    # words before a turn never fall along a path, so the least are those of the first owned node
    suffix = owners.groupBy("conv_id").agg(F.min("node.d").alias("first"), F.min("words_before").alias("shared"), F.max(F.col("childless").cast("long")).alias("leaf"))
    convs = seen.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("n_words").alias("words"), F.max("last_depth").alias("last"))
    joined = convs.join(suffix, "conv_id", "left")
    return joined.select(
        "conv_id", "turns", F.coalesce("first", F.col("last") + 1).alias("owned_from"), F.coalesce("shared", "words").alias("shared_words"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))


def ends_digests(seen: DataFrame) -> DataFrame:
    """node and ends_sha256 of the nodes where conversations end."""
    ship_package(seen.sparkSession)
    ends = seen.filter("depth = last_depth").select(F.col("node.d").alias("d"), F.col("node.a").alias("a"), F.col("node.b").alias("b"), "conv_id")
    key = ["d", "a", "b", "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(key, (*held, ids[0])), ids=",".join(map(str, ids)))], pa.schema([*[(k, pa.int64()) for k in key], ("ids", pa.string())]))

        for b in batches:
            for d, x, y, c in zip(*(b[k].to_pylist() for k in key)):
                if ids and (held != (d, x, y) or len(ids) == PIECE_IDS):
                    yield piece()
                    ids = []
                held = (d, x, y)
                ids.append(c)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(k, pa.int64()) for k in key[:3]], ("ends_sha256", pa.string())])
        held, running, out = None, None, []
        for b in batches:
            for d, x, y, text in zip(*(b[k].to_pylist() for k in (*key[:3], "ids"))):
                if held == (d, x, y):
                    running.update(b"," + text.encode())
                    continue
                if running:
                    out.append(dict(zip(key, held), ends_sha256=running.hexdigest()))
                held, running = (d, x, y), hashlib.sha256(text.encode())
            if len(out) > 5_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if running:
            out.append(dict(zip(key, held), ends_sha256=running.hexdigest()))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
        give_back()

    joined = ends.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(pieces, "d long, a long, b long, conv_id long, ids string")
    done = joined.repartition(*key[:3]).sortWithinPartitions(*key).mapInArrow(hashed, "d long, a long, b long, ends_sha256 string")
    return done.select(F.struct("d", "a", "b").alias("node"), "ends_sha256")


def prefix_trie(rows: DataFrame, group: int = 20, heads: int = 3) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node over rows (conv_id, turn, role, text)."""
    seen = materialize(occurrences(rebuilt(rows, group, heads)), "occurrences")
    suffixes = materialize(_owned_suffixes(seen), "owned-suffixes")
    each = join_counted(seen, suffixes, "conv_id", "turns")
    below = F.greatest(F.lit(0), F.col("shared_words") - F.col("words_before"))  # words from here on, less those of owned nodes
    owns_next = (F.col("depth") < F.col("last_depth")) & (F.col("depth") + 1 >= F.col("owned_from"))
    nodes = each.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("above.a").alias("a"), F.min("above.b").alias("b"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(owns_next.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(below).alias("saved_tokens"))
    nodes = materialize(nodes.withColumn("above", F.struct((F.col("node.d") - 1).alias("d"), "a", "b")).drop("a", "b"), "nodes")
    parents = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"), "n_children").filter("n_children > 0")
    rooted = nodes.filter("node.d = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = join_counted(nodes.filter("node.d > 0"), parents.withColumnRenamed("n_children", "children_"), "above", "children_").drop("children_").unionByName(rooted)
    found = found.join(ends_digests(seen), "node", "left")
    return found.select("conv_id", F.col("node.d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
