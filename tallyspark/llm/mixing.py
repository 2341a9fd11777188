"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key. Keys are uniform, so equal ranges of the key space hold about equally many
rows of a source; each source is cut into as many ranges as its row count asks for, which splits a hot source
over many tasks. Sorted ranges give prefix sums of sizes within a range, and the sums of the ranges before it
come from a small table of range totals, summed in two levels. One row a source is all that meets in one task. A row is taken once for each whole epoch that the source's budget
holds, and then as far as the words before it in the source leave room in the rest of the budget. So the words
taken meet a source's target to the word; at most one document of a source is cut. mixed_documents() emits
whole documents: there the cut goes to the nearer end of that one document.

Targets: source weights share the sum of all sizes; a target above max_epochs times its source's size stops
there and the excess is shared by weight among the others, until none is above. That is one water level: with
sources in the order of cap / weight, those before the level get their cap, the rest weight times the level.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows of equal
doc_id and size are interchangeable (mixed_documents() decides each by itself), and many rows of one id, or
without one, are spread over the key space by their numbers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize, numbered, unused_name, words_of

#: Rows of a key range, on average.
RANGE_ROWS = 2_000
#: Key ranges in a block of prefix sums: a source of 10 ** 10 rows has 1,221 blocks.
BLOCK_RANGES = 4_096


def hash_key(doc_id: Column, seed: str) -> Column:
    """32 random-looking bits of the id, as a long; the order of ties goes by doc_id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(rows: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """source, n_rows, source_size, target of rows (source, size). One row for each source is all that meets in one task."""
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    level_order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*level_order).rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy()
    zero = F.lit(0.0)
    rest_size = F.sum("source_size").over(total).cast("double") - F.coalesce(F.sum("cap").over(before), zero)
    rest_weight = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), zero)
    per = per.withColumn("level", rest_size / rest_weight)
    # the first source, in that order, whose cap its share of the rest does not pass sets the level
    under = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(*[(F.col("cap") / F.col("weight")).alias("ratio"), F.col("level").alias("level")]))
    per = per.withColumn("final", F.min(under).over(total)["level"])
    return per.select("source", "n_rows", "source_size", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def spread(sized: DataFrame, seed: str) -> DataFrame:
    """sized (doc_id, row_, ...) with key, the hash of the id; rows without id, or of one that more rows have than belong in a range, are spread by their own numbers."""
    rows = sized.count()
    bound = max(RANGE_ROWS, rows // 10_000)  # so that fewer than 10,000 ids are broadcast
    hot = sized.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter(F.col("count") > bound).select("doc_id", F.lit(True).alias("hot_"))
    hot = materialize(hot, "mix-hot-ids")
    own = hash_key(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("row_").cast("string")), seed)
    if not hot.isEmpty():
        sized = sized.join(F.broadcast(hot), "doc_id", "left")
        return sized.withColumn("key", F.when(F.col("doc_id").isNull() | F.col("hot_"), own).otherwise(hash_key(F.col("doc_id"), seed))).drop("hot_")
    return sized.withColumn("key", F.when(F.col("doc_id").isNull(), own).otherwise(hash_key(F.col("doc_id"), seed)))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs (doc_id, text, source), and the columns of carry.

    taken: words that the mix takes, repeats counted; copies: whole copies for a mix of whole documents.
    """
    sized = docs.select("doc_id", *carry, F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    # the row's number, as written, tells rows of equal ids apart
    sized = materialize(sized.withColumn("row_", F.monotonically_increasing_id()), "mix-sizes")
    sources = materialize(source_targets(sized, weights, max_epochs), "mix-sources")
    same = sized["source"].eqNullSafe(sources["source"])
    rows = spread(sized, seed).join(sources, same).select("doc_id", *carry, sized["source"].alias("source"), "size", "row_", "n_rows", "source_size", "target", "key")
    ranges = F.ceil(F.col("n_rows") / RANGE_ROWS)
    rows = rows.withColumn("range", F.floor(F.col("key") * ranges / F.lit(float(1 << 32))))
    totals = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    # ranges in blocks, so that a source's prefix sums are made in many tasks: within a block, and of blocks
    totals = materialize(totals.withColumn("block", F.floor(F.col("range") / BLOCK_RANGES)), "mix-ranges")
    blocks = totals.groupBy("source", "block").agg(F.sum("range_size").alias("block_size"))
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), F.coalesce(F.sum("block_size").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("block_offset"))
    within = F.coalesce(F.sum("range_size").over(W.partitionBy("source", "block").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("within", within).join(blocks, totals["source"].eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), (F.col("within") + F.col("block_offset")).alias("offset"))
    inner = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", *carry, "row_").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(offsets, rows["source"].eqNullSafe(F.col("o_source")) & (rows["range"] == F.col("o_range")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.floor(F.col("target") + 0.5) - epochs * F.col("source_size")
    before = F.col("offset") + F.col("inner")
    last = F.greatest(F.lit(0), F.least(F.col("size"), budget - before))
    copies = F.when(F.col("size") > 0, epochs + (before + F.col("size") / 2.0 <= budget).cast("int")).otherwise(0)
    return rows.select("doc_id", *carry, "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all columns. Texts without words are left out."""
    rows, number = numbered(docs)
    times, each = unused_name(rows, "copies_"), unused_name(rows, "copy_")
    copies = mix(rows, carry=[number], **how).filter("copies > 0").select(number, F.col("copies").alias(times))
    chosen = rows.join(copies, number)
    return chosen.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
