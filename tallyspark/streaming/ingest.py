"""Incremental ingestion: which files and fragments changed, their rows in versioned tables, and a stream of new files.

A row belongs to the file it was read from, and in a store to a fragment of it, a conversation. What is read anew
replaces its own rows and no others, so a session that several files tell is what all of them say, whichever of
them grows, in whatever order and however often batches come; a row without id is told apart by its file.

A file source of Structured Streaming notices new paths only, so files that grow are found by comparing manifests
of two levels: paths, sizes and times; and for the stores that changed, fragments with their fingerprints, which
are taken before anything is parsed.

A table is a folder of versions, each with some of the table's buckets of paths, and a pointer that says which
version holds a bucket now. A change rewrites the buckets it touches; their number doubles as the table grows, so a
bucket stays small. A pointer is written last: a job that dies before leaves the old state in force, and a repeated
batch gives the same table. The pointer's number fences writers: one that started from an older number is refused.
What neither the newest pointer nor the one before it names is removed. A table has an identity, made with its
first version; a manifest holds for that identity only, so a table that was emptied or replaced is read anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Buckets of a new table, and rows of a bucket on average from which their number doubles.
BUCKETS, BUCKET_ROWS = 8, 250_000
#: Files that a sync reads at once: their paths are all that the driver holds.
MAX_FILES = 10_000
#: Attempts to read files that change meanwhile.
ATTEMPTS = 2


class StaleWriter(RuntimeError):
    """The table has a newer version than the one that a writer started from."""


# --- files of the shared store ------------------------------------------------------------------------------


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _at(spark, folder)
    return [str(s.getPath()) for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def _exists(df: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return df()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def staged(df: DataFrame, table: str) -> DataFrame:
    """df as written beside the table, so that all that follows sees the same rows."""
    folder = f"{table}-staging/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# --- versions -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class State:
    """The number of the newest version, the table's identity, how many buckets it has, and by bucket the version that holds it and its rows."""

    number: int = 0
    identity: str = ""
    buckets: int = BUCKETS
    held: dict[int, tuple[str, int]] = field(default_factory=dict)


def newest(spark: SparkSession, table: str) -> State:
    """One row for each bucket comes to the driver."""
    log = _exists(lambda: spark.read.schema("version string, bucket int, rows long, buckets int, identity string, number long").parquet(f"{table}/pointer"))
    number = None if log is None else log.agg(F.max("number")).first()[0]
    if number is None:
        return State()
    rows = log.filter(F.col("number") == number).collect()
    return State(number, rows[0]["identity"], rows[0]["buckets"], {r["bucket"]: (r["version"], r["rows"]) for r in rows if r["version"]})


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def current(spark: SparkSession, table: str, state: State | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The table, or some buckets of it; None if there is nothing."""
    held = (state or newest(spark, table)).held
    paths = [f"{v}/bucket={b}" for b, (v, _) in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def _clean(spark: SparkSession, table: str, state: State, before: State) -> None:
    for pointer in children(spark, f"{table}/pointer"):
        number = pointer.rpartition("number=")[2]
        if number.isdigit() and int(number) < before.number:
            remove(spark, pointer)
    named = {v.rstrip("/").rpartition("/")[2] for s in (state, before) for v, _ in s.held.values()}
    for version in children(spark, f"{table}/versions"):
        if version.rpartition("/")[2] not in named:
            remove(spark, version)


def replace(spark: SparkSession, table: str, new: DataFrame, gone: DataFrame, state: State | None = None) -> State:
    """A version in which rows whose keys are in gone (path, and fragment or not) make room for new, as written (path, ...).

    state is the one that the writer started from; if the table has moved on, StaleWriter is raised and nothing changes.
    """
    keys = gone.columns
    state = state or newest(spark, table)
    paths = new.select("path").union(gone.select("path")).distinct()
    touched = [r["bucket"] for r in paths.select(bucket_of(F.col("path"), state.buckets).alias("bucket")).distinct().collect()]  # buckets at most
    if not touched:
        return state
    rows = sum(n for _, n in state.held.values()) + new.count()
    buckets = state.buckets
    while rows > buckets * BUCKET_ROWS:
        buckets *= 2
    old = current(spark, table, state, touched if buckets == state.buckets else None)
    if old is not None:
        new = old.join(gone.distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    folder = f"{table}/versions/{uuid.uuid4().hex}"
    new = new.withColumn("bucket", bucket_of(F.col("path"), buckets))
    new.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    written = _exists(lambda: spark.read.schema(new.schema).parquet(folder))
    counts = {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}
    kept = {b: x for b, x in state.held.items() if b not in touched} if buckets == state.buckets else {}
    after = State(state.number + 1, state.identity or uuid.uuid4().hex, buckets, {**kept, **{b: (folder, n) for b, n in counts.items()}})
    listed = [(v, b, n, buckets, after.identity) for b, (v, n) in after.held.items()] or [(None, 0, 0, buckets, after.identity)]
    if newest(spark, table).number != state.number:
        raise StaleWriter(f"{table} is at another version than {state.number}")
    try:
        spark.createDataFrame(listed, "version string, bucket int, rows long, buckets int, identity string").coalesce(1).write.mode("error").parquet(f"{table}/pointer/number={after.number}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise StaleWriter(f"{table} has version {after.number} already") from e
    _clean(spark, table, after, state)
    return after


# --- manifests ----------------------------------------------------------------------------------------------


def manifest(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, size and modified of the files below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def changed_files(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """path and change (new, changed, gone) between two manifests."""
    if before is None:
        return now.select("path", F.lit("new").alias("change"))
    both = now.alias("a").join(before.alias("b"), "path", "full")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.modified").eqNullSafe(F.col("b.modified"))
    change = F.when(F.col("b.size").isNull(), "new").when(F.col("a.size").isNull(), "gone").when(~same, "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def changed_fragments(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """path, fragment and change (new, changed, gone) between two tables of fingerprints (path, fragment, fingerprint) of the same files."""
    if before is None:
        return now.select("path", "fragment", F.lit("new").alias("change"))
    both = now.alias("a").join(before.alias("b"), ["path", "fragment"], "full")
    change = F.when(F.col("b.fingerprint").isNull(), "new").when(F.col("a.fingerprint").isNull(), "gone").when(F.col("a.fingerprint") != F.col("b.fingerprint"), "changed")
    return both.select("path", "fragment", change.alias("change")).filter("change IS NOT NULL")


# --- ingesting ----------------------------------------------------------------------------------------------

#: Messages (path, session_id, position, ...) of files; of a store those of some fragments (path, fragment) only, if these are given.
Reader = Callable[..., DataFrame]
#: path, fragment and fingerprint of each conversation in stores, without parsing it.
Fingerprints = Callable[[SparkSession, list[str]], DataFrame]


def stable_read(spark: SparkSession, path: str, glob: str, paths: list[str], read: Callable[[list[str]], DataFrame], table: str) -> tuple[DataFrame | None, list[str]]:
    """What read makes of files, as written, and which files were the same before and after: those that changed meanwhile are read again, or left for the next sync."""

    def at() -> dict:
        return {r["path"]: r for r in manifest(spark, path, glob).filter(F.col("path").isin(paths)).collect()}

    before = at()
    for attempt in range(ATTEMPTS):
        rows = staged(read(paths), table)
        after = at()
        steady = [p for p in paths if before.get(p) == after.get(p) is not None]
        if len(steady) == len(paths):
            return rows, steady
        before, paths = after, [p for p in paths if p in after] if attempt + 1 < ATTEMPTS else steady
    return (rows.filter(F.col("path").isin(paths)), paths) if paths else (None, [])


def _sync_some(spark: SparkSession, path: str, glob: str, read: Reader, table: str, fingerprints: Fingerprints | None) -> tuple[int, int]:
    """As sync(), of MAX_FILES files at most; also how many were due.

    The manifests that are published hold what was read, as it was then; a file that changes during the sync stays
    due, as does one whose rows were written by a job that died before its manifest.
    """
    state = newest(spark, table)
    known, parts = (f"{table}-{n}/{state.identity or 'none'}" for n in ("manifest", "fragments"))
    found = staged(manifest(spark, path, glob), table)
    before = current(spark, known)
    todo = staged(changed_files(found, before), table)
    due = [r["path"] for r in todo.filter("change <> 'gone'").orderBy("path").limit(MAX_FILES).collect()]
    gone = todo.filter("change = 'gone'").select("path")
    done: list[str] = []
    if due:
        seen = None
        if fingerprints is None:
            rows, done = stable_read(spark, path, glob, due, lambda paths: read(spark, paths), table)
        else:
            seen = staged(fingerprints(spark, due), table)
            held = current(spark, parts)
            changes = staged(changed_fragments(seen, None if held is None else held.filter(F.col("path").isin(due))), table)
            wanted = changes.filter("change <> 'gone'").select("path", "fragment")
            rows, done = stable_read(spark, path, glob, due, lambda paths: read(spark, paths, wanted), table)
        if done:
            files = spark.createDataFrame([(p,) for p in done], "path string")
            replaced = files if fingerprints is None or held is None else changes.select("path", "fragment").join(files, "path", "left_semi")
            after = replace(spark, table, rows, replaced, state)
            known, parts = (f"{table}-{n}/{after.identity}" for n in ("manifest", "fragments"))
            if seen is not None:
                replace(spark, parts, seen.join(files, "path", "left_semi"), files)
            replace(spark, known, found.join(files, "path", "left_semi"), files.union(gone))
    elif not gone.isEmpty():
        replace(spark, known, found.limit(0), gone)
    remove(spark, f"{table}-staging")
    return len(done), len(due)


def sync(spark: SparkSession, path: str, glob: str, read: Reader, table: str, force: bool = False, fingerprints: Fingerprints | None = None) -> int:
    """Read what is new or changed below a folder into the table of messages; returns how many files that were.

    With fingerprints, read takes the changed fragments as a third argument and reads these only. force forgets what
    was read before, so all files are due.
    """
    for name in ("manifest", "fragments") if force else ():
        remove(spark, f"{table}-{name}")
    n, (done, due) = 0, _sync_some(spark, path, glob, read, table, fingerprints)
    while done and due == MAX_FILES:
        n += done
        done, due = _sync_some(spark, path, glob, read, table, fingerprints)
    return n + done


def sync_file(spark: SparkSession, path: str, read: Reader, table: str) -> int:
    """One file into the table, as the hook at a session's end asks for; returns how many messages it has."""
    rows = staged(read(spark, [path]), table)
    replace(spark, table, rows, rows.select("path").distinct())
    return rows.count()


def rebuild(spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame]) -> State:
    """The whole table anew as change makes it, in its next version: for columns that can't be filled in by a default."""
    state = newest(spark, table)
    rows = current(spark, table, state)
    return state if rows is None else replace(spark, table, staged(change(rows), table), rows.select("path").distinct(), state)


def reset(spark: SparkSession, table: str) -> None:
    """Throw the table and what is known of its files away: the next sync reads all, into a table of another identity."""
    for name in ("", "-manifest", "-fragments", "-staging"):
        remove(spark, table + name)


def messages(spark: SparkSession, table: str) -> DataFrame | None:
    """The table's messages by session: an id that several files of a session have counts once, as the last of them tells it; rows without id are all kept.

    position runs through a session: its files by path, each in its own order.
    """
    rows = current(spark, table)
    if rows is None:
        return None
    again = W.partitionBy("session_id", "id").orderBy(F.desc("path"), F.desc("position"))
    rows = rows.withColumn("again", F.when(F.col("id").isNotNull(), F.row_number().over(again)).otherwise(1)).filter("again = 1")
    return rows.withColumn("position", (F.row_number().over(W.partitionBy("session_id").orderBy("path", "position")) - 1).cast("long")).drop("again")


def stream_files(spark: SparkSession, path: str, glob: str, read: Reader, table: str, checkpoint: str, files_a_batch: int = 1_000) -> StreamingQuery:
    """Every new file below a folder, once, by any reader: a batch is whole files and replaces what the table has of them, so a repeated batch changes nothing."""
    new = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    new = new.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(path).select("path")

    def batch(df: DataFrame, _: int) -> None:
        paths = [r["path"] for r in df.collect()]  # files_a_batch at most
        if paths:
            rows = staged(read(df.sparkSession, paths), table)
            replace(df.sparkSession, table, rows, df.sparkSession.createDataFrame([(p,) for p in paths], "path string"))

    return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
