"""What the operators of this subpackage share: the shared folder, tables written to it, and word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the ASCII blank and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one key from which a join treats it as hot.
HOT_ROWS = 2_000

_own_folders: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what the session names in spark.checkpoint.dir. Only a local session that names none, as in
    tests, gets a temporary folder; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = Path(tempfile.mkdtemp(prefix="tallyspark-")).as_uri()
    return _own_folders[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table, which cuts the lineage.

    Unlike localCheckpoint it survives lost executors, and unlike cache() it gives later joins true sizes.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of all executors, once a session, by Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="tallyspark-")) / "tallyspark.zip"  # read by the driver only
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((root / "tallyspark").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def ship_file(spark: SparkSession, path: str) -> str:
    """Hand a file of the driver to all executors; tasks open SparkFiles.get() of the name that is returned."""
    key = f"{spark.sparkContext.applicationId} {path}"
    if key not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(key)
    return Path(path).name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with 16 bytes that tell its rows apart, where doc_ids are null or repeat, and the name of that column.

    Rows of files go by file and place, which are the same whenever a task is run again. Other rows are written
    to the shared folder first, as numbers made on the fly could change.
    """
    name = unused_name(docs, "row_key_")
    key = lambda *parts: F.unhex(F.md5(F.concat_ws(":", *parts).cast("binary")))
    try:
        return docs.withColumn(name, key("_metadata.file_path", F.col("_metadata.row_index").cast("string"))), name
    except AnalysisException:
        return materialize(docs.withColumn(name, key(F.monotonically_increasing_id().cast("string"))), "numbered"), name


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row a key and in count how many of rows it stands for.

    The rows of a key with more than HOT_ROWS of them, and than a ten-thousandth of all, are dealt over salts,
    and the key's row goes to each. Only the hot keys travel by broadcast, and there are fewer than 10,000 of
    them, however many rows there are. rows must be a written table, so that a task that is run again deals
    its rows as before.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    bound = max(HOT_ROWS, total // 10_000)
    hot = table.filter(F.col(count) > bound).select(key, F.ceil(F.col(count) / bound).cast("int").alias("salts_"))
    if total <= bound or hot.isEmpty():
        return rows.join(table, key, how)
    one = F.coalesce("salts_", F.lit(1))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("salt_", F.pmod(F.monotonically_increasing_id(), one).cast("int")).drop("salts_")
    table = table.join(F.broadcast(hot), key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts_")
    return rows.join(table, [key, "salt_"], how).drop("salt_")


#: What the Python worker that runs this keeps between tasks: by operator a function that forgets it.
_kept: dict[str, Callable[[], None]] = {}


def keep(operator: str, forget: Callable[[], None]) -> None:
    _kept[operator] = forget


def make_room(operator: str) -> None:
    """Forget what tasks of other operators left in this worker: workers are reused, stage after stage."""
    others = [k for k in _kept if k != operator]
    for k in others:
        _kept.pop(k)()
    if others:
        gc.collect()


def give_back() -> None:
    """Return what a task's Arrow batches took: workers are reused, and their pool would keep it for the next task."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def words_of(text: Column) -> Column:
    """The words of a text in order, by a JVM expression; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def drawn_share(hashed: Column, share: Column) -> Column:
    """As drawn_by(), for a share that is a column."""
    return hashed.bitwiseAND(F.lit((1 << 63) - 1)).cast("double") < share * float(1 << 63)


def drawn_by(hashed: Column, wanted: int, of: int) -> Column:
    """Is a row with this hash (a long) in a sample of about wanted of so many rows? 63 bits decide, so a small share of many rows is drawn too."""
    most = (1 << 63) - 1
    return hashed.bitwiseAND(F.lit(most)) <= F.lit(min(most, (wanted << 63) // max(1, of)))


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor: the fixed folds of the learned operators."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def unused_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores before it until df has no such column, whatever the case."""
    names = {c.lower() for c in df.columns}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, as a lambda variable."""
    return F.transform(F.array(value), body)[0]
