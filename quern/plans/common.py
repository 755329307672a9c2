"""Helpers of the query plans: tables, sized broadcasts, scratch tables, top-k by group."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that a side may have to be broadcast; both are looked at before use, beyond them Spark shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
#: Rows of a side of single numbers, by which wide rows are picked where they lie.
BROADCAST_IDS = BROADCAST_BYTES // 32
#: Rows of texts or tokens in an Arrow batch, which an executor holds twice for each task.
BATCH_ROWS = 500

_written: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only on a local master.

    Executors of a cluster don't see the driver's temporary folder, so there an error is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear_scratch removes."""
    _written.append(f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a re-read and not a recomputation, and every
    later use of the table starts from the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession, since: int = 0) -> None:
    """Removes the scratch tables written since (all by default); results that read them are no longer valid."""
    for path in _written[since:]:
        remove(spark, path)
    del _written[since:]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written within are removed at the end; what is left must have been written elsewhere."""
    since = len(_written)
    try:
        yield
    finally:
        clear_scratch(spark, since)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What runs within gets Arrow batches of at most so many rows; afterwards the session has its own setting again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(held)) if int(held) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and bytes, else df as it is.

    df should be cheap to count: a scratch table or a small source. Bytes are measured only where
    a column has no fixed width.
    """
    head = df.limit(rows + 1)
    wide = [c.name for c in df.schema if c.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string") if df.schema[c].dataType.typeName() not in ("string", "binary") else F.col(f"`{c}`")), F.lit(0)) for c in wide]
    bytes_ = sum(texts, F.lit(0)) + 16 * len(df.columns)
    n, total = head.agg(F.count("*"), F.sum(bytes_.cast("long"))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def table_version(df: DataFrame) -> str:
    """A name for the present content of a table of files: it changes when a file is added, removed or rewritten.

    Folders are listed, one call for each; single files aren't asked for.
    """
    spark, files = df.sparkSession, set(df.inputFiles())
    seen = sorted(files)
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        place, store = _place(spark, folder)
        found = (f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in store.listStatus(place) if not s.isDirectory())
        seen += sorted(found)  # all files of the folder, whatever their names look like as addresses
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(seen)).hex


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    place, store = _place(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole; an error if it is there already."""
    place, store = _place(spark, path)
    draft, _ = _place(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = store.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(place) or not store.rename(draft, place):
        store.delete(draft, False)
        raise FileExistsError(path)


def get_text(spark: SparkSession, path: str) -> str:
    place, store = _place(spark, path)
    held = store.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(held)).decode()
    finally:
        held.close()


def remove(spark: SparkSession, path: str) -> None:
    place, store = _place(spark, path)
    store.delete(place, True)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; Spark limits the groups before it shuffles them."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def r6(c: Column | str) -> Column:
    """Rounded to 6 places: sums of doubles depend on the order of their rows beyond that."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
