"""Tables that streams keep: micro-batches are merged by key into buckets, under a manifest that knows the last batch.

A batch rewrites the buckets that its keys fall into and nothing else, so each bucket is one folder
at any time: what is read doesn't grow with the number of batches. A manifest is published once a
batch's folders are complete and holds the batch's number; a batch that is run again after that
changes nothing, and one that fails before it leaves the last version as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.common import get_text, materialise, names_in, put_text, remove, scratch

#: Parts of a table by the hash of its key; a batch rewrites those that it touches.
BUCKETS = 32
#: Versions whose folders are kept for readers that began with them.
VERSIONS = 2

Rows = Callable[[DataFrame], DataFrame]


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest version: version, batch (the last that is in it) and the folder of each bucket."""
    versions = [x for x in names_in(spark, f"{root}/versions") if x.endswith(".json")]
    return json.loads(get_text(spark, f"{root}/versions/{max(versions)}")) if versions else {"version": 0, "batch": -1, "folders": {}}


def merge_batch(batch: DataFrame, number: int, root: str, keys: list[str], lift: Rows, merge: Rows) -> bool:
    """Merges a batch into the table at root; False if the batch is in it already.

    lift: rows of a batch as rows of the table; merge: any rows of the table as one for each key.
    """
    spark = batch.sparkSession
    m = manifest(spark, root)
    if number <= m["batch"]:
        return False
    with scratch(spark):
        new = merge(lift(batch))
        columns = new.columns
        new = materialise(new.withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")), "batch")
        touched = [str(r[0]) for r in new.select("bucket_").distinct().collect()]  # BUCKETS at most
        rows, held = new.select(columns), [f"{root}/data/{m['folders'][b]}/bucket_={b}" for b in touched if b in m["folders"]]
        if held:
            rows = merge(spark.read.schema(rows.schema).parquet(*held).union(rows)).select(columns)
        folder = uuid.uuid4().hex
        if touched:
            rows.withColumn("bucket_", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{root}/data/{folder}")
    put_text(spark, f"{root}/versions/{m['version'] + 1:012d}.json", json.dumps({"version": m["version"] + 1, "batch": number, "folders": m["folders"] | dict.fromkeys(touched, folder)}))
    _tidy(spark, root)
    return True


def _tidy(spark: SparkSession, root: str) -> None:
    """Removes versions before the last ones, and buckets and folders that none of these names."""
    versions = sorted(x for x in names_in(spark, f"{root}/versions") if x.endswith(".json"))
    used = {(f, b) for v in versions[-VERSIONS:] for b, f in json.loads(get_text(spark, f"{root}/versions/{v}"))["folders"].items()}
    for v in versions[:-VERSIONS]:
        remove(spark, f"{root}/versions/{v}")
    for folder in names_in(spark, f"{root}/data"):
        parts = [x for x in names_in(spark, f"{root}/data/{folder}") if x.startswith("bucket_=")]
        gone = [x for x in parts if (folder, x[len("bucket_=") :]) not in used]
        for x in gone:
            remove(spark, f"{root}/data/{folder}/{x}")
        if len(gone) == len(parts):
            remove(spark, f"{root}/data/{folder}")


def read_kept(spark: SparkSession, root: str) -> DataFrame:
    """The table as its newest version has it."""
    folders = manifest(spark, root)["folders"]
    if not folders:
        raise ValueError(f"nothing has been kept at {root}")
    return spark.read.parquet(*[f"{root}/data/{f}/bucket_={b}" for b, f in sorted(folders.items())])


def keep(stream: DataFrame, root: str, checkpoint: str, keys: list[str], lift: Rows, merge: Rows):
    """Keeps the table of a stream up to date with what is there; starts from the checkpoint again later."""
    write = lambda batch, number: merge_batch(batch, number, root, keys, lift, merge) and None
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(stream: DataFrame, root: str, checkpoint: str, key: str, order: str, created: str):
    """The latest row of each key, with the time of creation of its first; read_latest reads it."""
    rest = [c for c in stream.columns if c not in (key, created)]

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"), F.min_by(created, "first_").alias(created), F.min("first_").alias("first_")).select(key, "row.*", created, "first_")

    return keep(stream, root, checkpoint, [key], lambda batch: batch.withColumn("first_", F.col(order)), merge)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    return read_kept(spark, root).drop("first_")
