"""The dense lane: nearest neighbours of query vectors, and scores from distances."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.best import Best, Floor, best_in_rounds
from quern.plans.common import r6, read

#: Queries that one pass over the vectors takes along; the driver never holds more.
BLOCK = 2_000


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k vectors with the largest dot product.

    queries: (query_id, vec); vectors: (vec_id, embedding). The queries go to the vectors in blocks;
    every task keeps k for each query, and of these what the rounds before don't surpass, so that what is
    shuffled grows neither with the vectors' width nor with their square. Similarities are rounded to 6 places, ties go to the smaller id.
    """
    if where is not None:
        vectors = vectors.where(where)
    asked = queries.where("vec is not null").select("query_id", "vec")
    blocks = max(1, -(-asked.count() // BLOCK))
    held = vectors.where("embedding is not null").select("vec_id", "embedding")
    n, names, paths = held.count(), ("query_id", "vec_id", "similarity"), []
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {held.schema['vec_id'].dataType.simpleString()}, similarity double"
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        ids = part.column("query_id").combine_chunks()
        q = np.array(part.column("vec").to_pylist(), np.float64) if len(ids) else np.empty((0, 0))

        def rows(batches: Iterable[pa.RecordBatch], floor: Floor | None, ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best = Best(ids, k, floor=floor)
            for b in batches:
                for at in range(0, b.num_rows if len(ids) else 0, best.step):
                    few = b.slice(at, best.step)
                    e = few.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(few.num_rows, -1)
                    best.add(few.column("vec_id"), np.round(e @ q.T, 6))
            yield from best.rows(names)

        paths.append(best_in_rounds(held, n, ids, k, names, schema, lambda floor, rows=rows: functools.partial(rows, floor=floor)))
    return queries.sparkSession.read.schema(f"{schema}, rank int").parquet(*paths)


def distance_to_similarity(distance: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - d; ip: d; l2 of unit vectors: 1 - d squared / 2; other: 1 / (1 + d); held within 0 and 1."""
    raw = {"cosine": 1 - distance, "ip": distance, "l2": 1 - distance * distance / 2}.get(metric, 1 / (1 + distance))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def offline_similarity(distance: Column, metric: str = "cosine") -> Column:
    """The scale of the evaluations: cosine: 1 - d; ip: (d + 1) / 2; l2 and others: 1 / (1 + d); held within 0 and 1."""
    raw = {"cosine": 1 - distance, "ip": (distance + 1) / 2}.get(metric, 1 / (1 + distance))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def add_vectors(store: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """The store with new rows in place of those with the same key; of new rows with one key the last by all columns counts."""
    row = F.struct(*(F.col(f"`{c}`") for c in store.columns))
    once = new.select(*store.columns).groupBy(F.col(key).alias("key_")).agg(F.max(row).alias("row")).select("row.*")
    return store.join(once.select(key), key, "left_anti").select(*store.columns).unionByName(once)


def delete_vectors(store: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti").select(*store.columns)


def get_vectors(store: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The rows of some ids, or all, that a condition holds for."""
    found = store if ids is None else store.join(ids.select(key).distinct(), key, "left_semi").select(*store.columns)
    return found if where is None else found.where(where)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def q_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(_asked(spark, sf_dir), read(spark, sf_dir, "embeddings"))


def q_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(_asked(spark, sf_dir), read(spark, sf_dir, "embeddings"), k=5, where=F.col("label") % 2 == 0)


def q_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vector of each label among the 50 nearest."""
    near = knn(_asked(spark, sf_dir), read(spark, sf_dir, "embeddings"), k=50)
    labelled = near.join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    best = F.min_by("vec_id", F.struct(-F.col("similarity"), F.col("vec_id")))
    return labelled.groupBy("query_id", "label").agg(F.max("similarity").alias("score"), best.alias("best_vec_id"), F.count("*").alias("hits"))


def q_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn(_asked(spark, sf_dir), read(spark, sf_dir, "embeddings"), k=20)
    d = 1 - F.col("similarity")
    return near.select("query_id", "vec_id", *(r6(distance_to_similarity(d, m)).alias(m) for m in ("cosine", "ip", "l2", "other")))


def q_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn(_asked(spark, sf_dir), read(spark, sf_dir, "embeddings"), k=20)
    d = 1 - F.col("similarity")
    return near.select("query_id", "vec_id", *(r6(offline_similarity(d, m)).alias(m) for m in ("cosine", "ip", "l2")))


def q_vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after vectors of even labels are written again under a new label and those of label 1 deleted."""
    store = read(spark, sf_dir, "embeddings")
    again = store.where("label % 2 = 0").withColumn("label", F.col("label") + 100)
    kept = delete_vectors(add_vectors(store, again), get_vectors(store, where=F.col("label") == 1))
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.max("vec_id").alias("last_id"))


_KNN = "n as (select q.vec_id as query_id, v.vec_id, v.label, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 6) as similarity from embeddings q join embeddings v on q.vec_id % 100 = 0 {}), r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id)::int as rank from n)"
QUERIES = {"knn_cosine_top10": q_knn, "knn_filtered": q_knn_filtered, "doc_maxpool": q_max_pool, "distance_to_similarity": q_distances, "offline_similarity": q_offline, "vector_store": q_vector_store}
ORACLE = {
    "offline_similarity": f"""with {_KNN.format('')}, d as (select query_id, vec_id, 1 - similarity as d from r where rank <= 20)
        select query_id, vec_id, round(greatest(0.0, least(1.0, 1 - d)), 6) as cosine, round(greatest(0.0, least(1.0, (d + 1) / 2)), 6) as ip, round(greatest(0.0, least(1.0, 1 / (1 + d))), 6) as l2 from d""",
    "vector_store": "select case when label % 2 = 0 then label + 100 else label end::int as label, count(*) as n, max(vec_id) as last_id from embeddings where label <> 1 group by 1",
    "knn_cosine_top10": f"with {_KNN.format('')} select query_id, vec_id, similarity, rank from r where rank <= 10",
    "knn_filtered": f"with {_KNN.format('and v.label % 2 = 0')} select query_id, vec_id, similarity, rank from r where rank <= 5",
    "doc_maxpool": f"with {_KNN.format('')} select query_id, label, max(similarity) as score, first(vec_id order by rank) as best_vec_id, count(*) as hits from r where rank <= 50 group by query_id, label",
    "distance_to_similarity": f"""with {_KNN.format('')}, d as (select query_id, vec_id, 1 - similarity as d from r where rank <= 20)
        select query_id, vec_id, round(greatest(0.0, least(1.0, 1 - d)), 6) as cosine, round(greatest(0.0, least(1.0, d)), 6) as ip, round(greatest(0.0, least(1.0, 1 - d * d / 2)), 6) as l2, round(greatest(0.0, least(1.0, 1 / (1 + d))), 6) as other from d""",
}
