"""An index of vectors: coarse cells, codes of the residuals, multi-probe search, exact scores of the survivors.

Cells are the centres of k-means on a bounded sample; every vector lies in the folder of its nearest
cell, with a code of one byte for each few dimensions of what is left of it. A search reads the codes
of the cells nearest to its queries, ranks them by tables of partial products, and scores only the
best few with the vectors themselves. How many cells are probed is set when the index is built, by
the recall that the sample shows. The exact way is `dense.knn`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.dense import knn
from quern.plans.common import exists, materialise, r6, read, shared_dir, sized, table_version, top_k

#: Rows that the cells and codes are fitted on, the first by the hash of their id; most cells; dimensions and values of a code.
SAMPLE, MAX_CELLS, WIDTH, VALUES = 20_000, 4_096, 2, 64
#: Recall on the sample that decides how many cells are probed and how many results of the codes are scored exactly, and neighbours it is measured on.
RECALL, NEAREST = 0.975, 10
#: Vectors and queries that meet in one task.
PART_ROWS, QUERY_ROWS = 1 << 16, 2_048
#: Vectors that are coded at once, and scores of codes that are computed at once.
CODED_ROWS, SCORES = 512, 1 << 20
_ROUNDS = 10


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(((centres**2).sum(1) - 2 * x[at : at + 4096] @ centres.T)).argmin(1) for at in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """At most k centres; one that loses all its rows moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(_ROUNDS):
        of = _nearest(x, centres)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(-((x - centres[of]) ** 2).sum(1), kind="stable")[: len(empty)]
            centres[empty] = x[far]
    return centres


@dataclass(frozen=True)
class Model:
    """centres (cells x dimensions), books (parts x VALUES x WIDTH), how many cells a search probes and how many survivors it keeps for each result."""

    centres: np.ndarray
    books: np.ndarray
    probes: int
    refine: int

    def parts(self, x: np.ndarray) -> np.ndarray:
        """x by parts of WIDTH dimensions, the last filled up with zeros."""
        wide = np.zeros((len(x), self.books.shape[0] * WIDTH))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), -1, WIDTH)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.centres)
        rest = self.parts(x - self.centres[cell])
        return cell, np.stack([_nearest(rest[:, m], b) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries and coded vectors of one cell: the centre's, and a looked up one for each part."""
        table = np.einsum("qmw,mvw->qmv", self.parts(q), self.books)
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for m in range(codes.shape[1]):
            out += table[:, m, codes[:, m]]
        return out

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each query."""
        far = (self.centres**2).sum(1) - 2 * q @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :probes]


def fit(x: np.ndarray, n: int) -> Model:
    """Cells and codes from a sample x of n vectors."""
    if not len(x):
        return Model(np.zeros((0, 0)), np.zeros((0, 0, WIDTH)), 1, 1)
    centres = k_means(x, max(1, min(MAX_CELLS, len(x) // 8 or 1, int(n**0.5))))
    model = Model(centres, np.zeros((-(-x.shape[1] // WIDTH), 1, WIDTH)), 1, 1)
    rest = model.parts(x - centres[_nearest(x, centres)])
    books = [k_means(rest[:, m], VALUES) for m in range(rest.shape[1])]
    books = np.stack([np.concatenate([b, np.repeat(b[-1:], VALUES - len(b), axis=0)]) for b in books])
    return _calibrated(x, n, Model(centres, books, 1, 1))


def _calibrated(x: np.ndarray, n: int, model: Model) -> Model:
    """Probes and survivors that enough of the nearest neighbours of 200 rows of the sample ask for.

    The codes' rank of a neighbour grows with the vectors around it, so it is carried on from the sample to n.
    """
    q = x[:: max(1, len(x) // 200)][:200]
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : NEAREST + 1]
    enough = lambda v: int(np.sort(v.ravel())[min(v.size - 1, int(np.ceil(RECALL * v.size)))]) + 1

    def places(order: np.ndarray) -> np.ndarray:
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        return out

    cell, codes = model.encode(x)
    near = places(model.probed(q, len(model.centres)))
    about = np.empty((len(q), len(x)))
    for c in range(len(model.centres)):
        about[:, cell == c] = model.scores(q, c, codes[cell == c])
    rank = enough(np.take_along_axis(places(np.argsort(-about, axis=1, kind="stable")), best, axis=1))
    return Model(model.centres, model.books, enough(np.take_along_axis(near, cell[best], axis=1)), max(2, -(-rank * max(1, n // len(x)) // NEAREST)))


@dataclass(frozen=True)
class Index:
    """vectors: all columns of the table, cell and code, in a folder for each cell; cells: (cell, n)."""

    vectors: DataFrame
    cells: DataFrame
    model: Model


def write_index(vectors: DataFrame, path: str) -> None:
    """Builds the index of vectors (vec_id, embedding and others) under path; rows without a vector aren't in it."""
    spark = vectors.sparkSession
    held = vectors.where("embedding is not null")
    n = held.count()
    sample = held.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    model = fit(np.array(sample.column(0).to_pylist(), np.float64), n)
    columns = vectors.columns

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CODED_ROWS):
                b = whole.slice(at, CODED_ROWS)
                cell, code = model.encode(np.array(b.column("embedding").to_pylist(), np.float64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], [*columns, "cell", "code"])

    kinds = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in columns)
    coded = held.mapInArrow(rows, f"{kinds}cell int, code binary")
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    if n:
        spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(model.centres.tolist(), model.books.tolist(), model.probes, model.refine, n)], "centres array<array<double>>, books array<array<array<double>>>, probes int, refine int, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def index_of(vectors: DataFrame) -> Index:
    """The index of a table of files, built once for its present content and kept in the shared folder."""
    spark = vectors.sparkSession
    path = f"{shared_dir(spark)}/quern/cells-{table_version(vectors)}-{SAMPLE}-{MAX_CELLS}-{WIDTH}-{VALUES}"
    if not exists(spark, f"{path}/model/_SUCCESS"):
        write_index(vectors, path)
    m = spark.read.parquet(f"{path}/model").first()
    model = Model(np.array(m.centres), np.array(m.books), m.probes, m.refine)
    if not m.n:
        empty = vectors.limit(0).withColumns({"cell": F.lit(0), "code": F.lit(b"")})
        return Index(empty, empty.select("cell", F.lit(0).cast("long").alias("n")), model)
    return Index(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"), model)


def probe(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """(query_id, vec, cell) for the cells that each query (query_id, vec) probes."""
    small = queries.where("vec is not null").select("query_id", "vec")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(at, QUERY_ROWS)
                near = model.probed(np.array(part.column("vec").to_pylist(), np.float64), probes)
                of = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(of), part.column("vec").take(of), pa.array(near.ravel(), pa.int32())], ["query_id", "vec", "cell"])

    return small.mapInArrow(rows, f"query_id {small.schema['query_id'].dataType.simpleString()}, vec {small.schema['vec'].dataType.simpleString()}, cell int")


def search(queries: DataFrame, index: Index, k: int = 10, where: Column | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): about the k vectors with the largest dot product, with exact similarities.

    where restricts the vectors before they are ranked. A cell with many vectors, or many queries, is
    met in several tasks, each of a part of the vectors and of the queries. Similarities are rounded to
    6 places, ties go to the smaller id; a null vector has no neighbours.
    """
    model = index.model
    if not len(model.centres):
        kinds = [queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["vec_id"].dataType.simpleString()]
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double, rank int")
    asked = materialise(probe(queries, model, min(probes or model.probes, len(model.centres))), "probed")
    loads = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    loads = F.broadcast(loads.join(F.broadcast(index.cells), "cell").select("cell", "blocks", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")))  # a row for each cell at most
    cells = [r.cell for r in asked.select("cell").distinct().collect()]
    held = index.vectors.where(F.col("cell").isin(cells))
    coded = held.where(where) if where is not None else held
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = asked.join(loads, "cell").select("cell", "query_id", "vec", deal("query_id", "blocks").alias("block"), each("parts").alias("part"))
    right = coded.join(loads, "cell").select("cell", "vec_id", "code", deal("vec_id", "parts").alias("part"), each("blocks").alias("block"))
    kinds = [asked.schema["query_id"].dataType.simpleString(), held.schema["vec_id"].dataType.simpleString()]
    most = k * model.refine

    def rank(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        ids, vec_ids, out = q.column("query_id").combine_chunks(), v.column("vec_id").combine_chunks(), []
        if len(ids) and len(vec_ids):
            codes = np.frombuffer(b"".join(v.column("code").to_pylist()), np.uint8).reshape(len(vec_ids), -1)
            step = max(1, min(128, SCORES // len(codes)))
            for at in range(0, len(ids), step):
                s = model.scores(np.array(q.column("vec")[at : at + step].to_pylist(), np.float64), key[0].as_py(), codes)
                best = np.argpartition(-s, most - 1, axis=1)[:, :most] if s.shape[1] > most else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                out.append((np.repeat(np.arange(at, at + len(s)), best.shape[1]), best.ravel(), np.take_along_axis(s, best, 1).ravel()))
        qs, vs, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([ids.take(pa.array(qs)), vec_ids.take(pa.array(vs)), pa.array(s)], ["query_id", "vec_id", "about"]).append_column("cell", pa.array(np.full(len(qs), key[0].as_py()), pa.int32()))

    by = ("cell", "part", "block")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rank, f"query_id {kinds[0]}, vec_id {kinds[1]}, about double, cell int")
    kept = materialise(top_k(found, ["query_id"], [F.desc("about"), F.col("vec_id")], most).drop("rank", "about"), "survivors")
    again = held.select("cell", "vec_id", "embedding").join(sized(kept), ["cell", "vec_id"]).join(sized(queries.select("query_id", "vec")), "query_id")
    product = F.aggregate(F.zip_with("vec", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    scored = again.select("query_id", "vec_id", r6(product).alias("similarity")).distinct()
    return top_k(scored, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours of the exact answer, how many of them were found, and their share."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("neighbours"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("neighbours"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_asked(spark, sf_dir), index_of(read(spark, sf_dir, "embeddings")))


def knn_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nine tenths of the exact neighbours are found, with and without a condition on the vectors."""
    vectors = read(spark, sf_dir, "embeddings")
    index, asked, out = index_of(vectors), _asked(spark, sf_dir), None
    for name, where in (("all", None), ("even labels", F.col("label") % 2 == 0)):
        r = recall(search(asked, index, where=where), knn(asked, vectors, where=where))
        r = r.select(F.lit(name).alias("vectors"), "neighbours", (F.col("recall") >= 0.9).alias("enough"))
        out = r if out is None else out.union(r)
    return out


QUERIES = {"knn_indexed": knn_indexed, "knn_index_recall": knn_index_recall}
ORACLE = {
    "knn_index_recall": """with q as (select count(*) as q from embeddings where vec_id % 100 = 0), n as (select count(*) as a, count(*) filter (label % 2 = 0) as e from embeddings)
        select 'all' as vectors, q * least(10, a) as neighbours, true as enough from q, n union all select 'even labels', q * least(10, e), true from q, n""",
}
