"""Quality classifier (operator 2): Bradley-Terry pairwise ranking of documents.

Every pair of a better and a worse labelled document is a preference. The score of a document is
linear in its features, and the chance that one document beats another is the logistic function of
the difference of their scores, so fitting is logistic regression on feature differences without an
intercept. The decision threshold is a quantile of the labelled documents' scores: the share of
worse labels. Scores are mapped to 0..1 so that the threshold lands on 0.7.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, held_out, read

#: Bound of the labelled sample; every pair of a better and a worse document in it is a preference.
MAX_LABELLED = 20_000
#: Better documents whose pairs are held in memory at once.
BLOCK = 500
CUT = 0.7

#: Classes of bytes whose shares are features.
_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r", "stop": b".", "comma": b",;:", "bang": b"!?", "bar": b"|", "marks": b"#$%&*+=<>@^_~\\/", "quote": b"\"'`-()[]{}"}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _i
N_FEATURES = len(_CLASSES) + 1 + 12


def features(text: str | None) -> np.ndarray:
    """Shares and shapes of the whole text; an empty text gives zeros."""
    out = np.zeros(N_FEATURES)
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return out
    n = len(_CLASSES) + 1
    out[:n] = np.bincount(_CLASS[raw], minlength=n) / len(raw)
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    top = counts.most_common(1)[0][1] if counts else 0
    letters = out[0] + out[1]
    out[n:] = (
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        len(counts) / k,
        len(counts) / k**0.75,
        top / k,
        sum(map(str.__eq__, words, words[1:])) / k,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        out[1] / letters if letters else 0,
        (lengths <= 3).mean(),
        np.log1p(out[5] * len(raw)) - np.log1p(k),
    )
    return out


def features_of(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of keep, and x: the features of each row's text."""
    small = docs.select(*keep, F.col(text_col).alias("text_"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text_").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    kinds = ", ".join(f"`{c}` {small.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(small, rows, f"{kinds}, x array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standard scores and their sizes, both bounded: a feature may be bad at both ends."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, np.abs(z)], axis=-1)

    def score(self, x: np.ndarray) -> np.ndarray:
        linear = (self.expand(x) * self.weights).sum(axis=-1)  # row by row, so that equal texts score the same in any batch
        s = (linear - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -60, 60)))


def _step(good: np.ndarray, bad: np.ndarray, w: np.ndarray, l2: float) -> np.ndarray:
    """The Newton step of the mean logistic loss over all pairs of a good and a bad row.

    The gradient and the Hessian of all pairs need only sums over the matrix of pair weights, which
    is made a block of rows at a time; no differences of features are formed.
    """
    n, d = len(good) * len(bad), len(w)
    g, h = np.zeros(d), np.zeros((d, d))
    of_bad, pull = np.zeros(len(bad)), np.zeros(len(bad))
    s_bad = bad @ w
    for at in range(0, len(good), BLOCK):
        part = good[at : at + BLOCK]
        p = 1 / (1 + np.exp(-np.clip((part @ w)[:, None] - s_bad[None], -40, 40)))
        v = p * (1 - p)
        g += part.T @ (1 - p).sum(axis=1)
        pull += (1 - p).sum(axis=0)
        of_bad += v.sum(axis=0)
        cross = part.T @ (v @ bad)
        h += (part * v.sum(axis=1)[:, None]).T @ part - cross - cross.T
    g -= bad.T @ pull
    h += (bad * of_bad[:, None]).T @ bad
    return np.linalg.solve(h / n + l2 * np.eye(d), g / n - l2 * w)


def fit(x: np.ndarray, label: np.ndarray, l2: float = 1e-2) -> Model:
    """Bradley-Terry by Newton steps on all preference pairs.

    Without two classes there is no preference; then every document scores exactly the cut.
    """
    d = x.shape[1] if x.size else N_FEATURES
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(d), np.ones(d), np.zeros(2 * d), 0.0, 1.0)
    scale = x.std(axis=0)
    model = Model(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * d), 0.0, 1.0)
    z = model.expand(x)
    w = np.zeros(2 * d)
    for _ in range(25):
        step = _step(z[good], z[bad], w, l2)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = len(bad)
    threshold = float((s[k - 1] + s[k]) / 2)
    spread = max(1e-6, float(np.median(z[good] @ w) - threshold) / 3)
    return Model(model.mean, model.scale, w, threshold, spread)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fits on at most MAX_LABELLED labelled rows of docs, the first by the hash of their id.

    Rows with a null id or label are left out; of rows that repeat an id each text counts. The bound
    holds for rows, however often an id repeats.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), "text", F.xxhash64("text").alias("sig"))
    order = (F.xxhash64("doc_id"), "doc_id", "label", "sig")
    sample = ids.join(texts.select("doc_id", "sig").distinct(), "doc_id").orderBy(*order).limit(MAX_LABELLED)
    rows = features_of(texts.join(F.broadcast(sample), ["doc_id", "sig"]), ["doc_id", "label", "sig"]).orderBy(*order).limit(MAX_LABELLED).toPandas()
    rows = rows.sort_values(["doc_id", "label", "sig"], kind="stable")
    x = np.array(rows["x"].tolist()) if len(rows) else np.empty((0, N_FEATURES))
    return fit(x, rows["label"].to_numpy())


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of keep, score (0 to 1) and predicted (1 if score >= 0.7) for every row of docs.

    A null text scores as an empty one. Repeated rows each give a row; an empty table gives none.
    """
    small = docs.select(*keep, F.col(text_col).alias("text_"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column("text_").to_pylist()]).reshape(-1, N_FEATURES)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], [*keep, "score", "predicted"])

    kinds = "".join(f"`{c}` {small.schema[c].dataType.simpleString()}, " for c in keep)
    return arrow_map(small, rows, f"{kinds}score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, out: Column) -> DataFrame:
    """Learns from the labelled rows where out is false, then scores all rows: doc_id, held_out, score, predicted.

    A null text scores as an empty one, a null id is kept and never learnt from. A row labelled both
    ways counts once for each label. Repeated rows each give a row and equal texts equal scores; a
    score of exactly the cut is accepted. Without labels of both kinds every row scores the cut. An
    empty table gives no rows; other columns are ignored.
    """
    model = train(docs.where(~out), labels)
    return score(docs.select("doc_id", out.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that the classifier accepts, with all their columns.

    Nulls, ties, repeated rows and empty tables are as in classify; other columns are kept.
    """
    model = train(docs.where(~held_out()), read(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return score(whole, model, ["row"]).where("predicted = 1").select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out())


QUERIES = {"op2_quality": op2_quality}
ORACLE: dict[str, str] = {}
