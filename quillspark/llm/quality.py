"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are counted over Arrow buffers in numpy, a batch at a time. Each class has a mean and a covariance that is shrunk towards
the pooled one and its diagonal; the score compares the two log-densities, whose Mahalanobis terms come from Cholesky factors that are
computed once and travel with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytespans import span_hashes, steps_of, word_spans
from .common import fresh, text_or_empty

#: The fit's bound: at most so many labelled rows, those with the least hash of doc_id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05

UPPER, LOWER, DIGIT, SPACE, LINE, STOP, SHOUT, SIGN, HIGH = range(9)
SENTENCE_SIGNS = b".,;:?'\"()-"


def _classes() -> np.ndarray:
    table = np.full(256, SIGN, dtype=np.uint8)
    table[128:] = HIGH
    for members, kind in ((range(65, 91), UPPER), (range(97, 123), LOWER), (range(48, 58), DIGIT), (b" \t\x0b\x0c\r", SPACE), (b"\n", LINE), (SENTENCE_SIGNS, STOP), (b"!", SHOUT)):
        table[list(members)] = kind
    return table


CLASS = _classes()


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By document, how many different keys there are, and how often the most frequent one occurs."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=n).astype(float), most


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text: raw holds the texts' UTF-8, at their offsets."""
    n = len(at) - 1
    kind = CLASS[raw]
    count = np.stack([np.diff(np.concatenate([[0], np.cumsum(kind == k)])[at]) for k in range(9)], axis=1).astype(float)
    gap = (kind == SPACE) | (kind == LINE)
    begin, end, doc = word_spans(gap, at)
    first = at[:-1][np.diff(at) > 0]
    words = np.bincount(doc, minlength=n).astype(float)
    key = span_hashes(raw, begin, end)
    different, most = _distinct(doc, key, n)
    same = doc[1:] == doc[:-1]
    again = np.bincount(doc[1:][same & (key[1:] == key[:-1])], minlength=n)
    pair = (key[1:] * np.uint64(3) + key[:-1])[same]
    pairs = np.bincount(doc[1:][same], minlength=n).astype(float)
    pairs_different, _ = _distinct(doc[1:][same], pair, n)
    cut = np.flatnonzero(kind == LINE)
    line_begin = np.unique(np.concatenate([first, cut + 1]))
    line_begin = line_begin[line_begin < len(raw)]
    line_doc = np.searchsorted(at, line_begin, side="right") - 1
    line_end = np.minimum(np.append(line_begin[1:], len(raw)), at[line_doc + 1])
    lines = np.bincount(line_doc, minlength=n).astype(float)
    lines_different, _ = _distinct(line_doc, span_hashes(raw, line_begin, line_end), n)
    length = np.diff(at).astype(float)
    solid = np.maximum(length - count[:, SPACE] - count[:, LINE], 1)
    one = np.maximum(words, 1)
    rare = lambda x: np.log(x + 0.01)
    return np.stack(
        [
            np.log1p(length),
            rare(count[:, SIGN] / solid),
            rare(count[:, SHOUT] / solid),
            rare(count[:, UPPER] / solid),
            rare(count[:, DIGIT] / solid),
            rare(count[:, STOP] / solid),
            count[:, HIGH] / solid,
            solid / one / 10,
            rare(again / one),
            np.log((different + 1) / (one + 1)),
            rare(most / one),
            rare(1 - pairs_different / np.maximum(pairs, 1)),
            rare(1 - lines_different / np.maximum(lines, 1)),
            np.log((lines + 1) / (one + 1)),
        ],
        axis=1,
    )


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes in standardised statistics, and a calibration of their difference."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    logdet: list[float]
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        logs = [-0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) - d for m, w, d in zip(self.means, self.whiten, self.logdet, strict=True)]
        return _sigmoid(self.slope * np.clip(logs[1] - logs[0], -200, 200) + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | float:
    """The discriminant, or where a class has fewer than two rows a score for all: the part of label 1, 0.5 without rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return float(y.mean()) if len(y) else 0.5
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - shift) / scale
    own = [np.cov(z[y == k].T) for k in (0, 1)]
    weight = [(y == k).mean() for k in (0, 1)]
    pooled = weight[0] * own[0] + weight[1] * own[1]
    means, whiten, logdet = [], [], []
    for k in (0, 1):
        mixed = (1 - SHRINK_POOLED) * own[k] + SHRINK_POOLED * pooled
        mixed = (1 - SHRINK_DIAGONAL) * mixed + SHRINK_DIAGONAL * np.diag(np.diag(mixed)) + 1e-3 * np.eye(len(mixed))
        factor = np.linalg.cholesky(mixed)
        means.append(z[y == k].mean(axis=0))
        whiten.append(np.linalg.inv(factor))
        logdet.append(float(np.log(np.diag(factor)).sum()))
    model = Discriminant(shift, scale, means, whiten, logdet, 1.0, float(np.log(weight[1] / weight[0])))
    return _calibrated(model, x, y)


def _calibrated(model: Discriminant, x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Slope and offset of a logistic curve through the log-density differences, by Newton steps: independence that the densities assume makes them too sure."""
    z = (x - model.shift) / model.scale
    logs = [-0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) - d for m, w, d in zip(model.means, model.whiten, model.logdet, strict=True)]
    g = np.stack([np.clip(logs[1] - logs[0], -200, 200) / 10, np.ones(len(y))], axis=1)
    beta = np.array([1.0, model.offset])
    for _ in range(50):
        p = _sigmoid(g @ beta)
        grad = g.T @ (y - p) - 1e-2 * beta
        hess = (g * (p * (1 - p))[:, None]).T @ g + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = max(float(beta[0]) / 10, 1e-3), float(beta[1])
    return model


def in_training(doc_id: Column) -> Column:
    """Rows that may be learnt from. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Discriminant | float:
    """Fits on documents with a label 0 or 1 that are not held out: one text for each of at most that many doc_ids, those with the least hash.

    Of several labels of a doc_id the least counts, of several texts the one with the least digest. Only statistics reach the driver.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = text_or_empty("text")
    texts = docs.select(F.col("doc_id").alias("id"), text.alias("text"), F.sha2(text, 256).alias("digest")).join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).select("doc_id", "digest", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in steps_of(batch.column("text")):
                x = statistics(raw, at)
                yield pa.RecordBatch.from_pydict({**{c: batch.column(c).slice(i, j - i) for c in ("doc_id", "digest", "quality")}, "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    schema = T.StructType().add("doc_id", chosen.schema["doc_id"].dataType).add("digest", "string").add("quality", "integer").add("x", T.ArrayType(T.DoubleType()))
    one = texts.mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("digest", "quality", "x")).alias("one"))
    got = one.select("one.quality", "one.x").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, 1)), np.zeros(0))
    x, y = np.array(got["x"].to_pylist()), got["quality"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # sums do not hang on the order in which rows arrive
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Discriminant | float, score: str) -> DataFrame:
    """The documents with their score as one more column, in double precision. Only the text goes to Python and only the score comes back."""

    @F.pandas_udf("double")
    def of(texts):
        column = pa.array(texts, pa.large_string())
        if isinstance(model, float):
            return texts.map(lambda _: model).astype("float64")
        import pandas as pd

        parts = [model.score(statistics(raw, at)) for _, _, raw, at in steps_of(column)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(score, of(text_or_empty("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if the score reaches the threshold).

    A null text counts as empty and gets the score of an empty text. Repeated rows and null doc_ids each give a row (null ones are held
    out); other columns are dropped; an empty table gives no row. Without labels of both classes every score is the part of label 1.
    """
    rows = scored(docs.select("doc_id", "text"), train(docs, labels), "score")
    return rows.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    (score,) = fresh(docs.columns, "score")
    return scored(docs, train(docs, labels), score).filter(F.col(score) >= threshold).drop(score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
