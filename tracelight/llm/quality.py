"""Text quality by logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SLOTS = 1 << 18
#: Labelled rows learnt from, drawn by a hash of their identifier; all of them where there are fewer.
SAMPLE_ROWS = 24_000
#: Rows that one task learns from; the tasks' weights are averaged.
SHARD_ROWS = 6_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Score from which a text counts as good.
THRESHOLD = 0.7
_FOLD_PARTS, _HELD_OUT = 4, 2

# byte classes: 0 space, 1 word (digits, letters, beyond ASCII), 2 other signs
_CLASS = np.full(256, 2, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = (np.arange(256) >= 65) & (np.arange(256) < 91)


def features(body: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Document rows and feature slots of all words, word pairs and word shapes.

    A word is a run of letters and digits or of other signs, lower-cased. Its shape (signs, capitals only,
    capital first, other) and the pairs of shapes are n-grams as well, as invented words never come again.
    """
    rows = len(at) - 1
    doc_of = np.repeat(np.arange(rows), np.diff(at))
    cls = _CLASS[body]
    new = np.ones(len(body), bool)
    new[1:] = cls[1:] != cls[:-1]
    new[at[:-1][at[:-1] < len(body)]] = True
    bounds = np.flatnonzero(new)
    ends = np.append(bounds[1:], len(body))
    word = cls[bounds] > 0
    starts, ends = bounds[word], ends[word]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = doc_of[starts]
    words = common.span_hashes(_LOWER[body], starts, ends)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[body])])
    n_capitals = capitals[ends] - capitals[starts]
    shape = np.where(cls[starts] == 2, 0, np.where((n_capitals == ends - starts) & (n_capitals > 1), 1, np.where(_UPPER[body[starts]], 2, 3))).astype(np.uint64)
    shape = common.mixed(shape + np.uint64(1 << 40))
    pair = doc[1:] == doc[:-1]
    k = np.uint64(0x9E3779B97F4A7C15)
    pairs = [common.mixed(x[:-1] * k + x[1:])[pair] for x in (words, shape)]
    hashed = np.concatenate([words, shape, *pairs])
    return np.concatenate([doc, doc, doc[1:][pair], doc[1:][pair]]), (hashed % np.uint64(slots)).astype(np.int64)


def _steps(col: pa.Array, slots: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    body, at = common.raw_bytes(col)
    for a, b in common.steps(at, 1 << 20):
        yield a, b, *features(body[at[a] : at[b]], at[a : b + 1] - at[a], slots)


class Leader:
    """FTRL-proximal logistic regression with a learning rate for each weight; the last slot is the bias."""

    def __init__(self, slots: int):
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(labelled: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Weights, the bias last, from rows (doc_id, text, label 0 or 1), such as ``labelled`` draws.

    Rows are dealt to shards of bounded size by a hash; each task runs FTRL over its shard, and the weights are
    averaged. Rare labels weigh more, up to balance at the square root of their rarity. The result has a fixed
    size. Null texts count as empty, repeated rows as often as they occur. Without both labels the weights are zero.
    """
    rows = common.stored(labelled.where("label in (0, 1)"), "quality-sample").select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text", F.col("label").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        return np.zeros(slots + 1)
    rare = {label: math.sqrt(n / (2 * size)) for label, size in sizes.items()}
    shards = max(1, math.ceil(n / SHARD_ROWS))
    drawn = rows.withColumn("shard", F.pmod(F.shiftright("h", 24), F.lit(shards)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        rows_x: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b, doc, at in _steps(pa.array(pdf["text"].fillna(""), pa.large_string()), slots):
            for i in range(b - a):
                own, count = np.unique(at[doc == i], return_counts=True)
                rows_x.append((np.append(own, slots), np.append(count / max(1, count.sum()) * 8, 1.0)))
        model, labels = Leader(slots), pdf["label"].to_numpy()
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(labels)):
                model.learn(*rows_x[i], float(labels[i]), rare[int(labels[i])])
        w = model.weights()
        there = np.flatnonzero(w)
        return pd.DataFrame({"slot": there, "w": w[there]})

    learnt = drawn.groupBy("shard").applyInPandas(learn, "slot long, w double").groupBy("slot").agg(F.sum("w").alias("w")).toPandas()
    w = np.zeros(slots + 1)
    w[learnt["slot"].to_numpy(np.int64)] = learnt["w"].to_numpy() / shards
    return w


def predict(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted, of every whole text.

    Null and empty texts get the score of the bias alone. Only the text decides, so ties and repeated rows score
    alike; a null identifier stays null. Further columns, clashing names too, are neither read nor returned. An
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # a fixed size
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, doc, at in _steps(common.text_column(batch, "text"), len(w) - 1):
                sums, n = np.bincount(doc, w[at], b - a), np.bincount(doc, minlength=b - a)
                out[a:b] = sums / np.maximum(n, 1) * 8
            p = 1 / (1 + np.exp(-np.clip(out + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, score double, predicted int")


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and label of about ``sample`` learning rows; of several labels of a document the largest counts.

    The sample is drawn from the labels, by a hash of the identifier, before any text is read: it is bounded,
    so it is broadcast and texts are not shuffled.
    """
    learning = common.fold(F.col("doc_id"), _FOLD_PARTS) != _HELD_OUT
    marks = labels.where(learning).groupBy("doc_id").agg(F.max(column).cast("int").alias("label")).where("label in (0, 1)")
    share = min(1.0, sample / max(1, marks.count()))
    drawn = marks.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / 1_000_003.0 < share)
    return docs.where(learning).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    weights = fit(labelled(docs, common.read(spark, sf_dir, "labels"), "quality"))
    return predict(docs, weights).select("doc_id", (common.fold(F.col("doc_id"), _FOLD_PARTS) == _HELD_OUT).alias("held_out"), "score", "predicted")
