"""Toxicity by compression distance: how much shorter a window gets with a dictionary trained on toxic text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each label learnt from, drawn by a hash of their identifier; all of them where there are fewer.
SAMPLE_ROWS = 4_000
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
LEVEL = 9
#: Ordinary words that both dictionaries hold, and strings that only the toxic one holds.
BASE_WORDS, TOXIC_STRINGS = 700, 400
#: A string is toxic if at least so many toxic sample texts hold it, so many times as often as ordinary ones.
LEAST_TEXTS, LEAST_RATIO = 5, 6.0
#: Shares of ordinary windows that the two calibrated thresholds of each window length may mark, faintly and clearly.
ORDINARY_RATES = (3e-3, 3e-4)
SHORTEST, LONGEST = 3, 12
_FOLD_PARTS, _HELD_OUT = 4, 2
_MEMO = 300_000

_LETTERS = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """The windows of a text: its words, lower-cased, without anything but letters."""
    return text.lower().encode().translate(_LETTERS).split()


def strings(text: str) -> set[str]:
    """Beginnings of a text's words, after a space, and its whole words between spaces."""
    out = set()
    for w in {w.decode("utf-8", "ignore") for w in words(text)}:
        out.update(" " + w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
        out.add(f" {w} ")
    return out


class Distance:
    """Compressed length with the ordinary dictionary less that with the toxic one.

    A window stands between a lead-in and a trailer that both dictionaries hold: so it is not stored raw for
    being short, and matches may reach its end. Both dictionaries end in the same ordinary words at the
    same distance, so an ordinary window compresses alike with both.
    """

    def __init__(self, base: bytes, toxic: bytes):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.ordinary, self.toxic = compressor(base).compress, compressor(toxic + base).compress
        self.lead, self.trailer = base[-160:-64], base[-40:-16]

    def __call__(self, window: bytes) -> int:
        padded = b"".join((self.lead, b" ", window, b" ", self.trailer))
        return len(self.ordinary(padded)) - len(self.toxic(padded))


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionary contents, the distances that mark a window of each length, and the weights of a text's marks."""

    base: bytes
    toxic: bytes
    limits: tuple[tuple[int, int], ...]
    weights: tuple[float, ...]


#: A clear mark counts in the high half of a number, a faint or clear one in the low half.
_CLEAR = 1 << 32
_NEVER = ToxicityModel(b" " * 256, b"", ((1 << 30, 1 << 30),), (-5.0, 0.0, 0.0, 0.0, 0.0))


def _marks(col: pa.Array, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Faintly and clearly marked windows, and windows, of each text. Words seen before are remembered, up to a bound."""
    distance, memo = Distance(model.base, model.toxic), {}
    marked, total = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
    for i, text in enumerate(col):
        own = words(text.as_py())
        for w in set(own).difference(memo):
            d, (faint, clear) = distance(w), model.limits[min(len(w), len(model.limits) - 1)]
            memo[w] = (d >= faint) + _CLEAR * (d >= clear)
        marked[i], total[i] = sum(map(memo.__getitem__, own)), len(own)
        if len(memo) > _MEMO:
            memo.clear()
    return marked % _CLEAR, marked // _CLEAR, total


def _features(faint: np.ndarray, clear: np.ndarray, total: np.ndarray) -> np.ndarray:
    dense = [np.log1p(1000.0 * m / np.maximum(total, 20)) for m in (faint, clear)]
    return np.stack([np.ones(len(total)), *(np.log1p(m.astype(np.float64)) for m in (faint, clear)), *dense], axis=1)


def labelled(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE_ROWS) -> DataFrame:
    """text and label of the learning rows, about ``sample`` of each label; of several labels of a document the largest counts.

    The sample is drawn from the labels, by a hash of the identifier, before any text is read: it is bounded,
    so it is broadcast and texts are not shuffled.
    """
    learning = common.fold(F.col("doc_id"), _FOLD_PARTS) != _HELD_OUT
    marks = labels.where(learning).groupBy("doc_id").agg(F.max(column).cast("int").alias("label")).where("label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, sample / sizes.get(1, 1))).otherwise(min(1.0, sample / sizes.get(0, 1)))
    drawn = marks.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / 1_000_003.0 < share)
    return docs.where(learning).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "label")


def fit(rows: DataFrame) -> ToxicityModel:
    """Train both dictionaries, window thresholds and text weights from a bounded sample (text, label 0 or 1).

    Spark counts in how many sample texts of each label a string occurs; the strings most telling by their
    likelihood ratio make the toxic dictionary, the commonest ordinary words the part both share. What
    reaches the driver is bounded by the parameters above. Without both labels nothing is ever marked.
    """
    drawn = common.stored(rows, "toxic-sample")
    n = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    if not (n.get(0) and n.get(1)):
        return _NEVER
    base, toxic = _dictionaries(drawn, n[1], n[0])
    if not toxic:
        return _NEVER
    model = ToxicityModel(base, toxic, _limits(drawn, base, toxic), ())
    return replace(model, weights=_weights(drawn, model))


def _dictionaries(drawn: DataFrame, n1: int, n0: int) -> tuple[bytes, bytes]:
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1)):
                counts[label.as_py()].update(strings(text.as_py()))
            both = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([counts[1][s] for s in both], pa.int64()), pa.array([counts[0][s] for s in both], pa.int64())], ["s", "a", "b"])

    counted = common.stored(drawn.select("text", "label").mapInArrow(occurrences, "s string, a long, b long").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b > 2"), "toxic-strings")
    a, b, all_ = F.col("a"), F.col("b"), n1 + n0
    part = lambda o, e: F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0)
    p = (a + b) / all_
    ratio = 2 * (part(a, p * n1) + part(n1 - a, (1 - p) * n1) + part(b, p * n0) + part(n0 - b, (1 - p) * n0))
    telling = counted.where((a >= LEAST_TEXTS) & (a / n1 > LEAST_RATIO * (b + 0.5) / n0)).withColumn("g", ratio).orderBy(F.desc("g"), "s").limit(10 * TOXIC_STRINGS).collect()
    common_words = counted.where(F.col("s").endswith(" ")).orderBy(F.desc("b"), "s").limit(BASE_WORDS).collect()
    base = "".join(r["s"].rstrip() for r in reversed(common_words)).encode() + b" "
    same = {(r["s"][:k], r["a"], r["b"]) for r in telling for k in range(SHORTEST + 1, len(r["s"]))}
    # of a word and its beginnings with the same counts the longest is enough
    chosen = [r["s"] for r in telling if (r["s"], r["a"], r["b"]) not in same][:TOXIC_STRINGS]
    return base.rjust(256), "".join(reversed(chosen)).encode()


def _limits(drawn: DataFrame, base: bytes, toxic: bytes) -> tuple[tuple[int, int], ...]:
    """For each window length, the least distances of at least 3 that few enough ordinary windows reach.

    Lengths from twice a dictionary string's on are one class: a longer word can match no more than a shorter one.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(base, toxic)
        for batch in batches:
            seen = Counter()
            for text in batch.column(0):
                seen.update(words(text.as_py()))
            found = Counter()
            for w, k in seen.items():
                found[min(len(w), 2 * LONGEST), distance(w)] += k
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["size", "d", "n"])

    found = drawn.where("label = 0").select("text").mapInArrow(spread, "size long, d long, n long").groupBy("size", "d").agg(F.sum("n").alias("n")).toPandas()
    limits = []
    for size in range(2 * LONGEST + 1):
        own = found[found["size"] == size]
        most = [own["n"].sum() * rate for rate in ORDINARY_RATES]
        limits.append(tuple(next(d for d in range(3, 1 << 20) if own.loc[own["d"] >= d, "n"].sum() <= m) for m in most))
    return tuple(limits)


def _weights(drawn: DataFrame, model: ToxicityModel) -> tuple[float, ...]:
    """Logistic regression of the label on a text's marks, moved so that the best F1 lies at the threshold.

    The table has a row for each combination of counts in the sample, so at most as many as the sample.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faint, clear, total = _marks(common.text_column(batch, "text"), model)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(faint), pa.array(clear), pa.array(total)], names)

    names = ["label", "faint", "clear", "n"]
    table = drawn.select("text", "label").mapInArrow(count, "label int, faint long, clear long, n long").groupBy(*names).agg(F.count("*").alias("k")).toPandas().sort_values(names)
    x, y, k = _features(*(table[c].to_numpy() for c in names[1:])), table["label"].to_numpy(float), table["k"].to_numpy(float)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a light ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.append(0.0, np.full(len(w) - 1, 1e-4 * k.sum()))
        w = w - np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6), x.T @ (k * (p - y)) + ridge * w)
    z = x @ w
    order = np.argsort(-z, kind="stable")
    tp, fp = np.cumsum((k * y)[order]), np.cumsum((k * (1 - y))[order])
    last = np.append(np.diff(z[order]) < -1e-9, True)
    # a cut that is wrong more often than right is none; the texts without any mark stay below in any case
    usable = last & (tp >= fp) & (z[order] > w[0] + 1e-9)
    f1 = np.where(usable, 2 * tp / (tp + fp + (k * y).sum()), -1.0)
    best = int(np.argmax(f1))
    below = z[order][best + 1] if best + 1 < len(z) else w[0]
    cut = (z[order][best] + below) / 2 if f1[best] > 0 else z.max() + 1
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return tuple(map(float, w))


def predict(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` (doc_id by default) with score (0 to 1) and predicted, of every whole text.

    Null and empty texts get the score of a text without marks. Only the text decides, so ties and repeated rows
    score alike; a null identifier stays null. Columns named score or predicted are replaced. An empty table gives
    an empty result. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the dictionaries' sizes

    def score(col: pa.Array) -> list[pa.Array]:
        p = 1 / (1 + np.exp(-np.clip(_features(*_marks(col, shared.value)) @ np.array(shared.value.weights), -30, 30)))
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return common.map_texts(docs, text_col, keep or ["doc_id"], "score double, predicted int", score)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(labelled(docs, common.read(spark, sf_dir, "labels")))
    held_out = common.fold(F.col("doc_id"), _FOLD_PARTS) == _HELD_OUT
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
