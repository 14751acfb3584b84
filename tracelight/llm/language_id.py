"""Language identification by nearest centroid over TF-IDF byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hashed n-gram dimensions.
DIMS = 4096
#: Learning rows of each language, drawn by a hash of their identifier; all of them where there are fewer.
SAMPLE_PER_LANGUAGE = 1500
CENTROIDS = 4
ROUNDS = 12
UNKNOWN = "und"
#: Length classes of texts begin at so many characters; shorter texts are never rejected for distance.
LENGTHS = (16, 64, 256, 1024)
#: A text is rejected where its cosine is below this share of the low quantile of sample texts cut to its length class.
REJECT_SHARE, LOW_QUANTILE = 0.5, 0.01
_FOLD_PARTS, _HELD_OUT = 3, 1

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)


def padded(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with a space before and after each and one for each non-letter, and their offsets."""
    rows = len(at) - 1
    joined = np.full(len(body) + 2 * rows, 32, np.uint8)
    joined[np.arange(len(body)) + 2 * np.repeat(np.arange(rows), np.diff(at)) + 1] = _LETTERS[body]
    return joined, at + 2 * np.arange(rows + 1)


def gram_counts(joined: np.ndarray, at: np.ndarray, dims: int = DIMS, most: int | None = None) -> np.ndarray:
    """Counts of hashed 2- and 3-byte grams inside the words of each padded row, spaces at their ends included.

    Of one row, only grams that start before byte ``most`` may be asked for.
    """
    rows = len(at) - 1
    doc = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros(rows * dims, np.float32)
    a = joined.astype(np.uint64)
    for size in (2, 3):
        if len(a) < size:
            continue
        code = a[: len(a) - size + 1].copy()
        for k in range(1, size):
            code = code << np.uint64(8) | a[k : len(a) - size + 1 + k]
        spaces = (joined[: len(code)] == 32) & (joined[1 : len(code) + 1] == 32)
        if size == 3:
            spaces |= joined[1 : len(code) + 1] == 32  # nothing across words, whatever stands between them
        bucket = (common.mixed(code + np.uint64(size << 32)) % np.uint64(dims)).astype(np.int64)
        keep = ~spaces
        if most is not None:
            keep[most:] = False
        out += np.bincount(doc[: len(code)][keep] * dims + bucket[keep], minlength=rows * dims).astype(np.float32)
    return out.reshape(rows, dims)


def _batches(col: pa.Array, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges of a text column and their gram counts."""
    body, at = common.raw_bytes(pa.concat_arrays([pc.utf8_lower(col)]))
    for a, b in common.steps(at):
        joined, own = padded(body[at[a] : at[b]], at[a : b + 1] - at[a])
        size = common.STEP_BYTES
        if b - a == 1 and len(joined) > size + 2:  # one huge text: slices with the two bytes that their last grams reach into
            parts = (joined[x : x + size + 2] for x in range(0, len(joined), size))
            counts = sum(gram_counts(part, np.array([0, len(part)]), dims, size) for part in parts)
        else:
            counts = gram_counts(joined, own, dims)
        yield a, b, counts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; term frequencies are dampened by a logarithm."""
    return _unit(np.log1p(counts) * idf)


def spherical_means(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Up to ``k`` unit centroids of unit vectors; each next start is the vector least like the ones so far."""
    picks = [int(np.random.default_rng(seed).integers(len(x)))]
    best = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[picks[-1]])
    centres = x[picks]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres = _unit(np.where(filled[:, None], sums, centres))
    return centres


def _vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    return np.concatenate([weighted(c, idf) for _, _, c in _batches(texts, len(idf))])


@dataclass(frozen=True)
class LanguageModel:
    """Languages, inverse document frequencies, unit centroids with their language, and rejection limits by centroid and length class."""

    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    language: np.ndarray
    limits: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS, dims: int = DIMS) -> LanguageModel:
    """Learn from rows with a language and letters.

    Document frequencies count every learning row. Centroids are clustered for each language by one task
    from at most about ``sample`` rows, drawn by a hash of the identifier, so a frequent language costs no
    more than a rare one. The same rows, cut to each length class, give the rejection limits: a low quantile,
    so that no single odd row decides. Only the document frequencies (``dims`` rows) and the centroids reach the
    driver. Null identifiers count as one, ties and repeated rows as any other rows; an empty table gives a model
    without languages.
    """
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("lang is not null and text rlike '\\\\p{L}'")

    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for a, b, counts in _batches(common.text_column(batch, "text"), dims):
                total += (counts > 0).sum(0)
                n += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(np.append(total, n))], ["slot", "n"])

    totals = {r["slot"]: r["n"] for r in rows.select("text").mapInArrow(document_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    found = np.array([totals.get(i, 0) for i in range(dims + 1)], np.float64)
    idf = np.log((found[dims] + 1) / (found[:dims] + 1)).astype(np.float32)

    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], idf, np.zeros((0, dims), np.float32), np.zeros(0, np.int64), np.zeros((0, len(LENGTHS) + 1)))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < share[F.col("lang")])

    def cluster(key: tuple[str], pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(pdf["text"], pa.large_string())
        centres = spherical_means(_vectors(texts, idf), centroids, ROUNDS)
        limits = [0.0]
        for letters in LENGTHS:
            long = texts.filter(pc.greater_equal(pc.utf8_length(texts), letters))
            near = _vectors(pc.utf8_slice_codeunits(long, 0, letters), idf) @ centres.T if len(long) else np.zeros((1, 1))
            limits.append(REJECT_SHARE * float(np.quantile(near.max(axis=1), LOW_QUANTILE)))
        return pd.DataFrame({"lang": key[0], "centre": [c.astype("<f4").tobytes() for c in centres], "limits": [limits] * len(centres)})

    rows_out = drawn.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, limits array<double>").collect()
    rows_out.sort(key=lambda r: (r["lang"], bytes(r["centre"])))
    languages = sorted({r["lang"] for r in rows_out})
    centres = np.array([np.frombuffer(bytes(r["centre"]), "<f4") for r in rows_out], np.float32).reshape(-1, dims)
    return LanguageModel(languages, idf, centres, np.array([languages.index(r["lang"]) for r in rows_out]), np.array([r["limits"] for r in rows_out]).reshape(-1, len(LENGTHS) + 1))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (doc_id by default) with lang_pred, score (cosine with the nearest centroid) and rejected, of every whole text.

    Without a letter (null and empty texts too) a text is ``und`` with score 0 and rejected. Any other gets
    the language of its nearest centroid, the first in name order of equal ones, and is rejected where it is
    too far from it for a text of its length. A model without languages gives ``und`` throughout. Only the text
    decides, so repeated rows get equal results; columns of the three names are replaced, and a null identifier
    stays null. An empty table gives an empty result. No shuffle.
    """
    dims = len(model.idf)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: dims x (centroids x languages)

    def score(col: pa.Array) -> list[pa.Array]:
        m = shared.value
        best, cosine = np.full(len(col), -1, np.int64), np.zeros(len(col))
        length = np.searchsorted(LENGTHS, pc.utf8_length(col).to_numpy(zero_copy_only=False), side="right")
        if len(m.centres):
            for a, b, counts in _batches(col, dims):
                near = weighted(counts, m.idf) @ m.centres.T
                best[a:b], cosine[a:b] = np.argmax(near, axis=1), near.max(axis=1)
        known = pc.match_substring_regex(col, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool) & (best >= 0)
        names = [m.languages[m.language[k]] if ok else UNKNOWN for k, ok in zip(best, known)]
        cosine = np.where(known, np.clip(cosine, 0, 1), 0.0)
        far = ~known | (cosine < np.append(m.limits, np.zeros((1, len(LENGTHS) + 1)), axis=0)[best, length])
        return [pa.array(names, pa.string()), pa.array(cosine), pa.array(far)]

    return common.map_texts(docs, text_col, keep or ["doc_id"], "lang_pred string, score double, rejected boolean", score)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.fold(F.col("doc_id"), _FOLD_PARTS) == _HELD_OUT
    found = predict(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
