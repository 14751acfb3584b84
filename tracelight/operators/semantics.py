"""Template texts as term weights, dense vectors and nearest templates, by joins and aggregates over (event, term) rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .vocab import with_templates

#: Columns of the range finder beyond the dimensions asked for, and its power iterations.
MORE, ROUNDS = 8, 6
#: For a first bound of a template's neighbours: so many of its rarest terms, and of each so many templates that weigh it most.
RARE_TERMS, HEAVIEST = 6, 8
#: Cosines that agree to so many places count as equal.
PLACES = 9


def term_weights(vocab: DataFrame, templates: DataFrame) -> DataFrame:
    """(event, term, w): TF-IDF of words and pairs of neighbouring words, rows of unit length.

    Words are runs of letters in lower case; idf is ln((1 + n) / (1 + df)) + 1 over all n events. A template that is missing
    or holds no letter has no rows.
    """
    text = with_templates(vocab.select("event"), templates).withColumn("text", F.when(F.col("text") == F.col("event"), "").otherwise(F.col("text")))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    terms = text.withColumn("words", words).select("event", F.explode(F.concat("words", pairs)).alias("term")).groupBy("event", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    size = text.agg(F.count("*").alias("n"))
    raw = terms.join(df, "term").crossJoin(F.broadcast(size)).withColumn("raw", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # size: one row
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("event")))
    return raw.select("event", "term", (F.col("raw") / length).alias("w"))


def _names(n: int) -> list[str]:
    return [f"y{j}" for j in range(n)]


def _normal(seed: Column) -> Column:
    """A standard normal number from two hashes of ``seed``."""
    unit = lambda k: (F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.ln(unit(0))) * F.cos(2 * np.pi * unit(1))


def _gram(rows: DataFrame, n: int) -> np.ndarray:
    """The n x n matrix of sums of products of columns; nothing longer reaches the driver."""
    y = _names(n)
    found = rows.agg(*(F.sum(F.col(y[i]) * F.col(y[j])).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n))).first()
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = found[f"g{i}_{j}"] or 0.0
    return out


def _times(rows: DataFrame, key: str, n: int, by: np.ndarray) -> DataFrame:
    """``rows`` (key, y0, ...) times a small matrix."""
    y = _names(n)
    made = [sum((F.col(y[i]) * float(by[i, j]) for i in range(n)), F.lit(0.0)).alias(f"y{j}") for j in range(by.shape[1])]
    return rows.select(key, *made)


def _orthonormal(rows: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """Orthonormal columns of the same span, twice for precision; those of no length are dropped."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(_gram(rows, n))
        kept = values > 1e-13 * max(values[-1], 1e-300)
        if not kept.any():
            return rows, 0
        rows = stored(_times(rows, key, n, vectors[:, kept] / np.sqrt(values[kept])), "range")
        n = int(kept.sum())
    return rows, n


def _applied(weights: DataFrame, rows: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """Sums of w times the row of ``key``, for each ``other``."""
    return weights.join(rows, key).groupBy(other).agg(*(F.sum(F.col("w") * F.col(y)).alias(y) for y in _names(n)))


def reduced(weights: DataFrame, dims: int, rounds: int = ROUNDS) -> DataFrame:
    """(event, vector): the rows of ``weights`` in the space of their ``dims`` largest singular values (fewer if the rank is less).

    A randomised range finder: the columns of A are mixed with hashed normal numbers and sharpened by power
    iterations with A times its transpose, each an aggregate over the entries; only matrices of (dims + MORE) columns
    squared are solved on the driver. Coordinates are those of A times the right singular vectors, each signed so
    that its column sums to a positive number.
    """
    n = dims + MORE
    noise = [F.sum(F.col("w") * _normal(F.concat_ws("/", "term", F.lit(str(j))))).alias(f"y{j}") for j in range(n)]
    rows, n = _orthonormal(stored(weights.groupBy("event").agg(*noise), "range"), "event", n)
    for _ in range(rounds if n else 0):
        rows, n = _orthonormal(stored(_applied(weights, _applied(weights, rows, "event", "term", n), "term", "event", n), "range"), "event", n)
    if not n:
        return weights.select("event").distinct().select("event", F.array().cast("array<double>").alias("vector"))
    values, vectors = np.linalg.eigh(_gram(stored(_applied(weights, rows, "event", "term", n), "range"), n))
    first = np.argsort(-values)[:dims]
    first = first[values[first] > 1e-12 * values.max()]
    made = _times(rows, "event", n, vectors[:, first] * np.sqrt(values[first]))
    total = made.agg(*(F.sum(y).alias(y) for y in _names(len(first)))).first()
    signs = [-1.0 if total[y] < 0 else 1.0 for y in _names(len(first))]
    return made.select("event", F.array(*(F.col(y) * s for y, s in zip(_names(len(first)), signs))).alias("vector"))


def template_vectors(vocab: DataFrame, templates: DataFrame, dims: int = 16) -> DataFrame:
    """(event, vector): term weights reduced to at most ``dims`` places, unit rows, scaled to a largest entry of .1; zeros without a template."""
    weights = stored(term_weights(vocab, templates), "term-weights")
    sizes = weights.agg(F.countDistinct("term")).first()[0], vocab.count()
    k = max(1, min(dims, sizes[0] - 1, sizes[1] - 1))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = stored(reduced(weights, k).withColumn("vector", F.transform("vector", lambda x: F.coalesce(x / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))), "unit-vectors")
    top = unit.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("top"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("size"))
    scaled = vocab.select("event").join(unit, "event", "left").crossJoin(F.broadcast(top))  # one row
    value = F.transform("vector", lambda x: F.coalesce(x * 0.1 / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)))
    return scaled.select("event", F.coalesce(value, F.array_repeat(F.lit(0.0), F.col("size"))).alias("vector"))


def _cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(event, other, cosine) of pairs."""
    a = pairs.join(weights.select("event", "term", "w"), "event")
    b = weights.select(F.col("event").alias("other"), "term", F.col("w").alias("v"))
    return a.join(b, ["other", "term"]).groupBy("event", "other").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))


def _ranked(cosines: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("event").orderBy(F.round("cosine", PLACES).desc(), "other")
    return cosines.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidates(weights: DataFrame, k: int) -> DataFrame:
    """(event, other): pairs among which are the ``k`` most similar others of each template.

    A few others that share a rare term give a bound that the k-th cosine reaches. A template's terms are then taken
    from the rarest on until those left, by the largest weight that each has anywhere and by their length, add up to
    less than the bound: who shares none of the terms taken cannot be among the first, nor who reaches too little
    on them.
    """
    df = weights.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("most")).where("df > 1")
    terms = stored(weights.join(df, "term"), "shared-terms")
    rare = terms.withColumn("r", F.row_number().over(Window.partitionBy("event").orderBy("df", F.desc("w"), "term"))).where(F.col("r") <= RARE_TERMS)
    heavy = terms.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w"), "event"))).where(F.col("r") <= HEAVIEST)
    some = rare.select("event", "term").join(heavy.select(F.col("event").alias("other"), "term"), "term").where("event <> other").select("event", "other").distinct()
    bound = _ranked(_cosines(some, weights), k).groupBy("event").agg(F.min("cosine").alias("low"), F.count("*").alias("n"))
    bound = bound.select("event", F.when(F.col("n") == k, F.col("low")).otherwise(0.0).alias("bound"))
    rest = Window.partitionBy("event").orderBy(F.desc("df"), "w", "term").rowsBetween(Window.unboundedPreceding, 0)
    left = F.least(F.sum(F.col("w") * F.col("most")).over(rest), F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest)))
    least = F.coalesce("bound", F.lit(0.0)) - 1e-9
    cut = terms.withColumn("left", left).join(bound, "event", "left").select("event", "term", "w", "left", least.alias("least"))
    rest = cut.groupBy("event").agg(F.coalesce(F.max(F.when(F.col("left") < F.col("least"), F.col("left"))), F.lit(0.0)).alias("rest"))
    taken = cut.where("left >= least").join(terms.select(F.col("event").alias("other"), "term", F.col("w").alias("v")), "term").where("event <> other")
    met = taken.groupBy("event", "other").agg(F.sum(F.col("w") * F.col("v")).alias("part"), F.first("least").alias("least")).join(rest, "event")
    return met.where(F.col("part") + F.col("rest") >= F.col("least")).select("event", "other")


def most_similar(weights: DataFrame, k: int = 3) -> DataFrame:
    """(event, other, cosine, rank): the ``k`` most similar other templates of each, exactly; those that share no term are none.

    Equal cosines go by name. The pairs compared are ``candidates``, not all.
    """
    return _ranked(_cosines(stored(candidates(weights, k), "similar-pairs"), weights), k).select("event", "other", "cosine", "rank")
