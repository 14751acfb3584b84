"""Evaluation: curves by distinct score, confusion counts, ranking quality, distributions and comparisons.

Curves are built from one row for each distinct score with running sums by value range, never from a sort of
all rows in one partition. ``by`` names columns that separate several score sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import quantiles, running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def curve(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per distinct score p, q (its positives and negatives), cp, cq (those at or above it) and the totals tp, tn."""
    by = by or []
    points = scored.groupBy(*by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    totals = scored.groupBy(*by).agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("tn"))
    summed = running(points, [F.col("score").desc()], {"cp": F.col("p"), "cq": F.col("q")}, F.col("score"), by, descending=True)
    return summed.join(totals, by) if by else summed.crossJoin(F.broadcast(totals))


def precision_recall(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision and recall when rows at or above each threshold count as positive."""
    c = curve(scored, by)
    return c.select(*(by or []), F.col("score").alias("threshold"), ratio(F.col("cp"), F.col("cp") + F.col("cq")).alias("precision"), ratio(F.col("cp"), F.col("tp")).alias("recall"))


def roc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """False and true positive rate at each distinct score."""
    return curve(scored, by).select(*(by or []), F.col("score").alias("threshold"), ratio(F.col("cq"), F.col("tn")).alias("fpr"), ratio(F.col("cp"), F.col("tp")).alias("tpr"))


def ranking_quality(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Auroc (ties half), pr_auc (average precision) and the two-sample ks distance."""
    p, q, cp, cq, tp, tn = (F.col(c) for c in ("p", "q", "cp", "cq", "tp", "tn"))
    own = curve(scored, by).groupBy(*(by or [])).agg(
        ratio(F.sum((cp - p) * q + p * q * 0.5), F.max(tp * tn)).alias("auroc"), F.sum(ratio(p, tp) * ratio(cp, cp + cq)).alias("pr_auc"), F.max(F.abs(ratio(cp - p, tp) - ratio(cq - q, tn))).alias("ks"), F.max("tp").alias("n_pos"), F.max("tn").alias("n_neg"),
    )
    return own


def confusion(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tn, fp, fn, tp of y against pred."""
    y, pred = F.col("y"), F.col("pred")
    return judged.groupBy(*(by or [])).agg(F.count_if((y == 0) & (pred == 0)).alias("tn"), F.count_if((y == 0) & (pred == 1)).alias("fp"), F.count_if((y == 1) & (pred == 0)).alias("fn"), F.count_if((y == 1) & (pred == 1)).alias("tp"))


def prf(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 with 0 for an empty denominator."""
    c = confusion(judged, by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def top_accuracy(scored: DataFrame, ks: tuple[int, ...] = (1, 3, 5), places: int | None = 6) -> DataFrame:
    """Share of windows whose target is among the k most probable events, rounded to ``places``."""
    hit = lambda k: F.avg(F.when(F.col("target_rank").between(1, k), 1.0).otherwise(0.0))
    return scored.agg(F.count("*").alias("n"), *((hit(k) if places is None else F.round(hit(k), places)).alias(f"top{k}") for k in ks))


def per_event(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every event that occurs as target or prediction."""
    true = scored.groupBy(F.col("target").alias("event")).agg(F.count("*").alias("support"), F.count_if(F.col("target") == F.col("predicted")).alias("hits"))
    pred = scored.groupBy(F.col("predicted").alias("event")).agg(F.count("*").alias("n_pred"))
    both = true.join(pred, "event", "full_outer").fillna(0, ["support", "hits", "n_pred"])
    h, s, n = F.col("hits"), F.col("support"), F.col("n_pred")
    return both.select("event", ratio(h, n).alias("precision"), ratio(h, s).alias("recall"), ratio(2 * h, n + s).alias("f1"), "support")


def averages(events: DataFrame) -> DataFrame:
    """Weighted and macro averages of ``per_event``."""
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return events.agg(*(weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def distribution(scored: DataFrame, group: str = "y", value: str = "score") -> DataFrame:
    """Count, mean, median, p90, p99, min and max by group."""
    own = scored.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return own.join(quantiles(scored, value, {"median": 0.5, "p90": 0.9, "p99": 0.99}, [group]), group).select(group, "n", "mean", "median", "p90", "p99", "lo", "hi")


def histogram(scored: DataFrame, value: str, by: list[str], bins: int = 40) -> DataFrame:
    """Density over equal bins of [0, 1], the last one closed, by group."""
    bin_no = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy(*by, bin_no.alias("bin")).agg(F.count("*").alias("n"))
    totals = scored.groupBy(*by).agg(F.count("*").alias("total"))
    return counts.join(totals, by).select(*by, "bin", "n", (F.col("n") * bins / F.col("total")).alias("density"))


def verdict_metrics(verdicts: DataFrame, by: str = "rung") -> DataFrame:
    """Metrics of parsed verdicts (truth 0/1, cls NORMAL/SUSPICIOUS, parse_ok, latency)."""
    sus, y = F.col("cls") == "SUSPICIOUS", F.col("truth")
    c = verdicts.groupBy(by).agg(F.count("*").alias("n"), F.count_if(sus & (y == 1)).alias("tp"), F.count_if(sus & (y == 0)).alias("fp"), F.count_if(~sus & (y == 0)).alias("tn"), F.count_if(~sus & (y == 1)).alias("fn"), F.avg(F.col("parse_ok").cast("double")).alias("parse_rate"), F.avg("latency").alias("mean_latency"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"accuracy": ratio(tp + tn, F.col("n")), "recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "fpr": ratio(fp, fp + tn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2})


def rand_index(parsed: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two groupings of the same rows."""
    two = lambda n: n * (n - 1) / 2
    cells = parsed.groupBy(a, b).agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("both"))
    one = lambda c, name: parsed.groupBy(c).agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias(name))
    all_rows = parsed.agg(two(F.count("*")).alias("pairs"))
    joined = cells.crossJoin(one(a, "left_pairs")).crossJoin(one(b, "right_pairs")).crossJoin(all_rows)  # single rows
    expected = F.col("left_pairs") * F.col("right_pairs") / F.col("pairs")
    return joined.select(ratio(F.col("both") - expected, (F.col("left_pairs") + F.col("right_pairs")) / 2 - expected).alias("ari"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", name: str = "feature") -> DataFrame:
    """Q values: step-up over the (few) tests."""
    order = Window.orderBy(F.col(p), name)
    m = F.count("*").over(Window.partitionBy())
    stepped = tests.withColumn("rank", F.row_number().over(order)).withColumn("raw", F.col(p) * m / F.col("rank"))
    up = Window.orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    return stepped.withColumn("q", F.least(F.min("raw").over(up), F.lit(1.0))).drop("raw")
