"""Top-k selections and rank look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import ranked, running
from .splits import seeded_hash


def most_surprising(signals: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` most surprising windows of each block with their rank; ties go to the earliest."""
    order = Window.partitionBy("block_id").orderBy(F.round("surprisal", 12).desc(), "pos")
    return signals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_blocks(banded: DataFrame, n: int, band: str = "ANOMALY") -> DataFrame:
    """The ``n`` most suspicious blocks of a band."""
    return banded.where(F.col("band") == band).orderBy(F.col("score").desc(), "block_id").limit(n)


def percentile_among(scored: DataFrame, reference: DataFrame) -> DataFrame:
    """100 x the share of ``reference`` scores that are strictly smaller; both sides are merged and summed by value range."""
    points = scored.select("score").distinct().select("score", F.lit(0).alias("n")).unionByName(reference.groupBy("score").agg(F.count("*").cast("int").alias("n")))
    points = points.groupBy("score").agg(F.sum("n").alias("n"))
    below = running(points, [F.col("score")], {"c": F.col("n")}, F.col("score")).select("score", (F.col("c") - F.col("n")).alias("below"))
    total = reference.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    return scored.join(below, "score").crossJoin(F.broadcast(total)).withColumn("percentile", 100.0 * F.col("below") / F.col("total")).drop("below", "total")


def confused_pairs(scored: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` commonest pairs of target and different prediction."""
    return scored.where("target <> predicted").groupBy("target", "predicted").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "target", "predicted").limit(n)


def representatives(banded: DataFrame) -> DataFrame:
    """One block for each band: median-ranked true normal, highest true anomaly (else any), and a seeded uncertain one."""
    normal = ranked(banded.where("band = 'NORMAL' and y = 0"), [F.col("score"), F.col("block_id")], F.col("score"), "r")
    n = normal.agg(F.max("r").alias("n"))
    median = normal.crossJoin(n).where("r = floor((n + 1) / 2)").drop("r", "n")
    anomaly = banded.where("band = 'ANOMALY'").orderBy(F.col("y").desc(), F.col("score").desc(), "block_id").limit(1)
    unsure = banded.where("band = 'UNCERTAIN'").orderBy(seeded_hash(F.col("block_id")), "block_id").limit(1)
    return median.unionByName(anomaly).unionByName(unsure)


def budget_hits(scored: DataFrame, budgets: tuple[int, ...] = (39, 100, 200)) -> DataFrame:
    """Anomalies among the top of the ranking for each review budget."""
    top = ranked(scored, [F.col("score").desc(), F.col("block_id")], F.col("score"), "r", descending=True)
    table = scored.sparkSession.createDataFrame([(b,) for b in budgets], "budget int")
    return top.where(F.col("r") <= max(budgets)).join(F.broadcast(table), F.col("r") <= F.col("budget")).groupBy("budget").agg(F.sum("y").alias("hits"), F.count("*").alias("reviewed"))


def tie_census(scored: DataFrame) -> DataFrame:
    """Distinct scores, and normal blocks that share their score with an anomaly."""
    hot = scored.where("y = 1").select("score").distinct()
    tied = scored.where("y = 0").join(hot, "score", "left_semi").agg(F.count("*").alias("tied_normals"))
    return scored.agg(F.countDistinct("score").alias("distinct_scores")).crossJoin(tied)


def duration_rank(timed: DataFrame, marked: str = "y") -> DataFrame:
    """Rank by duration (ties share the smallest) of marked sessions among all."""
    points = timed.groupBy("duration").agg(F.count("*").alias("n"))
    above = running(points, [F.col("duration").desc()], {"c": F.col("n")}, F.col("duration"), descending=True).select("duration", (F.col("c") - F.col("n") + 1).alias("rank"))
    return timed.where(F.col(marked) == 1).join(above, "duration")
