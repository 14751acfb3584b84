"""Window signals aggregated to block scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLL = 5
#: Events with fewer reference windows take the global mean and deviation.
LEAST_REFERENCE = 5
TINY = 1e-8
NAMES = ["msp_uncertainty_max", "surprisal_max", "surprisal_mean", "nll_max", "nll_mean", "miss_count", "miss_frac", "nll_rolling_max", "combined_z", "event_z_mean", "event_z_max"]


def floored_max(x: Column) -> Column:
    """The largest value, at least 0."""
    return F.greatest(F.coalesce(F.max(x), F.lit(0.0)), F.lit(0.0))


def mean_or_zero(x: Column) -> Column:
    """The mean, 0 for a block without windows."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def sum_or_zero(x: Column) -> Column:
    """The sum, 0 for a block without windows."""
    return F.coalesce(F.sum(x), F.lit(0))


def rolling_max(signals: DataFrame, value: str = "nll", width: int = ROLL) -> DataFrame:
    """(block_id, nll_rolling_max): largest mean of ``width`` windows in a row; the plain mean if there are fewer."""
    order = Window.partitionBy("block_id").orderBy("pos")
    frame = order.rowsBetween(-(width - 1), 0)
    moving = signals.select("block_id", F.avg(value).over(frame).alias("m"), F.row_number().over(order).alias("i"), F.avg(value).over(Window.partitionBy("block_id")).alias("plain"), F.count("*").over(Window.partitionBy("block_id")).alias("n"))
    value_of = F.when(F.col("n") < width, F.col("plain")).when(F.col("i") >= width, F.col("m"))
    return moving.groupBy("block_id").agg(F.max(value_of).alias("nll_rolling_max"))


def simple_scores(blocks: DataFrame, signals: DataFrame) -> DataFrame:
    """A01-A03, A05-A07, A10 in one aggregation: ``blocks`` (block_id, ...) with their scores."""
    per = signals.groupBy("block_id").agg(
        floored_max(1 - F.col("msp")).alias("msp_uncertainty_max"), floored_max(F.col("surprisal")).alias("surprisal_max"), mean_or_zero(F.col("surprisal")).alias("surprisal_mean"),
        floored_max(F.col("nll")).alias("nll_max"), mean_or_zero(F.col("nll")).alias("nll_mean"), sum_or_zero(F.col("miss")).alias("miss_count"), mean_or_zero(F.col("miss")).alias("miss_frac"), mean_or_zero(F.col("msp")).alias("msp_mean"),
    )
    names = [c for c in per.columns if c != "block_id"]
    return blocks.join(per, "block_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def combined_z(scores: DataFrame, reference: Column) -> DataFrame:
    """z(nll_max) + z(miss_count), mean and population deviation from the rows where ``reference`` holds."""
    stats = scores.where(reference).agg(*(f(c).alias(f"{n}_{c}") for c in ("nll_max", "miss_count") for f, n in ((F.avg, "mu"), (F.stddev_pop, "sd"))))
    z = lambda c: (F.col(c) - F.col(f"mu_{c}")) / (F.col(f"sd_{c}") + TINY)
    return scores.crossJoin(F.broadcast(stats)).withColumn("combined_z", z("nll_max") + z("miss_count")).drop(*stats.columns)  # stats: one row


def event_z(signals: DataFrame, reference: Column) -> DataFrame:
    """(block_id, event_z_mean, event_z_max): nll against its target event's own distribution in the reference windows."""
    base = signals.where(reference)
    world = base.agg(F.avg("nll").alias("g_mu"), (F.stddev_pop("nll") + TINY).alias("g_sd"))
    own = base.groupBy("target").agg(F.count("*").alias("n"), F.avg("nll").alias("mu"), F.avg(F.col("nll") * F.col("nll")).alias("sq"))
    own = own.select("target", "n", "mu", F.sqrt(F.greatest(F.col("sq") - F.col("mu") * F.col("mu"), F.lit(TINY))).alias("sd"))
    few = F.coalesce(F.col("n"), F.lit(0)) < LEAST_REFERENCE
    joined = signals.join(own, "target", "left").crossJoin(F.broadcast(world))
    z = (F.col("nll") - F.when(few, F.col("g_mu")).otherwise(F.col("mu"))) / F.when(few, F.col("g_sd")).otherwise(F.col("sd"))
    return joined.groupBy("block_id").agg(mean_or_zero(z).alias("event_z_mean"), floored_max(z).alias("event_z_max"))


def all_scores(blocks: DataFrame, signals: DataFrame, reference: Column) -> DataFrame:
    """Every candidate score of each block in one wide table. ``reference`` is over the columns of ``blocks`` and ``signals``."""
    wide = combined_z(simple_scores(blocks, signals), reference)
    for part, names in ((rolling_max(signals), ["nll_rolling_max"]), (event_z(signals, reference), ["event_z_mean", "event_z_max"])):
        wide = wide.join(part, "block_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})
    return wide


def long_scores(wide: DataFrame, keep: list[str], names: list[str] | None = None) -> DataFrame:
    """One row for each block and score: ``keep``, score_name, score."""
    names = names or NAMES
    return wide.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("score_name"), F.col(n).cast("double").alias("score")) for n in names))).alias("s")).select(*keep, "s.score_name", "s.score")
