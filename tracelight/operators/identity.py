"""Sequence identity and timing of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import quantiles


def census(sequences: DataFrame) -> DataFrame:
    """Q01: distinct sequences, per 1,000 sessions, and the share of the commonest."""
    own = sequences.groupBy("sequence").agg(F.count("*").alias("n"))
    out = own.agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_sessions"), F.max("n").alias("top"))
    return out.select("n_distinct", "n_sessions", (1000.0 * F.col("n_distinct") / F.col("n_sessions")).alias("per_1000"), (F.col("top") / F.col("n_sessions")).alias("top_share"))


def twins(sequences: DataFrame) -> DataFrame:
    """Q02: normal sessions with the same sequence, for each anomalous one. Counted per sequence before the join."""
    normal = sequences.where("y = 0").groupBy("sequence").agg(F.count("*").alias("n_twins"))
    return sequences.where("y = 1").join(normal, "sequence", "left").withColumn("n_twins", F.coalesce("n_twins", F.lit(0)))


def recall_ceiling(sequences: DataFrame) -> DataFrame:
    """Q03: share of anomalous sessions without a normal twin."""
    alone = sequences.where("y = 1").join(sequences.where("y = 0").select("sequence").distinct(), "sequence", "left_anti")
    n = sequences.where("y = 1").agg(F.count("*").alias("n_anomalous"))
    return alone.agg(F.count("*").alias("n_alone")).crossJoin(n).withColumn("ceiling", F.coalesce(F.col("n_alone") / F.nullif(F.col("n_anomalous"), F.lit(0)), F.lit(0.0)))


def timing(log: DataFrame, key: str = "session_id") -> DataFrame:
    """Q04: duration, count, gap statistics (seconds) and rate of each session."""
    order = Window.partitionBy(key).orderBy("ts", "line_no")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(order), F.col("ts")) / 1e6
    gapped = log.select(key, "ts", gap.alias("gap"))
    out = gapped.groupBy(key).agg(
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6).alias("duration"), F.count("*").alias("n"), F.avg("gap").alias("gap_mean"), F.percentile("gap", F.lit(0.5)).alias("gap_median"), F.stddev_pop("gap").alias("gap_std"), F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"),
    )
    return out.withColumn("rate", F.when(F.col("duration") > 0, F.col("n") / F.col("duration")))


def duration_summary(timed: DataFrame) -> DataFrame:
    """Q05: count, median, mean, min and max of the duration by label."""
    own = timed.groupBy("y").agg(F.count("*").alias("n"), F.avg("duration").alias("mean"), F.min("duration").alias("lo"), F.max("duration").alias("hi"))
    return own.join(quantiles(timed, "duration", {"median": 0.5}, ["y"]), "y")


def slot_features(slots: DataFrame, names: list[str], key: str = "session_id") -> DataFrame:
    """Q06: per session, the mean of each numeric slot and the distinct values of each categorical one."""
    numeric = F.avg(F.when(F.col("kind") == "numeric", F.expr("try_cast(value as double)")))
    return slots.groupBy(key).pivot("slot", names).agg(numeric.alias("mean"), F.countDistinct(F.when(F.col("kind") == "categorical", F.col("value"))).alias("distinct"))


def majority_source(lines: DataFrame, key: str = "block_id") -> DataFrame:
    """(key, source): the source that most lines of a block come from, the first by name of several."""
    own = lines.groupBy(key, "source").agg(F.count("*").alias("__n"))
    return own.groupBy(key).agg(F.min(F.struct(-F.col("__n"), "source"))["source"].alias("source"))
