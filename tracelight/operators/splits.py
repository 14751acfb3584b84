"""Reproducible splits and samples of blocks; order comes from a portable hash, never from file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import ranked

SEED = 42


def seeded_hash(key: Column, seed: int = SEED) -> Column:
    """The first 32 bits of md5(key || seed)."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def _cut(rank: Column, n: Column) -> Column:
    """70 / 10 / 20 by 1-based rank, in whole numbers."""
    return F.when(rank * 10 <= n * 7, "tr").when(rank * 10 <= n * 8, "va").otherwise("te")


def stratified(blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """``split`` tr / va / te, 70 / 10 / 20 within each label."""
    hashed = blocks.withColumn("h", seeded_hash(F.col("block_id"), seed))
    sized = hashed.join(hashed.groupBy("y").agg(F.count("*").alias("__n")), "y")
    placed = ranked(sized, [F.col("h"), F.col("block_id")], F.col("h"), "__r", ["y"])
    return placed.withColumn("split", _cut(F.col("__r"), F.col("__n"))).drop("__r", "__n", "h")


def chronological(blocks: DataFrame) -> DataFrame:
    """First 70 %, next 10 %, last 20 % by ordinal (0-based)."""
    n = blocks.agg(F.count("*").alias("__n"))
    placed = blocks.crossJoin(F.broadcast(n))  # one row
    first, second = F.floor(F.col("__n") * 7 / 10), F.floor(F.col("__n") * 8 / 10)
    return placed.withColumn("split", F.when(F.col("ordinal") < first, "tr").when(F.col("ordinal") < second, "va").otherwise("te")).drop("__n")


def anomaly_holdout(blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """Every anomalous block to the test split, normal ones split as in ``stratified``."""
    normal = stratified(blocks.where("y = 0"), seed)
    return normal.unionByName(blocks.where("y = 1").withColumn("split", F.lit("te")))


def normal_only(blocks: DataFrame) -> DataFrame:
    """Normal training blocks."""
    return blocks.where("split = 'tr' and y = 0")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement, in the order of a seeded hash."""
    return df.withColumn("h", seeded_hash(F.col(key), seed)).orderBy("h", key).limit(n).drop("h")


def first_rows(df: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` rows in order."""
    return df.where(F.col(ordinal) < n)


def exemplars(band: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """``k`` blocks of a band, half anomalous, the rest normal."""
    order = Window.partitionBy("y").orderBy("h", "block_id")
    placed = band.withColumn("h", seeded_hash(F.col("block_id"), seed)).withColumn("__r", F.row_number().over(order))
    return placed.where(F.col("__r") <= F.when(F.col("y") == 1, k // 2).otherwise(k - k // 2)).drop("h", "__r")


def audit(split_blocks: DataFrame, events: DataFrame) -> DataFrame:
    """Per split its size, anomalies, base rate and distinct events that training never saw."""
    own = events.join(split_blocks.select("block_id", "split"), "block_id").select("split", "event").distinct()
    seen = own.where("split = 'tr'").select("event")
    unseen = own.join(seen, "event", "left_anti").groupBy("split").agg(F.count("*").alias("unseen_events"))
    sizes = split_blocks.groupBy("split").agg(F.count("*").alias("n_blocks"), F.countDistinct("block_id").alias("n_distinct"), F.sum("y").alias("n_anomalous"), F.round(F.avg("y"), 6).alias("base_rate"))
    return sizes.join(unseen, "split", "left").withColumn("unseen_events", F.coalesce("unseen_events", F.lit(0)))
