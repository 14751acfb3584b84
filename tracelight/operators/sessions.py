"""Sessions and windows: how a log becomes ordered sequences and (context, next event) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import ROWS_PER_RANGE, ranked

CONTEXT = 20


def numbered(events: DataFrame, order: list[str], key: Column, tie: Column | None = None) -> DataFrame:
    """``events`` with a 1-based ``line_no`` in ``order``, whose first column sorts like ``key``, the second like ``tie``."""
    return ranked(events, [F.col(c) for c in order], key, "line_no", tie=tie)


def count_windows(log: DataFrame, width: int) -> DataFrame:
    """Windows of ``width`` lines in file order as block_id, ordinal, pos; a trailing partial one is dropped. Lines are numbered from 1 without gaps."""
    cut = log.withColumn("ordinal", F.floor((F.col("line_no") - 1) / width)).withColumn("pos", ((F.col("line_no") - 1) % width).cast("int"))
    whole = log.agg(F.floor(F.max("line_no") / width).alias("__whole"))  # one row
    return cut.crossJoin(F.broadcast(whole)).where(F.col("ordinal") < F.col("__whole")).drop("__whole").withColumn("block_id", F.concat(F.lit("b"), F.col("ordinal").cast("string")))


def keyed_sessions(log: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("ts", "line_no")) -> DataFrame:
    """(key, events): the events of each key in time order."""
    items = F.array_sort(F.collect_list(F.struct(*order, "event")))
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.transform(items, lambda x: x["event"]).alias("events"))


def any_alert(blocks: DataFrame, key: str = "block_id") -> DataFrame:
    """y = 1 if any line of the block is an alert."""
    return blocks.groupBy(key).agg(F.max("alert").alias("y"))


def session_labels(sessions: DataFrame, labelled: DataFrame, mode: str, key: str = "session_id") -> DataFrame:
    """Y by mode ``strict`` (key among ``labelled``) or ``source`` ('abnormal' among the sources)."""
    if mode == "strict":
        marks = labelled.select(key).distinct().withColumn("__hit", F.lit(1))
        return sessions.join(marks, key, "left").withColumn("y", F.coalesce("__hit", F.lit(0))).withColumn("label_mode", F.lit(mode)).drop("__hit")
    if mode == "source":
        return sessions.withColumn("y", F.array_contains("sources", "abnormal").cast("int")).withColumn("label_mode", F.lit(mode))
    raise ValueError(f"unknown label mode {mode}")


def provenance(log: DataFrame, key: str = "session_id") -> DataFrame:
    """Sorted distinct sources, number of events, first and last time of each session."""
    return log.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def flatten(traces: DataFrame, key: str = "block_id") -> DataFrame:
    """One event per row, in order."""
    return traces.select(key, F.posexplode("events").alias("pos", "event"))


def in_block_windows(events: DataFrame, length: int = CONTEXT, key: str = "block_id") -> DataFrame:
    """For every event but the first of a block: up to ``length`` events before it, and the event itself."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(-length, -1)
    seen = events.withColumn("ctx", F.collect_list("event").over(before)).withColumn("ctx_len", F.size("ctx"))
    return seen.where("ctx_len > 0").withColumnRenamed("event", "target")


def flat_windows(events: DataFrame, length: int, stream: str = "stream_id", order: str = "line_no") -> DataFrame:
    """Windows that cross blocks, only of full length."""
    before = Window.partitionBy(stream).orderBy(order).rowsBetween(-length, -1)
    return events.withColumn("ctx", F.collect_list("event").over(before)).where(F.size("ctx") == length).withColumnRenamed("event", "target")


def length_batches(windows: DataFrame, size: int, keys: list[str], rows_per_part: int = ROWS_PER_RANGE) -> DataFrame:
    """``windows`` with batch_id: batches of ``size`` windows of one context length, so that none needs padding.

    All batches of a length but its last are full. A length is cut by a hash of ``keys`` into parts of about
    ``rows_per_part`` windows; parts are numbered inside and begin where the ones before them end, so no task
    has a whole length.
    """
    lengths = windows.groupBy("ctx_len").agg(F.ceil(F.count("*") / rows_per_part).alias("__parts"))  # a row for each length, of which there are few
    salted = windows.join(F.broadcast(lengths), "ctx_len").withColumn("__part", F.pmod(F.xxhash64(*keys), F.col("__parts"))).drop("__parts")
    before = Window.partitionBy("ctx_len").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("ctx_len", "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("ctx_len", "__part").orderBy(*keys)) - 1
    placed = salted.withColumn("__place", inside).join(counts, ["ctx_len", "__part"])
    return placed.withColumn("batch_id", F.floor((F.col("__before") + F.col("__place")) / size)).drop("__part", "__place", "__before")


def long_enough(encoded: DataFrame, least: int = 2, key: str = "block_id") -> DataFrame:
    """(key, n_known, kept): whether a block has at least ``least`` known events (idx not null)."""
    return encoded.groupBy(key).agg(F.count("idx").alias("n_known")).withColumn("kept", F.col("n_known") >= least)


def labelled_blocks(traces: DataFrame, labels: DataFrame, key: str = "block_id") -> DataFrame:
    """Blocks with their label; those without one are dropped."""
    return traces.join(labels, key)


def lost_labels(labelled: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Labelled keys that no session has."""
    return labelled.join(sessions, key, "left_anti")
