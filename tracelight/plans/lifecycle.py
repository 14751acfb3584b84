"""The detection lifecycle over the events table: log, windows, split, model, signals and scores.

Each part is written to the shared folder once for a session and input folder and read by every query that needs it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model, scores, sessions, splits, vocab
from ..shared import generation, stored

WIDTH = 20
ALERT_VALUE = 200
PLACES = 9
KEYS = ["block_id", "ordinal", "y", "n_events", "split"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Lifecycle:
    """``source`` keeps the lines of one source only; ``chronological`` trains on the past and judges the future."""

    def __init__(self, spark: SparkSession, sf_dir: str, source: int | None = None, chronological: bool = False):
        self.spark, self.sf_dir, self.source, self.split = spark, sf_dir, source, splits.chronological if chronological else splits.stratified

    @cached_property
    def log(self) -> DataFrame:
        if self.split is splits.chronological and self.source is None:
            return lifecycle(self.spark, self.sf_dir).log
        e = read(self.spark, self.sf_dir, "events")
        e = e if self.source is None else e.where(F.col("event_id") % 3 == self.source)
        view = e.select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("event"), (F.col("event_id") % 3).cast("string").alias("source"),
            F.when(F.col("value") >= ALERT_VALUE, 1).otherwise(0).alias("alert"), "value", F.get_json_object("props", "$.k").cast("long").alias("slot"),
        )
        return stored(sessions.numbered(view, ["ts", "event_id"], F.col("ts"), F.col("event_id")), "log")

    @cached_property
    def events(self) -> DataFrame:
        return stored(sessions.count_windows(self.log, WIDTH), "block-events")

    @cached_property
    def blocks(self) -> DataFrame:
        own = self.events.groupBy("block_id", "ordinal").agg(F.max("alert").alias("y"), F.count("*").alias("n_events"))
        return stored(self.split(own).select(*KEYS), "blocks")

    @cached_property
    def vocab(self) -> DataFrame:
        return stored(vocab.fit(self.log), "vocab")

    @cached_property
    def windows(self) -> DataFrame:
        """Windows with as many events of their context as the model asks for, and its whole length; see ``sequences``."""
        cut = sessions.in_block_windows(self.events.select("block_id", "pos", "event"), model.ORDER).withColumn("ctx_len", F.least("pos", F.lit(sessions.CONTEXT)))
        return stored(cut.join(self.placed, "block_id"), "windows")

    @property
    def placed(self) -> DataFrame:
        """(block_id, y, split) to join windows with: merged, as windows are sorted by block already and the blocks' small file holds too many rows to broadcast."""
        return self.blocks.select("block_id", "y", "split").hint("merge")

    @property
    def sequences(self) -> DataFrame:
        """(block_id, pos, sequence): whole contexts, made anew for the queries that show them."""
        return sessions.in_block_windows(self.events.select("block_id", "pos", "event")).select("block_id", "pos", F.col("ctx").alias("sequence"))

    @cached_property
    def model(self) -> tuple[DataFrame, DataFrame]:
        return model.fit(self.windows.where("split = 'tr' and y = 0"), self.vocab)

    @cached_property
    def signals(self) -> DataFrame:
        return stored(model.score(self.windows, self.model, self.vocab), "signals")

    @cached_property
    def wide(self) -> DataFrame:
        every = scores.all_scores(self.blocks, self.signals, F.col("split") == "va")
        return stored(every.select(*KEYS, "msp_mean", *(F.round(F.col(c).cast("double"), PLACES).alias(c) for c in scores.NAMES)), "scores")

    @cached_property
    def scored(self) -> DataFrame:
        """(block_id, y, split, score): the detection score, mean -log p."""
        return self.wide.select("block_id", "ordinal", "y", "split", F.col("nll_mean").alias("score"))

    @cached_property
    def long(self) -> DataFrame:
        return scores.long_scores(self.wide, ["block_id", "y", "split"])

    def part(self, split: str) -> DataFrame:
        return self.scored.where(F.col("split") == split)


_KNOWN: dict[tuple, Lifecycle] = {}


def lifecycle(spark: SparkSession, sf_dir: str, source: int | None = None, chronological: bool = False) -> Lifecycle:
    key = (spark.sparkContext.applicationId, generation(), sf_dir, source, chronological)
    if key not in _KNOWN:
        _KNOWN[key] = Lifecycle(spark, sf_dir, source, chronological)
    return _KNOWN[key]
