"""Vocabulary, encoding and checks of encoded data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import ranked, text_key


def fit(events: DataFrame) -> DataFrame:
    """(event, idx, n): distinct events in name order with a dense 0-based index."""
    own = events.where("event is not null").groupBy("event").agg(F.count("*").alias("n"))
    return ranked(own, [F.col("event")], text_key(F.col("event")), "__r").withColumn("idx", (F.col("__r") - 1).cast("int")).drop("__r")


def encode(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Events with their index; unknown ones are dropped, order columns stay."""
    return events.join(vocab.select("event", "idx"), "event")


def dropped(events: DataFrame, vocab: DataFrame, key: str = "block_id") -> DataFrame:
    """Unknown events by block."""
    known = events.join(vocab.select("event", "idx"), "event", "left")
    return known.groupBy(key).agg(F.count_if(F.col("idx").isNull()).alias("n_dropped"), F.count("*").alias("n_events"))


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Index to event; out of range becomes <UNK:i>."""
    known = encoded.join(vocab.select("idx", "event"), "idx", "left")
    return known.withColumn("event", F.coalesce("event", F.concat(F.lit("<UNK:"), F.col("idx").cast("string"), F.lit(">"))))


def out_of_range(encoded: DataFrame, size: int) -> DataFrame:
    """Number of indices outside [0, size) and the first of them in (block_id, pos) order."""
    bad = encoded.where((F.col("idx") < 0) | (F.col("idx") >= size))
    first = F.min(F.struct("block_id", "pos", "idx"))
    return bad.agg(F.count("*").alias("n_bad"), first.alias("f")).select("n_bad", F.col("f.block_id").alias("block_id"), F.col("f.pos").alias("pos"), F.col("f.idx").alias("value"))


def consistency(encoded: DataFrame, vocab: DataFrame, windows: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each fact (name, expected, found, ok) of ``expected`` (name, expected)."""
    found = vocab.agg(F.lit("vocab_size").alias("name"), F.count("*").alias("found"))
    found = found.union(windows.agg(F.lit("seq_len"), F.coalesce(F.max("ctx_len"), F.lit(0)).cast("long"))).union(windows.agg(F.lit("n_windows"), F.count("*"))).union(encoded.agg(F.lit("n_events"), F.count("*")))
    return expected.join(found, "name", "left").withColumn("ok", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))


def distribution(events: DataFrame, k: int) -> DataFrame:
    """The ``k`` commonest events with their share in percent."""
    own = events.groupBy("event").agg(F.count("*").alias("n"))
    total = events.agg(F.count("*").alias("total"))
    return own.crossJoin(F.broadcast(total)).orderBy(F.col("n").desc(), "event").limit(k).select("event", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def misaligned(windows: DataFrame, events: DataFrame, length: int, first: int) -> DataFrame:
    """Of the first windows, those whose target is not the event that follows their context in the stream."""
    head = windows.where(F.col("line_no") <= first)
    each = head.select("stream_id", "line_no", "target", F.posexplode("ctx").alias("i", "event"))
    want = each.select("stream_id", (F.col("line_no") - length + F.col("i")).alias("at"), "event").union(head.select("stream_id", F.col("line_no"), "target"))
    have = events.select("stream_id", F.col("line_no").alias("at"), "event")
    checked = head.agg(F.count("*").alias("n_checked"))
    return want.join(have, ["stream_id", "at", "event"], "left_anti").agg(F.count("*").alias("n_wrong")).crossJoin(checked)


def class_weights(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """sqrt(N / (V max(n, 1))), 0 for an absent class, divided by the mean over all classes."""
    own = vocab.select("event", "idx").join(events.groupBy("event").agg(F.count("*").alias("n")), "event", "left").fillna(0, ["n"])
    sums = own.agg(F.sum("n").alias("all"), F.count("*").alias("v"))
    raw = F.when(F.col("n") > 0, F.sqrt(F.col("all") / (F.col("v") * F.greatest("n", F.lit(1))))).otherwise(0.0)
    weighted = own.crossJoin(F.broadcast(sums)).withColumn("raw", raw)
    mean = weighted.agg(F.avg("raw").alias("mean"))
    return weighted.crossJoin(F.broadcast(mean)).select("event", "idx", "n", (F.col("raw") / F.col("mean")).alias("weight"))


def normal_frequencies(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Event counts over normal training blocks, with their total."""
    own = events.join(blocks.where("split = 'tr' and y = 0").select("block_id"), "block_id")
    total = own.agg(F.count("*").alias("total_events"))
    return own.groupBy("event").agg(F.count("*").alias("freq")).crossJoin(F.broadcast(total))


def with_templates(events: DataFrame, templates: DataFrame) -> DataFrame:
    """Events with their template text, the event id where there is none."""
    return events.join(templates.select("event", "template"), "event", "left").withColumn("text", F.coalesce("template", "event")).drop("template")
