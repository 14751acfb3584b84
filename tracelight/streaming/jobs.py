"""Structured Streaming forms of vocabulary counting, sessions, scoring and band counts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import bands, model
from ..shared import new_path

WINDOWS = "session_id string, us long, line_id long, ctx array<string>, target string"
_COLUMNS = ["session_id", "us", "line_id", "ctx", "target"]
#: Rows that wait for the watermark; and of each session the last events that have left, and when the last one did.
STATE = "us array<long>, lines array<long>, sessions array<string>, events array<string>, names array<string>, last array<array<string>>, seen_ms array<long>"
#: Sessions share their state by a hash. The number is fixed, as a checkpoint outlives a run.
BUCKETS = 2_048
OUT_ROWS = 50_000


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream with a real timestamp, as watermarks need. The table may be one file or a folder."""
    schema = spark.read.parquet(path).schema
    # a stream reads a single file only through a pattern; this one matches the path alone
    raw = spark.readStream.schema(schema).format("parquet").load(f"{path[:-1]}[{path[-1]}]")
    return raw.select(F.col("event_id").alias("line_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("event"), "value")


def run_available(stream: DataFrame, name: str, mode: str = "append", late: list[int] | None = None) -> DataFrame:
    """Run a stream over what is there, into a Parquet table of the shared folder (append) or the last full result (complete).

    The number of rows dropped as they came too late is appended to ``late``.
    """
    spark = stream.sparkSession
    out, marks = new_path(spark, name), new_path(spark, f"{name}-marks")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state on disk, not on the heap
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    dropped: dict[int, int] = {}
    while not query.awaitTermination(1):
        _count_late(query, dropped)
    _count_late(query, dropped)
    if late is not None:
        late.append(sum(dropped.values()))
    return spark.read.schema(stream.schema).parquet(out)


def _count_late(query: StreamingQuery, dropped: dict[int, int]) -> None:
    """Rows that each batch reported so far has dropped."""
    for progress in query.recentProgress:
        dropped[progress["batchId"]] = sum(op.get("numRowsDroppedByWatermark", 0) for op in progress["stateOperators"])


def vocabulary(stream: DataFrame) -> DataFrame:
    """Running event counts (complete mode)."""
    return stream.groupBy("event").agg(F.count("*").alias("n"))


def gap_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions closed by a gap; rows later than the watermark are dropped."""
    seen = stream.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return seen.agg(F.count("*").alias("n_events"), F.max("value").alias("top_value")).select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "top_value")


def _in_order(length: int, idle_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Rows of a bucket of sessions wait for the watermark and leave in the order of (time, line_id), each with the events of its session before it.

    State and rows come and go once for a bucket and batch: a call for each session costs far more than its work.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        waiting, known = [], {}
        if state.exists:
            us, lines, sessions, events, names, last, seen = state.get
            waiting, known = list(zip(us, lines, sessions, events)), {n: (list(x), ms) for n, x, ms in zip(names, last, seen)}
        for new in [] if state.hasTimedOut else rows:
            waiting += zip(new["us"].tolist(), new["line_id"].tolist(), new["session_id"].tolist(), new["event"].tolist())
        waiting.sort(key=lambda r: (r[0], r[1], r[2] or "", r[3] or ""))
        n = bisect_right(waiting, mark, key=lambda r: _ms(r[0]))
        out = []
        for us, line, session, event in waiting[:n]:
            last, seen = known.get(session, ((), 0))
            if last and _ms(us) - seen < idle_ms:
                out.append((session, us, line, last, event))
                last = [*last, event][-length:]
            else:
                last = [event]
            known[session] = last, _ms(us)
            if len(out) == OUT_ROWS:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)
        known = {name: (last, seen) for name, (last, seen) in known.items() if seen + idle_ms > mark}
        due = [seen + idle_ms for _, seen in known.values()] + [_ms(r[0]) for r in waiting[n : n + 1]]
        if due:
            columns = map(list, zip(*waiting[n:])) if n < len(waiting) else ([] for _ in range(4))
            state.update((*columns, list(known), [last for last, _ in known.values()], [seen for _, seen in known.values()]))
            state.setTimeoutTimestamp(min(due) - 1)  # goes off once the watermark is past it
        elif state.exists:
            state.remove()

    return step


def _ms(us: int) -> int:
    """Milliseconds of microseconds, rounded up: a watermark of so many has passed the time."""
    return -(-us // 1000)


def contexts(stream: DataFrame, length: int = model.ORDER, idle_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """R03, first half: each event but the first of its session with up to ``length`` events before it, in the order of (ts, line_id).

    Rows are kept until the watermark has passed them, so the order and the batches in which they come make no
    difference. Rows that come after the watermark has passed their time are dropped, and ``run_available`` counts them.
    A session idle for ``idle_ms`` gives up its state and begins anew. Sessions are dealt to ``BUCKETS`` by a hash.
    """
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).alias("bucket")
    marked = stream.withWatermark("ts", late).select(bucket, "session_id", "ts", F.unix_micros("ts").alias("us"), "line_id", "event")
    found = marked.groupBy("bucket").applyInPandasWithState(_in_order(length, idle_ms), WINDOWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("session_id", F.timestamp_micros("us").alias("ts"), "line_id", "ctx", "target")


def banded(stream: DataFrame, fitted: tuple[DataFrame, DataFrame], vocab: DataFrame, uncertain: float, suspicious: float, order: int = model.ORDER) -> DataFrame:
    """R03, second half: stream-static joins with the whole back-off model, and bands of each window's surprise."""
    scored = model.score(contexts(stream, order), fitted, vocab, order).withColumn("score", F.round("nll", 9))
    return scored.select("session_id", "ts", "line_id", "target", "score", bands.classify(F.col("score"), F.lit(uncertain), F.lit(suspicious)).alias("band"))


def window_counts(scored: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by tumbling window and band."""
    seen = scored.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "band")
    return seen.agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "band", "n")
