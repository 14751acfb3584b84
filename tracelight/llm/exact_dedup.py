"""Exact duplicates by a content sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Leading characters of a text that are compared first; keeps the sampled splitters small.
PREFIX_CHARS = 48

_RUNS = "doc_id long, text_sha256 string, run long, run_id long, run_size long, first boolean, edge boolean, edge_text binary"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts as
    empty. Of equal texts exactly one row stays, one of the smallest identifier; of rows that repeat both,
    the others go. A null identifier comes last: such a row stays only if its group has no other identifier, and
    keep_id is null then. Further columns are ignored; an empty table gives an empty result.

    Rows are range-partitioned by sampled splitters over (leading characters, SHA-256, identifier, place in the
    table) and sorted by (leading characters, SHA-256, whole text, identifier, place), so equal texts are adjacent
    and a hot text is spread over as many partitions as it fills, even if its identifier repeats. Splitters hold
    leading characters only, as whole texts may be huge. Neighbours are compared in full. The first and last
    run of each partition, which may go on in the next, are then joined by their whole text.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), norm.alias("norm"))
    rows = rows.select("doc_id", F.col("norm").cast("binary").alias("norm"), F.sha2("norm", 256).alias("text_sha256"))
    rows = rows.withColumns({"head": F.substring("norm", 1, PREFIX_CHARS), "last": F.col("doc_id").isNull(), "place": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(n, "head", "text_sha256", "last", "doc_id", "place").sortWithinPartitions("head", "text_sha256", "norm", "last", "doc_id", "place")
    runs = common.stored(ordered.select("doc_id", "text_sha256", "norm").mapInArrow(_runs, _RUNS), "exact-runs")

    edges = runs.where("edge_text is not null")
    whole = edges.groupBy("edge_text").agg(F.min("run_id").alias("keep_id"), F.sum("run_size").alias("group_size"), F.min("run").alias("lead"))
    # at most two runs of each partition, so this side is bounded by the number of partitions
    fixes = edges.join(whole, "edge_text").select("run", "keep_id", "group_size", "lead")
    inner = runs.where("not edge").select("doc_id", F.col("run_id").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("first").alias("kept"), "text_sha256")
    # partitions are in order, so of the runs of a text the first one's first row stays
    outer = runs.where("edge").join(F.broadcast(fixes), "run").select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("run") == F.col("lead"))).alias("kept"), "text_sha256")
    return inner.unionByName(outer)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in one sorted partition; the first and the last one are marked as edges with their text."""
    part, run = TaskContext.get().partitionId(), 0
    ids: list[pa.Array] = []
    text = sha = None

    def closed(last: bool) -> pa.RecordBatch:
        own = pa.chunked_array(ids, pa.int64())
        size, edge = len(own), last or run == 0
        first = own[0].as_py()
        return pa.RecordBatch.from_arrays(
            [
                own.combine_chunks(), pa.repeat(pa.scalar(sha), size), pa.repeat(pa.scalar((part << 40) + run), size), pa.repeat(pa.scalar(first, pa.int64()), size),
                pa.repeat(pa.scalar(size), size), pa.array([True] + [False] * (size - 1)), pa.repeat(pa.scalar(edge), size), pa.array([text if edge else None] + [None] * (size - 1), pa.large_binary()).cast(pa.binary()),
            ],
            ["doc_id", "text_sha256", "run", "run_id", "run_size", "first", "edge", "edge_text"],
        )

    done: list[pa.RecordBatch] = []
    for batch in batches:
        norm, own_ids, shas = batch.column(2), batch.column(0), batch.column(1)
        if not len(norm):
            continue
        same = pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist(), len(norm)]
        for a, b in zip(starts, starts[1:]):
            if text is not None and (a or norm[0].as_py() != text):
                done.append(closed(False))
                run, ids = run + 1, []
            if not ids:
                text, sha = norm[a].as_py(), shas[a].as_py()
            ids.append(own_ids.slice(a, b - a))
            if len(done) >= 1024:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
    if ids:
        done.append(closed(True))
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
