"""Packing of tokenised documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

CAPACITY = 1024
#: Token id that ends each document.
END_ID = 2
#: Pieces that one task packs; shards are packed apart, so each may leave a few sequences part-filled.
SHARD_PIECES = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenised_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document's pieces.

    A document is its token ids and ``end_id``. Only longer ones than ``capacity`` are cut, into pieces of
    exactly that length but for the first. Null text counts as empty and gives one piece of one id.
    """
    path = tokenizer_path or bpe.default_path()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        for batch in batches:
            own, col = batch.column(0), common.text_column(batch, "text")
            _, at = common.raw_bytes(col)
            for first, last in common.steps(at):
                row, piece, start, length, ids = [], [], [], [], []
                for i in range(first, last):
                    all_ids = np.append(encoder.ids(col[i].as_py()).astype("<u4"), np.uint32(end_id))
                    cuts = [0, *range(len(all_ids) % capacity or capacity, len(all_ids) + 1, capacity)] if len(all_ids) > capacity else [0, len(all_ids)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(all_ids[a:b].tobytes())
                arrays = [own.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(cut, _PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in decreasing order of size.

    ``open_bins[g]`` counts the open bins with gap g. Putting an item of size s into a bin of gap g takes
    one from that count and adds one to the count of gap g - s, which changes the sum of squared counts by
    2 (open_bins[g - s] - open_bins[g]) + 2; a bin that becomes full is no longer open and changes it by
    1 - 2 open_bins[g]. The place of the smallest change is taken, the tightest of equal ones. A new bin is
    opened only if no open one has room, which for sizes in decreasing order keeps the number of bins near
    the lower bound.
    """
    counts = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        room = counts[s:]
        to = 2 * counts[: capacity + 1 - s]
        to[0] = -1  # with the 2 that all other changes have besides, 1
        change = np.where(room > 0, to - 2 * room, np.iinfo(np.int64).max)
        k = int(np.argmin(change))
        if room[k] > 0:
            gap = s + k
            counts[gap] -= 1
            bins[i] = stacks[gap].pop()
        else:
            gap, bins[i] = capacity, opened
            opened += 1
        offsets[i] = capacity - gap
        if gap > s:
            counts[gap - s] += 1
            stacks[gap - s].append(int(bins[i]))
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (a stored table with doc_id, piece and length) with sequence_id and offset.

    Full pieces are sequences of their own. The others are dealt evenly to shards of about
    ``shard_pieces`` by their place in the table, each packed by one task, so no task grows with the corpus and
    neither an identifier nor repeated rows can be hot. Null identifiers are packed like any other. Columns named
    sequence_id, offset or shard are an error; an empty table gives no rows.
    """
    if len({"sequence_id", "offset", "shard"} & set(pieces.columns)):
        raise ValueError("pieces already has a column sequence_id, offset or shard")
    full = F.col("length") >= capacity
    part = pieces.where(~full)
    shards = max(1, math.ceil(part.count() / shard_pieces))
    names = list(pieces.columns)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf[names].assign(sequence_id=(pdf["shard"].to_numpy() << 40) + bins, offset=offsets)

    schema = pieces.limit(0).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    shared = part.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).groupBy("shard").applyInPandas(packed, schema)
    alone = pieces.where(full).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return shared.unionByName(alone)


def pack_documents(docs: DataFrame, derive: dict[str, Column] | None = None, keep_ids: bool = True, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, [ids,] derived columns, sequence_id, offset.

    ``derive`` adds columns computed from those of ``tokenised_pieces`` before the ids may be dropped.
    Null identifiers and repeated rows are packed like any other row; an empty table gives no rows.
    """
    pieces = tokenised_pieces(docs, tokenizer_path, capacity, end_id).withColumns(derive or {})
    return pack(common.stored(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity, shard_pieces)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(common.read(spark, sf_dir, "documents"), {"ids_crc32": F.crc32("ids")}, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
