"""Token counts of whole texts (overlap resynchronisation for huge ones)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common

#: A document of more tokens is over the limit.
TOKEN_LIMIT = 512


def token_counts(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    limit: int = TOKEN_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = bpe.CHUNK_CHARS,
    overlap_chars: int = bpe.OVERLAP_CHARS,
) -> DataFrame:
    """One row per input row: identifier, UTF-8 bytes, tokens, and whether they exceed ``limit``.

    A null text counts as empty (0 bytes, 0 tokens); a null identifier stays null; repeated rows give
    repeated results; an empty table gives an empty result. Further columns are neither read nor returned.
    Huge texts are encoded in overlapping chunks, spliced at proven common boundaries (see ``bpe``), so
    memory does not grow with a document's tokens. No shuffle.
    """
    path = tokenizer_path or bpe.default_path()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        for batch in batches:
            col = common.text_column(batch, "text")
            _, at = common.raw_bytes(col)
            n = np.fromiter((encoder.count(t.as_py(), chunk_chars, overlap_chars) for t in col), np.int64, len(col))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read(spark, sf_dir, "documents"))
