"""What several operators of this package share: shared-folder tables, Arrow text access and hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import shared_dir, stored  # noqa: F401 - used through this module

#: Most text bytes and documents that one vectorised step holds; a longer document is a step of its own.
STEP_BYTES = 4 << 20
STEP_DOCS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``: the split that keeps held-out rows apart."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large strings, nulls as empty texts, starting at offset zero."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    return pa.concat_arrays([col])


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large-string array and the offsets of its rows (one more than rows)."""
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def steps(at: np.ndarray, most_bytes: int = STEP_BYTES, most_docs: int = STEP_DOCS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes and documents; one row at least."""
    start, rows = 0, len(at) - 1
    while start < rows:
        end = int(np.searchsorted(at, at[start] + most_bytes, side="right")) - 1
        end = min(rows, start + most_docs, max(end, start + 1))
        yield start, end
        start = end


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) that spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans, whatever their place in ``body``."""
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(body)), out=sums[1:])
    inverse = powers(_INVERSE, len(body) + 1)
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def map_texts(docs: DataFrame, text_col: str, keep: list[str], added: str, make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with those of the schema ``added``, which ``make`` gives for each batch of texts.

    ``make`` gets nulls as empty texts. Columns of the same names as added ones are replaced.
    """
    new = [part.split()[0] for part in added.split(",")]
    keep = [c for c in keep if c not in new]
    source = keep if text_col in keep else [*keep, text_col]
    rows = docs.select(*source)
    schema = rows.select(*keep).limit(0).schema
    for field in StructType.fromDDL(added):
        schema = schema.add(field)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *make(text_column(batch, text_col))], [*keep, *new])

    return rows.mapInArrow(batches, schema)
