"""Near duplicates by SuperMinHash signatures: banding finds candidates, full sets confirm, union-find and star steps group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, minhash
from .components import components

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NONE = ~np.uint64(0)


@dataclass(frozen=True)
class Sets:
    """Texts link at Jaccard similarity 0.8 or more of their distinct shingles of ``shingle`` words.

    A signature has ``bands`` * ``rows`` values (at most 255); a key is one band of them. At the bound a pair shares
    no key with probability (1 - 0.8 ** rows) ** bands.
    """

    shingle: int
    bands: int
    rows: int


#: Two-word shingles; a pair at the bound is missed with probability 3e-6, less for the lower variance of the signature.
PAIRS = Sets(2, 32, 5)


def signatures(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash of several sets at once: one row of ``size`` values for each set ``values[at[i] : at[i + 1]]``.

    Element by element a random permutation of the places is drawn (Fisher-Yates), whose j-th place gets rank j and a
    random fraction; a place keeps the least. All elements draw their j-th place together. A set is finished
    when its largest value has a rank of j at most, as later draws rank higher: large sets after one draw.
    An empty set keeps the largest value everywhere.
    """
    out = np.full((len(at) - 1, size), _NONE)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    places = None
    for j in range(size):
        drawn = common.mixed(values + np.uint64((j + 1) * int(_GOLDEN) % (1 << 64)))
        swap = j + ((drawn & np.uint64(0xFFFFFF)) * np.uint64(size - j) >> np.uint64(24)).astype(np.int64)
        own = np.arange(len(values))
        place = swap if places is None else places[own, swap].astype(np.int64)
        np.minimum.at(out.reshape(-1), owner * size + place, (np.uint64(j) << np.uint64(56)) | (drawn >> np.uint64(8)))
        open_sets = (out.max(1) >> np.uint64(56)) > j
        left = np.flatnonzero(open_sets[owner])
        if not len(left):
            break
        if places is None:
            places = np.tile(np.arange(size, dtype=np.uint8), (len(left), 1))
            places[np.arange(len(left)), swap[left]] = 0
        else:
            places[own, swap] = places[own, j]
            places = places[left] if len(left) < len(values) else places
        values, owner = values[left], owner[left]
    return out


def band_keys(signed: np.ndarray, scheme: Sets) -> np.ndarray:
    """A row of keys for each signature, one for each band."""
    keys = np.tile(np.arange(1, scheme.bands + 1, dtype=np.uint64), (len(signed), 1))
    for r in range(scheme.rows):
        keys = common.mixed(keys * _GOLDEN + signed[:, r :: scheme.rows][:, : scheme.bands])
    return keys.view(np.int64)


def _marked(rows: DataFrame, scheme: Sets) -> DataFrame:
    """(doc_id, text_hash, node, n, keys): a node stands for one set of n shingles; an empty set has no keys."""
    size = scheme.bands * scheme.rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = common.text_column(batch, "text")
            _, at = common.raw_bytes(col)
            for a, b in common.steps(at):
                sets = [minhash.shingles(t.as_py(), scheme.shingle) for t in col.slice(a, b - a).cast(pa.large_binary())]
                sizes = np.array([len(s) for s in sets], np.int64)
                signed = signatures(np.concatenate(sets), np.append(0, np.cumsum(sizes)), size)
                keys = band_keys(signed, scheme)
                # an empty set has no keys
                ends = np.append(0, np.cumsum(np.where(sizes > 0, scheme.bands, 0))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[sizes > 0].reshape(-1)))
                nodes = pa.array([minhash._digest(s) for s in sets], pa.int64())
                columns = [*(batch.column(k).slice(a, b - a) for k in (0, 1)), nodes, pa.array(sizes.astype(np.int32)), listed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "keys"])

    return rows.select("doc_id", "text_hash", "text").mapInArrow(make, "doc_id long, text_hash long, node long, n int, keys array<long>")


def spanning(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of the links that union-find needs to join what all of them join."""
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(codes[: len(u)].tolist(), codes[len(u) :].tolist())):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def _spanning_links(links: DataFrame) -> DataFrame:
    """Union-find over the links of each batch: fewer links that join the same nodes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(k).to_numpy() for k in (0, 1))
            yield batch.take(pa.array(spanning(u, v)))

    return links.select("u", "v").mapInArrow(make, "u long, v long")


def near_duplicates(docs: DataFrame, scheme: Sets = PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (distinct shingles), component_id (smallest doc_id reachable over links) and kept of every row.

    A-Z are lower-cased and words are runs of non-space bytes; fewer words than a shingle has are one shingle. Texts
    of equal sets are one node, so copies never become pairs. Candidates share a band, and every link is
    confirmed on both full sets (64-bit hashes of shingles). Texts without words, null ones too, link with nothing:
    their component is themselves. Rows of a null identifier take part; a component without any identifier is null.
    ``kept`` says that doc_id and component_id are the same (both null counts). Repeated rows give repeated results,
    rows that share an identifier but not a text are told apart, an empty table gives none; further columns
    are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marked = common.stored(_marked(rows, scheme), "shingled")
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(minhash._NO_ID)).alias("doc_id"), "text_hash")).alias("one")
    nodes = marked.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), one, F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = common.stored(nodes.withColumn("mark", minhash._mark(F.col("one.doc_id"), F.col("one.text_hash"))).drop("one"), "set-nodes")
    roots = components(_spanning_links(minhash.links(rows, nodes, scheme)))
    placed = nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    placed = common.stored(placed, "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    found = marked.where("n > 0").join(named, "node").select("doc_id", "n", "component_id")
    found = found.union(marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
