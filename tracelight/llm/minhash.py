"""Near duplicates by the Jaccard similarity of distinct shingles: MinHash bands find candidates, the sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, line_dedup
from .components import components

#: Sets of one bucket are compared pair by pair up to this many, beyond it by a spanning forest.
PAIRED_BUCKET = 8
#: Shingles of one block; a task compares the members of two, and larger buckets are cut into cells of two blocks.
BLOCK_SHINGLES = 2_000_000
_STEP = 512
_NO_ID = (1 << 63) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Sets:
    """Texts link at Jaccard similarity 0.8 or more of their distinct shingles of ``shingle`` words.

    A key is one band of ``rows`` minima. At the bound a pair shares one of ``bands`` keys with probability
    1 - (1 - 0.8 ** rows) ** bands.
    """

    shingle: int
    bands: int
    rows: int


def similar(both: np.ndarray | int, a: np.ndarray | int, b: int) -> np.ndarray | bool:
    """Whether sets of ``a`` and ``b`` members with ``both`` in common have a Jaccard similarity of 4/5, in whole numbers."""
    return 9 * both >= 4 * (a + b)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of fewer words, of the whole sequence.

    A-Z are lower-cased and words are runs of non-space bytes.
    """
    body = _LOWER[np.frombuffer(text + b" ", np.uint8)]
    _, _, hashes = line_dedup._words(body)
    if not len(hashes):
        return np.zeros(0, np.uint64)
    k = min(size, len(hashes))
    start = np.arange(len(hashes) - k + 1)
    return np.unique(common.mixed(line_dedup._Sums(hashes).run(start, start + k) + np.uint64(k)))


def band_keys(own: np.ndarray, scheme: Sets) -> np.ndarray:
    """Keys of a set that is not empty, one for each band."""
    n = np.arange(1, scheme.bands * scheme.rows + 1, dtype=np.uint64)
    times, plus = common.mixed(n) | np.uint64(1), common.mixed(n + np.uint64(1 << 32))
    least = np.full(len(n), ~np.uint64(0))
    for a in range(0, len(own), _STEP):
        np.minimum(least, (own[a : a + _STEP, None] * times + plus).min(0), out=least)
    keys = np.arange(1, scheme.bands + 1, dtype=np.uint64)
    for row in least.reshape(scheme.bands, scheme.rows).T:
        keys = common.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def _digest(own: np.ndarray) -> int:
    return int(common.mixed(common.mixed(own).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own))).view(np.int64)[0])


def _marked(rows: DataFrame, scheme: Sets) -> DataFrame:
    """(doc_id, text_hash, node, n, keys): a node stands for one set of n shingles."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for t in common.text_column(batch, "text").cast(pa.large_binary()):
                own = shingles(t.as_py(), scheme.shingle)
                nodes.append(_digest(own))
                sizes.append(len(own))
                keys.append(band_keys(own, scheme) if len(own) else [])
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "node", "n", "keys"])

    return rows.select("doc_id", "text_hash", "text").mapInArrow(make, "doc_id long, text_hash long, node long, n int, keys array<long>")


def _mark(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id, F.lit(_NO_ID)), text_hash)


def _sets(rows: DataFrame, wanted: DataFrame, scheme: Sets) -> DataFrame:
    """(node, members) of the nodes ``wanted`` (node, mark), each named by one row's mark.

    Texts are read again, and only the sets asked for are shuffled.
    """
    bitmap = rows.sparkSession.sparkContext.broadcast(line_dedup.bitmap(wanted.select(F.col("mark").alias("row"), F.lit(0).alias("line_no"))))
    marks = rows.select(_mark(F.col("doc_id"), F.col("text_hash")).alias("mark"), "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            rows = pa.array(np.flatnonzero(line_dedup.marked(bits, batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64))))
            own = [shingles(t.as_py(), scheme.shingle) for t in common.text_column(batch, "text").cast(pa.large_binary()).take(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "members"])

    return marks.mapInArrow(make, "node long, members binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def forest(node: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that join the same nodes as all links among them do, at most one for each node.

    Walks breadth first: each node reached is compared at once, by the postings of its shingles, with all
    that are not reached yet.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    posted = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    count = np.bincount(codes)
    first = np.cumsum(count) - count
    left = np.ones(len(sets), bool)
    u, v = [], []
    for root in range(len(sets)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            at = queue.pop()
            own = codes[ends[at] - sizes[at] : ends[at]]
            many = count[own]
            places = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            both = np.bincount(posted[places], minlength=len(sets))
            near = np.flatnonzero(left & similar(both, sizes, int(sizes[at])))
            left[near] = False
            u.extend(node[near].tolist())
            v.extend([int(node[at])] * len(near))
            queue.extend(near.tolist())
    return u, v


def links(rows: DataFrame, nodes: DataFrame, scheme: Sets, paired_bucket: int = PAIRED_BUCKET, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (u, v) among ``nodes`` (node, mark, n, keys) that join whatever their similar pairs with a shared key join.

    Every link is checked on the two sets. Small buckets give pairs, each checked once; large ones give a
    spanning forest each, beyond ``block`` shingles in cells of two blocks, so no link is lost.
    """
    keyed = nodes.select(F.explode("keys").alias("bucket"), "node", "n")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    shared = common.stored(keyed.join(sizes, "bucket"), "buckets")
    wanted = common.stored(nodes.select("node", "mark").join(shared.select("node").distinct(), "node", "left_semi"), "candidates")
    sets = common.stored(_sets(rows, wanted, scheme), "sets")

    small = shared.where(F.col("size") <= paired_bucket)
    a, b = small.alias("a"), small.alias("b")
    # sets of sizes too far apart cannot be similar
    fits = 5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n")
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")) & fits).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("members").alias("y")), "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(m.as_py(), np.uint64) for m in (x, y))
                good.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    checked = pairs.select("u", "v", "x", "y").mapInArrow(verify, "u long, v long")

    large = shared.where(F.col("size") > paired_bucket).withColumn("blocks", F.ceil(F.col("total") / block).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node").join(sets, "node")

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = forest(pdf["node"].to_numpy(), [np.frombuffer(m, np.uint64) for m in pdf["members"]])
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return checked.union(large.groupBy("bucket", "i", "j").applyInPandas(grown, "u long, v long"))


def near_duplicates(docs: DataFrame, scheme: Sets, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (XXH64 of the text as Spark has it), root and component_id of every row.

    A component is what links reach; ``root`` is a number of its own, and component_id its smallest doc_id. Texts of equal sets are one node, so
    copies never become pairs; texts without words are one too. Rows of a null identifier take part, and get a
    null component unless it holds an identifier. Repeated rows give repeated results; rows that share an
    identifier but not a text are told apart.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marked = common.stored(_marked(rows, scheme), "shingled")
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text_hash")).alias("one")
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least"), one, F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = common.stored(nodes.withColumn("mark", _mark(F.col("one.doc_id"), F.col("one.text_hash"))).drop("one"), "set-nodes")
    roots = components(links(rows, nodes, scheme))
    placed = nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    placed = common.stored(placed, "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return marked.select("doc_id", "text_hash", "node").join(named, "node").select("doc_id", "text_hash", "root", "component_id")
