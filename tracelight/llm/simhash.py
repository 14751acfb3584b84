"""SimHash near-duplicates found through Golay-code keys of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, golay, minhash
from .components import components

HASH_SEED = 42
#: A fingerprint word is cut into segments of so many bits, highest first.
SEGMENTS = (22, 21, 21)
#: Fingerprints that share a key are compared pair by pair up to this many, beyond it by a spanning forest.
PAIRED_BUCKET = 8
#: Fingerprints that one task compares; larger buckets are cut into cells of two blocks.
BLOCK = 8_000
_ROUND = 1 << 16


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are made, keyed and compared.

    ``words`` 64-bit words are made from the same shingles. ``tables`` lists (word, segment, segment, exact):
    a key is the first segment, as it is (exact) or its Golay keys, with the Golay keys of the second.
    Fingerprints link at ``radius`` or fewer differing bits over all words.
    """

    shingle: int
    words: int
    radius: int
    tables: tuple[tuple[int, int, int, bool], ...]


#: Two errors over three segments leave one segment without an error and, in cyclic order, a next one with at
#: most two, so every pair within 2 bits shares a key.
STRICT = Scheme(3, 1, 2, ((0, 0, 1, True), (0, 1, 2, True), (0, 2, 0, True)))
#: Five-word shingles, Jaccard similarity 0.8. Fingerprint keys that cover this bound are shared by too many unrelated
#: texts, so candidates come from MinHash bands over the same shingles, and the shingle sets decide. A pair at
#: the bound is missed with probability 7e-5.
SIMILAR = minhash.Sets(5, 24, 5)


def fingerprint(text: bytes, shingle: int, words: int) -> list[int]:
    """Signed 64-bit fingerprint words of one text (see ``fingerprints``)."""
    tokens = text.lower().split()  # for bytes: A-Z, and ASCII white space
    if not tokens:
        return [0] * words
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(tokens))
    starts, ends = (ends - sizes)[: len(tokens) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros((words, 64), np.int64)
    for a in range(0, len(starts), _ROUND):
        h = np.fromiter((digest(joined[s:e], HASH_SEED) for s, e in zip(starts[a : a + _ROUND].tolist(), ends[a : a + _ROUND].tolist())), np.uint64)
        for w in range(words):
            own = h if w == 0 else common.mixed(h + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64)))
            votes[w] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(starts), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (XXH64 of the text as Spark has it) and fingerprint words w0, w1, ... of every whole text.

    A-Z are lower-cased; words are runs of non-space bytes; shingles are space-joined, repeats included (of
    fewer words, the whole sequence). A bit is 1 if set in over half of the shingles' XXH64. A text without
    words, a null one too, has fingerprint zero.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = common.text_column(batch, "text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py(), shingle, words) for t in col], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, w]) for w in range(words))], ["doc_id", "text_hash", *_names(words)])

    return rows.mapInArrow(make, "doc_id long, text_hash long, " + ", ".join(f"{w} long" for w in _names(words)))


def _names(words: int) -> list[str]:
    return [f"w{w}" for w in range(words)]


def bucket_keys(values: np.ndarray, table: int, first: int, second: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprint words (signed 64-bit) in one table."""
    shifts = [sum(SEGMENTS[i + 1 :]) for i in range(len(SEGMENTS))]
    part = [(values.view(np.uint64) >> np.uint64(shifts[i])).astype(np.int64) & (1 << SEGMENTS[i]) - 1 for i in (first, second)]
    a = part[0][:, None] if exact else golay.keys(part[0])
    b = golay.keys(part[1])
    keys = (table << 40) + (a[:, :, None] << golay.DATA_BITS) + b[:, None, :]
    there = np.broadcast_to((a >= 0)[:, :, None] & (b >= 0)[:, None, :], keys.shape)
    rows = np.broadcast_to(np.arange(len(values))[:, None, None], keys.shape)
    return rows[there], keys[there]


def _keyed(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(bucket, node) for every key of every node."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                node = part.column(0).to_numpy()
                for t, (word, first, second, exact) in enumerate(scheme.tables):
                    values = np.ascontiguousarray(part.column(1 + word).to_numpy())
                    rows, keys = bucket_keys(values, t, first, second, exact)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[rows])], ["bucket", "node"])

    return nodes.select("node", *_names(scheme.words)).mapInArrow(make, "bucket long, node long")


def forest(node: np.ndarray, words: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that join the same nodes as all links within ``radius`` do, at most one for each node.

    Walks breadth first: each node reached is compared at once with all that are not reached yet.
    """
    left = np.arange(len(node))
    u, v = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(words[left] ^ words[at]).sum(1, dtype=np.int64) <= radius
            for x in left[near].tolist():
                u.append(int(node[x]))
                v.append(int(node[at]))
            queue.extend(left[near].tolist())
            left = left[~near]
    return u, v


def _differing(pairs: list[tuple[Column, Column]]) -> Column:
    total = F.lit(0)
    for a, b in pairs:
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def free_parts(scheme: Scheme, table: int) -> list[int]:
    """Masks of one part more than errors, over the bits that members of a bucket of ``table`` may differ in."""
    _, first, second, exact = scheme.tables[table]
    shift = sum(SEGMENTS[first + 1 :])
    places = [b for b in range(64) if not exact or not shift <= b < shift + SEGMENTS[first]]
    n = scheme.radius + 1
    return [sum(1 << b for b in places[len(places) * k // n : len(places) * (k + 1) // n]) for k in range(n)]


def _divided(huge: DataFrame, scheme: Scheme) -> DataFrame:
    """(bucket, size, node, w0): members of huge buckets once for each part of their free bits, in a bucket of those that share it.

    Two members of a link differ in at most ``radius`` bits, so one of the parts is the same in both.
    """
    table = F.shiftright("bucket", 40)
    parts = F.lit(None)
    for t in range(len(scheme.tables)):
        own = [F.struct(F.lit(k).alias("k"), F.col("w0").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("v")) for k, mask in enumerate(free_parts(scheme, t))]
        parts = F.when(table == t, F.array(*own)).otherwise(parts)
    spread = huge.select("bucket", "node", "w0", F.explode(parts).alias("part"))
    spread = spread.select(F.xxhash64("bucket", "part.k", "part.v").alias("bucket"), "node", "w0")
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return spread.join(sizes, "bucket").select("bucket", "size", "node", "w0")


def links(nodes: DataFrame, scheme: Scheme, paired_bucket: int = PAIRED_BUCKET, block: int = BLOCK) -> DataFrame:
    """Links (u, v) among ``nodes`` (node, w0, ...) that join whatever the links within the radius join.

    Buckets of one fingerprint are dropped by a join that adaptive execution can split. Small buckets are
    self-joined on their key with the comparison as join condition. Large ones give a spanning forest in one
    task. Beyond ``block`` members they are divided (see ``_divided``), and what still has more is cut into cells of
    two blocks.
    """
    names = _names(scheme.words)
    keyed = _keyed(nodes, scheme)
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = common.stored(keyed.join(sizes, "bucket").join(nodes.select("node", *names), "node"), "buckets")

    small = shared.where(F.col("size") <= paired_bucket)
    a, b = small.alias("a"), small.alias("b")
    near = _differing([(F.col(f"a.{w}"), F.col(f"b.{w}")) for w in names]) <= scheme.radius
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")) & near).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()

    large = shared.where((F.col("size") > paired_bucket) & (F.col("size") <= block)).select("bucket", "size", "node", *names)
    if scheme.words == 1:
        large = large.unionByName(_divided(shared.where(F.col("size") > block).select("bucket", "node", "w0"), scheme))
    else:
        large = large.unionByName(shared.where(F.col("size") > block).select("bucket", "size", "node", *names))
    large = large.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *names)
    radius = scheme.radius

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = forest(pdf["node"].to_numpy(), pdf[names].to_numpy(np.int64), radius)
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return pairs.union(large.groupBy("bucket", "i", "j").applyInPandas(grown, "u long, v long"))


def near_duplicates(docs: DataFrame, scheme: Scheme | minhash.Sets = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fingerprint words, root and component_id of every row.

    A component is what links reach; ``root`` is a number of its own, and component_id its smallest doc_id. Equal
    fingerprints are one node, so copies never become pairs. Texts without words link like any other. Rows of a null
    identifier take part, and get a null component unless it holds an identifier. Repeated rows give repeated results;
    rows that share an identifier but not a fingerprint are told apart; an empty table gives none.
    A scheme of shingle sets gives ``minhash.near_duplicates``.
    """
    if isinstance(scheme, minhash.Sets):
        return minhash.near_duplicates(docs, scheme, id_col, text_col)
    names = _names(scheme.words)
    marked = common.stored(fingerprints(docs, scheme.shingle, scheme.words, id_col, text_col), "fingerprints")
    node = F.col("w0") if scheme.words == 1 else F.xxhash64(*names)
    nodes = common.stored(marked.groupBy(*names).agg(F.min("doc_id").alias("least")).select(node.alias("node"), "least", *names), "nodes")
    roots = components(links(nodes, scheme))
    placed = nodes.join(roots, nodes["node"] == roots["u"], "left").select(*names, "least", F.coalesce("root", "node").alias("root"))
    placed = common.stored(placed, "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(*names, "root", "component_id")
    return marked.join(named, names).select("doc_id", "text_hash", *names, "root", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")
