"""Approximate nearest neighbours by counting collisions in query-centred windows of single projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NEIGHBOURS = 10
#: Single-projection arrays, and how many windows must hold a vector before it is verified.
PROJECTIONS, COLLIDING = 64, 45
#: Half the width of a window that covers a distance, in units of it. A vector at that very distance is in such a window
#: with probability 0.806, and in at least 45 of 64 with 0.98; nearer ones nearly always.
REACH = 1.3
#: Windows grow by this factor from a small share of a projection's spread, until so many vectors collide enough.
GROWTH, LEVELS, FIRST_WIDTH, LEAST_CANDIDATES = 1.3, 22, 0.05, 64
#: Vectors, and queries, that one task holds at a time.
BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Regions that vectors are dealt to at most, for each vector length, and vectors that their bounds are learnt from.
MOST_REGIONS, SAMPLE = 4_096, 65_536

_FOUND = "query_id long, vec_id long, score double"
_FIRST = "dim int, region int, low binary, high binary, query_id long, radius double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def axes(dim: int) -> np.ndarray:
    """Random directions; two points at distance r differ on each by a normal variable of deviation r."""
    return np.random.default_rng([11, dim]).standard_normal((dim, PROJECTIONS))


class Arrays:
    """One sorted array for each projection of a block of vectors."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.line = x @ axes(x.shape[1])
        self.order = np.argsort(self.line, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.line, self.order, axis=0)

    def window(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the window around ``centre`` in each array."""
        low = [np.searchsorted(self.sorted[:, j], centre[j] - half, side="left") for j in range(PROJECTIONS)]
        high = [np.searchsorted(self.sorted[:, j], centre[j] + half, side="right") for j in range(PROJECTIONS)]
        return np.array(low), np.array(high)

    def nearest(self, collided: np.ndarray, q: np.ndarray, q_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and exact distances of the ``k`` nearest of the vectors ``collided``, each identifier once."""
        found = collided[self.ids[collided] != q_id]
        distance = np.sqrt(((self.x[found] - q) ** 2).sum(axis=1))
        order = np.lexsort((self.ids[found], distance))
        ids, first = np.unique(self.ids[found][order], return_index=True)
        best = np.sort(first)[:k]
        return self.ids[found][order][best], distance[order][best]

    def radius(self, q: np.ndarray, q_id: int, centre: np.ndarray, k: int) -> float:
        """The distance of the k-th nearest found by virtual rehashing: all windows widen level by level.

        Only the newly covered stretches are counted at each level. Without ``k`` vectors it is infinite.
        """
        n = len(self.ids)
        counts, a, b = np.zeros(n, np.int64), None, None
        wanted = min(n, max(LEAST_CANDIDATES, 2 * k))
        spread = float(np.mean(self.line.std(axis=0))) or 1.0
        for level in range(LEVELS + 1):
            lower, upper = self.window(centre, FIRST_WIDTH * spread * GROWTH**level if level < LEVELS else math.inf)
            a, b = (lower, lower) if a is None else (a, b)
            fresh = [self.order[lower[j] : a[j], j] for j in range(PROJECTIONS)] + [self.order[b[j] : upper[j], j] for j in range(PROJECTIONS)]
            counts += np.bincount(np.concatenate(fresh), minlength=n)
            a, b = lower, upper
            if np.count_nonzero(counts >= COLLIDING) >= wanted:
                break
        distance = self.nearest(np.flatnonzero(counts >= COLLIDING), q, q_id, k)[1]
        return float(distance[k - 1]) if len(distance) >= k else math.inf

    def within(self, q: np.ndarray, q_id: int, centre: np.ndarray, half: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest of the vectors that enough windows of a given width hold."""
        low, high = self.window(centre, half)
        counts = np.bincount(np.concatenate([self.order[low[j] : high[j], j] for j in range(PROJECTIONS)]), minlength=len(self.ids))
        return self.nearest(np.flatnonzero(counts >= COLLIDING), q, q_id, k)


def half_width(radius: float, centre: np.ndarray) -> float:
    """Half the window that covers ``radius``, with room for rounding."""
    return REACH * radius + 1e-9 * float(np.abs(centre).max())


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["embedding"].to_numpy()).astype(np.float64)


def median_tree(line: np.ndarray) -> np.ndarray:
    """Thresholds of a binary tree in heap order; level l halves each node by its median on projection l."""
    at, out = np.zeros(len(line), np.int64), []
    for level in range(line.shape[1]):
        first = 2**level - 1
        cuts = np.full(2**level, np.inf)
        order = np.argsort(at, kind="stable")
        for node, rows in zip(*_groups(at[order], order)):
            cuts[node - first] = np.median(line[rows, level])
        out.append(cuts)
        at = 2 * at + 1 + (line[:, level] >= cuts[at - first])
    return np.concatenate(out) if out else np.zeros(0)


def _groups(keys: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    own, first = np.unique(keys, return_index=True)
    return own.tolist(), np.split(rows, first[1:])


def _placed(vectors: DataFrame, trees: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` (vec_id, embedding) with dim and region, the leaf of its length's tree."""
    shared = vectors.sparkSession.sparkContext.broadcast(trees)  # at most MOST_REGIONS thresholds for each length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(1).offsets.to_numpy())
            region = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                tree, own = shared.value.get(dim, np.zeros(0)), np.flatnonzero(dims == dim)
                depth = (len(tree) + 1).bit_length() - 1
                if depth:
                    x = batch.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    line, at = x @ axes(dim)[:, :depth], np.zeros(len(own), np.int64)
                    for level in range(depth):
                        at = 2 * at + 1 + (line[:, level] >= tree[at])
                    region[own] = at - len(tree)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims.astype(np.int32)), pa.array(region)], ["vec_id", "embedding", "dim", "region"])

    return vectors.mapInArrow(place, "vec_id long, embedding array<double>, dim int, region int")


def _trees(base: DataFrame, block: int) -> dict[int, np.ndarray]:
    """A tree for each vector length, learnt from a bounded sample drawn by a hash of the identifier."""
    sizes = {r["dim"]: r["n"] for r in base.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    depths = {dim: max(0, math.ceil(math.log2(min(MOST_REGIONS, n / block)))) for dim, n in sizes.items() if n > block}
    if not depths:
        return {}
    share = F.create_map(*(F.lit(x) for dim in depths for x in (dim, min(1.0, SAMPLE / sizes[dim]))))
    drawn = base.withColumn("dim", F.size("embedding")).where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) / 1_000_003.0 < F.coalesce(share[F.col("dim")], F.lit(0.0)))

    def learn(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = median_tree(_matrix(pdf) @ axes(key[0])[:, : depths[key[0]]])
        return pd.DataFrame({"dim": [key[0]], "cuts": [cuts.tobytes()]})

    return {r["dim"]: np.frombuffer(bytes(r["cuts"])) for r in drawn.groupBy("dim").applyInPandas(learn, "dim int, cuts binary").collect()}


def nearest(queries: DataFrame, base: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of ``base`` for each of ``queries`` (vec_id, embedding).

    The score is the Euclidean distance in double precision. Rows of the query's own identifier are no
    candidates; an identifier that repeats counts once, at its nearest vector; ties go to the smaller vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows of a null
    identifier; of repeated queries of one identifier one counts; vectors of another length are not compared.
    Further columns are ignored. Without queries or vectors the result is empty.

    Every vector is indexed. Vectors are dealt to regions, the leaves of a tree of medians on the first
    projections, and within a region to blocks of bounded size by a hash. A query first searches one block of its own
    region, level by level; the distance of the k-th nearest found there bounds the true one. Then its windows
    widen to cover that distance, and it goes to every region that enough of them meet: elsewhere nothing can
    collide often enough. So vectors are shuffled twice whatever the queries, and queries once for each region
    they reach. A task holds one block of vectors and one of queries.
    """
    some = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    base, queries = some(base), some(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    trees = _trees(base, block)
    base, asked = common.stored(_placed(base, trees), "vectors"), common.stored(_placed(queries, trees), "queries")
    region = ["dim", "region"]
    blocks = common.stored(base.groupBy(*region).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "regions")

    def cells(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Vectors and queries (with dim, region and block) with a cell number, so that a cell holds a bounded number of either."""
        rounds = wanted.groupBy(*region, "block").agg(F.ceil(F.count("*") / query_block).cast("int").alias("rounds"))
        # a row for each block, at most MOST_REGIONS and one for each full block
        own = base.join(blocks, region).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
        own = own.join(rounds, [*region, "block"], "left").withColumn("cell", F.explode(F.sequence(F.lit(0), F.coalesce("rounds", F.lit(1)) - 1))).drop("rounds")
        dealt = wanted.join(rounds, [*region, "block"]).withColumn("cell", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("rounds")).cast("int")).drop("rounds")
        return own, dealt

    keys = [*region, "block", "cell"]

    def first(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            arrays = Arrays(_matrix(left), left["vec_id"].to_numpy())
            out.append((key[0], key[1], arrays.sorted[0].astype("<f8").tobytes(), arrays.sorted[-1].astype("<f8").tobytes(), None, None))
        for q_id, q in zip(right["vec_id"], right["embedding"]):
            radius = arrays.radius(q, q_id, q @ axes(len(q)), k) if len(left) else math.inf
            out.append((key[0], key[1], None, None, q_id, radius))
        return pd.DataFrame(out, columns=["dim", "region", "low", "high", "query_id", "radius"]).astype({"query_id": "Int64"})

    home = asked.join(blocks, region, "left").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    left, right = cells(home)
    found = common.stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(first, _FIRST), "radii")
    radii = found.where("query_id is not null").select("query_id", "radius")

    reaching = _reaching(asked.join(radii, asked["vec_id"] == radii["query_id"]).select("vec_id", "embedding", "dim", "radius"), _bounds(found))
    reached = reaching.join(blocks, region).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    left, right = cells(common.stored(reached, "reached"))

    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            arrays = Arrays(_matrix(left), left["vec_id"].to_numpy())
            for q_id, q, radius in zip(right["vec_id"], right["embedding"], right["radius"]):
                centre = q @ axes(len(q))
                ids, distance = arrays.within(q, q_id, centre, half_width(radius, centre), k)
                out.append((np.full(len(ids), q_id), ids, distance))
        q_ids, ids, distance = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"query_id": q_ids, "vec_id": ids, "score": distance})

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(second, _FOUND)
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounds(found: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector length its regions, and their least and greatest value on each projection."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.stack([np.frombuffer(x) for x in pdf["low"]]).min(axis=0)
        high = np.stack([np.frombuffer(x) for x in pdf["high"]]).max(axis=0)
        return pd.DataFrame({"dim": pdf["dim"][:1], "region": pdf["region"][:1], "low": [low.tobytes()], "high": [high.tobytes()]})

    boxes = found.where("low is not null").select("dim", "region", "low", "high")
    rows = boxes.groupBy("dim", "region").applyInPandas(merged, boxes.schema).collect()  # at most MOST_REGIONS for each length
    out = {}
    for dim in {r["dim"] for r in rows}:
        own = [r for r in rows if r["dim"] == dim]
        out[dim] = (np.array([r["region"] for r in own], np.int32), *(np.stack([np.frombuffer(bytes(r[c])) for r in own]) for c in ("low", "high")))
    return out


def _reaching(asked: DataFrame, bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Each query (vec_id, embedding, dim, radius) with every region where enough of its windows hold something."""
    shared = asked.sparkSession.sparkContext.broadcast(bounds)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for i, (q, dim, radius) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if dim not in shared.value:
                    continue
                region, low, high = shared.value[dim]
                centre = q.values.to_numpy(zero_copy_only=False) @ axes(dim)
                half = half_width(radius, centre)
                met = ((low <= centre + half) & (high >= centre - half)).sum(axis=1) >= COLLIDING
                row.append(np.full(met.sum(), i))
                to.append(region[met])
            own = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([*(c.take(own) for c in batch.columns), pa.array(np.concatenate(to))], ["vec_id", "embedding", "dim", "radius", "region"])

    return asked.mapInArrow(reach, "vec_id long, embedding array<double>, dim int, radius double, region int")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.where("vec_id % 100 = 0"), vectors)
