"""Connected components by alternating large-star and small-star steps, each a shuffle of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Every step at least halves the depth of the trees, so this is never met in practice; exceeding it is an error.
MOST_STEPS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of those."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every node u of ``links`` (u, v long) that is not the smallest of its component.

    Links may repeat and have either direction; loops are ignored. Nothing is collected but two sums
    that tell whether a step changed the links.
    """
    now = common.stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(MOST_STEPS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select("u", F.col("v").alias("root"))
        seen = mark
        now = common.stored(_small_star(_large_star(now).distinct()).distinct(), "links")
    raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    """doc_id, text_hash and component_id of the rows of ``second``, where groups that share a text with one group of ``first`` are one.

    Both hold (doc_id, text_hash, root) of the same rows, and a text has one root in each.
    """
    first, second = (common.stored(df.select("doc_id", "text_hash", "root"), "grouped") for df in (first, second))
    a, b = (df.select("text_hash", F.col("root").alias(name)).distinct() for df, name in ((first, "a"), (second, "b")))
    shared = common.stored(a.join(b, "text_hash").select("a", "b").distinct(), "shared-groups")
    least = shared.groupBy("a").agg(F.min("b").alias("m"))
    roots = components(shared.join(least, "a").where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v")))
    placed = common.stored(second.join(roots.withColumnRenamed("root", "other"), second["root"] == F.col("u"), "left").select("doc_id", "text_hash", F.coalesce("other", "root").alias("root")), "united")
    return placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "text_hash", "component_id")
