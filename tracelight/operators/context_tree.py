"""Next-event model of variable order: suffixes of up to 20 events, kept while they change the prediction.

A node is a suffix of the context, named by a hash of its events from the last one back. It has the back-off
distribution of ``model`` over its parent, the suffix without its oldest event. The tree grows level by level
through suffixes that were seen often enough, so a level has never more entries than there are distinct (context,
target) rows, and ends where none is left. Then it is pruned from its leaves: an event far back may matter where the
ones between do not, so a node stays if it or any below it gains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from . import model

ORDER = 20
#: A suffix is kept if it was seen so often at least, and it or a longer one gains over its parent, on what follows it, so many times
#: the nats that the Bayesian information criterion asks of it: half the logarithm of all windows for each event seen after it.
LEAST_COUNT, PENALTY = 8, 1.0
_ROOT = 0


def _child(parent: Column, event: Column) -> Column:
    return F.xxhash64(parent, event)


def fit(windows: DataFrame, vocab: DataFrame, order: int = ORDER, alpha: float = model.ALPHA, least_count: int = LEAST_COUNT, penalty: float = PENALTY) -> tuple[DataFrame, DataFrame]:
    """M01 with contexts of up to ``order`` events: the tables probs (k, node, event, n, total, p) and nodes.

    nodes (k, node, parent, total, share, entropy, top, gain, log_shares) has the facts of ``model`` for each kept suffix
    of k events, and the nats its distribution gains over its parent's on what followed it; ``log_shares`` sums ln(share) from the root, so that what a node leaves for an event first seen at an ancestor
    is one subtraction.
    """
    cases = stored(windows.groupBy("ctx", F.col("target").alias("event")).agg(F.count("*").alias("n")), "cases")
    asked = penalty * 0.5 * F.log(F.lit(max(2.0, float(cases.agg(F.sum("n")).first()[0] or 0))))
    probs, facts = model.unconditional(cases.groupBy("event").agg(F.sum("n").alias("n")), vocab, alpha)
    probs, facts = (df.withColumn("ctx", F.lit(_ROOT).cast("long")) for df in (probs, facts))
    every_p = probs.select("k", F.col("ctx").alias("node"), "event", "n", "total", "p")
    nodes = facts.select("k", F.col("ctx").alias("node"), F.lit(None).cast("long").alias("parent"), "total", "share", "entropy", "top", F.lit(0.0).alias("gain"), F.lit(0.0).alias("log_shares"))
    every_n, levels, active = nodes, [], cases.withColumn("ctx_node", F.lit(_ROOT).cast("long"))
    for k in range(1, order + 1):
        # events that are in the node's name already are not carried on
        rest = F.slice("ctx", 1, F.size("ctx") - 1).alias("ctx")
        step = active.where(F.size("ctx") > 0).select(rest, "event", "n", F.col("ctx_node").alias("lower"), _child(F.col("ctx_node"), F.element_at("ctx", -1)).alias("node"))
        counts = step.groupBy("node", "lower", "event").agg(F.sum("n").alias("n"))
        totals = counts.groupBy("node").agg(F.sum("n").alias("total")).where(F.col("total") >= least_count)
        seen = stored(counts.join(totals, "node").withColumnRenamed("node", "ctx"), f"tree-seen-{k}")
        if seen.isEmpty():
            break
        probs = model.probabilities(seen, probs, k, alpha)
        gains = probs.groupBy("ctx").agg(F.sum(F.col("n") * F.ln(F.col("p") / F.col("q"))).alias("gain"), F.count("*").alias("events"))
        above = nodes.select(F.col("node").alias("lower"), F.col("log_shares").alias("before"))
        shares = (F.col("before") + F.ln("share")).alias("log_shares")
        grown = model.facts(probs, facts, k, alpha).join(gains, "ctx").join(above, "lower").select("k", F.col("ctx").alias("node"), F.col("lower").alias("parent"), "total", "share", "entropy", "top", "gain", shares, "events")
        nodes = stored(grown, f"tree-nodes-{k}")
        facts = nodes.select("k", F.col("node").alias("ctx"), "total", "share", "entropy", "top")
        levels.append((probs.select("k", F.col("ctx").alias("node"), "event", "n", "total", "p"), nodes))
        active = stored(step.join(nodes.select("node"), "node", "left_semi").select("ctx", "event", "n", F.col("node").alias("ctx_node")), f"tree-active-{k}")
    kept, below = [], None
    for own_p, own in reversed(levels):
        gaining = own.where(F.col("gain") >= asked * F.col("events")).select("node")
        named = gaining if below is None else gaining.union(below.select(F.col("parent").alias("node"))).distinct()
        below = stored(own.join(named, "node", "left_semi").drop("events"), "tree-kept")
        if kept or not below.isEmpty():
            kept.append((own_p.join(below.select("node"), "node", "left_semi"), below))
        else:
            below = None
    for own_p, own in reversed(kept):
        every_p, every_n = every_p.unionByName(own_p), every_n.unionByName(own)
    return every_p, every_n


def depth(nodes: DataFrame) -> int:
    """Events of the longest kept suffix."""
    return nodes.agg(F.max("k")).first()[0] or 0


def path(ctx: Column, most: int) -> Column:
    """Names of the suffixes of one to ``most`` events, shortest first."""
    near = F.reverse(F.when(F.size(ctx) <= most, ctx).otherwise(F.slice(ctx, -most, most)))
    start = F.struct(F.lit(_ROOT).cast("long").alias("node"), F.array().cast("array<bigint>").alias("all"))

    def longer(state: Column, event: Column) -> Column:
        node = _child(state["node"], event)
        return F.struct(node.alias("node"), F.array_append(state["all"], node).alias("all"))

    return F.aggregate(near, start, longer, lambda state: state["all"])


def score(windows: DataFrame, tree: tuple[DataFrame, DataFrame], vocab: DataFrame) -> DataFrame:
    """M02 with the tree: ``windows`` with the signals of ``model.score`` and ``depth``, the length of the deciding suffix.

    Each distinct (context, target) asks once for all its suffixes, by one join on their names (and one for the
    probabilities); the longest known one decides. A target not seen after it has the probability at the
    longest suffix that saw it, times the shares left on the way.
    """
    probs, nodes = tree
    most = depth(nodes)
    near = F.when(F.size("ctx") <= most, F.col("ctx")).otherwise(F.slice("ctx", -max(most, 1), max(most, 1))) if most else F.array().cast("array<string>")
    keyed = windows.withColumn("__near", F.array_join(near, model.SEP))
    asked = stored(keyed.groupBy("__near", "target").agg(F.first(near).alias("ctx")), "tree-asked")
    root = F.array(F.lit(_ROOT).cast("long"))
    spread = asked.select("__near", "target", F.explode(F.concat(root, path(F.col("ctx"), most)) if most else root).alias("node"))
    known = spread.join(nodes.select("node", "k", "log_shares", F.struct("entropy", "top").alias("f")), "node")
    known = known.join(probs.select("node", F.col("event").alias("target"), "p"), ["node", "target"], "left")
    best = known.groupBy("__near", "target").agg(
        F.max("k").alias("depth"), F.max_by("log_shares", "k").alias("__all"), F.max_by("f", "k").alias("__f"),
        F.max(F.when(F.col("p").isNotNull(), F.struct("k", "p", "log_shares"))).alias("__own"),
    )
    best = best.select("__near", "target", "depth", "__f", (F.col("__own.p") * F.exp(F.col("__all") - F.col("__own.log_shares"))).alias("p_true"))
    # windows of few events are small files with very many rows; a left join never sends them to the driver, and every target asked for is there
    told = keyed.where(F.col("target").isNotNull()).join(stored(best, "tree-best"), ["__near", "target"], "left")
    return model.signals(told, [*windows.columns, "depth"], vocab)


def sizes(nodes: DataFrame) -> DataFrame:
    """(k, n_nodes, n_seen, gain) of each length of suffix kept."""
    return nodes.groupBy("k").agg(F.count("*").alias("n_nodes"), F.sum("total").alias("n_seen"), F.sum("gain").alias("gain"))
