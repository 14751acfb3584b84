"""Next-event model: back-off context counts, sparse in the vocabulary.

p_k(e | c) = (n(c, e) + a p_{k-1}(e | c')) / (n(c) + a), where c' is c without its oldest event and p_{-1} = 1 / V.
Only events seen after a context are stored for it; every other one is a share of the next lower order, so
neither fitting nor scoring makes rows for the whole vocabulary of each context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

ORDER = 2
ALPHA = 1.0
TOP = 5
MISS_RANK = 3
#: Weights of normalised entropy and of a top-k miss in the composite score; surprisal has the rest.
ENTROPY_WEIGHT, MISS_WEIGHT = 0.35, 0.10
#: Probabilities that agree to so many places count as equal when events are ranked.
PLACES = 12
SEP = "|"


def context(ctx: Column, order: int) -> Column:
    """The last ``order`` events as a key; null if there are fewer."""
    if order == 0:
        return F.lit("")
    return F.when(F.size(ctx) >= order, F.array_join(F.slice(ctx, -order, order), SEP))


def context_counts(windows: DataFrame, order: int = ORDER) -> DataFrame:
    """M01, first half: (k, ctx, event, n) for every context order up to ``order``; one pass over the windows."""
    keys = F.array(*(F.struct(F.lit(k).alias("k"), context(F.col("ctx"), k).alias("ctx")) for k in range(order + 1)))
    spread = windows.select(F.explode(keys).alias("c"), F.col("target").alias("event")).select("c.k", "c.ctx", "event")
    return spread.where("ctx is not null").groupBy("k", "ctx", "event").agg(F.count("*").alias("n"))


def fit(windows: DataFrame, vocab: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """The tables probs (k, ctx, event, n, total, p) and contexts (k, ctx, total, share, entropy, top).

    ``share`` is what an event not seen after the context gets of the lower order; ``top`` holds the most probable
    events as (p, event). An event outside a context's own list can only be among its top if it is
    among those of the lower order. Entropies follow from the lower order's in the same way.
    """
    counts = stored(context_counts(windows, order), "counts")
    probs, contexts = unconditional(counts.where("k = 0").select("event", "n"), vocab, alpha)
    every_p, every_c = probs, contexts
    for k in range(1, order + 1):
        own = counts.where(F.col("k") == k).drop("k")
        totals = own.groupBy("ctx").agg(F.sum("n").alias("total"))
        shorter = F.array_join(F.slice(F.split("ctx", f"\\{SEP}"), 2, k), SEP) if k > 1 else F.lit("")
        seen = own.join(totals, "ctx").withColumn("lower", shorter)
        probs, contexts = conditional(seen, probs, contexts, k, alpha)
        every_p, every_c = every_p.unionByName(probs.drop("lower", "q")), every_c.unionByName(contexts.drop("lower"))
    return every_p, every_c


def unconditional(zero: DataFrame, vocab: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """probs and contexts without any context, from the counts (event, n) of targets."""
    size = vocab.agg(F.count("*").alias("v"))
    base = vocab.select("event").join(zero, "event", "left").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(zero.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))))
    base = base.select(F.lit(0).alias("k"), F.lit("").alias("ctx"), "event", F.coalesce("n", F.lit(0)).alias("n"), "total", ((F.coalesce("n", F.lit(0)) + F.lit(alpha) / F.col("v")) / (F.col("total") + alpha)).alias("p"))
    probs = stored(base, "probs-0")
    # a top-n of the vocabulary, not a list of it
    likely = probs.orderBy(F.round("p", PLACES).desc(), "event").limit(TOP).agg(_top(F.collect_list(F.struct("p", "event"))).alias("top"))
    facts = probs.groupBy("k", "ctx", "total").agg(F.lit(0.0).alias("share"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))
    return probs, stored(facts.crossJoin(likely), "contexts-0")  # single rows


def conditional(seen: DataFrame, probs: DataFrame, contexts: DataFrame, k: int, alpha: float) -> tuple[DataFrame, DataFrame]:
    """probs and contexts of order ``k`` from the counts (ctx, lower, event, n, total) and those of the next lower order."""
    probs = probabilities(seen, probs, k, alpha)
    return probs, stored(facts(probs, contexts, k, alpha), f"contexts-{k}")


def probabilities(seen: DataFrame, probs: DataFrame, k: int, alpha: float) -> DataFrame:
    below = probs.select(F.col("ctx").alias("lower"), "event", F.col("p").alias("q"))
    seen = seen.join(below, ["lower", "event"]).withColumn("p", (F.col("n") + alpha * F.col("q")) / (F.col("total") + alpha))
    return stored(seen.select(F.lit(k).alias("k"), "ctx", "event", "n", "total", "p", "lower", "q"), f"probs-{k}")


def facts(probs: DataFrame, contexts: DataFrame, k: int, alpha: float) -> DataFrame:
    """Entropy and most probable events of each context, from what was seen after it and those of its lower one."""
    best = F.struct((-F.round("p", PLACES)).alias("o"), "event", "p")
    # of the events seen only the first TOP can be among the top; those of the lower order count only if not seen here
    sums = probs.groupBy("ctx", "total", "lower").agg(F.sum(F.col("p") * F.ln("p")).alias("plnp"), F.sum("q").alias("mass"), F.sum(F.col("q") * F.ln("q")).alias("qlnq"))
    order = Window.partitionBy("ctx").orderBy(F.round("p", PLACES).desc(), "event")
    first = probs.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= TOP).groupBy("ctx").agg(F.array_sort(F.collect_list(best)).alias("own"))
    lower = contexts.select(F.col("ctx").alias("lower"), F.col("entropy").alias("h"), F.col("top").alias("low"))
    low = contexts.select(F.col("ctx").alias("lower"), F.explode("top").alias("x")).select("lower", F.col("x.event").alias("event"))
    also = probs.select("ctx", "lower", "event").join(low, ["lower", "event"]).groupBy("ctx").agg(F.collect_list("event").alias("both"))  # TOP at most
    share = F.lit(alpha) / (F.col("total") + alpha)
    made = sums.join(lower, "lower").join(first, "ctx").join(also, "ctx", "left").withColumn("share", share)
    rest = F.col("share") * (-F.col("h") - F.col("qlnq")) + F.col("share") * F.ln("share") * (1 - F.col("mass"))
    both = F.coalesce("both", F.array().cast("array<string>"))
    others = F.transform(F.filter("low", lambda x: ~F.array_contains(both, x["event"])), lambda x: F.struct((x["p"] * F.col("share")).alias("p"), x["event"].alias("event")))
    own = F.transform("own", lambda x: F.struct(x["p"].alias("p"), x["event"].alias("event")))
    return made.select(F.lit(k).alias("k"), "ctx", "total", "share", (-(F.col("plnp") + rest)).alias("entropy"), _top(F.concat(own, others)).alias("top"), "lower")


def _top(items: Column) -> Column:
    """The ``TOP`` most probable of (p, event), equal ones by event."""
    keyed = F.transform(items, lambda x: F.struct((-F.round(x["p"], PLACES)).alias("o"), x["event"].alias("event"), x["p"].alias("p")))
    return F.transform(F.slice(F.array_sort(keyed), 1, TOP), lambda x: F.struct(x["p"].alias("p"), x["event"].alias("event")))


def score(windows: DataFrame, model: tuple[DataFrame, DataFrame], vocab: DataFrame, order: int = ORDER) -> DataFrame:
    """``windows`` with p_true, nll, predicted, msp, miss, gap, entropy_n, surprisal, composite and target rank.

    Two joins for each order, on the context and on context and target. The longest context that training saw decides. A
    target seen after it has a stored probability; else the shares of the longer contexts multiply that of
    the first shorter one that saw it.
    """
    return signals(probable(windows, model, order), windows.columns, vocab)


def probable(windows: DataFrame, model: tuple[DataFrame, DataFrame], order: int = ORDER) -> DataFrame:
    """``windows`` with p_true and ``__f``, the entropy and top of the deciding context."""
    probs, contexts = model
    base = probs.where("k = 0").select(F.col("event").alias("target"), F.col("p").alias("__p0"))
    first = contexts.where("k = 0").select(F.struct("entropy", "top").alias("__f0"))
    out = windows.join(base, "target", "left").join(F.broadcast(first), F.lit(True), "left")  # first: one row
    for k in range(1, order + 1):
        key = f"__c{k}"
        out = out.withColumn(key, context(F.col("ctx"), k))
        known = contexts.where(F.col("k") == k).select(F.col("ctx").alias(key), F.col("share").alias(f"__s{k}"), F.struct("entropy", "top").alias(f"__f{k}"))
        own = probs.where(F.col("k") == k).select(F.col("ctx").alias(key), F.col("event").alias("target"), F.col("p").alias(f"__p{k}"))
        out = out.join(known, key, "left").join(own, [key, "target"], "left")
    p = F.col("__p0")
    for k in range(1, order + 1):
        p = F.coalesce(F.col(f"__p{k}"), F.coalesce(F.col(f"__s{k}"), F.lit(1.0)) * p)
    deciding = F.coalesce(*(F.col(f"__f{k}") for k in range(order, -1, -1)))
    return out.select(*windows.columns, F.coalesce(p, F.lit(0.0)).alias("p_true"), deciding.alias("__f"))


def signals(scored: DataFrame, columns: list[str], vocab: DataFrame) -> DataFrame:
    """``columns`` and the signals of windows with ``p_true`` (null counts as 0) and ``__f``, the entropy and top of the deciding context."""
    out = scored.crossJoin(F.broadcast(vocab.agg(F.count("*").alias("__v")))).withColumn("p_true", F.coalesce("p_true", F.lit(0.0)))
    top = F.col("__f.top")
    out = out.select(
        *columns, "p_true", (-F.ln(F.least(F.greatest("p_true", F.lit(1e-12)), F.lit(1.0)))).alias("nll"), F.get(top, F.lit(0))["event"].alias("predicted"), F.get(top, F.lit(0))["p"].alias("msp"),
        F.when(F.exists(F.slice(top, 1, MISS_RANK), lambda x: x["event"] == F.col("target")), 0).otherwise(1).alias("miss"),
        (F.get(top, F.lit(0))["p"] - F.coalesce(F.get(top, F.lit(1))["p"], F.lit(0.0))).alias("gap"), (F.col("__f.entropy") / F.ln(F.greatest(F.col("__v"), F.lit(2)))).alias("entropy_n"),
        F.coalesce(F.array_position(F.transform(top, lambda x: x["event"]), F.col("target")), F.lit(0)).alias("target_rank"),
    )
    out = out.withColumn("surprisal", 1 - F.col("p_true"))
    return out.withColumn("composite", composite(F.col("surprisal"), F.col("entropy_n"), F.col("miss")))


def composite(surprisal: Column, entropy_n: Column, miss: Column) -> Column:
    """Weighted sum of the three signals, within [0, 1]."""
    total = (1 - ENTROPY_WEIGHT - MISS_WEIGHT) * surprisal + ENTROPY_WEIGHT * entropy_n + MISS_WEIGHT * miss
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def losses(scored: DataFrame, alpha: float = 1.0, gamma: float = 2.0) -> DataFrame:
    """Mean cross-entropy and mean focal loss."""
    focal = alpha * F.pow(1 - F.col("p_true"), gamma) * F.col("nll")
    return scored.agg(F.count("*").alias("n"), F.avg("nll").alias("cross_entropy"), F.avg(focal).alias("focal"))


def occlusion(windows: DataFrame, model: tuple[DataFrame, DataFrame], keys: list[str], order: int = ORDER) -> DataFrame:
    """M09, first half: (keys, left_out, event, weight) of the last ``order`` places of each context.

    A place weighs by how much log p of the target changes when its event is left out and the rest moves up, so windows
    need ``order`` + 1 events of context. Weights of a window sum to 1; where nothing changes its places
    share alike. Places further back do not reach the model and have no weight.
    """
    size = F.size("ctx")
    spread = windows.select(*keys, "target", "ctx", F.explode(F.sequence(F.lit(0), F.least(size, F.lit(order)))).alias("left_out"))
    spread = spread.withColumn("event", F.when(F.col("left_out") > 0, F.get("ctx", size - F.col("left_out"))))
    spread = spread.withColumn("ctx", F.filter("ctx", lambda _, i: i != size - F.col("left_out")))
    own = Window.partitionBy(*keys)
    logs = probable(spread, model, order).select(*keys, "left_out", "event", F.ln(F.greatest("p_true", F.lit(1e-12))).alias("lp"))
    change = logs.withColumn("change", F.abs(F.col("lp") - F.max(F.when(F.col("left_out") == 0, F.col("lp"))).over(own))).where("left_out > 0")
    total, n = F.sum("change").over(own), F.count("*").over(own)
    return change.select(*keys, "left_out", "event", F.when(total > 1e-9, F.col("change") / total).otherwise(1.0 / n).alias("weight"))


def attribution(weights: DataFrame, k: int = 5) -> DataFrame:
    """(window_id, event, weight, rank): weights of a window's positions summed by event, the ``k`` largest."""
    total = weights.groupBy("window_id", "event").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("window_id").orderBy(F.round("weight", PLACES).desc(), "event")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
