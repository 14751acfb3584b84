"""Thresholds learnt on validation blocks, bands and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import quantiles, running, text_key
from . import metrics

MAX_NORMAL_RATE = 0.01
BANDS = ["NORMAL", "UNCERTAIN", "ANOMALY"]
#: Cut-offs of the model's own confidence.
MSP_HIGH, MSP_LOW = 0.70, 0.40


def best_f1(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold of the largest F1, the lowest of tied ones: (threshold, f1, precision, recall)."""
    c = metrics.curve(scored, by)
    f1 = metrics.ratio(2 * F.col("cp"), F.col("cp") + F.col("cq") + F.col("tp"))
    best = c.withColumn("f1", f1).groupBy(*(by or [])).agg(F.max(F.struct(F.round("f1", 12).alias("o"), (-F.col("score")).alias("s"), "f1", "cp", "cq", "tp")).alias("b"))
    return best.select(*(by or []), (-F.col("b.s")).alias("threshold"), F.col("b.f1").alias("f1"), metrics.ratio(F.col("b.cp"), F.col("b.cp") + F.col("b.cq")).alias("precision"), metrics.ratio(F.col("b.cp"), F.col("b.tp")).alias("recall"))


def derive_bands(scored: DataFrame, by: list[str] | None = None, max_normal_rate: float = MAX_NORMAL_RATE, id_col: str = "block_id") -> DataFrame:
    """(uncertain, suspicious): cut-offs from validation rows (id, score, y).

    Suspicious is T02. Rows are ranked by ascending score (ties by id); uncertain is the score one row past
    the last prefix whose anomaly rate is at most ``max_normal_rate``, the lowest score if there is none,
    and never above suspicious.
    """
    by = by or []
    rows = running(scored, [F.col("score"), F.col(id_col)], {"r": F.lit(1), "cy": F.col("y")}, F.col("score"), by, tie=text_key(F.col(id_col).cast("string")))
    marks = rows.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("cy") <= max_normal_rate * F.col("r"), F.col("r"))), F.lit(0)).alias("clean"), F.max("r").alias("n"))
    at = marks.select(*by, F.when(F.col("clean") == 0, 1).otherwise(F.least(F.col("clean") + 1, F.col("n"))).alias("r"))
    low = rows.join(at, [*by, "r"]).select(*by, F.col("score").alias("low"))
    top = best_f1(scored, by).select(*by, F.col("threshold").alias("suspicious"))
    both = low.join(top, by) if by else low.crossJoin(top)  # single rows
    return both.select(*by, F.least("low", "suspicious").alias("uncertain"), "suspicious")


def normal_quantiles(scored: DataFrame, low: float = 0.95, high: float = 0.99) -> DataFrame:
    """Cut-offs at two quantiles of normal validation scores, for validation sets without anomalies."""
    return quantiles(scored.where("y = 0"), "score", {"uncertain": low, "suspicious": high})


def calibrated(train: DataFrame, low: float = 0.90, high: float = 0.99) -> DataFrame:
    """Two quantiles of training scores, with linear interpolation; the lower never above the higher."""
    return quantiles(train, "score", {"uncertain": low, "suspicious": high}).select(F.least("uncertain", "suspicious").alias("uncertain"), "suspicious")


def classify(score: Column, uncertain: Column, suspicious: Column) -> Column:
    """Suspicious wins, then uncertain."""
    return F.when(score >= suspicious, "ANOMALY").when(score >= uncertain, "UNCERTAIN").otherwise("NORMAL")


def fixed_bands(score: Column, anomaly: float) -> Column:
    """Cut-offs at ``anomaly`` and half of it."""
    return classify(score, F.lit(anomaly / 2), F.lit(anomaly))


def msp_band(msp: Column, high: Column | float = MSP_HIGH, low: Column | float = MSP_LOW) -> Column:
    """Confident windows are NORMAL, unsure ones ANOMALY, between them UNCERTAIN; NORMAL wins on overlap."""
    high, low = (x if isinstance(x, Column) else F.lit(x) for x in (high, low))
    return F.when(msp >= high, "NORMAL").when(msp <= low, "ANOMALY").otherwise("UNCERTAIN")


def banded(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows with their band; ``cutoffs`` is one row."""
    return scored.crossJoin(F.broadcast(cutoffs)).withColumn("band", classify(F.col("score"), F.col("uncertain"), F.col("suspicious"))).drop("uncertain", "suspicious")


def band_summary(rows: DataFrame) -> DataFrame:
    """Per band its count, share, anomalous share and mean score; empty bands stay, and a TOTAL row is added."""
    spark = rows.sparkSession
    part = rows.groupBy("band").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum("score").alias("total"))
    fixed = spark.createDataFrame([(b,) for b in BANDS], "band string").join(part, "band", "left").fillna(0, ["n", "pos", "total"])
    summed = fixed.rollup("band").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("total").alias("total"))
    every = summed.agg(F.max("n").alias("all"))
    return summed.crossJoin(every).select(F.coalesce("band", F.lit("TOTAL")).alias("band"), "n", metrics.ratio(F.col("n"), F.col("all")).alias("share"), metrics.ratio(F.col("pos"), F.col("n")).alias("purity"), metrics.ratio(F.col("total"), F.col("n")).alias("mean_score"))


def threshold_study(windows: DataFrame, sets: list[tuple[str, float, float]]) -> DataFrame:
    """The same windows banded under several (high, low) pairs: share sent on and accuracy by band."""
    table = windows.sparkSession.createDataFrame(sets, "set_name string, high double, low double")
    rows = windows.crossJoin(F.broadcast(table)).withColumn("band", msp_band(F.col("msp"), F.col("high"), F.col("low")))
    right = F.col("target") == F.col("predicted")
    acc = lambda b: metrics.ratio(F.count_if((F.col("band") == b) & right), F.count_if(F.col("band") == b))
    return rows.groupBy("set_name", "high", "low").agg(
        *(F.count_if(F.col("band") == b).alias(f"n_{b.lower()}") for b in BANDS), F.avg(F.when(F.col("band") == "UNCERTAIN", 1.0).otherwise(0.0)).alias("usage"), acc("NORMAL").alias("normal_accuracy"), acc("ANOMALY").alias("anomaly_accuracy"),
    )


def band_sizes(long: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Validation band sizes for each candidate score."""
    b = classify(F.col("score"), F.col("uncertain"), F.col("suspicious"))
    return long.join(cutoffs, "score_name").withColumn("band", b).groupBy("score_name").agg(*(F.count_if(F.col("band") == x).alias(f"n_{x.lower()}") for x in BANDS))


def adoption_gate(quality: DataFrame, sizes: DataFrame, candidate: str, incumbent: str) -> DataFrame:
    """Adopt the candidate if its validation PR-AUC leads by .005 and its uncertain band is big enough."""
    pick = lambda name, p: quality.where(F.col("score_name") == name).select(F.col("pr_auc").alias(p))
    own = sizes.where(F.col("score_name") == candidate).select("n_uncertain", (F.col("n_normal") + F.col("n_uncertain") + F.col("n_anomaly")).alias("n_val"))
    gap = (F.col("new") - F.col("old")).alias("gap")
    row = pick(candidate, "new").crossJoin(pick(incumbent, "old")).crossJoin(own).select(gap, "n_uncertain", F.greatest(F.lit(20.0), 0.01 * F.col("n_val")).alias("needed"))
    return row.withColumn("adopt", (F.round("gap", 9) >= 0.005) & (F.col("n_uncertain") >= F.col("needed")))


def escalation_cost(rows: DataFrame, seconds: float = 14.9) -> DataFrame:
    """Share of blocks to look at closer, and hours for all against hours for those only."""
    flagged = F.count_if(F.col("band") != "NORMAL")
    n = F.count("*")
    return rows.agg(n.alias("n"), flagged.alias("n_flagged"), metrics.ratio(flagged, n).alias("flagged_share"), (n * seconds / 3600).alias("hours_all"), (flagged * seconds / 3600).alias("hours_routed"), metrics.ratio(n, flagged).alias("reduction"))


def capped_routing(windows: DataFrame, cap: int) -> DataFrame:
    """``routed`` for the ``cap`` least confident UNCERTAIN windows; found by a top-n, not a global sort."""
    picked = windows.where("band = 'UNCERTAIN'").orderBy("msp_r", "block_id", "pos").limit(cap).select("block_id", "pos", F.lit(True).alias("routed"))
    return windows.join(picked, ["block_id", "pos"], "left").withColumn("routed", F.coalesce("routed", F.lit(False)))
