"""Second-stage head over vectors, and statistics that need resampling."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stored
from . import metrics
from .splits import seeded_hash


def text_vectors(texts: DataFrame, text_col: str = "text", dims: int = 1024) -> DataFrame:
    """``vector``: hashed TF-IDF of a text column."""
    stages = [RegexTokenizer(inputCol=text_col, outputCol="__w", pattern="\\W+"), HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dims), IDF(inputCol="__tf", outputCol="vector")]
    clean = texts.withColumn(text_col, F.coalesce(text_col, F.lit("")))
    return Pipeline(stages=stages).fit(clean).transform(clean).drop("__w", "__tf")


def fit_head(rows: DataFrame, reg: float = 0.01) -> PipelineModel:
    """Standardised, class-balanced, L2-regularised logistic regression on (vector, y)."""
    sizes = rows.groupBy("y").agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*").alias("__all"))
    weighted = rows.join(F.broadcast(sizes), "y").crossJoin(F.broadcast(total)).withColumn("w", F.col("__all") / (2 * F.col("__n"))).withColumn("y", F.col("y").cast("double"))
    scale = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scale, LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="w", regParam=reg, maxIter=60)]).fit(weighted.select("vector", "y", "w"))


def score_head(rows: DataFrame, head: PipelineModel | None, threshold: float = 0.5) -> DataFrame:
    """Score, verdict and reason; without a head or a vector the verdict is null and the block stays UNCERTAIN."""
    if head is None:
        return rows.withColumns({"score": F.lit(None).cast("double"), "verdict": F.lit(None).cast("int"), "reason": F.lit("no-head")})
    done = head.transform(rows.where("vector is not null")).withColumn("score", vector_to_array("probability")[1])
    done = done.select(*rows.columns, "score", (F.col("score") >= threshold).cast("int").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    missing = rows.where("vector is null").withColumns({"score": F.lit(None).cast("double"), "verdict": F.lit(None).cast("int"), "reason": F.lit("no-vector")})
    return done.unionByName(missing)


def reproduced(judged: DataFrame, expected: DataFrame) -> DataFrame:
    """Confusion of a refit head beside the recorded one, and whether they are equal."""
    got = metrics.confusion(judged)
    want = expected.select(*(F.col(c).alias(f"want_{c}") for c in ("tn", "fp", "fn", "tp")))
    same = F.lit(True)
    for c in ("tn", "fp", "fn", "tp"):
        same = same & (F.col(c) == F.col(f"want_{c}"))
    return got.crossJoin(want).withColumn("same", same)  # single rows


def release(head: PipelineModel, judge: Callable[[PipelineModel], DataFrame], path: str) -> None:
    """Save a head and, beside it, the confusion of the rows it judges."""
    head.write().save(f"{path}/head")
    metrics.confusion(judge(head)).write.parquet(f"{path}/confusion")


def released(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/head")


def recorded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/confusion")


def embedding_rows(embeddings: DataFrame, key: str = "vec_id") -> DataFrame:
    """An existing vector column as head input: (key, vector, y) with y = 1 for labels 5 and up."""
    return embeddings.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"), (F.col("label") >= 5).cast("int").alias("y"))


def out_of_fold(rows: DataFrame, key: str, folds: int = 2, seed: int = 42) -> DataFrame:
    """Q07: ``rows`` (key, vector, y) with the score of a head that was fitted without them, one fold of a hash of ``key`` after the other.

    A fold whose other rows have one label only gets the score 0.5.
    """
    dealt = rows.withColumn("__fold", F.pmod(seeded_hash(F.col(key).cast("string"), seed), F.lit(folds)))
    out = None
    for fold in range(folds):
        train, held = dealt.where(F.col("__fold") != fold), dealt.where(F.col("__fold") == fold)
        labels = train.agg(F.countDistinct("y")).first()[0]
        own = score_head(held, fit_head(train)) if labels > 1 else held.withColumn("score", F.lit(0.5))
        own = own.select(*rows.columns, "score")
        out = own if out is None else out.unionByName(own)
    return out


#: Poisson totals of so many blocks at most are drawn from their distribution function, larger ones from a normal number.
MOST_EXACT = 32
#: No number drawn is larger: (2 ** 32 - 0.5) / 2 ** 32.
MOST_DRAWN = 1 - 1e-10


def poisson_table(spark: SparkSession) -> DataFrame:
    """(n, cdf): the distribution function of Poisson variables with mean 1 to ``MOST_EXACT``, up to the first value that no number drawn reaches."""
    rows = []
    for n in range(1, MOST_EXACT + 1):
        terms = [math.exp(-n + k * math.log(n) - math.lgamma(k + 1)) for k in range(120)]
        cdf = list(accumulate(terms))
        rows.append((n, cdf[: 1 + next(k for k, c in enumerate(cdf) if c > MOST_DRAWN)]))
    return spark.createDataFrame(rows, "n long, cdf array<double>")


def bootstrap_difference(paired: DataFrame, replicates: int = 50, seed: int = 42) -> DataFrame:
    """Interval of the AUROC difference of two scores (block_id, y, a, b) from Poisson-weighted replicates.

    Blocks that agree in y and, to nine places, in both scores are counted first. In a replicate n of them have a
    Poisson total of mean n, the sum of n weights of mean 1: drawn by inversion from a hash of the scores and the replicate
    up to ``MOST_EXACT``, beyond it as the normal number of two hashes with its skewness corrected. So rows grow with
    distinct scores, not with blocks, and none is collected. Hashes are stored before they are compared, as
    Spark would otherwise take them anew for each value of a distribution function, and so are the points, which are read four times.
    """
    spark = paired.sparkSession
    counted = paired.select("y", F.round("a", 9).alias("a"), F.round("b", 9).alias("b")).groupBy("y", "a", "b").agg(F.count("*").alias("n"))
    table = spark.range(replicates).withColumnRenamed("id", "replicate")
    whole = lambda c: F.round(F.col(c) * 1e9).cast("decimal(38,0)").cast("string")
    key = F.concat_ws("/", whole("a"), whole("b"), F.col("y").cast("string"), F.col("replicate").cast("string"))
    spread = counted.crossJoin(F.broadcast(table)).repartition("y", "a", "b", "replicate")  # few counts fill one partition, but not their replicates
    u, v = ((seeded_hash(k, seed) + 0.5) / float(1 << 32) for k in (key, F.concat(key, F.lit("/2"))))
    z = F.sqrt(-2 * F.ln("u")) * F.cos(2 * math.pi * F.col("v"))
    large = F.greatest(F.floor(F.col("n") + F.sqrt("n") * z + (z * z - 1) / 6 + 0.5), F.lit(0))
    drawn = stored(spread.select("*", u.alias("u"), v.alias("v")), "drawn").join(F.broadcast(poisson_table(spark)), "n", "left")  # of a fixed size
    weighted = drawn.withColumn("w", F.when(F.col("cdf").isNotNull(), F.size(F.filter("cdf", lambda c: c <= F.col("u")))).otherwise(large)).where("w > 0")
    long = weighted.select("replicate", "y", "w", F.explode(F.array(F.struct(F.lit("a").alias("name"), F.col("a").alias("score")), F.struct(F.lit("b").alias("name"), F.col("b").alias("score")))).alias("s")).select("replicate", "y", "w", "s.*")
    points = stored(long.groupBy("replicate", "name", "score").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum(F.col("w") * (1 - F.col("y"))).alias("q")), "points")
    from ..functions.ordered import running

    summed = running(points, [F.col("score").desc()], {"cp": F.col("p")}, F.col("score"), ["replicate", "name"], descending=True)
    area = summed.groupBy("replicate", "name").agg(metrics.ratio(F.sum((F.col("cp") - F.col("p")) * F.col("q") + F.col("p") * F.col("q") * 0.5), F.sum("p") * F.sum("q")).alias("auroc"))
    both = area.groupBy("replicate").pivot("name", ["a", "b"]).agg(F.first("auroc")).withColumn("diff", F.col("a") - F.col("b"))
    q = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return both.agg(F.count("*").alias("n_replicates"), q.alias("q")).select("n_replicates", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))


def separation_tests(long: DataFrame, name: str = "score_name") -> DataFrame:
    """Per feature the AUROC, its rank-sum z and p (normal approximation, variance less that of ties) and the Benjamini-Hochberg q.

    ``t`` equal scores take (t ** 3 - t) / (N * (N - 1)) off the N + 1 of the variance m * n / 12 * (N + 1). A feature of
    one value has z = 0.
    """
    t = F.col("t").cast("double")
    ties = long.groupBy(name, "score").agg(F.count("*").alias("t")).groupBy(name).agg(F.sum(t * t * t - t).alias("ties"))
    own = metrics.ranking_quality(long, [name]).join(ties, name)
    m, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    spread = m + n + 1 - F.col("ties") / F.greatest((m + n) * (m + n - 1), F.lit(1.0))
    z = F.coalesce(F.abs(F.col("auroc") - 0.5) * F.sqrt(12.0 * m * n / F.when(spread > 1e-9, spread)), F.lit(0.0))
    # two-sided normal tail by the complementary error function's rational approximation (absolute error below 1.5e-7)
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    tests = own.select(name, "auroc", "n_pos", "n_neg", z.alias("z"), tail.alias("p"))
    return metrics.benjamini_hochberg(tests, "p", name)
