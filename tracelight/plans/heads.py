"""Queries of the second-stage head; they fit models, so their results are tested by invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import head, identity, metrics
from ..shared import new_path, stored
from .lifecycle import lifecycle, read
from .registry import query, r6
from .texts import _cases


def _rows(s, d):
    return head.embedding_rows(read(s, d, "embeddings"))


def _train(rows):
    return rows.where("vec_id % 5 <> 0")


def _head(s, d):
    rows = _rows(s, d)
    return head.fit_head(_train(rows))


@query("h02_fit_head")
def _(s, d):
    model = _head(s, d)
    done = head.score_head(_train(_rows(s, d)), model).withColumn("pred", F.col("verdict"))
    return metrics.prf(done).select("tn", "fp", "fn", "tp", *r6("precision", "recall", "f1"))


@query("h03_score_head")
def _(s, d):
    """Every vector scored, with a mark for those that training did not see; a few have lost their vector."""
    rows = _rows(s, d).withColumn("held_out", F.col("vec_id") % 5 == 0)
    some = rows.withColumn("vector", F.when(F.col("vec_id") % 15 != 0, F.col("vector")))
    return head.score_head(some, _head(s, d)).select("vec_id", "y", "held_out", *r6("score"), "verdict", "reason")


@query("h04_reproduction_gate")
def _(s, d):
    """A head is released: saved with the confusion it has on held-out rows. A later fit must reach that record."""
    held_out = _rows(s, d).where("vec_id % 5 = 0")
    judged = lambda own: head.score_head(held_out, own).withColumn("pred", F.col("verdict"))
    path = new_path(s, "released-head")
    head.release(_head(s, d), judged, path)
    again = head.reproduced(judged(_head(s, d)), head.recorded(s, path))
    saved = metrics.confusion(judged(head.released(path))).select(F.struct("tn", "fp", "fn", "tp").alias("saved"))
    return again.crossJoin(saved).select(*again.columns, (F.col("saved") == F.struct("want_tn", "want_fp", "want_fn", "want_tp")).alias("saved_same"))  # single rows


@query("h05_text_vectors")
def _(s, d):
    texts = _cases(s, d).select("case_id", F.col("blob").alias("text"))
    from pyspark.ml.functions import vector_to_array

    vectors = head.text_vectors(texts, dims=64)
    return vectors.select("case_id", F.size(F.filter(vector_to_array("vector"), lambda x: x != 0)).alias("n_terms"))


@query("q07_source_control")
def _(s, d):
    """How well block scores tell the log's sources apart without any anomaly: per source the AUROC of heads on blocks they did not see."""
    from pyspark.ml.functions import array_to_vector

    life = lifecycle(s, d)
    sources = stored(identity.majority_source(life.events), "majority-source")
    own = life.wide.where("y = 0").join(sources, "block_id").select("block_id", "source", array_to_vector(F.array("nll_mean", "surprisal_max", "miss_frac", "msp_mean")).alias("vector"))
    out = None
    for source in sorted(r["source"] for r in sources.select("source").distinct().collect()):  # the log's files
        rows = own.withColumn("y", (F.col("source") == source).cast("int"))
        done = metrics.ranking_quality(head.out_of_fold(rows, "block_id").select("y", "score")).select(F.lit(source).alias("source"), *r6("auroc", "pr_auc"), "n_pos", "n_neg")
        out = done if out is None else out.unionByName(done)
    return out
