"""Queries over the detection lifecycle: sessions, splits, vocabulary, model, scores, bands, rankings and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import quantiles
from ..operators import bands, context_tree, head, identity, metrics, model, ranking, scores, sessions, splits, vocab
from ..shared import stored
from .checks import CHRONOLOGICAL, NAMES, check, of_source, variant
from .lifecycle import lifecycle
from .registry import longs, query, r6

SCORE = "nll_mean"
V = ("va", "te")


def joined(c: str):
    return F.array_join(c, "|").alias(c)


# --- sessions and windows -------------------------------------------------------------------------------------------
@query("w01_count_windows", check("SELECT block_id, pos, line_no, event FROM ev"))
def _(s, d):
    return lifecycle(s, d).events.select("block_id", *longs("pos"), "line_no", "event")


@query("w02_keyed_sessions", check("SELECT session_id, string_agg(event, '|' ORDER BY ts, line_no) AS events, count(*) AS n FROM log GROUP BY session_id"))
def _(s, d):
    return sessions.keyed_sessions(lifecycle(s, d).log).select("session_id", joined("events"), F.size("events").cast("long").alias("n"))


@query("w03_any_alert", check("SELECT block_id, y FROM blk"))
def _(s, d):
    return sessions.any_alert(lifecycle(s, d).events)


LABEL_SQL = """
, src AS (SELECT session_id, CASE WHEN max(value) >= 250 THEN 1 ELSE 0 END AS bad FROM log GROUP BY session_id)
SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM log WHERE value >= 300) THEN 1 ELSE 0 END AS y, 'strict' AS label_mode FROM src
UNION ALL SELECT session_id, bad AS y, 'source' AS label_mode FROM src"""


@query("w04_session_labels", check(LABEL_SQL))
def _(s, d):
    log = lifecycle(s, d).log
    own = log.groupBy("session_id").agg(F.array_distinct(F.array_append(F.collect_set("source"), F.when(F.max("value") >= 250, "abnormal").otherwise("normal"))).alias("sources"))
    marked = log.where("value >= 300").select("session_id")
    return sessions.session_labels(own, marked, "strict").unionByName(sessions.session_labels(own, marked, "source")).select("session_id", "y", "label_mode")


@query("w05_provenance", check("SELECT session_id, (SELECT string_agg(source, '|' ORDER BY source) FROM (SELECT DISTINCT source FROM log l WHERE l.session_id = log.session_id)) AS sources, count(*) AS n_events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM log GROUP BY session_id"))
def _(s, d):
    return sessions.provenance(lifecycle(s, d).log).select("session_id", joined("sources"), "n_events", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("w06_flatten", check("SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, line_no) - 1 AS pos, event FROM log"))
def _(s, d):
    return sessions.flatten(sessions.keyed_sessions(lifecycle(s, d).log), "session_id").select("session_id", *longs("pos"), "event")


@query("w07_in_block_windows", check("SELECT * FROM (SELECT block_id, pos, event AS target, string_agg(event, '|') OVER (PARTITION BY block_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ctx FROM ev) WHERE pos > 0"))
def _(s, d):
    return sessions.in_block_windows(lifecycle(s, d).events).select("block_id", *longs("pos"), "target", joined("ctx"))


def _streams(s, d) -> DataFrame:
    # line numbers within one user's stream, so that no single partition orders the whole log
    own = Window.partitionBy("session_id").orderBy("ts", "event_id")
    return lifecycle(s, d).log.select(F.col("session_id").alias("stream_id"), F.row_number().over(own).cast("long").alias("line_no"), "event")


FLAT = ", st AS (SELECT session_id AS stream_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS line_no, event FROM log), fw AS (SELECT * FROM (SELECT stream_id, line_no, event AS target, string_agg(event, '|') OVER w AS ctx, count(*) OVER w AS n FROM st WINDOW w AS (PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE n = 5)"


@query("w08_flat_windows", check(FLAT + " SELECT stream_id, line_no, target, ctx FROM fw"))
def _(s, d):
    return sessions.flat_windows(_streams(s, d), 5).select("stream_id", "line_no", "target", joined("ctx"))


BATCH = 64


@query("w09_length_buckets", check(f"SELECT ctx_len, batch_id, least({BATCH}, c - batch_id * {BATCH}) AS n FROM (SELECT ctx_len, c, unnest(range((c + {BATCH - 1}) // {BATCH})) AS batch_id FROM (SELECT pos AS ctx_len, count(*) AS c FROM win GROUP BY pos))"))
def _(s, d):
    """Batches of each context length with their sizes."""
    batches = sessions.length_batches(lifecycle(s, d).windows.select("ctx_len", "block_id", "pos"), BATCH, ["block_id", "pos"])
    return batches.groupBy(F.col("ctx_len").cast("long").alias("ctx_len"), "batch_id").agg(F.count("*").alias("n"))


@query("w10_long_enough", check("SELECT session_id, count(*) FILTER (event IN ('click', 'error')) AS n_known, count(*) FILTER (event IN ('click', 'error')) >= 20 AS kept FROM log GROUP BY session_id"))
def _(s, d):
    life = lifecycle(s, d)
    known = life.log.join(life.vocab.where("event in ('click', 'error')").select("event", "idx"), "event", "left")
    return sessions.long_enough(known, 20, "session_id")


@query("w11_labelled_blocks", check("SELECT e.block_id, string_agg(e.event, '|' ORDER BY e.pos) AS events, b.y FROM ev e JOIN blk b USING (block_id) WHERE b.ordinal % 3 <> 0 GROUP BY e.block_id, b.y"))
def _(s, d):
    life = lifecycle(s, d)
    traces = life.events.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event"))), lambda x: x["event"]).alias("events"))
    return sessions.labelled_blocks(traces, life.blocks.where("ordinal % 3 <> 0").select("block_id", "y")).select("block_id", joined("events"), "y")


@query("w12_lost_labels", check("SELECT CAST(c_custkey AS VARCHAR) AS session_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT session_id FROM log)"))
def _(s, d):
    marked = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("session_id"))
    return sessions.lost_labels(marked, lifecycle(s, d).log.select("session_id"))


# --- splits ---------------------------------------------------------------------------------------------------------
@query("x01_stratified", check("SELECT block_id, y, split FROM spl"))
def _(s, d):
    return lifecycle(s, d).blocks.select("block_id", "y", "split")


@query("x02_chronological", check("SELECT block_id, CASE WHEN ordinal < (SELECT count(*) FROM blk) * 7 // 10 THEN 'tr' WHEN ordinal < (SELECT count(*) FROM blk) * 8 // 10 THEN 'va' ELSE 'te' END AS split FROM blk"))
def _(s, d):
    return splits.chronological(lifecycle(s, d).blocks.drop("split")).select("block_id", "split")


@query("x03_anomaly_holdout", check("SELECT block_id, CASE WHEN y = 1 THEN 'te' ELSE split END AS split FROM spl"))
def _(s, d):
    return splits.anomaly_holdout(lifecycle(s, d).blocks.drop("split")).select("block_id", "split")


@query("x04_normal_only", check("SELECT block_id FROM spl WHERE split = 'tr' AND y = 0"))
def _(s, d):
    return splits.normal_only(lifecycle(s, d).blocks).select("block_id")


@query("x05_sample_rows", check("SELECT block_id, y FROM hsh ORDER BY h, block_id LIMIT 50"))
def _(s, d):
    return splits.sample_rows(lifecycle(s, d).blocks, 50, "block_id").select("block_id", "y")


@query("x06_first_rows", check("SELECT block_id, y FROM blk WHERE ordinal < 25"))
def _(s, d):
    return splits.first_rows(lifecycle(s, d).blocks, 25).select("block_id", "y")


@query("x07_exemplars", check("SELECT block_id, y FROM (SELECT b.block_id, b.y, row_number() OVER (PARTITION BY b.y ORDER BY h.h, b.block_id) AS r FROM bnd b JOIN hsh h USING (block_id) WHERE band = 'UNCERTAIN') WHERE r <= 3"))
def _(s, d):
    return splits.exemplars(_banded(s, d).where("band = 'UNCERTAIN'"), 6).select("block_id", "y")


@query("x08_split_audit", check("""
, own AS (SELECT DISTINCT split, event FROM ev JOIN spl USING (block_id))
SELECT s.split, count(*) AS n_blocks, count(DISTINCT s.block_id) AS n_distinct, CAST(sum(y) AS BIGINT) AS n_anomalous, round(avg(y), 6) AS base_rate,
  (SELECT count(*) FROM own o WHERE o.split = s.split AND o.event NOT IN (SELECT event FROM own WHERE split = 'tr')) AS unseen_events FROM spl s GROUP BY s.split"""))
def _(s, d):
    life = lifecycle(s, d)
    return splits.audit(life.blocks, life.events)


# --- vocabulary -----------------------------------------------------------------------------------------------------
@query("v01_fit", check("SELECT event, idx, n FROM voc"))
def _(s, d):
    return lifecycle(s, d).vocab.select("event", *longs("idx", "n"))


def _some(s, d) -> DataFrame:
    """A vocabulary without two of the events, so that some are unknown; indices of the whole one."""
    return lifecycle(s, d).vocab.where("event not in ('error', 'view')")


@query("v02_encode", check("SELECT block_id, pos, idx FROM ev JOIN voc USING (event) WHERE event NOT IN ('error', 'view')"))
def _(s, d):
    return vocab.encode(lifecycle(s, d).events, _some(s, d)).select("block_id", *longs("pos", "idx"))


@query("v03_dropped", check("SELECT block_id, count(*) FILTER (event IN ('error', 'view')) AS n_dropped, count(*) AS n_events FROM ev GROUP BY block_id"))
def _(s, d):
    return vocab.dropped(lifecycle(s, d).events, _some(s, d))


@query("v04_decode", check("SELECT block_id, pos, CASE WHEN event IN ('error', 'view') THEN '<UNK:' || idx || '>' ELSE event END AS event FROM ev JOIN voc USING (event)"))
def _(s, d):
    life = lifecycle(s, d)
    coded = vocab.encode(life.events, life.vocab).drop("event")
    return vocab.decode(coded, _some(s, d)).select("block_id", *longs("pos"), "event")


@query("v05_out_of_range", check("SELECT (SELECT count(*) FROM ev JOIN voc USING (event) WHERE idx >= 3) AS n_bad, block_id, pos, idx AS value FROM ev JOIN voc USING (event) WHERE idx >= 3 ORDER BY block_id, pos LIMIT 1"))
def _(s, d):
    life = lifecycle(s, d)
    return vocab.out_of_range(vocab.encode(life.events, life.vocab), 3).select(*longs("n_bad"), "block_id", *longs("pos", "value"))


@query("v06_consistency", check("""
SELECT * FROM (SELECT 'vocab_size' AS name, CAST(5 AS BIGINT) AS expected, count(*) AS found, count(*) = 5 AS ok FROM voc UNION ALL SELECT 'seq_len', 19, max(pos), max(pos) = 19 FROM win
UNION ALL SELECT 'n_windows', 1, count(*), count(*) = 1 FROM win UNION ALL SELECT 'n_events', 2, count(*), count(*) = 2 FROM ev)"""))
def _(s, d):
    life = lifecycle(s, d)
    want = s.createDataFrame([("vocab_size", 5), ("seq_len", 19), ("n_windows", 1), ("n_events", 2)], "name string, expected long")
    return vocab.consistency(vocab.encode(life.events, life.vocab), life.vocab, life.windows, want)


@query("v07_distribution", check("SELECT event, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM log), 6) AS pct FROM log GROUP BY event ORDER BY n DESC, event LIMIT 3"))
def _(s, d):
    return vocab.distribution(lifecycle(s, d).log, 3).select("event", "n", *r6("pct"))


@query("v08_misaligned", check(FLAT + " SELECT CAST(0 AS BIGINT) AS n_wrong, count(*) AS n_checked FROM fw WHERE line_no <= 12"))
def _(s, d):
    streams = _streams(s, d)
    return vocab.misaligned(sessions.flat_windows(streams, 5), streams, 5, 12)


@query("v09_class_weights", check("""
, raw AS (SELECT v.event, v.idx, coalesce(t.n, 0) AS n, CASE WHEN coalesce(t.n, 0) > 0 THEN sqrt((SELECT count(*) FROM ev WHERE event <> 'view') / ((SELECT count(*) FROM voc) * t.n)) ELSE 0 END AS w FROM voc v LEFT JOIN (SELECT event, count(*) AS n FROM ev WHERE event <> 'view' GROUP BY event) t USING (event))
SELECT event, idx, n, round(w / (SELECT avg(w) FROM raw), 6) AS weight FROM raw"""))
def _(s, d):
    life = lifecycle(s, d)
    return vocab.class_weights(life.events.where("event <> 'view'"), life.vocab).select("event", *longs("idx"), "n", *r6("weight"))


@query("v10_normal_frequencies", check("SELECT event, count(*) AS freq, CAST(sum(count(*)) OVER () AS BIGINT) AS total_events FROM ev JOIN spl USING (block_id) WHERE split = 'tr' AND spl.y = 0 GROUP BY event"))
def _(s, d):
    life = lifecycle(s, d)
    return vocab.normal_frequencies(life.events, life.blocks)


# --- model ----------------------------------------------------------------------------------------------------------
@query("m01_fit", check("SELECT 0 AS k, '' AS ctx, event, n FROM n0 UNION ALL SELECT 1, c1, event, n FROM n1 UNION ALL SELECT 2, c2 || '|' || c1, event, n FROM n2"))
def _(s, d):
    return model.context_counts(lifecycle(s, d).windows.where("split = 'tr' and y = 0"))


@query("m02_score_windows", check("SELECT block_id, pos, target, predicted, round(p_true, 6) AS p_true, round(nll, 6) AS nll, round(msp, 6) AS msp FROM sig"))
def _(s, d):
    return lifecycle(s, d).signals.select("block_id", *longs("pos"), "target", "predicted", *r6("p_true", "nll", "msp"))


@query("m03_top_k_miss", check("SELECT block_id, pos, miss FROM sig"))
def _(s, d):
    return lifecycle(s, d).signals.select("block_id", *longs("pos"), "miss")


@query("m04_uncertainty", check("SELECT block_id, pos, round(msp, 6) AS msp, round(gap, 6) AS gap, round(entropy_n, 6) AS entropy_n FROM sig"))
def _(s, d):
    return lifecycle(s, d).signals.select("block_id", *longs("pos"), *r6("msp", "gap", "entropy_n"))


@query("m05_composite", check("SELECT block_id, pos, round(composite, 6) AS composite FROM sig"))
def _(s, d):
    return lifecycle(s, d).signals.select("block_id", *longs("pos"), *r6("composite"))


@query("m06_losses", check("SELECT count(*) AS n, round(avg(nll), 6) AS cross_entropy, round(avg(0.25 * (1 - p_true) * (1 - p_true) * nll), 6) AS focal FROM sig WHERE split = 'te'"))
def _(s, d):
    return model.losses(lifecycle(s, d).signals.where("split = 'te'"), 0.25, 2.0).select("n", *r6("cross_entropy", "focal"))


def _variant(s, d, order: int, alpha: float, mixed: bool) -> DataFrame:
    life = lifecycle(s, d)
    train = life.windows.where("split = 'tr'" if mixed else "split = 'tr' and y = 0")
    return model.score(life.windows.where("split = 'te'"), model.fit(train, life.vocab, order, alpha), life.vocab, order)


def _order1(train: str, alpha: str) -> str:
    """SQL of an order-1 fit over other training rows, scored on the test windows."""
    return f"""(SELECT w.target, w.y, (coalesce(b.n, 0) + {alpha} * q.p) / (coalesce(t.n, 0) + {alpha}) AS p FROM win w
  JOIN (SELECT v.event, (coalesce(z.n, 0) + {alpha} / (SELECT count(*) FROM voc)) / ((SELECT count(*) FROM win WHERE {train}) + {alpha}) AS p FROM voc v LEFT JOIN (SELECT target AS event, count(*) AS n FROM win WHERE {train} GROUP BY 1) z USING (event)) q ON q.event = w.target
  LEFT JOIN (SELECT c1, target, count(*) AS n FROM win WHERE {train} GROUP BY 1, 2) b ON b.c1 = w.c1 AND b.target = w.target LEFT JOIN (SELECT c1, count(*) AS n FROM win WHERE {train} GROUP BY 1) t ON t.c1 = w.c1 WHERE w.split = 'te')"""


REGIME = """
, a AS (SELECT count(*) AS n, avg(-ln(p)) AS nll, avg(CASE WHEN y = 1 THEN -ln(p) END) AS bad FROM {0}), b AS (SELECT count(*) AS n, avg(-ln(p)) AS nll, avg(CASE WHEN y = 1 THEN -ln(p) END) AS bad FROM {1})
SELECT a.n, round(a.nll, 6) AS mixed_nll, round(b.nll, 6) AS normal_nll, round(a.nll - b.nll, 6) AS delta, round(a.bad - b.bad, 6) AS delta_anomalous FROM a, b""".format(_order1("split = 'tr'", "1.0"), _order1("split = 'tr' AND y = 0", "1.0"))


@query("m07_regimes", check(REGIME))
def _(s, d):
    out = None
    for name, mixed in (("mixed", True), ("normal", False)):
        own = _variant(s, d, 1, 1.0, mixed).select(F.lit(name).alias("regime"), "y", "nll")
        out = own if out is None else out.unionByName(own)
    wide = out.groupBy().pivot("regime", ["mixed", "normal"]).agg(F.count("nll").alias("n"), F.avg("nll").alias("nll"), F.avg(F.when(F.col("y") == 1, F.col("nll"))).alias("bad"))
    wide = wide.withColumns({"delta": F.col("mixed_nll") - F.col("normal_nll"), "delta_anomalous": F.col("mixed_bad") - F.col("normal_bad")})
    return wide.select(F.col("mixed_n").alias("n"), *r6("mixed_nll", "normal_nll", "delta", "delta_anomalous"))


def _per(signals: str) -> str:
    """SQL of counts, precision, recall and F1 of every event that is a target or a prediction in the test split."""
    return f"(SELECT event, support, coalesce(h / nullif(np, 0), 0) AS precision, coalesce(h / nullif(support, 0), 0) AS recall, coalesce(2 * h / nullif(np + support, 0), 0) AS f1 FROM (SELECT coalesce(t.event, p.event) AS event, coalesce(t.n, 0) AS support, coalesce(t.h, 0) AS h, coalesce(p.n, 0) AS np FROM (SELECT target AS event, count(*) AS n, count(*) FILTER (target = predicted) AS h FROM {signals} WHERE split = 'te' GROUP BY 1) t FULL JOIN (SELECT predicted AS event, count(*) AS n FROM {signals} WHERE split = 'te' GROUP BY 1) p ON p.event = t.event))"


TOPS = ", ".join(f"avg(CASE WHEN target_rank BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END) AS top{k}" for k in (1, 3, 5))
F1S = "sum(f1 * support) / sum(support) AS weighted_f1, avg(f1) AS macro_f1"


def _next_event(signals: DataFrame) -> DataFrame:
    """One row: top-1, top-3 and top-5 accuracy, weighted and macro F1 of the predicted events."""
    tops = metrics.top_accuracy(signals, places=None).drop("n")
    return tops.crossJoin(metrics.averages(metrics.per_event(signals)).select("weighted_f1", "macro_f1"))  # single rows


#: Name, order, smoothing, and whether the context is what follows the event instead of what precedes it.
VARIANTS = [("order1", 1, 1.0, False), ("order2", 2, 1.0, False), ("order2_a5", 2, 5.0, False), ("order2_backward", 2, 1.0, True)]
VARIED = "".join(variant(f"_{n}", o, a, b) for n, o, a, b in VARIANTS)


@query("m08_variants", check(VARIED + " " + " UNION ALL ".join(f"SELECT '{n}' AS variant, m.n, round(m.cross_entropy, 6) AS cross_entropy, round(top1, 6) AS top1, round(top3, 6) AS top3, round(weighted_f1, 6) AS weighted_f1, round(macro_f1, 6) AS macro_f1 FROM (SELECT count(*) AS n, avg(nll) AS cross_entropy, {TOPS} FROM sig_{n} WHERE split = 'te') m, (SELECT {F1S} FROM {_per('sig_' + n)}) f" for n, *_ in VARIANTS)))
def _(s, d):
    life, out = lifecycle(s, d), None
    reversed_events = life.events.select("block_id", (-F.col("pos")).alias("pos"), "event")
    backward = sessions.in_block_windows(reversed_events, model.ORDER).join(life.blocks.select("block_id", "y", "split"), "block_id")
    for name, order, alpha, back in VARIANTS:
        windows = backward if back else life.windows
        fitted = model.fit(windows.where("split = 'tr' and y = 0"), life.vocab, order, alpha)
        scored = stored(model.score(windows.where("split = 'te'"), fitted, life.vocab, order), f"variant-{name}")
        own = model.losses(scored).select("n", "cross_entropy").crossJoin(_next_event(scored))
        own = own.select(F.lit(name).alias("variant"), "n", *r6("cross_entropy", "top1", "top3", "weighted_f1", "macro_f1"))
        out = own if out is None else out.unionByName(own)
    return out


OCCLUDED = """
, oc AS (SELECT * FROM (SELECT e.block_id, e.pos, e.event AS target, lag(e.event, 1) OVER w AS c1, lag(e.event, 2) OVER w AS c2, lag(e.event, 3) OVER w AS c3, s.split FROM ev e JOIN spl s USING (block_id) WINDOW w AS (PARTITION BY e.block_id ORDER BY e.pos)) WHERE pos > 0 AND split = 'te'),
ov AS (SELECT block_id, pos, target, 0 AS left_out, NULL AS event, c1 AS a1, c2 AS a2 FROM oc UNION ALL SELECT block_id, pos, target, 1, c1, c2, c3 FROM oc UNION ALL SELECT block_id, pos, target, 2, c2, c1, c3 FROM oc WHERE c2 IS NOT NULL),
ol AS (SELECT v.*, ln((coalesce(b.n, 0) + (coalesce(a.n, 0) + p0.p) / (coalesce(u.t, 0) + 1)) / (coalesce(x.t, 0) + 1)) AS lp FROM ov v JOIN p0 ON p0.event = v.target
  LEFT JOIN n1 a ON a.c1 = v.a1 AND a.event = v.target LEFT JOIN (SELECT c1, sum(n) AS t FROM n1 GROUP BY c1) u ON u.c1 = v.a1
  LEFT JOIN n2 b ON b.c2 = v.a2 AND b.c1 = v.a1 AND b.event = v.target LEFT JOIN (SELECT c2, c1, sum(n) AS t FROM n2 GROUP BY c2, c1) x ON x.c2 = v.a2 AND x.c1 = v.a1),
od AS (SELECT o.block_id, o.pos, o.event, abs(o.lp - z.lp) AS d, sum(abs(o.lp - z.lp)) OVER own AS total, count(*) OVER own AS n FROM ol o JOIN ol z ON z.block_id = o.block_id AND z.pos = o.pos AND z.left_out = 0 WHERE o.left_out > 0 WINDOW own AS (PARTITION BY o.block_id, o.pos)),
ow AS (SELECT block_id, pos, event, sum(CASE WHEN total > 1e-9 THEN d / total ELSE 1.0 / n END) AS w FROM od GROUP BY ALL) """


def occluded(s, d) -> DataFrame:
    """(block_id, pos, left_out, event, weight) of the test windows."""
    life = lifecycle(s, d)
    near = sessions.in_block_windows(life.events.select("block_id", "pos", "event"), model.ORDER + 1).join(life.blocks.where("split = 'te'").select("block_id"), "block_id")
    return model.occlusion(near, life.model, ["block_id", "pos"])


def _wide(s, d) -> DataFrame:
    """All windows with contexts of up to 20 events."""
    life = lifecycle(s, d)
    return sessions.in_block_windows(life.events.select("block_id", "pos", "event")).join(life.placed, "block_id")


def _tree(s, d) -> tuple[DataFrame, DataFrame]:
    life = lifecycle(s, d)
    # other blocks go before their windows are made
    events = life.events.select("block_id", "pos", "event").join(life.placed.where("split = 'tr' and y = 0").select("block_id"), "block_id", "left_semi")
    return context_tree.fit(sessions.in_block_windows(events), life.vocab)


@query("m09_attribution", check(OCCLUDED + """
SELECT window_id, event, round(w, 6) AS weight, rank FROM (SELECT block_id || '/' || pos AS window_id, event, w, row_number() OVER (PARTITION BY block_id, pos ORDER BY round(w, 12) DESC, event) AS rank FROM ow) WHERE rank <= 3"""))
def _(s, d):
    """Events of each test window's context by how much the model's log p of the target depends on them."""
    weights = occluded(s, d).withColumn("window_id", F.concat_ws("/", "block_id", "pos"))
    return model.attribution(weights, 3).select("window_id", "event", *r6("weight"), *longs("rank"))


@query("m01_context_tree")
def _(s, d):
    """A tree of suffixes of up to 20 events: its nodes and what they gain, by length."""
    return context_tree.sizes(_tree(s, d)[1]).select(*longs("k"), "n_nodes", "n_seen", *r6("gain"))


@query("m02_tree_scores")
def _(s, d):
    """All windows scored by the longest suffix in the tree."""
    scored = context_tree.score(_wide(s, d), _tree(s, d), lifecycle(s, d).vocab)
    return scored.select("block_id", *longs("pos", "depth"), "target", "predicted", *r6("p_true", "nll", "msp", "entropy_n"))


#: Contexts of at most two events, kept under the same rules.
TREE2 = """
, t1 AS (SELECT c1, sum(n) AS t FROM n1 GROUP BY c1 HAVING sum(n) >= 8), q1 AS (SELECT t1.c1, p0.event, (coalesce(n1.n, 0) + p0.p) / (t1.t + 1) AS p FROM t1 CROSS JOIN p0 LEFT JOIN n1 ON n1.c1 = t1.c1 AND n1.event = p0.event),
t2 AS (SELECT c2, c1, sum(n) AS t FROM n2 GROUP BY ALL HAVING sum(n) >= 8), g2 AS (SELECT n2.c2, n2.c1, any_value(t) AS t FROM n2 JOIN t2 USING (c2, c1) JOIN q1 ON q1.c1 = n2.c1 AND q1.event = n2.event GROUP BY n2.c2, n2.c1 HAVING sum(n * ln((n + q1.p) / (t + 1) / q1.p)) >= 0.05 * count(*) * (SELECT ln(n) FROM sz)),
g1 AS (SELECT n1.c1 FROM n1 JOIN t1 USING (c1) JOIN p0 USING (event) GROUP BY n1.c1 HAVING sum(n * ln((n + p0.p) / (t + 1) / p0.p)) >= 0.05 * count(*) * (SELECT ln(n) FROM sz) UNION SELECT c1 FROM g2)
SELECT w.block_id, w.pos, CASE WHEN g2.t IS NOT NULL THEN 2 WHEN g1.c1 IS NOT NULL THEN 1 ELSE 0 END AS depth, round(CASE WHEN g2.t IS NOT NULL THEN (coalesce(n2.n, 0) + q1.p) / (g2.t + 1) WHEN g1.c1 IS NOT NULL THEN q1.p ELSE p0.p END, 6) AS p_true
FROM win w JOIN p0 ON p0.event = w.target LEFT JOIN g1 ON g1.c1 = w.c1 LEFT JOIN q1 ON q1.c1 = w.c1 AND q1.event = w.target LEFT JOIN g2 ON g2.c2 = w.c2 AND g2.c1 = w.c1 LEFT JOIN n2 ON n2.c2 = w.c2 AND n2.c1 = w.c1 AND n2.event = w.target"""


@query("m02_pruned_contexts", check(TREE2))
def _(s, d):
    """The tree of at most two events over the same windows, pruned less."""
    life = lifecycle(s, d)
    tree = context_tree.fit(life.windows.where("split = 'tr' and y = 0").select("ctx", "target"), life.vocab, 2, penalty=0.1)
    return context_tree.score(life.windows.select("block_id", "pos", "ctx", "target"), tree, life.vocab).select("block_id", *longs("pos", "depth"), *r6("p_true"))


# --- block scores ---------------------------------------------------------------------------------------------------
def _score_query(key: str, *names: str) -> None:
    sql = check("SELECT block_id, " + ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names) + " FROM sc")
    query(key, sql)(lambda s, d: lifecycle(s, d).wide.select("block_id", *r6(*names)))


_score_query("a01_floored_max", "nll_max", "event_z_max")
_score_query("a02_mean", "nll_mean")
_score_query("a03_sum", "miss_count")
_score_query("a04_rolling_max", "nll_rolling_max")
_score_query("a05_surprise", "surprisal_max", "surprisal_mean", "nll_max", "nll_mean")
_score_query("a06_miss_fraction", "miss_frac")
_score_query("a07_msp_uncertainty", "msp_uncertainty_max")
_score_query("a08_combined_z", "combined_z")
_score_query("a09_event_z", "event_z_mean", "event_z_max")
_score_query("a10_block_means", "msp_mean", "surprisal_mean")
_score_query("a11_all_scores", *NAMES)


# --- thresholds and bands -------------------------------------------------------------------------------------------
def _val(s, d) -> DataFrame:
    return lifecycle(s, d).part("va")


def _cut(s, d) -> DataFrame:
    return bands.derive_bands(_val(s, d))


def _banded(s, d) -> DataFrame:
    return bands.banded(lifecycle(s, d).part("te"), _cut(s, d))


ONE = f"score_name = '{SCORE}'"


@query("t01_precision_recall", check(f"SELECT round(score, 6) AS threshold, round(cp / (cp + cq), 6) AS precision, round(cp / tp, 6) AS recall FROM cur WHERE {ONE} AND split = 'va'"))
def _(s, d):
    return metrics.precision_recall(_val(s, d)).select(*r6("threshold", "precision", "recall"))


@query("t02_best_f1", check(f"SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM bst WHERE {ONE} AND split = 'va'"))
def _(s, d):
    return bands.best_f1(_val(s, d)).select(*r6("threshold", "f1", "precision", "recall"))


@query("t03_honest_threshold", check(f"SELECT block_id, y, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pred FROM sd CROSS JOIN (SELECT threshold FROM bst WHERE {ONE} AND split = 'va') WHERE split = 'te'"))
def _(s, d):
    return _judged(s, d).select("block_id", "y", "pred")


def _judged(s, d) -> DataFrame:
    test, best = lifecycle(s, d).part("te"), bands.best_f1(_val(s, d)).select("threshold")
    return test.crossJoin(F.broadcast(best)).withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))  # one row


@query("t04_derive_bands", check(f"SELECT round(uncertain, 6) AS uncertain, round(suspicious, 6) AS suspicious FROM cut WHERE {ONE}"))
def _(s, d):
    return _cut(s, d).select(*r6("uncertain", "suspicious"))


@query("t05_normal_quantiles", check("SELECT round(quantile_cont(score, 0.95), 6) AS uncertain, round(quantile_cont(score, 0.99), 6) AS suspicious FROM sd WHERE split = 'va' AND y = 0"))
def _(s, d):
    return bands.normal_quantiles(_val(s, d)).select(*r6("uncertain", "suspicious"))


@query("t06_calibrated", check("SELECT round(quantile_cont(score, 0.9), 6) AS uncertain, round(quantile_cont(score, 0.99), 6) AS suspicious FROM sd WHERE split = 'tr'"))
def _(s, d):
    return bands.calibrated(lifecycle(s, d).part("tr")).select(*r6("uncertain", "suspicious"))


@query("t07_fixed_bands", check("SELECT block_id, pos, CASE WHEN composite >= 0.9 THEN 'ANOMALY' WHEN composite >= 0.45 THEN 'UNCERTAIN' ELSE 'NORMAL' END AS band FROM (SELECT block_id, pos, round(composite, 9) AS composite FROM sig)"))
def _(s, d):
    return lifecycle(s, d).signals.select("block_id", *longs("pos"), bands.fixed_bands(F.round("composite", 9), 0.9).alias("band"))


@query("t08_classify", check("SELECT block_id, band FROM bnd"))
def _(s, d):
    return _banded(s, d).select("block_id", "band")


MSP_SQL = "CASE WHEN round(msp, 9) >= {0} THEN 'NORMAL' WHEN round(msp, 9) <= {1} THEN 'ANOMALY' ELSE 'UNCERTAIN' END"


@query("t09_msp_bands", check(f"SELECT block_id, pos, {MSP_SQL.format(0.24, 0.22)} AS band FROM sig"))
def _(s, d):
    return lifecycle(s, d).signals.select("block_id", *longs("pos"), bands.msp_band(F.round("msp", 9), 0.24, 0.22).alias("band"))


SUMMARY = """
SELECT b.band, count(x.block_id) AS n, round(count(x.block_id) / (SELECT count(*) FROM bnd), 6) AS share, round(coalesce(avg(x.y), 0), 6) AS purity, round(coalesce(avg(x.score), 0), 6) AS mean_score
FROM (VALUES ('NORMAL'), ('UNCERTAIN'), ('ANOMALY')) b(band) LEFT JOIN bnd x ON x.band = b.band GROUP BY b.band
UNION ALL SELECT 'TOTAL', count(*), 1.0, round(avg(y), 6), round(avg(score), 6) FROM bnd"""


@query("t10_band_summary", check(SUMMARY))
def _(s, d):
    return bands.band_summary(_banded(s, d)).select("band", *longs("n"), *r6("share", "purity", "mean_score"))


SETS = [("loose", 0.24, 0.22), ("default", 0.26, 0.23), ("strict", 0.30, 0.24)]
STUDY = " UNION ALL ".join(f"""
SELECT '{n}' AS set_name, count(*) FILTER (band = 'NORMAL') AS n_normal, count(*) FILTER (band = 'UNCERTAIN') AS n_uncertain, count(*) FILTER (band = 'ANOMALY') AS n_anomaly, round(avg(CASE WHEN band = 'UNCERTAIN' THEN 1.0 ELSE 0.0 END), 6) AS usage,
  round(coalesce(avg(CASE WHEN target = predicted THEN 1.0 ELSE 0.0 END) FILTER (band = 'NORMAL'), 0), 6) AS normal_accuracy, round(coalesce(avg(CASE WHEN target = predicted THEN 1.0 ELSE 0.0 END) FILTER (band = 'ANOMALY'), 0), 6) AS anomaly_accuracy
FROM (SELECT *, {MSP_SQL.format(h, lo)} AS band FROM sig)""" for n, h, lo in SETS)


@query("t11_threshold_study", check(STUDY))
def _(s, d):
    rounded = lifecycle(s, d).signals.withColumn("msp", F.round("msp", 9))
    return bands.threshold_study(rounded, SETS).select("set_name", "n_normal", "n_uncertain", "n_anomaly", *r6("usage", "normal_accuracy", "anomaly_accuracy"))


def _quality(s, d, split: str) -> DataFrame:
    return metrics.ranking_quality(lifecycle(s, d).long.where(F.col("split") == split), ["score_name"])


def _sizes(s, d) -> DataFrame:
    val = lifecycle(s, d).long.where("split = 'va'")
    return bands.band_sizes(val, bands.derive_bands(val, ["score_name"]))


SIZES = "SELECT l.score_name, count(*) FILTER (score < uncertain) AS n_normal, count(*) FILTER (score >= uncertain AND score < suspicious) AS n_uncertain, count(*) FILTER (score >= suspicious) AS n_anomaly FROM lng l JOIN cut c USING (score_name) WHERE split = 'va' GROUP BY l.score_name"


@query("t12_band_sizes", check(SIZES))
def _(s, d):
    return _sizes(s, d)


@query("t13_adoption_gate", check(f"""
, z AS ({SIZES}), q AS (SELECT (SELECT pr_auc FROM qul WHERE score_name = 'combined_z' AND split = 'va') - (SELECT pr_auc FROM qul WHERE {ONE} AND split = 'va') AS gap)
SELECT round(gap, 6) AS gap, n_uncertain, greatest(20.0, 0.01 * (n_normal + n_uncertain + n_anomaly)) AS needed, round(gap, 9) >= 0.005 AND n_uncertain >= greatest(20.0, 0.01 * (n_normal + n_uncertain + n_anomaly)) AS adopt FROM z, q WHERE score_name = 'combined_z'"""))
def _(s, d):
    return bands.adoption_gate(_quality(s, d, "va"), _sizes(s, d), "combined_z", SCORE).select(*r6("gap"), "n_uncertain", *r6("needed"), "adopt")


@query("t14_escalation_cost", check("""
SELECT n, f AS n_flagged, round(f / n, 6) AS flagged_share, round(n * 14.9 / 3600, 6) AS hours_all, round(f * 14.9 / 3600, 6) AS hours_routed, round(coalesce(n / nullif(f, 0), 0), 6) AS reduction FROM (SELECT count(*) AS n, count(*) FILTER (band <> 'NORMAL') AS f FROM bnd)"""))
def _(s, d):
    return bands.escalation_cost(_banded(s, d)).select("n", "n_flagged", *r6("flagged_share", "hours_all", "hours_routed", "reduction"))


@query("t15_capped_routing", check(f"""
SELECT block_id, pos, band, coalesce(r <= 40 AND band = 'UNCERTAIN', false) AS routed FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY msp_r, block_id, pos) AS r FROM (SELECT block_id, pos, round(msp, 9) AS msp_r, {MSP_SQL.format(0.24, 0.22)} AS band FROM sig))"""))
def _(s, d):
    rows = lifecycle(s, d).signals.select("block_id", "pos", F.round("msp", 9).alias("msp_r")).withColumn("band", bands.msp_band(F.col("msp_r"), 0.24, 0.22))
    return bands.capped_routing(rows, 40).select("block_id", *longs("pos"), "band", "routed")


# --- rankings -------------------------------------------------------------------------------------------------------
TOPW = "(SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY round(surprisal, 12) DESC, pos) AS rank FROM sig)"


@query("k01_most_surprising", check(f"SELECT block_id, pos, target, predicted, round(surprisal, 6) AS surprisal FROM {TOPW} WHERE rank = 1"))
def _(s, d):
    return ranking.most_surprising(lifecycle(s, d).signals).select("block_id", *longs("pos"), "target", "predicted", *r6("surprisal"))


@query("k02_top_windows", check(f"SELECT block_id, pos, rank, round(surprisal, 6) AS surprisal FROM {TOPW} WHERE rank <= 3"))
def _(s, d):
    return ranking.most_surprising(lifecycle(s, d).signals, 3).select("block_id", *longs("pos", "rank"), *r6("surprisal"))


@query("k03_top_blocks", check("SELECT block_id, round(score, 6) AS score, y FROM bnd WHERE band = 'ANOMALY' ORDER BY bnd.score DESC, block_id LIMIT 5"))
def _(s, d):
    return ranking.top_blocks(_banded(s, d), 5).select("block_id", *r6("score"), "y")


PCT = "100.0 * (SELECT count(*) FROM sd v WHERE v.split = 'va' AND v.y = 0 AND v.score < s.score) / greatest((SELECT count(*) FROM sd v WHERE v.split = 'va' AND v.y = 0), 1)"


def _percentiles(s, d) -> DataFrame:
    return ranking.percentile_among(lifecycle(s, d).part("te"), _val(s, d).where("y = 0"))


@query("k04_percentile", check(f"SELECT block_id, round({PCT}, 6) AS percentile FROM sd s WHERE split = 'te'"))
def _(s, d):
    return _percentiles(s, d).select("block_id", *r6("percentile"))


@query("k05_confused_pairs", check("SELECT target, predicted, count(*) AS n FROM sig WHERE target <> predicted GROUP BY ALL ORDER BY n DESC, target, predicted LIMIT 8"))
def _(s, d):
    return ranking.confused_pairs(lifecycle(s, d).signals)


@query("k06_representatives", check("""
, a AS (SELECT *, row_number() OVER (ORDER BY score, block_id) AS r, count(*) OVER () AS n FROM bnd WHERE band = 'NORMAL' AND y = 0)
SELECT block_id, band FROM a WHERE r = (n + 1) // 2 UNION ALL SELECT block_id, band FROM (SELECT * FROM bnd WHERE band = 'ANOMALY' ORDER BY y DESC, score DESC, block_id LIMIT 1)
UNION ALL SELECT block_id, band FROM (SELECT b.* FROM bnd b JOIN hsh h USING (block_id) WHERE band = 'UNCERTAIN' ORDER BY h.h, block_id LIMIT 1)"""))
def _(s, d):
    return ranking.representatives(_banded(s, d)).select("block_id", "band")


@query("k07_budget_hits", check("""
, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, block_id) AS r FROM sd WHERE split = 'te') SELECT CAST(budget AS BIGINT) AS budget, CAST(sum(y) AS BIGINT) AS hits, count(*) AS reviewed FROM r JOIN (VALUES (39), (100), (200)) b(budget) ON r.r <= b.budget GROUP BY budget"""))
def _(s, d):
    return ranking.budget_hits(lifecycle(s, d).part("te")).select(*longs("budget", "hits"), "reviewed")


@query("k08_tie_census", check("SELECT count(DISTINCT miss_count) AS distinct_scores, count(*) FILTER (y = 0 AND miss_count IN (SELECT miss_count FROM sc WHERE split = 'te' AND y = 1)) AS tied_normals FROM sc WHERE split = 'te'"))
def _(s, d):
    return ranking.tie_census(lifecycle(s, d).wide.where("split = 'te'").select("y", F.col("miss_count").alias("score")))


TIMED = ", gp AS (SELECT session_id, ts, alert, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, line_no))) / 1e6 AS gap FROM log), tm AS (SELECT session_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration, count(*) AS n, CASE WHEN sum(alert) >= 3 THEN 1 ELSE 0 END AS y, avg(gap) AS gap_mean, quantile_cont(gap, 0.5) AS gap_median, stddev_pop(gap) AS gap_std, min(gap) AS gap_min, max(gap) AS gap_max FROM gp GROUP BY session_id) "


def _timed(s, d) -> DataFrame:
    log = lifecycle(s, d).log
    marks = log.groupBy("session_id").agg((F.sum("alert") >= 3).cast("int").alias("y"))
    return identity.timing(log).join(marks, "session_id")


@query("k09_duration_rank", check(TIMED + "SELECT session_id, round(duration, 6) AS duration, rank FROM (SELECT *, rank() OVER (ORDER BY duration DESC) AS rank FROM tm) WHERE y = 1"))
def _(s, d):
    return ranking.duration_rank(_timed(s, d)).select("session_id", *r6("duration"), *longs("rank"))


# --- metrics --------------------------------------------------------------------------------------------------------
JUDGED = f", jd AS (SELECT block_id, y, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pred FROM sd CROSS JOIN (SELECT threshold FROM bst WHERE {ONE} AND split = 'va') WHERE split = 'te'), cf AS (SELECT count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM jd) "
PRF = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


@query("j01_confusion", check(JUDGED + "SELECT tn, fp, fn, tp FROM cf"))
def _(s, d):
    return metrics.confusion(_judged(s, d))


@query("j02_prf", check(JUDGED + f"SELECT {PRF} FROM cf"))
def _(s, d):
    return metrics.prf(_judged(s, d)).select(*r6("precision", "recall", "f1"))


def _quality_query(key: str, name: str) -> None:
    query(key, check(f"SELECT score_name, split, round({name}, 6) AS {name} FROM qul WHERE split <> 'tr'"))(lambda s, d: metrics.ranking_quality(lifecycle(s, d).long.where("split <> 'tr'"), ["score_name", "split"]).select("score_name", "split", *r6(name)))


_quality_query("j03_auroc", "auroc")
_quality_query("j04_pr_auc", "pr_auc")
_quality_query("j09_ks", "ks")


@query("j05_roc", check(f"SELECT round(score, 6) AS threshold, round(cq / tn, 6) AS fpr, round(cp / tp, 6) AS tpr FROM cur WHERE {ONE} AND split = 'te'"))
def _(s, d):
    return metrics.roc(lifecycle(s, d).part("te")).select(*r6("threshold", "fpr", "tpr"))


@query("j06_top_accuracy", check("SELECT count(*) AS n, round(avg(CASE WHEN target_rank BETWEEN 1 AND 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN target_rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg(CASE WHEN target_rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM sig WHERE split = 'te'"))
def _(s, d):
    return metrics.top_accuracy(lifecycle(s, d).signals.where("split = 'te'"))


PER = f", pf AS {_per('sig')} "


@query("j07_per_event", check(PER + "SELECT event, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pf"))
def _(s, d):
    return metrics.per_event(lifecycle(s, d).signals.where("split = 'te'")).select("event", *r6("precision", "recall", "f1"), "support")


@query("j08_averages", check(PER + "SELECT " + ", ".join(f"round(sum({c} * support) / sum(support), 6) AS weighted_{c}, round(avg({c}), 6) AS macro_{c}" for c in ("precision", "recall", "f1")) + " FROM pf"))
def _(s, d):
    own = metrics.averages(metrics.per_event(lifecycle(s, d).signals.where("split = 'te'")))
    return own.select(*r6(*own.columns))


@query("j10_distribution", check("SELECT y, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.99), 6) AS p99, round(min(score), 6) AS lo, round(max(score), 6) AS hi FROM sd WHERE split = 'te' GROUP BY y"))
def _(s, d):
    return metrics.distribution(lifecycle(s, d).part("te")).select("y", "n", *r6("mean", "median", "p90", "p99", "lo", "hi"))


def _hist(source: str, by: str) -> str:
    return f"SELECT {by}, least(floor(x * 40), 39)::INT AS bin, count(*) AS n, round(count(*) * 40.0 / sum(count(*)) OVER (PARTITION BY {by}), 6) AS density FROM {source} GROUP BY {by}, 2"


@query("j11_histogram", check(_hist("(SELECT y, round(composite, 9) AS x FROM sig)", "y")))
def _(s, d):
    return metrics.histogram(lifecycle(s, d).signals.select("y", F.round("composite", 9).alias("x")), "x", ["y"]).select("y", "bin", "n", *r6("density"))


@query("j12_band_histogram", check(_hist(f"(SELECT round(msp, 9) AS x, {MSP_SQL.format(0.24, 0.22)} AS band FROM sig)", "band")))
def _(s, d):
    rows = lifecycle(s, d).signals.select(F.round("msp", 9).alias("x")).withColumn("band", bands.msp_band(F.col("x"), 0.24, 0.22))
    return metrics.histogram(rows, "x", ["band"]).select("band", "bin", "n", *r6("density"))


def _leaderboard(s, d) -> DataFrame:
    long = lifecycle(s, d).long
    best = bands.best_f1(long.where("split = 'va'"), ["score_name"]).select("score_name", "threshold")
    judged = long.where("split = 'te'").join(best, "score_name").withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))
    val = _quality(s, d, "va").select("score_name", F.col("pr_auc").alias("val_pr_auc"))
    out = val.join(_quality(s, d, "te").select("score_name", "auroc", "pr_auc"), "score_name").join(metrics.prf(judged, ["score_name"]), "score_name")
    # the ranking spans the score names only
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.round("val_pr_auc", 9).desc(), "score_name")))


BOARD = f""", ju AS (SELECT l.score_name, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 0 AND score >= threshold) AS fp, count(*) FILTER (y = 1 AND score < threshold) AS fn FROM lng l JOIN bst b ON b.score_name = l.score_name AND b.split = 'va' WHERE l.split = 'te' GROUP BY l.score_name),
lb AS (SELECT v.score_name, v.pr_auc AS val_pr_auc, t.auroc, t.pr_auc, {PRF}, row_number() OVER (ORDER BY round(v.pr_auc, 9) DESC, v.score_name) AS rank FROM qul v JOIN qul t ON t.score_name = v.score_name AND t.split = 'te' JOIN ju ON ju.score_name = v.score_name WHERE v.split = 'va') """


@query("j13_leaderboard", check(BOARD + "SELECT score_name, rank, round(val_pr_auc, 6) AS val_pr_auc, round(auroc, 6) AS auroc, round(pr_auc, 6) AS pr_auc, precision, recall, f1 FROM lb"))
def _(s, d):
    return _leaderboard(s, d).select("score_name", *longs("rank"), *r6("val_pr_auc", "auroc", "pr_auc", "precision", "recall", "f1"))


@query("j14_best_aggregator", check(BOARD + "SELECT lb.score_name, lb.f1, round(b.f1, 6) AS oracle_f1 FROM lb JOIN bst b ON b.score_name = lb.score_name AND b.split = 'te' WHERE rank = 1"))
def _(s, d):
    upper = bands.best_f1(lifecycle(s, d).long.where("split = 'te'"), ["score_name"]).select("score_name", F.col("f1").alias("oracle_f1"))
    return _leaderboard(s, d).where("rank = 1").select("score_name", "f1").join(upper, "score_name").select("score_name", *r6("f1", "oracle_f1"))


DETECTION = ["f1", "precision", "recall", "pr_auc", "auroc", "ks"]


def _detection(life) -> DataFrame:
    """One row of test metrics with the threshold learnt on the validation split of the same lifecycle."""
    best = bands.best_f1(life.part("va")).select("threshold")
    judged = life.part("te").crossJoin(F.broadcast(best)).withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))  # one row
    facts = life.part("te").agg(F.count("*").cast("double").alias("n_test"), F.avg("y").alias("test_rate"))
    found = metrics.prf(judged).select("f1", "precision", "recall").crossJoin(metrics.ranking_quality(life.part("te")).select("pr_auc", "auroc", "ks"))
    return facts.crossJoin(found)  # single rows


def _detection_sql(x: str) -> str:
    """SQL of the same row, from the views whose names end in ``x``."""
    return f"""(SELECT CAST((SELECT count(*) FROM sd{x} WHERE split = 'te') AS DOUBLE) AS n_test, (SELECT avg(y) FROM sd{x} WHERE split = 'te') AS test_rate, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  q.pr_auc, q.auroc, q.ks FROM (SELECT count(*) FILTER (y = 0 AND score >= threshold) AS fp, count(*) FILTER (y = 1 AND score < threshold) AS fn, count(*) FILTER (y = 1 AND score >= threshold) AS tp FROM sd{x} CROSS JOIN (SELECT threshold FROM bst{x} WHERE {ONE} AND split = 'va') WHERE split = 'te'),
  (SELECT * FROM qul{x} WHERE {ONE} AND split = 'te') q)"""


def _by_metric(rows: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """One row for each metric, a column for each of the one-row frames."""
    out = None
    for name, row in rows.items():
        own = row.select(F.explode(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c).cast("double"))))).alias("metric", name))
        out = own if out is None else out.join(own, "metric")
    return out


def _by_metric_sql(rows: dict[str, str], names: list[str], more: str = "") -> str:
    each = [f"(SELECT m.metric, CASE m.metric {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN r.{c}' for c in names)} END AS v FROM {row} r, (SELECT unnest({names}) AS metric) m) {name}" for name, row in rows.items()]
    first = list(rows)[0]
    joins = "".join(f" JOIN {x} USING (metric)" for x in each[1:])
    return f"SELECT metric, {', '.join(f'round({n}.v, 6) AS {n}' for n in rows)}{more} FROM {each[0]}{joins}"


COMPARED = ["n_test", "test_rate", *DETECTION[:5]]


@query("j19_random_vs_chronological", check(CHRONOLOGICAL + " " + _by_metric_sql({"random": _detection_sql(""), "chronological": _detection_sql("_c")}, COMPARED, ", round(chronological.v - random.v, 6) AS delta")))
def _(s, d):
    both = _by_metric({"random": _detection(lifecycle(s, d)), "chronological": _detection(lifecycle(s, d, chronological=True))}, COMPARED)
    return both.withColumn("delta", F.col("chronological") - F.col("random")).select("metric", *r6("random", "chronological", "delta"))


SOURCES = [0, 1, 2]
TABLE = ["vocabulary", "n_blocks", "n_test", "test_rate", "top1", "top3", "top5", "weighted_f1", "macro_f1", *DETECTION]


def _table_sql(x: str) -> str:
    return f"(SELECT CAST((SELECT count(*) FROM voc{x}) AS DOUBLE) AS vocabulary, CAST((SELECT count(*) FROM blk{x}) AS DOUBLE) AS n_blocks, e.*, f.*, t.* FROM {_detection_sql(x)} e, (SELECT {F1S} FROM {_per('sig' + x)}) f, (SELECT {TOPS} FROM sig{x} WHERE split = 'te') t)"


@query("j20_dataset_comparison", check("".join(of_source(i) for i in SOURCES) + " " + _by_metric_sql({f"d{i}": _table_sql(f"_s{i}") for i in SOURCES}, TABLE)))
def _(s, d):
    rows = {}
    for i in SOURCES:
        life = lifecycle(s, d, source=i)
        shape = life.vocab.agg(F.count("*").alias("vocabulary")).crossJoin(life.blocks.agg(F.count("*").alias("n_blocks")))
        rows[f"d{i}"] = shape.crossJoin(_next_event(life.signals.where("split = 'te'"))).crossJoin(_detection(life))  # single rows
    return _by_metric(rows, TABLE).select("metric", *r6(*rows))


# Poisson totals of the blocks that agree in label and scores, in each replicate, from hashes
BOOTSTRAP = """
, pt AS (SELECT n, list(cdf ORDER BY k) AS cdf FROM (SELECT n, k, sum(exp(-n + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS cdf FROM range(1, 33) x(n), range(120) z(k)) GROUP BY n),
pc AS (SELECT y, round(nll_mean, 9) AS a, round(miss_frac, 9) AS b, count(*) AS n FROM sc WHERE split = 'te' GROUP BY ALL),
pk AS (SELECT *, CAST(CAST(round(a * 1e9) AS DECIMAL(38, 0)) AS VARCHAR) || '/' || CAST(CAST(round(b * 1e9) AS DECIMAL(38, 0)) AS VARCHAR) || '/' || y || '/' || r AS key FROM pc, (SELECT unnest(range(50)) AS r)),
pu AS (SELECT *, (CAST('0x' || substr(md5(key || '42'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u, (CAST('0x' || substr(md5(key || '/242'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS v FROM pk),
pz AS (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM pu), bw AS (SELECT r, y, a, b, CASE WHEN cdf IS NOT NULL THEN len(list_filter(cdf, lambda c: c <= u)) ELSE greatest(floor(n + sqrt(n) * z + (z * z - 1) / 6 + 0.5), 0) END AS w FROM pz LEFT JOIN pt USING (n)),
bl AS (SELECT r, 'a' AS name, a AS score, y, w FROM bw WHERE w > 0 UNION ALL SELECT r, 'b', b, y, w FROM bw WHERE w > 0), bp AS (SELECT r, name, score, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM bl GROUP BY ALL),
bc AS (SELECT *, sum(p) OVER (PARTITION BY r, name ORDER BY score DESC) AS cp FROM bp), ba AS (SELECT r, name, coalesce(sum((cp - p) * q + 0.5 * p * q) / nullif(sum(p) * sum(q), 0), 0) AS auroc FROM bc GROUP BY r, name),
bd AS (SELECT r, max(auroc) FILTER (name = 'a') - max(auroc) FILTER (name = 'b') AS d FROM ba GROUP BY r) """


@query("j21_bootstrap_difference", check(BOOTSTRAP + "SELECT count(*) AS n_replicates, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.975), 6) AS high FROM bd"))
def _(s, d):
    paired = lifecycle(s, d).wide.where("split = 'te'").select("block_id", "y", F.col("nll_mean").alias("a"), F.col("miss_frac").alias("b"))
    return head.bootstrap_difference(paired).select("n_replicates", *r6("low", "median", "high"))


SEPARATION = """
, ti AS (SELECT score_name, sum(CAST(p + q AS DOUBLE) ** 3 - (p + q)) AS ties FROM pts WHERE split = 'te' GROUP BY 1),
vs AS (SELECT *, n_pos + n_neg + 1 - ties / greatest(CAST(n_pos + n_neg AS DOUBLE) * (n_pos + n_neg - 1), 1) AS spread FROM qul JOIN ti USING (score_name) WHERE split = 'te'),
zs AS (SELECT score_name, auroc, coalesce(abs(auroc - 0.5) * sqrt(12.0 * n_pos * n_neg / CASE WHEN spread > 1e-9 THEN spread END), 0) AS z FROM vs), ts AS (SELECT *, z / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * z / sqrt(2.0)) AS t FROM zs),
ps AS (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS p FROM ts), rs AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, score_name) AS raw, row_number() OVER (ORDER BY p, score_name) AS r FROM ps) """


@query("j22_separation_tests", check(SEPARATION + "SELECT score_name, round(auroc, 6) AS auroc, round(z, 6) AS z, round(p, 6) AS p, round(least(min(raw) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS q FROM rs"))
def _(s, d):
    return head.separation_tests(lifecycle(s, d).long.where("split = 'te'")).select("score_name", *r6("auroc", "z", "p", "q"))


@query("j24_provenance_control", check("""
, ms AS (SELECT block_id, source FROM (SELECT block_id, source, row_number() OVER (PARTITION BY block_id ORDER BY count(*) DESC, source) AS r FROM ev GROUP BY block_id, source) WHERE r = 1)
SELECT s.y, source AS source_group, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median FROM sd s JOIN ms USING (block_id) GROUP BY ALL"""))
def _(s, d):
    """Scores by label and by the source that most lines of a block come from."""
    life, by = lifecycle(s, d), ["y", "source_group"]
    scored = stored(life.scored.join(identity.majority_source(life.events), "block_id").withColumnRenamed("source", "source_group"), "scored-by-source")
    own = scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    return own.join(quantiles(scored, "score", {"median": 0.5}, by), by).select("y", "source_group", "n", *r6("mean", "median"))


# --- identity and timing --------------------------------------------------------------------------------------------
SEQ = ", sq AS (SELECT e.block_id, b.y, string_agg(event, '|' ORDER BY pos) AS sequence FROM ev e JOIN blk b USING (block_id) GROUP BY e.block_id, b.y) "


def _sequences(s, d) -> DataFrame:
    life = lifecycle(s, d)
    own = life.events.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event"))), lambda x: x["event"]), "|").alias("sequence"))
    return own.join(life.blocks.select("block_id", "y"), "block_id")


@query("q01_census", check(SEQ + "SELECT count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_sessions, round(1000.0 * count(*) / sum(n), 6) AS per_1000, round(max(n) / sum(n), 6) AS top_share FROM (SELECT sequence, count(*) AS n FROM sq GROUP BY sequence)"))
def _(s, d):
    return identity.census(_sequences(s, d)).select("n_distinct", "n_sessions", *r6("per_1000", "top_share"))


@query("q02_twins", check(SEQ + "SELECT block_id, (SELECT count(*) FROM sq o WHERE o.y = 0 AND o.sequence = sq.sequence) AS n_twins FROM sq WHERE y = 1"))
def _(s, d):
    return identity.twins(_sequences(s, d)).select("block_id", "n_twins")


@query("q03_recall_ceiling", check(SEQ + "SELECT count(*) FILTER (sequence NOT IN (SELECT sequence FROM sq WHERE y = 0)) AS n_alone, count(*) AS n_anomalous, round(count(*) FILTER (sequence NOT IN (SELECT sequence FROM sq WHERE y = 0)) / count(*), 6) AS ceiling FROM sq WHERE y = 1"))
def _(s, d):
    return identity.recall_ceiling(_sequences(s, d)).select("n_alone", "n_anomalous", *r6("ceiling"))


TIMES = ["duration", "gap_mean", "gap_median", "gap_std", "gap_min", "gap_max"]


@query("q04_timing", check(TIMED + "SELECT session_id, n, " + ", ".join(f"round({c}, 4) AS {c}" for c in TIMES) + ", round(n / duration, 6) AS rate FROM tm"))
def _(s, d):
    return identity.timing(lifecycle(s, d).log).select("session_id", "n", *(F.round(c, 4).alias(c) for c in TIMES), *r6("rate"))


@query("q05_duration_summary", check(TIMED + "SELECT y, count(*) AS n, round(quantile_cont(duration, 0.5), 4) AS median, round(avg(duration), 4) AS mean, round(min(duration), 4) AS lo, round(max(duration), 4) AS hi FROM tm GROUP BY y"))
def _(s, d):
    return identity.duration_summary(_timed(s, d)).select("y", "n", *(F.round(c, 4).alias(c) for c in ("median", "mean", "lo", "hi")))
