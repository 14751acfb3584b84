"""Operators on small frames with answers worked out by hand."""

from __future__ import annotations

import datetime as dt
import gzip
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.functions import ordered
from tracelight.functions.ordered import ranked
from tracelight.operators import bands, context_tree, evidence, fixed_texts, head, identity, metrics, model, parsing, ranking, scores, semantics, sessions, splits, vocab
from tracelight.sources import logs
from tracelight.streaming import jobs


def scored(spark, rows):
    return spark.createDataFrame([(f"b{i:02d}", float(s), y) for i, (s, y) in enumerate(rows)], "block_id string, score double, y int")


# --- ranks, bands and metrics ---------------------------------------------------------------------------------------
def test_ranks_with_ties_are_positions(spark):
    df = spark.createDataFrame([(i, float(i // 3)) for i in range(50)], "id int, s double")
    got = {r["id"]: r["rank"] for r in ranked(df, [F.col("s").desc(), F.col("id")], F.col("s"), descending=True).collect()}
    want = {i: k for k, i in enumerate(sorted(range(50), key=lambda i: (-(i // 3), i)), 1)}
    assert got == want


@pytest.mark.parametrize("ranges", [None, 5])
def test_quantiles_equal_numpy(spark, ranges, monkeypatch):
    if ranges:
        monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 20)
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 0.5, -2.0, 1e9])) for g in "ab" for _ in range(120)] + [("c", 4.0), ("b", None)]
    got = {r["g"]: r for r in ordered.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", {"low": 0.05, "mid": 0.5, "high": 0.99}, ["g"]).collect()}
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None]
        for name, share in (("low", 0.05), ("mid", 0.5), ("high", 0.99)):
            assert math.isclose(got[g][name], np.quantile(own, share), rel_tol=1e-12, abs_tol=1e-12)


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("k")).withColumn("__key", F.col("k"))
    for per, least, most in ((500_000, 7, 9), (10, 90, 110), (1, 800, 1100)):
        monkeypatch.setattr(ordered, "ROWS_PER_RANGE", per)
        found = rows.withColumn("r", ordered.value_range(rows, F.col("k"))).groupBy("r").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("r").collect()
        assert least <= len(found) <= most and all(x["b"] < y["a"] for x, y in zip(found, found[1:]))


def test_a_hot_key_is_cut_by_its_ties(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 50)
    rng = random.Random(4)
    rows = [(k, i) for i, k in enumerate([3.0] * 500 + [7.0] * 300 + [float(rng.randrange(20)) for _ in range(200)])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k double, t int")
    got = [(r["k"], r["t"]) for r in ordered.ranked(df, [F.col("k"), F.col("t")], F.col("k"), tie=F.col("t")).orderBy("rank").collect()]
    assert got == sorted(rows)
    keyed = df.withColumns({"__key": F.col("k"), "__tie": F.col("t").cast("double")})
    sizes = [r["count"] for r in keyed.groupBy(ordered.value_range(df, F.col("k"), tie=F.col("t"))).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 150


def test_text_ranks(spark):
    words = ["b", "a", "", "ab", "aaaaaaaz", "aaaaaaab", "é", "日本", "~"]
    got = ordered.ranked(spark.createDataFrame([(w,) for w in words], "w string"), [F.col("w")], ordered.text_key(F.col("w"))).orderBy("rank").collect()
    assert [r["w"] for r in got] == sorted(words, key=str.encode)


def test_best_f1_takes_the_lowest_of_tied_thresholds(spark):
    # at 2 and at 1 the F1 is 2/3 each
    df = scored(spark, [(3, 1), (2, 0), (1, 1), (1, 0), (1, 0)])
    c = {r["threshold"]: (r["precision"], r["recall"]) for r in metrics.precision_recall(df).collect()}
    assert c[3.0] == (1.0, 0.5) and c[1.0] == (0.4, 1.0)
    assert bands.best_f1(df).first()["threshold"] == 3.0
    tied = scored(spark, [(2, 1), (1, 1), (1, 0), (1, 0)])
    assert bands.best_f1(tied).first()["threshold"] == 1.0  # 2/3 at both


def test_bands_use_the_last_clean_prefix(spark):
    # the rate rises above the limit and falls back under it: 1/2, ..., 1/100 at row 100
    rows = [(0, 0), (0.5, 1)] + [(1 + i, 0) for i in range(98)] + [(200, 1), (201, 1)]
    cut = bands.derive_bands(scored(spark, [(s, y) for s, y in rows]), id_col="block_id").first()
    assert cut["uncertain"] == 200.0 and cut["suspicious"] == 200.0


def test_bands_without_clean_prefix_start_at_the_lowest_score(spark):
    cut = bands.derive_bands(scored(spark, [(0, 1), (1, 0), (2, 1)])).first()
    assert cut["uncertain"] == 0.0


def test_ranking_quality_against_pairs(spark):
    rows = [(1, 0), (2, 1), (2, 0), (3, 1), (0, 0), (3, 0), (5, 1)]
    q = metrics.ranking_quality(scored(spark, rows)).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert math.isclose(q["auroc"], sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    grid = sorted({s for s, _ in rows})
    ks = max(abs(sum(p <= g for p in pos) / len(pos) - sum(n <= g for n in neg) / len(neg)) for g in grid)
    assert math.isclose(q["ks"], ks)


def test_empty_denominators_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    assert metrics.prf(df).first().asDict() | {} == {"tn": 2, "fp": 0, "fn": 0, "tp": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_msp_bands_normal_wins(spark):
    df = spark.createDataFrame([(0.9,), (0.5,), (0.1,)], "m double")
    assert [r[0] for r in df.select(bands.msp_band(F.col("m"))).collect()] == ["NORMAL", "UNCERTAIN", "ANOMALY"]
    assert [r[0] for r in df.select(bands.msp_band(F.col("m"), 0.4, 0.6)).collect()] == ["NORMAL", "NORMAL", "ANOMALY"]


def test_band_summary_keeps_empty_bands(spark):
    df = spark.createDataFrame([("b", 1, 2.0, "ANOMALY")], "block_id string, y int, score double, band string")
    got = {r["band"]: (r["n"], r["share"]) for r in bands.band_summary(df).collect()}
    assert got == {"NORMAL": (0, 0.0), "UNCERTAIN": (0, 0.0), "ANOMALY": (1, 1.0), "TOTAL": (1, 1.0)}


def test_percentile_counts_strictly_smaller(spark):
    ref = scored(spark, [(1, 0), (2, 0), (2, 0), (3, 0)])
    got = {r["score"]: r["percentile"] for r in ranking.percentile_among(scored(spark, [(2, 0), (9, 1), (0, 0)]), ref).collect()}
    assert got == {2.0: 25.0, 9.0: 100.0, 0.0: 0.0}


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.999), ("a", 0.0)], "g string, x double")
    assert {r["bin"]: r["n"] for r in metrics.histogram(df, "x", ["g"]).collect()} == {39: 2, 0: 1}


# --- block scores ---------------------------------------------------------------------------------------------------
def test_scores_of_short_and_empty_blocks(spark):
    blocks = spark.createDataFrame([("a", "va"), ("b", "va"), ("c", "te")], "block_id string, split string")
    sig = spark.createDataFrame([("a", i, "x", float(i), 0.5, 0.5, 1, "va") for i in range(6)] + [("b", 0, "y", 4.0, 0.2, 0.8, 0, "va")], "block_id string, pos int, target string, nll double, msp double, surprisal double, miss int, split string")
    got = {r["block_id"]: r for r in scores.all_scores(blocks, sig, F.col("split") == "va").collect()}
    assert got["a"]["nll_rolling_max"] == 3.0 and got["b"]["nll_rolling_max"] == 4.0 and got["c"]["nll_rolling_max"] == 0.0
    assert got["a"]["miss_count"] == 6 and got["c"]["miss_count"] == 0 and got["c"]["nll_mean"] == 0.0
    # y has fewer than five reference windows, so it takes the global mean (19 / 7)
    values = [0, 1, 2, 3, 4, 5, 4]
    mu = sum(values) / 7
    sd = math.sqrt(sum((v - mu) ** 2 for v in values) / 7) + 1e-8
    assert math.isclose(got["b"]["event_z_max"], (4 - mu) / sd, rel_tol=1e-9)


def test_maximum_is_floored_at_zero(spark):
    df = spark.createDataFrame([("a", -3.0), ("a", -1.0)], "b string, x double")
    assert df.groupBy("b").agg(scores.floored_max(F.col("x")).alias("m")).first()["m"] == 0.0


# --- model ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def cycle(spark):
    """Normal blocks follow a, b, c, d in turn."""
    rows = [(f"n{k}", i, "abcd"[(i + k) % 4]) for k in range(20) for i in range(8)]
    events = spark.createDataFrame(rows, "block_id string, pos int, event string")
    return sessions.in_block_windows(events), spark.createDataFrame([(e,) for e in "abcdz"], "event string")


def test_probabilities_sum_to_one(spark, cycle):
    windows, words = cycle
    fitted = model.fit(windows, words)
    every = windows.select("ctx").distinct().crossJoin(words.withColumnRenamed("event", "target"))
    p = model.score(every, fitted, words).groupBy("ctx").agg(F.sum("p_true").alias("s"), F.max("entropy_n").alias("e"))
    assert all(math.isclose(r["s"], 1.0, rel_tol=1e-9) for r in p.collect())


def test_entropy_equals_the_dense_one(spark, cycle):
    windows, words = cycle
    fitted = model.fit(windows, words)
    every = windows.select("ctx").distinct().crossJoin(words.withColumnRenamed("event", "target"))
    own = model.score(every, fitted, words).groupBy("ctx").agg((-F.sum(F.col("p_true") * F.ln("p_true")) / math.log(5)).alias("dense"), F.max("entropy_n").alias("sparse"))
    assert all(math.isclose(r["dense"], r["sparse"], rel_tol=1e-9) for r in own.collect())


def test_planted_anomalies_outrank_normal_blocks(spark, cycle):
    windows, words = cycle
    fitted = model.fit(windows, words)
    test = spark.createDataFrame([("normal", i, "abcd"[i % 4]) for i in range(8)] + [("swapped", i, e) for i, e in enumerate("abdcabcd")] + [("unseen", i, e) for i, e in enumerate("abczabcd")], "block_id string, pos int, event string")
    nll = {r["block_id"]: r["m"] for r in model.score(sessions.in_block_windows(test), fitted, words).groupBy("block_id").agg(F.avg("nll").alias("m")).collect()}
    assert nll["normal"] < nll["swapped"] and nll["normal"] < nll["unseen"]


def test_composite_stays_in_range(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0), (1.0, 1.0, 1), (1.0, 1.2, 1)], "s double, e double, m int")
    assert [round(r[0], 6) for r in df.select(model.composite(F.col("s"), F.col("e"), F.col("m"))).collect()] == [0.0, 1.0, 1.0]


def test_focal_loss(spark):
    df = spark.createDataFrame([(0.9, -math.log(0.9))], "p_true double, nll double")
    plain, focal = model.losses(df, 1.0, 0.0).first(), model.losses(df, 1.0, 2.0).first()
    assert math.isclose(plain["focal"], plain["cross_entropy"]) and focal["focal"] < focal["cross_entropy"]


def test_attribution(spark):
    df = spark.createDataFrame([("w", e, w) for e, w in zip(["open", "close", "read", "open", "read", "sync"], [0.05, 0.15, 0.2, 0.25, 0.25, 0.1])], "window_id string, event string, weight double")
    got = [(r["event"], round(r["weight"], 9)) for r in model.attribution(df, 3).orderBy("rank").collect()]
    assert got == [("read", 0.45), ("open", 0.3), ("close", 0.15)]


# --- parsing and sources --------------------------------------------------------------------------------------------
U = "12345678-1234-1234-1234-123456789abc"


def test_masks_and_keys(spark):
    df = spark.createDataFrame([(f"[instance: {U}] took 1.5 s at 10.0.0.1 /var/x 7",), (f"GET /servers/{U}/ids",), ("[req-1] nothing",)], "t string")
    got = [(r[0], r[1]) for r in df.select(parsing.masked(F.col("t")), parsing.session_key(F.col("t"))).collect()]
    assert got[0] == ("[instance: <*>] took <*> s at <*> <*> <*>", U)
    assert got[1][1] == U and got[2][1] is None


def test_lines_are_stripped_and_counted(spark):
    df = spark.createDataFrame([(f"f d t 1 INFO c [a-{U}] text\r\n",), ("  \r\n",), ("  File x, line 3",)], "line string")
    out = parsing.header_fields(parsing.stripped(df)).collect()
    assert [(r["parsed"], r["content"]) for r in out] == [(True, "text"), (False, "")]


def test_templates_do_not_depend_on_line_order(spark):
    messages = [(f"open file f{i % 9}x by user{c}", ) for i in range(30) for c in "ab"]
    a = {r["message"]: r["template"] for r in parsing.mine_templates(spark.createDataFrame(messages, "message string")).collect()}
    b = {r["message"]: r["template"] for r in parsing.mine_templates(spark.createDataFrame(messages[::-1], "message string")).collect()}
    assert a == b and set(a.values()) == {"open file <*> by usera", "open file <*> by userb"}


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text('BlockId,Features\nb1,"[E5, E22,E5]"\nb2,"[]"\n')
    assert [(r[0], r[1]) for r in logs.traces(spark, str(tmp_path / "t.csv")).collect()] == [("b1", ["E5", "E22", "E5"]), ("b2", [])]
    (tmp_path / "l.csv").write_text("BlockId,Label\nb1, ANOMALY \nb2,Normal\n")
    assert [r[1] for r in logs.labels(spark, str(tmp_path / "l.csv")).collect()] == [1, 0]
    (tmp_path / "d.csv").write_text("EventId,EventTemplate\nE1,[*]block[*] \n")
    assert logs.template_dictionary(spark, [str(tmp_path / "none.csv"), str(tmp_path / "l.csv"), str(tmp_path / "d.csv")]).first()["template"] == "<...>block<...>"
    assert logs.template_dictionary(spark, [str(tmp_path / "none.csv")]).count() == 0


# --- splits, vocabulary, identity -----------------------------------------------------------------------------------
def test_splits_are_disjoint_and_sized(spark):
    blocks = spark.createDataFrame([(f"b{i}", i, int(i % 5 == 0)) for i in range(100)], "block_id string, ordinal int, y int")
    got = splits.stratified(blocks).groupBy("split", "y").count().collect()
    assert {(r["split"], r["y"]): r["count"] for r in got} == {("tr", 0): 56, ("va", 0): 8, ("te", 0): 16, ("tr", 1): 14, ("va", 1): 2, ("te", 1): 4}
    chrono = splits.chronological(blocks)
    assert chrono.where("split = 'tr'").agg(F.max("ordinal")).first()[0] == 69


def test_class_weights_average_over_all_classes(spark):
    events, words = spark.createDataFrame([("a",), ("a",), ("b",)], "event string"), spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "event string, idx int")
    got = {r["event"]: r["weight"] for r in vocab.class_weights(events, words).collect()}
    assert got["c"] == 0.0 and math.isclose(sum(got.values()) / 3, 1.0)


def test_census_and_twins_of_whole_sequences(spark):
    rows = [("a", "open|read|close", 1), ("b", "open|read|close", 0), ("c", "open|read|close", 0), ("d", "open|read|sync", 1), ("e", "open", 0), ("f", "", 1), ("g", "", 0)]
    df = spark.createDataFrame(rows, "block_id string, sequence string, y int")
    c = identity.census(df).first()
    assert (c["n_distinct"], c["n_sessions"]) == (4, 7) and math.isclose(c["per_1000"], 4000 / 7) and math.isclose(c["top_share"], 3 / 7)
    assert {r["block_id"]: r["n_twins"] for r in identity.twins(df).collect()} == {"a": 2, "d": 0, "f": 1}
    r = identity.recall_ceiling(df).first()
    assert (r["n_alone"], r["n_anomalous"]) == (1, 3) and math.isclose(r["ceiling"], 1 / 3)


def test_recall_ceiling(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 0), ("c", "y", 1)], "block_id string, sequence string, y int")
    assert identity.recall_ceiling(df).first()["ceiling"] == 0.5
    assert {r["block_id"]: r["n_twins"] for r in identity.twins(df).collect()} == {"a": 1, "c": 0}


def test_intermediate_tables_can_be_cleared(spark, tmp_path):
    from tracelight import shared

    kept, made = shared._MADE[:], shared.generation()
    shared._MADE.clear()
    try:
        table = shared.stored(spark.range(3), "to-clear")
        path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert table.count() == 3 and os.path.exists(path)
        shared.clear(spark)
        assert not os.path.exists(path) and shared.generation() == made + 1
    finally:
        shared._MADE.extend(kept)


def test_any_order_within_the_watermark_gives_the_batch_contexts(spark, tmp_path):
    start, rng = dt.datetime(2024, 1, 1), random.Random(22)
    times = [start + dt.timedelta(seconds=3 * i + rng.random()) for i in range(600)]
    times[10:13] = [times[10]] * 3  # a tie goes by line_id
    rows = [(i, t, rng.choice("abc"), f"e{rng.randrange(4)}") for i, t in enumerate(times)]
    last, want = {}, {}
    for i, t, key, event in sorted(rows, key=lambda r: (r[1], r[0])):
        if last.get(key):
            want[i] = (last[key], event)
        last[key] = [*last.get(key, []), event][-3:]
    closed = {i for i, t, _, _ in rows if i in want and t <= max(times) - dt.timedelta(minutes=10, milliseconds=1)}
    schema = "line_id long, ts timestamp, session_id string, event string"
    for name, mixed, parts in (("sorted", rows, 1), ("mixed", sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(500))), 4)):
        size = len(rows) // parts
        for k in range(parts):
            spark.createDataFrame(mixed[size * k : size * (k + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        if parts > 1:  # long after the watermark has passed them
            spark.createDataFrame([(1000 + i, start, "a", "late") for i in range(7)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        late = []
        got = {r["line_id"]: (list(r["ctx"]), r["target"]) for r in jobs.run_available(jobs.contexts(stream, 3), name, late=late).collect()}
        assert {i: want[i] for i in got} == got
        assert closed <= set(got), (name, late, len(closed - set(got)))
        assert late == [7 if parts > 1 else 0]


def test_idle_sessions_begin_anew(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "line_id long, ts timestamp, session_id string, event string"
    for i, minutes in enumerate((0, 1, 30, 200, 201, 300)):
        spark.createDataFrame([(i, start + dt.timedelta(minutes=minutes), "a", f"e{i}")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["line_id"]: list(r["ctx"]) for r in jobs.run_available(jobs.contexts(stream, 3, idle_ms=3_600_000), "idle").collect()}
    assert got == {1: ["e0"], 2: ["e0", "e1"], 4: ["e3"]}


def test_many_sessions_share_few_states(spark, tmp_path, monkeypatch):
    start, n = dt.datetime(2024, 1, 1), 3_000
    times = [start + dt.timedelta(milliseconds=10 * i) for i in range(2 * n)]
    rows = [(i, t, f"s{i % n}", f"e{i // n}") for i, t in enumerate(times)] + [(2 * n, start + dt.timedelta(hours=1), "last", "e0")]
    spark.createDataFrame(rows, "line_id long, ts timestamp, session_id string, event string").coalesce(1).write.parquet(str(tmp_path / "in"))
    states, own = [0], jobs._count_late

    def noted(query, dropped):
        states.extend(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
        own(query, dropped)

    monkeypatch.setattr(jobs, "_count_late", noted)
    stream = spark.readStream.schema("line_id long, ts timestamp, session_id string, event string").parquet(str(tmp_path / "in"))
    got = {r["line_id"]: (list(r["ctx"]), r["target"]) for r in jobs.run_available(jobs.contexts(stream), "many").collect()}
    assert got == {n + i: (["e0"], "e1") for i in range(n)}
    assert 0 < max(states) < n


# --- evidence -------------------------------------------------------------------------------------------------------
def text(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(
    ("narrative", "blob", "kept"),
    [
        ("Two replicas answered. Its anomaly score was 3.75! The lease ended.", "", "Two replicas answered. The lease ended."),
        ("Perhaps the swap filled up? Node seven left.", "node left", "Node seven left."),
        ("We met a configuration error.", "lease renewed", ""),
        ("We met a configuration error.", "configuration error in lease", "We met a configuration error."),
        ("Swap space was freed.  It ended.", "swap space freed", "Swap space was freed. It ended."),
        ("The lease seems to expire. The lease was renewed.", "", "The lease was renewed."),
        ("An espionage tool ran. A worm was caught.", "worm gear", "A worm was caught."),
        ("Swapping went on. Networks met.", "", "Swapping went on. Networks met."),
        ("", "", ""),
    ],
)
def test_scrubber(spark, narrative, blob, kept):
    assert text(spark, evidence.scrub_narrative(F.col("t"), F.lit(blob)), narrative) == kept


def test_contradictions_only_where_the_prediction_was_right(spark):
    t = "The order deviates here. It records a step."
    assert text(spark, evidence.scrub_contradictions(F.col("t"), F.lit(True)), t) == "It records a step."
    assert text(spark, evidence.scrub_contradictions(F.col("t"), F.lit(False)), t) == t


def test_root_cause_needs_a_whole_word(spark):
    assert '"exception"' not in text(spark, evidence.root_cause(F.col("t")), "KeyException7 while parsing (timeouts)")
    assert '"denied"' in text(spark, evidence.root_cause(F.col("t")), "KeyException7: lease DENIED by peer")
    assert text(spark, evidence.root_cause(F.col("t")), "Lease renewed") == fixed_texts.NO_ROOT_CAUSE
    assert text(spark, evidence.keyword_rule(F.col("t")), "two timeouts") is True


def test_confidence_text(spark):
    shown = text(spark, evidence.confidence_text(F.lit(0.3125), F.lit("UNCERTAIN")))
    assert "31.3%" in shown and "review" in shown and "0.31" not in shown


@pytest.mark.parametrize(
    ("answer", "cls", "conf"),
    [
        ("CLASSIFICATION: NORMAL\nCONFIDENCE: 75\nEVIDENCE: x\nEXPLANATION: y", "NORMAL", 0.75),
        ("CLASSIFICATION: maybe\nit is suspicious", "SUSPICIOUS", None),
        ("CLASSIFICATION: NORMAL or SUSPICIOUS", None, None),
        ('{"classification": "suspicious", "confidence": 140}', "SUSPICIOUS", 1.0),
        ('{"classification": "odd", "confidence": 10}', None, None),
        ("nothing", None, None),
    ],
)
def test_verdicts(spark, answer, cls, conf):
    got = text(spark, evidence.parse_verdict(F.col("t")), answer)
    assert (got["cls"], got["conf"]) == (cls, conf)


def test_verdict_parts(spark):
    read = lambda answer: text(spark, evidence.parse_verdict(F.col("t")), answer)
    got = read("Classification: suspicious\nEvidence:  lease lost \nExplanation: no renewal seen\nmore")
    assert (got["cls"], got["evidence"], got["explanation"], got["json_ok"]) == ("SUSPICIOUS", "lease lost", "no renewal seen", False)
    got = read('{"classification": "normal", "confidence": "n/a", "evidence": "renewed twice"}')
    assert (got["cls"], got["conf"], got["evidence"], got["explanation"], got["json_ok"]) == ("NORMAL", None, "renewed twice", "", True)


def test_facts_leave_out_what_is_not_known(spark):
    cases = spark.createDataFrame([("c", ["open", "read"], "sync", "close", 0.25, 0.75, "UNCERTAIN")], "case_id string, sequence array<string>, predicted string, actual string, confidence double, anomaly_score double, band string")
    named = evidence.with_involved(cases, spark.createDataFrame([("open", "Opened it"), ("close", "Closed it")], "event string, template string"))
    bare = "cast(null as double) percentile, cast(null as long) actual_freq, cast(null as long) pred_freq, cast(null as long) total_events, cast(null as array<struct<rank int, event string, text string, surprisal double>>) top_windows"
    few = named.selectExpr("*", *bare.split(", cast")[:1], *(f"cast{x}" for x in bare.split(", cast")[1:])).select(evidence.facts(F.lit("looked odd")).alias("t")).first()["t"].split("\n")
    assert few[:6] == ["BEGIN_FACTS", "Observed sequence (2 events, in order):", "   1. open -> Opened it", "   2. read -> template unavailable", "", "Expected next event : sync -> n/a"]
    assert few[-4:] == ["Routing reason : looked odd", "END_FACTS", "", fixed_texts.FACT_QUESTION] and len(few) == 13 and not any("null" in x for x in few)
    whole = "12.34D percentile, 0L actual_freq, 12345L pred_freq, 99999L total_events, array(named_struct('rank', 2, 'event', 'read', 'text', 'none', 'surprisal', 0.5D)) top_windows"
    many = named.selectExpr("*", *whole.split(", ", 4)).select(evidence.facts().alias("t")).first()["t"]
    assert "NEVER seen among 99,999 events" in many and "seen 12,345 times" in many and "validation blocks : 12.3 " in many and "#2 in this block : actual read -> none (surprise 0.50)" in many and fixed_texts.FACT_REASON in many


def test_majority(spark):
    df = spark.createDataFrame([("a", "SUSPICIOUS"), ("a", "SUSPICIOUS"), ("a", "NORMAL"), ("a", "NORMAL"), ("b", None), ("c", "SUSPICIOUS")], "case_id string, cls string")
    assert {r["case_id"]: (r["cls"], r["parse_ok"]) for r in evidence.majority(df).collect()} == {"a": ("NORMAL", True), "b": ("NORMAL", False), "c": ("SUSPICIOUS", True)}


def test_section(spark):
    assert text(spark, evidence.section(F.col("t")), "OBSERVED: a\nevidence_based_interpretation:\n  b c.\nd ") == "b c.\nd"


# --- raw logs -------------------------------------------------------------------------------------------------------
def test_raw_lines_are_numbered_in_file_order(spark, tmp_path):
    rng = random.Random(21)
    texts = {"a.log": [f"line {i} " + "x" * rng.randint(0, 60) for i in range(700)], "b.log.gz": ["", "second\twith tab", "third"], "c.log": ["one"], "d.log": []}
    for name, lines in texts.items():
        body = ("\r\n" if name == "c.log" else "\n").join(lines) + ("\n" if name != "c.log" and lines else "")
        (tmp_path / name).write_bytes(gzip.compress(body.encode()) if name.endswith("gz") else body.encode())
    want = [(i, line, name) for i, (name, line) in enumerate(((n, t) for n, own in sorted(texts.items()) for t in own), 1)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = logs.numbered_text(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 20
        got = [(r["line_no"], r["line"], r["source_file"].rsplit("/", 1)[1]) for r in rows.orderBy("line_no").collect()]
        assert got == want
        assert logs.numbered_text(spark, [str(tmp_path / "a.log")], 30).count() == 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_raw_layouts(spark, tmp_path):
    flat = ["- 1 2 node 4 5 6 7 8 a message here", "too short", "FATAL 1 2 n2 4 5 6 7 8 bad\tone", ""]
    (tmp_path / "flat.log").write_text("\n".join(flat) + "\n")
    got = [tuple(r) for r in logs.flat_log(spark, str(tmp_path / "flat.log")).orderBy("line_no").collect()]
    assert got == [(1, "-", "node", "a message here", 0), (3, "FATAL", "n2", "bad one", 1)]
    key = "00112233-4455-6677-8899-aabbccddeeff"
    lines = [f"f.log 2017-05-16 00:00:00.008 25746 INFO nova.api [req-1 a b] [instance: {key}] started", "", "Traceback", f"f.log 2017-05-16 00:00:01.008 25746 ERROR nova.api [req-2] GET /servers/{key}/x"]
    (tmp_path / "head.log").write_bytes("\r\n".join(lines).encode())
    got = [(r["line_no"], r["parsed"], r["level"], r["session_id"]) for r in logs.header_log(spark, {"normal": str(tmp_path / "head.log")}).orderBy("line_no").collect()]
    assert got == [(1, True, "INFO", key), (3, False, "", None), (4, True, "ERROR", key)]


# --- variable-order contexts, occlusion and batches ------------------------------------------------------------------
def brute_tree(cases, words, order, alpha, least_count, penalty):
    """Kept suffixes (tuples, latest event first) with their counts, and p of any event after any of them."""
    counts = {}
    for ctx, event in cases:
        for k in range(min(order, len(ctx)) + 1):
            own = counts.setdefault(tuple(ctx[::-1][:k]), {})
            own[event] = own.get(event, 0) + 1

    def p(node, event):
        own = counts[node]
        low = 1 / len(words) if not node else p(node[:-1], event)
        return (own.get(event, 0) + alpha * low) / (sum(own.values()) + alpha)

    kept = {()}
    for node in counts:
        if node and sum(counts[node].values()) >= least_count and sum(n * math.log(p(node, e) / p(node[:-1], e)) for e, n in counts[node].items()) >= penalty * 0.5 * len(counts[node]) * math.log(len(cases)):
            kept |= {node[:k] for k in range(len(node) + 1)}
    return kept, p


def long_memory(rng, n, lag):
    """Events that mostly repeat the one ``lag`` places before, between others that say nothing."""
    out = [rng.choice("abcd") for _ in range(lag)]
    while len(out) < n:
        out.append(out[-lag] if rng.random() < 0.9 else rng.choice("abcd"))
    return out


def test_the_tree_equals_brute_force(spark):
    rng = random.Random(31)
    events = [("t" if b < 60 else "v", b, i, e) for b in range(80) for i, e in enumerate(long_memory(rng, 30, 3))]
    df = spark.createDataFrame([(f"{s}{b}", i, e) for s, b, i, e in events], "block_id string, pos int, event string")
    windows = sessions.in_block_windows(df, 6)
    train = windows.where("block_id like 't%'")
    words = vocab.fit(df)
    for order, count, penalty in ((4, 3, 0.3), (2, 1, -1e9)):
        tree = context_tree.fit(train, words, order, 1.0, count, penalty)
        cases = [(list(r["ctx"]), r["target"]) for r in train.collect()]
        kept, p = brute_tree(cases, "abcd", order, 1.0, count, penalty)
        assert tree[1].count() == len(kept)
        for r in context_tree.score(windows, tree, words).collect():
            suffix = tuple(r["ctx"][::-1])
            node = max((suffix[:k] for k in range(len(suffix) + 1) if suffix[:k] in kept), key=len)
            assert all(node[:k] in kept for k in range(len(node)))
            assert r["depth"] == len(node) and math.isclose(r["p_true"], p(node, r["target"]), rel_tol=1e-9)
            every = {e: p(node, e) for e in "abcd"}
            assert math.isclose(r["msp"], max(every.values()), rel_tol=1e-9)
            assert math.isclose(r["entropy_n"], -sum(x * math.log(x) for x in every.values()) / math.log(4), rel_tol=1e-9)


def test_the_tree_carries_no_event_that_its_nodes_name(spark, monkeypatch):
    written = {}

    def kept(df, name, store=context_tree.stored):
        written[name] = store(df, name)
        return written[name]

    monkeypatch.setattr(context_tree, "stored", kept)
    windows = spark.createDataFrame([(list("abcd"), "e"), (list("bcd"), "e"), (list("xbcd"), "f")] * 20, "ctx array<string>, target string")
    probs, nodes = context_tree.fit(windows, spark.createDataFrame([("e",), ("f",)], "event string"), 20, penalty=-1e9)
    assert {r["k"]: r["n_nodes"] for r in context_tree.sizes(nodes).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2}
    for k in (1, 2, 3):
        assert sorted(r["ctx"] for r in written[f"tree-active-{k}"].collect()) == sorted(c[: len(c) - k] for c in (list("abcd"), list("bcd"), list("xbcd")))


def test_long_contexts_predict_better_where_they_matter(spark):
    rng = random.Random(32)
    df = spark.createDataFrame([(f"{'t' if b < 150 else 'v'}{b}", i, e) for b in range(200) for i, e in enumerate(long_memory(rng, 40, 4))], "block_id string, pos int, event string")
    windows, words = sessions.in_block_windows(df), vocab.fit(df)
    train, test = windows.where("block_id like 't%'"), windows.where("block_id like 'v%'")
    tree = context_tree.fit(train, words)
    loss = lambda scored: model.losses(scored).first()["cross_entropy"]
    deep, flat = loss(context_tree.score(test, tree, words)), loss(model.score(test, model.fit(train, words), words))
    assert deep < 0.6 * flat and context_tree.depth(tree[1]) >= 4
    assert tree[0].count() <= 4 * train.count() and all(r['n_nodes'] <= train.count() for r in context_tree.sizes(tree[1]).collect())


def test_tree_scores_never_send_the_windows_to_the_driver(spark, tmp_path):
    rows = [(i, [str(i % 3), str(i % 2)], str(i % 5)) for i in range(60)] + [(60, ["0"], None)]
    spark.createDataFrame(rows, "id int, ctx array<string>, target string").write.parquet(f"{tmp_path}/windows")
    windows = spark.read.parquet(f"{tmp_path}/windows")
    words = spark.createDataFrame([(str(i),) for i in range(5)], "event string")
    scored = context_tree.score(windows, context_tree.fit(windows.where("target is not null"), words, 2), words)
    assert "BuildLeft" not in scored._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in scored.collect()) == list(range(60))


def test_two_thousand_event_types(spark):
    rng = random.Random(33)
    rows = [(f"{'t' if b < 80 else 'v'}{b}", i, f"e{int(rng.paretovariate(0.4)) % 2000}") for b in range(100) for i in range(60)]
    df = spark.createDataFrame(rows, "block_id string, pos int, event string")
    words = spark.range(2000).select(F.concat(F.lit("e"), "id").alias("event"))
    windows = sessions.in_block_windows(df, 2)
    train = windows.where("block_id like 't%'")
    fitted = model.fit(train, words)
    counts = {}
    for r in train.collect():
        for k in range(min(2, len(r["ctx"])) + 1):
            own = counts.setdefault(tuple(r["ctx"][len(r["ctx"]) - k :]), {})
            own[r["target"]] = own.get(r["target"], 0) + 1

    def p(ctx, event):
        low = 1 / 2000 if not ctx else p(ctx[1:], event)
        own = counts.get(ctx, {})
        return (own.get(event, 0) + low) / (sum(own.values()) + 1) if own else low

    for r in model.score(windows.where("block_id like 'v%'"), fitted, words).limit(400).collect():
        assert math.isclose(r["p_true"], p(tuple(r["ctx"]), r["target"]), rel_tol=1e-9)


def test_occlusion_weights_equal_leaving_each_event_out(spark):
    rng = random.Random(34)
    df = spark.createDataFrame([(f"b{b}", i, rng.choice("aabbc")) for b in range(30) for i in range(12)], "block_id string, pos int, event string")
    windows, words = sessions.in_block_windows(df, 3), vocab.fit(df)
    fitted = model.fit(windows.where("block_id < 'b2'"), words)
    got = {}
    for r in model.occlusion(windows, fitted, ["block_id", "pos"]).collect():
        got.setdefault((r["block_id"], r["pos"]), {})[r["left_out"]] = (r["event"], r["weight"])
    asked, places = [], []
    for w in windows.collect():
        for k in range(min(2, len(w["ctx"])) + 1):
            left = [e for i, e in enumerate(w["ctx"]) if i != len(w["ctx"]) - k]
            asked.append((len(asked), left, w["target"]))
            places.append((w["block_id"], w["pos"], k, w["ctx"][-k] if k else None))
    lp = {r["i"]: math.log(r["p_true"]) for r in model.score(spark.createDataFrame(asked, "i int, ctx array<string>, target string"), fitted, words).collect()}
    whole = {(b, at): lp[i] for i, (b, at, k, _) in enumerate(places) if not k}
    for i, (b, at, k, event) in enumerate(places):
        if k:
            own = [abs(lp[j] - whole[b, at]) for j, (x, y, z, _) in enumerate(places) if (x, y) == (b, at) and z]
            want = abs(lp[i] - whole[b, at]) / sum(own) if sum(own) > 1e-9 else 1 / len(own)
            assert got[b, at][k][0] == event and math.isclose(got[b, at][k][1], want, abs_tol=1e-9)
    assert all(math.isclose(sum(w for _, w in own.values()), 1) for own in got.values())


@pytest.mark.parametrize("per_part", [500_000, 7])
def test_batches_of_a_length_are_full_but_the_last(spark, per_part):
    rows = [(n, f"b{i}", i) for n, count in ((1, 100), (2, 32), (5, 1)) for i in range(count)]
    df = spark.createDataFrame(rows, "ctx_len int, block_id string, pos int")
    got = sessions.length_batches(df, 16, ["block_id", "pos"], per_part).collect()
    assert sorted((r["ctx_len"], r["block_id"], r["pos"]) for r in got) == sorted(rows)
    sizes = {}
    for r in got:
        sizes[r["ctx_len"], r["batch_id"]] = sizes.get((r["ctx_len"], r["batch_id"]), 0) + 1
    assert sizes == {(1, i): 16 if i < 6 else 4 for i in range(7)} | {(2, 0): 16, (2, 1): 16, (5, 0): 1}


# --- template vectors and neighbours ---------------------------------------------------------------------------------
def template_texts(rng, families, members, n_words):
    """Families of alike texts, as one statement of a program writes them; small words are everywhere."""
    named = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n_words)]
    out = []
    for _ in range(families):
        base = [rng.choice(["of", "to", "the", "for"]) if rng.random() < 0.3 else rng.choice(named) for _ in range(rng.randint(5, 9))]
        for _ in range(members):
            own = list(base)
            own[rng.randrange(len(own))] = rng.choice(named)
            out.append((f"E{len(out):04d}", " ".join(own)))
    return out


def plain_weights(rows):
    """The term weights as a matrix."""
    terms = []
    for _, text in rows:
        ws = re.findall("[a-z]+", (text or "").lower())
        terms.append(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])
    names = {t: i for i, t in enumerate(sorted({t for own in terms for t in own}))}
    tf = np.zeros((len(rows), len(names)))
    for i, own in enumerate(terms):
        for t in own:
            tf[i, names[t]] += 1
    raw = tf * (np.log((1 + len(rows)) / (1 + (tf > 0).sum(0))) + 1)
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    return raw / np.where(norm > 0, norm, 1)


def test_reduced_vectors_span_what_numpy_finds(spark):
    rng = random.Random(41)
    rows = template_texts(rng, 8, 4, 20) + [("E9998", None), ("E9999", "123 -")]
    df = spark.createDataFrame(rows, "event string, template string")
    for rows, dims in ((rows, 4), ([*rows[:5], rows[0], *rows[-2:]], 6)):  # the second of rank 5
        rows = [(f"{e}{i}" if i == 5 and dims == 6 else e, t) for i, (e, t) in enumerate(rows)]
        df = spark.createDataFrame(rows, "event string, template string")
        a = plain_weights(rows)
        u, sv, _ = np.linalg.svd(a, full_matrices=False)
        got = {r["event"]: np.array(r["vector"]) for r in semantics.reduced(semantics.term_weights(df.select("event"), df), dims, 12 if dims == 4 else 1).collect()}
        k = len(next(iter(got.values())))
        assert k == min(dims, int((sv > 1e-6 * sv[0]).sum()))
        mine = np.stack([got.get(e, np.zeros(k)) for e, _ in rows])
        q, _ = np.linalg.qr(mine)
        assert np.arccos(np.clip(np.linalg.svd(q.T @ u[:, :k], compute_uv=False), -1, 1)).max() < 1e-6
        assert np.allclose(mine @ mine.T, (u[:, :k] * sv[:k] ** 2) @ u[:, :k].T, atol=1e-8)
    rows = template_texts(random.Random(41), 8, 4, 20) + [("E9998", None), ("E9999", "123 -")]
    df = spark.createDataFrame(rows, "event string, template string")
    vectors = {r["event"]: np.array(r["vector"]) for r in semantics.template_vectors(df.select("event"), df, 4).collect()}
    assert math.isclose(max(abs(v).max() for v in vectors.values()), 0.1) and not vectors["E9998"].any() and len(vectors["E9999"]) == 4
    assert len({round(float(np.linalg.norm(v)), 9) for e, v in vectors.items() if e < "E9"}) == 1


def test_neighbours_equal_all_pairs_from_few_pairs(spark):
    rng = random.Random(42)
    rows = template_texts(rng, 300, 5, 1200)
    df = spark.createDataFrame(rows, "event string, template string")
    weights = semantics.stored(semantics.term_weights(df.select("event"), df), "weights")
    pairs = semantics.candidates(weights, 3).count()
    assert pairs < 0.05 * len(rows) * len(rows)
    a = plain_weights(rows)
    cosines = np.round(a @ a.T, 9)
    np.fill_diagonal(cosines, -1)
    order = np.argsort(-cosines, axis=1, kind="stable")[:, :3]
    got = {}
    for r in semantics.most_similar(weights, 3).collect():
        got[r["event"], r["rank"]] = (r["other"], r["cosine"])
    for i, (event, _) in enumerate(rows):
        for k, j in enumerate(order[i], 1):
            if cosines[i, j] > 0:
                other, cosine = got[event, k]
                assert math.isclose(cosine, cosines[i, j], abs_tol=2e-9) and math.isclose(cosines[i, int(other[1:])], cosines[i, j], abs_tol=2e-9)
            else:
                assert (event, k) not in got


# --- controls and separation -----------------------------------------------------------------------------------------
def test_rank_sum_variance_is_less_by_ties(spark):
    # 0/1 scores with 30 of 50 and 20 of 50 ones: AUROC 0.6, z 2.0 over the standard deviation without ties
    rows = [("f", float(i < 30), 1) for i in range(50)] + [("f", float(i < 20), 0) for i in range(50)]
    rows += [("one", 1.0, i % 2) for i in range(20)] + [("far", float(i), int(i >= 40)) for i in range(80)]
    got = {r["score_name"]: r for r in head.separation_tests(spark.createDataFrame(rows, "score_name string, score double, y int")).collect()}

    def plain(own):
        values = sorted(s for _, s, _ in own)
        rank = {v: (values.index(v) + 1 + len(values) - values[::-1].index(v)) / 2 for v in set(values)}
        m, size = sum(y for _, _, y in own), len(own)
        n = size - m
        u = sum(rank[s] for _, s, y in own if y) - m * (m + 1) / 2
        mean = (size + 1) / 2
        variance = m * n / (size * (size - 1)) * sum((rank[v] - mean) ** 2 for v in values)  # of ranks as they are
        return abs(u - m * n / 2) / math.sqrt(variance)

    for name in ("f", "far"):
        own = [r for r in rows if r[0] == name]
        assert math.isclose(got[name]["z"], plain(own), rel_tol=1e-9)
        assert math.isclose(got[name]["p"], math.erfc(plain(own) / math.sqrt(2)), abs_tol=2e-7)
    assert got["one"]["z"] == 0 and got["one"]["p"] > 0.999 and got["f"]["p"] < 0.05


def test_sources_that_do_not_differ_are_not_told_apart_out_of_fold(spark):
    rng = np.random.default_rng(7)
    from pyspark.ml.functions import array_to_vector

    values = rng.normal(size=(600, 4))
    for shift, low, high in ((0.0, 0.4, 0.6), (2.0, 0.9, 1.0)):
        rows = [(f"b{i}", int(i % 3 == 0), [float(x + shift * (i % 3 == 0)) for x in v]) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "block_id string, y int, v array<double>").select("block_id", "y", array_to_vector("v").alias("vector"))
        done = head.out_of_fold(df, "block_id")
        assert done.count() == 600
        assert low <= metrics.ranking_quality(done.select("y", "score")).first()["auroc"] <= high


def test_majority_source_of_a_block(spark):
    rows = [("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", None)]
    got = {r["block_id"]: r["source"] for r in identity.majority_source(spark.createDataFrame(rows, "block_id string, source string")).collect()}
    assert got == {"a": "y", "b": "x", "c": None}


def test_bootstrap_rows_grow_with_distinct_scores(spark):
    rng = np.random.default_rng(8)
    # few scores: one combination of 300 blocks, which the normal number draws
    y = (rng.random(1000) < 0.5).astype(int)
    a = np.where(rng.random(1000) < 0.7, y, 1 - y) * 1.0
    b = np.where(rng.random(1000) < 0.6, y, 1 - y) * 1.0
    df = spark.createDataFrame([(f"b{i}", int(y[i]), float(a[i]), float(b[i])) for i in range(1000)], "block_id string, y int, a double, b double")
    got = head.bootstrap_difference(df, 400).first()

    def auroc(s, w):
        pos, neg = (w * y), (w * (1 - y))
        wins = (pos[s == 1].sum() * neg[s == 0].sum()) + 0.5 * (pos[s == 1].sum() * neg[s == 1].sum() + pos[s == 0].sum() * neg[s == 0].sum())
        return wins / (pos.sum() * neg.sum())

    plain = [auroc(a, w) - auroc(b, w) for w in rng.poisson(1, (2000, 1000))]
    for name, q in (("low", 0.025), ("median", 0.5), ("high", 0.975)):
        assert abs(got[name] - np.quantile(plain, q)) < 0.012
    table = {r["n"]: r["cdf"] for r in head.poisson_table(spark).collect()}
    assert math.isclose(table[1][1], 2 / math.e, rel_tol=1e-12) and all(abs(c[-1] - 1) < 1e-12 for c in table.values())


def test_poisson_tables_end_where_no_number_drawn_reaches(spark):
    largest = 1 - 0.5 / 2**32
    for n, cdf in head.poisson_table(spark).collect():
        full = [sum(math.exp(-n + k * math.log(n) - math.lgamma(k + 1)) for k in range(m + 1)) for m in range(120)]
        assert len(cdf) < 90 and cdf[-1] > largest
        assert all(sum(c <= u for c in cdf) == sum(c <= u for c in full) for u in (0.5 / 2**32, 0.3, 0.999, largest))


def test_mining_never_shuffles_the_messages(spark):
    mined = parsing.mine_templates(spark.createDataFrame([(f"job {i} on host{i % 7} ended", i) for i in range(50)], "message string, line_no int"))
    assert "Exchange hashpartitioning" not in mined._jdf.queryExecution().executedPlan().toString()
    assert {r["template"] for r in mined.collect()} == {"job <*> on <*> ended"}


def test_slots_are_typed_by_rows_and_distinct_values(spark):
    rows = [("t", 0, "a" * 32, "s1")] * 3 + [("t", 0, "x", "s2"), ("t", 1, "1", "s1"), ("t", 1, "2.5", "s2"), ("t", 1, None, "s3"), ("t", 2, "q", "s1"), ("t", 2, "1", None)]
    got = sorted(tuple(r) for r in parsing.typed_slots(spark.createDataFrame(rows, "template string, slot int, value string, session_id string")).collect())
    assert got == [("t", 1, "numeric", 2, 3), ("t", 2, "categorical", 2, 1)]
