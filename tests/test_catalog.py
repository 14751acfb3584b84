"""Every registered query with SQL against DuckDB on the smallest tables, and invariants of those without."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelight import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def run(spark, sf, name):
    return catalog.queries()[name](spark, sf).toPandas()


def test_bootstrap_interval_is_ordered(spark, sf):
    r = run(spark, sf, "j21_bootstrap_difference").iloc[0]
    assert r["n_replicates"] == 50 and r["low"] <= r["median"] <= r["high"]


def test_separation_tests_are_probabilities(spark, sf):
    t = run(spark, sf, "j22_separation_tests")
    assert t["p"].between(0, 1).all() and (t["q"] >= t["p"] - 1e-9).all() and (t["q"] <= 1).all()


def test_head_learns_its_training_rows(spark, sf):
    assert run(spark, sf, "h02_fit_head").iloc[0]["f1"] > 0.5


def test_head_falls_back_without_a_vector(spark, sf):
    t = run(spark, sf, "h03_score_head")
    assert len(t) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and (t["held_out"] == (t["vec_id"] % 5 == 0)).all()
    missing = t[t["vec_id"] % 15 == 0]
    assert missing["verdict"].isna().all() and (missing["reason"] == "no-vector").all()
    assert t[t["vec_id"] % 15 != 0]["score"].between(0, 1).all()


def test_head_is_reproduced(spark, sf):
    r = run(spark, sf, "h04_reproduction_gate").iloc[0]
    assert r["same"] and r["saved_same"]


def test_other_queries_have_rows(spark, sf):
    for name in ("l11_facts", "h05_text_vectors", "q07_source_control"):
        assert len(run(spark, sf, name)) > 0


def test_facts_message(spark, sf):
    text = run(spark, sf, "l11_facts").iloc[0]["facts"]
    assert text.startswith("BEGIN_FACTS") and "END_FACTS" in text


def test_stream_sessions_lose_nothing_but_the_open_ones(spark, sf):
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert 0.8 * total < run(spark, sf, "r02_stream_sessions")["n_events"].sum() <= total


def test_stream_scores_every_closed_event_but_the_first_of_a_session(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    t = run(spark, sf, "r03_stream_scores")
    closed = events.crossJoin(events.agg(F.max("ts").alias("__last"))).where("ts <= __last - INTERVAL 10 MINUTES")
    assert 0.7 * closed.count() < len(t) <= closed.count() - closed.select("user_id").distinct().count()  # fewer where a day passes between events
    assert set(t["band"]) <= {"NORMAL", "UNCERTAIN", "ANOMALY"}
    assert run(spark, sf, "r04_stream_band_counts")["n"].sum() > 0
