"""Streaming queries, run over what is there (availableNow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands
from ..shared import new_path
from ..streaming import jobs
from .checks import check
from .lifecycle import lifecycle
from .registry import longs, query, r6


@query("r01_stream_vocabulary", "SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return jobs.run_available(jobs.vocabulary(jobs.event_stream(s, f"{d}/events.parquet")), "vocabulary", "complete")


# what the watermark (ten minutes behind the last event) has closed by the end
SESSIONS = """
WITH g AS (SELECT CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) AS t, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
h AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT session_id, min(t) AS started_us, max(t) + 1800000000 AS ended_us, count(*) AS n_events, round(max(value), 6) AS top_value FROM h GROUP BY session_id, i
HAVING max(t) + 1800000000 <= (SELECT max(t) // 1000 * 1000 - 600000000 FROM g)"""


@query("r02_stream_sessions", SESSIONS)
def _(s, d):
    out = jobs.run_available(jobs.gap_sessions(jobs.event_stream(s, f"{d}/events.parquet")), "sessions")
    return out.select("session_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n_events", *r6("top_value"))


def _scored(s, d):
    life = lifecycle(s, d)
    windows = life.signals.where("split = 'va'").select(F.concat_ws("/", "block_id", "pos").alias("block_id"), "y", F.round("nll", 9).alias("score"))
    cut = bands.derive_bands(windows).first()  # two numbers
    return jobs.banded(jobs.event_stream(s, f"{d}/events.parquet"), life.model, life.vocab, cut["uncertain"], cut["suspicious"])


# events that the watermark has passed by the end; a day without events begins a session anew
SCORED = """
, gp AS (SELECT *, CASE WHEN (epoch_us(ts) + 999) // 1000 - lag((epoch_us(ts) + 999) // 1000) OVER (PARTITION BY session_id ORDER BY ts, event_id) >= 86400000 THEN 1 ELSE 0 END AS fresh FROM log),
sn AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM gp),
st AS (SELECT session_id, event_id AS line_id, ts, event AS target, lag(event, 1) OVER w AS c1, lag(event, 2) OVER w AS c2 FROM sn WINDOW w AS (PARTITION BY session_id, part ORDER BY ts, event_id)),
ps AS (SELECT s.*, p0.p AS q0, (coalesce(a.n, 0) + p0.p) / (coalesce(t1.t, 0) + 1) AS q1, b.n AS n2, t2.t AS t2 FROM st s JOIN p0 ON p0.event = s.target LEFT JOIN n1 a ON a.c1 = s.c1 AND a.event = s.target LEFT JOIN (SELECT c1, sum(n) AS t FROM n1 GROUP BY c1) t1 ON t1.c1 = s.c1
  LEFT JOIN n2 b ON b.c2 = s.c2 AND b.c1 = s.c1 AND b.event = s.target LEFT JOIN (SELECT c2, c1, sum(n) AS t FROM n2 GROUP BY c2, c1) t2 ON t2.c2 = s.c2 AND t2.c1 = s.c1 WHERE s.c1 IS NOT NULL),
sw AS (SELECT session_id, line_id, ts, target, round(-ln(least(greatest((coalesce(n2, 0) + q1) / (coalesce(t2, 0) + 1), 1e-12), 1.0)), 9) AS score FROM ps),
vw AS (SELECT block_id || '/' || pos AS id, y, round(nll, 9) AS score FROM sig WHERE split = 'va'), vp AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM vw GROUP BY score),
vc AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(p) OVER () AS tp FROM vp WINDOW w AS (ORDER BY score DESC)), sus AS (SELECT score AS s FROM vc ORDER BY round(2 * cp / (cp + cq + tp), 12) DESC, score LIMIT 1),
vr AS (SELECT score, row_number() OVER w AS r, sum(y) OVER w AS cy, count(*) OVER () AS n FROM vw WINDOW w AS (ORDER BY score, id ROWS UNBOUNDED PRECEDING)), vk AS (SELECT coalesce(max(r) FILTER (cy <= 0.01 * r), 0) AS clean, max(n) AS n FROM vr),
ct AS (SELECT least(vr.score, sus.s) AS u, sus.s FROM vk, sus, vr WHERE vr.r = CASE WHEN clean = 0 THEN 1 ELSE least(clean + 1, vk.n) END),
sb AS (SELECT sw.*, CASE WHEN score >= ct.s THEN 'ANOMALY' WHEN score >= ct.u THEN 'UNCERTAIN' ELSE 'NORMAL' END AS band FROM sw, ct WHERE epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM log)) """


@query("r03_stream_scores", check(SCORED + "SELECT session_id, line_id, target, round(score, 6) AS score, band FROM sb"))
def _(s, d):
    return jobs.run_available(_scored(s, d), "scored").select("session_id", *longs("line_id"), "target", *r6("score"), "band")


@query("r04_stream_band_counts", check(SCORED + """
SELECT started_us, band, count(*) AS n FROM (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS started_us, band FROM sb) WHERE started_us + 3600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM sb) GROUP BY ALL"""))
def _(s, d):
    scored = jobs.run_available(_scored(s, d), "scored").select("ts", "band")
    path = new_path(s, "scored-again")
    scored.write.parquet(path)
    again = s.readStream.schema(scored.schema).format("parquet").load(path)
    out = jobs.run_available(jobs.window_counts(again), "band-counts")
    return out.select(F.unix_micros("started").alias("started_us"), "band", "n")
