"""SQL views that the queries' checks share: the same lifecycle, written densely and apart from the Spark plans."""

from __future__ import annotations

import re

NAMES = ["msp_uncertainty_max", "surprisal_max", "surprisal_mean", "nll_max", "nll_mean", "miss_count", "miss_frac", "nll_rolling_max", "combined_z", "event_z_mean", "event_z_max"]

VIEWS = {
    "log": """
SELECT row_number() OVER (ORDER BY ts, event_id) AS line_no, event_id, ts, CAST(user_id AS VARCHAR) AS session_id, event_type AS event, CAST(event_id % 3 AS VARCHAR) AS source,
  CASE WHEN value >= 200 THEN 1 ELSE 0 END AS alert, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS slot FROM events""",
    "ev": """
SELECT 'b' || ((line_no - 1) // 20) AS block_id, (line_no - 1) // 20 AS ordinal, (line_no - 1) % 20 AS pos, event, alert, ts, source, line_no, session_id FROM log
WHERE line_no <= (SELECT count(*) // 20 * 20 FROM log)""",
    "blk": "SELECT block_id, ordinal, max(alert) AS y, count(*) AS n_events FROM ev GROUP BY block_id, ordinal",
    "hsh": "SELECT *, CAST('0x' || substr(md5(block_id || '42'), 1, 8) AS BIGINT) AS h FROM blk",
    "rnk": "SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, block_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM hsh",
    "spl": "SELECT block_id, ordinal, y, n_events, h, CASE WHEN r * 10 <= n * 7 THEN 'tr' WHEN r * 10 <= n * 8 THEN 'va' ELSE 'te' END AS split FROM rnk",
    "voc": "SELECT event, row_number() OVER (ORDER BY event) - 1 AS idx, n FROM (SELECT event, count(*) AS n FROM log GROUP BY event)",
    "win": """
SELECT * FROM (SELECT e.block_id, e.pos, e.event AS target, lag(e.event, 1) OVER w AS c1, lag(e.event, 2) OVER w AS c2, s.y, s.split
  FROM ev e JOIN spl s USING (block_id) WINDOW w AS (PARTITION BY e.block_id ORDER BY e.pos)) WHERE pos > 0""",
    "trn": "SELECT * FROM win WHERE split = 'tr' AND y = 0",
    "n0": "SELECT target AS event, count(*) AS n FROM trn GROUP BY 1",
    "n1": "SELECT c1, target AS event, count(*) AS n FROM trn GROUP BY 1, 2",
    "n2": "SELECT c2, c1, target AS event, count(*) AS n FROM trn WHERE c2 IS NOT NULL GROUP BY 1, 2, 3",
    "sz": "SELECT count(*) AS v, (SELECT count(*) FROM trn) AS n FROM voc",
    "p0": "SELECT event, (coalesce(n0.n, 0) + 1.0 / sz.v) / (sz.n + 1) AS p FROM voc LEFT JOIN n0 USING (event) CROSS JOIN sz",
    "p1": """
SELECT c.c1, p0.event, (coalesce(n1.n, 0) + p0.p) / (coalesce(t.t, 0) + 1) AS p FROM (SELECT DISTINCT c1 FROM win) c CROSS JOIN p0
LEFT JOIN n1 ON n1.c1 = c.c1 AND n1.event = p0.event LEFT JOIN (SELECT c1, sum(n) AS t FROM n1 GROUP BY c1) t ON t.c1 = c.c1""",
    "p2": """
SELECT c.c2, c.c1, p1.event, (coalesce(n2.n, 0) + p1.p) / (coalesce(t.t, 0) + 1) AS p FROM (SELECT DISTINCT c2, c1 FROM win WHERE c2 IS NOT NULL) c JOIN p1 ON p1.c1 = c.c1
LEFT JOIN n2 ON n2.c2 = c.c2 AND n2.c1 = c.c1 AND n2.event = p1.event LEFT JOIN (SELECT c2, c1, sum(n) AS t FROM n2 GROUP BY c2, c1) t ON t.c2 = c.c2 AND t.c1 = c.c1""",
    "dst": "SELECT c1, c2, event, p FROM p2 UNION ALL SELECT c1, '' AS c2, event, p FROM p1",
    "rk": "SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY round(p, 12) DESC, event) AS r FROM dst",
    "stt": """
SELECT c1, c2, max(p) FILTER (r = 1) AS msp, max(event) FILTER (r = 1) AS predicted, max(p) FILTER (r = 1) - coalesce(max(p) FILTER (r = 2), 0) AS gap,
  -sum(p * ln(p)) / ln(greatest(count(*), 2)) AS entropy_n FROM rk GROUP BY c1, c2""",
    "sig": """
SELECT w.block_id, w.pos, w.target, w.c1, w.c2, w.y, w.split, k.p AS p_true, -ln(least(greatest(k.p, 1e-12), 1.0)) AS nll, 1 - k.p AS surprisal, s.predicted, s.msp, s.gap, s.entropy_n,
  CASE WHEN k.r <= 3 THEN 0 ELSE 1 END AS miss, CASE WHEN k.r <= 5 THEN k.r ELSE 0 END AS target_rank,
  least(greatest(0.55 * (1 - k.p) + 0.35 * s.entropy_n + 0.10 * (CASE WHEN k.r <= 3 THEN 0 ELSE 1 END), 0.0), 1.0) AS composite
FROM win w JOIN rk k ON k.c1 = w.c1 AND k.c2 = coalesce(w.c2, '') AND k.event = w.target JOIN stt s ON s.c1 = w.c1 AND s.c2 = coalesce(w.c2, '')""",
    "sc0": """
SELECT b.block_id, b.ordinal, b.y, b.n_events, b.split, greatest(coalesce(max(1 - msp), 0), 0) AS msp_uncertainty_max, greatest(coalesce(max(surprisal), 0), 0) AS surprisal_max, coalesce(avg(surprisal), 0) AS surprisal_mean,
  greatest(coalesce(max(nll), 0), 0) AS nll_max, coalesce(avg(nll), 0) AS nll_mean, CAST(coalesce(sum(miss), 0) AS DOUBLE) AS miss_count, coalesce(avg(miss), 0) AS miss_frac, coalesce(avg(msp), 0) AS msp_mean
FROM spl b LEFT JOIN sig g ON g.block_id = b.block_id GROUP BY ALL""",
    "rol": """
SELECT block_id, max(CASE WHEN n < 5 THEN plain WHEN i >= 5 THEN m END) AS nll_rolling_max FROM (SELECT block_id, avg(nll) OVER (PARTITION BY block_id ORDER BY pos ROWS 4 PRECEDING) AS m,
  row_number() OVER (PARTITION BY block_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY block_id) AS n, avg(nll) OVER (PARTITION BY block_id) AS plain FROM sig) GROUP BY block_id""",
    "cst": "SELECT avg(nll_max) AS m1, stddev_pop(nll_max) + 1e-8 AS s1, avg(miss_count) AS m2, stddev_pop(miss_count) + 1e-8 AS s2 FROM sc0 WHERE split = 'va'",
    "est": "SELECT target, count(*) AS n, avg(nll) AS mu, sqrt(greatest(avg(nll * nll) - avg(nll) * avg(nll), 1e-8)) AS sd FROM sig WHERE split = 'va' GROUP BY target",
    "ezs": """
SELECT block_id, coalesce(avg(z), 0) AS event_z_mean, greatest(coalesce(max(z), 0), 0) AS event_z_max FROM (SELECT g.block_id, CASE WHEN coalesce(e.n, 0) < 5 THEN (g.nll - w.mu) / w.sd ELSE (g.nll - e.mu) / e.sd END AS z
  FROM sig g LEFT JOIN est e ON e.target = g.target CROSS JOIN (SELECT avg(nll) AS mu, stddev_pop(nll) + 1e-8 AS sd FROM sig WHERE split = 'va') w) GROUP BY block_id""",
    "sc": "SELECT s.block_id, s.ordinal, s.y, s.n_events, s.split, s.msp_mean, " + ", ".join(f"round({x}, 9) AS {n}" for n, x in {
        **{n: f"s.{n}" for n in NAMES[:7]}, "nll_rolling_max": "coalesce(rol.nll_rolling_max, 0)", "combined_z": "(s.nll_max - c.m1) / c.s1 + (s.miss_count - c.m2) / c.s2", "event_z_mean": "coalesce(z.event_z_mean, 0)", "event_z_max": "coalesce(z.event_z_max, 0)",
    }.items()) + " FROM sc0 s CROSS JOIN cst c LEFT JOIN rol USING (block_id) LEFT JOIN ezs z ON z.block_id = s.block_id",
    "sd": "SELECT block_id, ordinal, y, split, nll_mean AS score FROM sc",
    "lng": " UNION ALL ".join(f"SELECT block_id, y, split, '{n}' AS score_name, {n} AS score FROM sc" for n in NAMES),
    # curves: one row for each score name, split and distinct score
    "pts": "SELECT score_name, split, score, sum(y) AS p, sum(1 - y) AS q FROM lng GROUP BY ALL",
    "cur": """
SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(p) OVER (PARTITION BY score_name, split) AS tp, sum(q) OVER (PARTITION BY score_name, split) AS tn FROM pts
WINDOW w AS (PARTITION BY score_name, split ORDER BY score DESC)""",
    "qul": """
SELECT score_name, split, coalesce(sum((cp - p) * q + 0.5 * p * q) / nullif(max(tp * tn), 0), 0) AS auroc, sum(coalesce(p / nullif(tp, 0), 0) * cp / (cp + cq)) AS pr_auc,
  max(abs(coalesce((cp - p) / nullif(tp, 0), 0) - coalesce((cq - q) / nullif(tn, 0), 0))) AS ks, max(tp) AS n_pos, max(tn) AS n_neg FROM cur GROUP BY ALL""",
    "bst": """
SELECT score_name, split, score AS threshold, f1, cp / (cp + cq) AS precision, coalesce(cp / nullif(tp, 0), 0) AS recall FROM (SELECT *, 2 * cp / (cp + cq + tp) AS f1,
  row_number() OVER (PARTITION BY score_name, split ORDER BY round(2 * cp / (cp + cq + tp), 12) DESC, score) AS o FROM cur) WHERE o = 1""",
    "pre": """
SELECT score_name, score, row_number() OVER w AS r, sum(y) OVER (PARTITION BY score_name ORDER BY score, block_id ROWS UNBOUNDED PRECEDING) AS cy, count(*) OVER (PARTITION BY score_name) AS n FROM lng WHERE split = 'va'
WINDOW w AS (PARTITION BY score_name ORDER BY score, block_id)""",
    "cln": "SELECT score_name, coalesce(max(r) FILTER (cy <= 0.01 * r), 0) AS clean, max(n) AS n FROM pre GROUP BY score_name",
    "cut": """
SELECT c.score_name, least(p.score, b.threshold) AS uncertain, b.threshold AS suspicious FROM cln c JOIN pre p ON p.score_name = c.score_name AND p.r = CASE WHEN clean = 0 THEN 1 ELSE least(clean + 1, c.n) END
JOIN bst b ON b.score_name = c.score_name AND b.split = 'va'""",
    "bnd": """
SELECT s.block_id, s.ordinal, s.y, s.split, s.score, CASE WHEN score >= suspicious THEN 'ANOMALY' WHEN score >= uncertain THEN 'UNCERTAIN' ELSE 'NORMAL' END AS band
FROM sd s CROSS JOIN (SELECT * FROM cut WHERE score_name = 'nll_mean') c WHERE split = 'te'""",
    "tpl": "SELECT event, CASE WHEN event <> 'signup' THEN 'User [*] did ' || event || CASE WHEN event = 'error' THEN ' error on item [*]' ELSE ' on item [*]' END END AS raw FROM voc",
    "tmp": "SELECT event, replace(raw, '[*]', '<...>') AS template FROM tpl WHERE raw IS NOT NULL",
}


def again(suffix: str, first: str, upto: str, edits: dict[str, str]) -> str:
    """The views from ``first`` to ``upto`` once more, under names that end in ``suffix`` and with some definitions replaced."""
    names = list(VIEWS)
    own = names[names.index(first) : names.index(upto) + 1]
    named = re.compile(r"\b(" + "|".join(own) + r")\b")
    return "".join(f",\n{n}{suffix} AS ({named.sub(lambda m: m[1] + suffix, edits.get(n, VIEWS[n]).strip())})" for n in own)


#: The lifecycle with a split by time.
CHRONOLOGICAL = again("_c", "spl", "bst", {"spl": """
SELECT block_id, ordinal, y, n_events, 0 AS h, CASE WHEN ordinal < (SELECT count(*) FROM blk) * 7 // 10 THEN 'tr' WHEN ordinal < (SELECT count(*) FROM blk) * 8 // 10 THEN 'va' ELSE 'te' END AS split FROM blk"""})


def of_source(source: int) -> str:
    """The lifecycle over the lines of one source."""
    return again(f"_s{source}", "log", "bst", {"log": VIEWS["log"] + f" WHERE event_id % 3 = {source}"})


def variant(suffix: str, order: int, alpha: float, backward: bool) -> str:
    """Windows and signals of a model of another order, smoothing or direction."""
    edits = {}
    if backward:
        edits["win"] = VIEWS["win"].replace("lag(", "lead(").replace("WHERE pos > 0", "WHERE c1 IS NOT NULL")
    edits["p0"] = VIEWS["p0"].replace("1.0 / sz.v", f"{alpha} / sz.v").replace("(sz.n + 1)", f"(sz.n + {alpha})")
    for p, lower in (("p1", "p0.p"), ("p2", "p1.p")):
        edits[p] = VIEWS[p].replace(f"+ {lower}) / (coalesce(t.t, 0) + 1)", f"+ {alpha} * {lower}) / (coalesce(t.t, 0) + {alpha})")
    if order == 1:
        edits["dst"] = "SELECT c1, '' AS c2, event, p FROM p1"
        edits["sig"] = VIEWS["sig"].replace("coalesce(w.c2, '')", "''")
    return again(suffix, "win", "sig", edits)


def check(query: str, upto: str = "tmp") -> str:
    """``query`` behind the views it may use."""
    names = list(VIEWS)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names[: names.index(upto) + 1]) + "\n" + query.strip()
