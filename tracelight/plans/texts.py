"""Queries over raw text: sources and sinks, parsing, templates, evidence and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bands, evidence, fixed_texts, metrics, model, parsing, ranking, semantics, sessions, splits, vocab
from ..shared import new_path, stored
from ..sources import logs
from .checks import check
from .detection import MSP_SQL, OCCLUDED, PCT, TOPW, _banded, _percentiles, occluded
from .lifecycle import lifecycle, read
from .registry import longs, query, r6

# --- raw logs written from the events table, so that readers have files to read ------------------------------------
FLAT_SQL = """CASE WHEN event_id % 50 = 0 THEN 'short line ' || event_id ELSE concat_ws(' ', CASE WHEN value >= 200 THEN 'FATAL' ELSE '-' END, CAST(event_id AS VARCHAR), 'day', 'node' || CAST(user_id AS VARCHAR), 'time', 'node', 'APP', 'CORE', 'INFO',
 event_type, 'by', CAST(user_id AS VARCHAR), 'from', '10.0.' || CAST(event_id % 7 AS VARCHAR) || '.1', 'at', '/srv/' || event_type || '/x.1', 'took', CAST(event_id % 13 AS VARCHAR) || '.5', 'ok') END"""
UUID_SQL = "substr(md5(CAST({0} AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST({0} AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST({0} AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST({0} AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST({0} AS VARCHAR)), 21, 12)"
HEAD_SQL = f"""CASE WHEN event_id % 40 = 0 THEN 'Traceback of ' || event_id WHEN event_id % 40 = 1 THEN '   ' ELSE concat_ws(' ', 'app.log', '2024-01-01', '00:00:01', CAST(event_id AS VARCHAR), CASE WHEN value >= 200 THEN 'ERROR' ELSE 'INFO' END, 'svc.' || event_type,
 '[req-' || {UUID_SQL.format('event_id')} || ']', CASE WHEN event_id % 3 = 0 THEN '[instance: ' || {UUID_SQL.format('user_id')} || '] state' WHEN event_id % 3 = 1 THEN 'GET /servers/' || {UUID_SQL.format('user_id')} || '/ids' ELSE 'no key here' END) END"""


def _spark(sql: str) -> str:
    """The same expression for Spark."""
    return sql.replace("AS VARCHAR", "AS STRING")


def _events(s, d) -> DataFrame:
    return read(s, d, "events")


def _flat_path(s, d) -> str:
    """A raw log in several files, in the order of their names."""
    path = new_path(s, "flat-log")
    _events(s, d).orderBy("event_id").select(F.expr(_spark(FLAT_SQL))).write.text(path)
    return path


def _header_paths(s, d) -> dict[str, str]:
    paths = {}
    for i, name in enumerate(("normal1", "normal2", "abnormal")):
        paths[name] = new_path(s, f"header-{name}")
        line = F.concat(F.expr(_spark(HEAD_SQL)), F.lit("\r"))
        _events(s, d).where(F.col("event_id") % 3 == i).orderBy("event_id").select(line).write.text(paths[name])
    return paths


FL = f"WITH l AS (SELECT event_id AS line_no, {FLAT_SQL} AS line FROM events), f AS (SELECT *, string_split_regex(trim(line), '\\s+') AS p FROM l), g AS (SELECT line_no, p[1] AS label, p[4] AS node, array_to_string(p[10:], ' ') AS content, CASE WHEN p[1] = '-' THEN 0 ELSE 1 END AS alert FROM f WHERE len(p) > 9) "
HD = f"""WITH l AS (SELECT event_id AS line_no, CASE event_id % 3 WHEN 0 THEN 'normal1' WHEN 1 THEN 'normal2' ELSE 'abnormal' END AS source, {HEAD_SQL} AS line FROM events),
k AS (SELECT *, regexp_matches(line, '^(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+\\[([^\\]]*)\\]\\s+(.*)$') AS parsed FROM l WHERE trim(line) <> ''),
h AS (SELECT *, CASE WHEN parsed THEN split_part(line, ' ', 5) ELSE '' END AS level, CASE WHEN parsed THEN split_part(line, ' ', 6) ELSE '' END AS component, CASE WHEN parsed THEN regexp_extract(line, '\\] (.*)$', 1) ELSE '' END AS content FROM k),
z AS (SELECT *, coalesce(nullif(regexp_extract(content, '\\[instance:\\s*([0-9a-f-]{{36}})\\]', 1), ''), nullif(regexp_extract(content, '/servers/([0-9a-f-]{{36}})', 1), '')) AS session_id FROM h) """.replace("'\\] (.*)$'", "'\\] (.*)$'")


@query("s01_event_column", "SELECT event_type AS event FROM events WHERE event_type IS NOT NULL")
def _(s, d):
    return logs.event_column(s, f"{d}/events.parquet", "event_type")


@query("s02_flat_log", FL.replace("event_id AS line_no", "row_number() OVER (ORDER BY event_id) AS line_no") + "SELECT line_no, label, node, content, alert FROM g")
def _(s, d):
    return logs.flat_log(s, _flat_path(s, d))


@query("s03_header_log", HD.replace("event_id AS line_no", "row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS line_no") + "SELECT line_no, source, parsed, level, component, coalesce(session_id, 'none') AS session_id FROM z")
def _(s, d):
    return logs.header_log(s, _header_paths(s, d)).select("line_no", "source", "parsed", "level", "component", F.coalesce("session_id", F.lit("none")).alias("session_id"))


@query("s04_traces", check("SELECT block_id, string_agg(event, '|' ORDER BY pos) AS events FROM ev GROUP BY block_id"))
def _(s, d):
    path = new_path(s, "traces")
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "event"))), lambda x: x["event"])
    own = lifecycle(s, d).events.groupBy(F.col("block_id").alias("BlockId")).agg(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).alias("Features"))
    logs.write_result(own, path, form="csv")
    return logs.traces(s, path).select("block_id", F.array_join("events", "|").alias("events"))


@query("s05_labels", check("SELECT block_id, y FROM blk"))
def _(s, d):
    path = new_path(s, "labels")
    own = lifecycle(s, d).blocks.select(F.col("block_id").alias("BlockId"), F.when(F.col("y") == 1, " ANOMALY ").otherwise("Normal").alias("Label"))
    logs.write_result(own, path, form="csv")
    return logs.labels(s, path)


@query("s06_labelled_ids", f"SELECT DISTINCT {UUID_SQL.format('user_id')} AS session_id FROM events WHERE value >= 200")
def _(s, d):
    path = new_path(s, "ids")
    _events(s, d).where("value >= 200").select(F.concat(F.lit("instance "), F.expr(_spark(UUID_SQL.format("user_id"))), F.lit(" was broken; see "), F.expr(_spark(UUID_SQL.format("user_id"))))).write.text(path)
    return logs.labelled_ids(s, path)


def _templates(s, d) -> DataFrame:
    """A template dictionary of the events, without one of them, read back through the source that finds it."""
    path, other = new_path(s, "templates"), new_path(s, "no-templates")
    text = F.concat(F.lit("User [*] did "), F.col("event"), F.when(F.col("event") == "error", " error on item [*]").otherwise(" on item [*]"))
    own = lifecycle(s, d).vocab.where("event <> 'signup'")
    logs.write_result(own.select(F.col("event").alias("EventId"), text.alias("EventTemplate")), path, form="csv")
    logs.write_result(own.select(F.col("event").alias("Name")), other, form="csv")
    return logs.template_dictionary(s, [f"{path}-missing", other, path])


@query("s07_template_dictionary", check("SELECT event, template FROM tmp"))
def _(s, d):
    return _templates(s, d)


@query("s08_result_sinks", check("SELECT block_id, CAST(n_events AS BIGINT) AS n_events, round(bnd.score, 6) AS surprise_score, band AS classification, bnd.y AS true_label FROM bnd JOIN blk USING (block_id)"))
def _(s, d):
    path = new_path(s, "results")
    own = _banded(s, d).join(lifecycle(s, d).blocks.select("block_id", "n_events"), "block_id")
    logs.write_result(own.select("block_id", "n_events", F.round("score", 6).alias("surprise_score"), F.col("band").alias("classification"), F.col("y").alias("true_label")), path, by="classification")
    return s.read.parquet(path)


SEQUENCES = ", sqn AS (SELECT block_id, pos, string_agg(event, ' ') OVER (PARTITION BY block_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sequence FROM ev) "


def _csv(s, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as CSV and read back with their types."""
    path = new_path(s, name)
    logs.write_result(rows, path, form="csv")
    return s.read.csv(path, header=True, schema=rows.schema)


@query("s08_window_results", check(SEQUENCES + "SELECT block_id, pos, sequence, predicted AS predicted_event, target AS actual_event, predicted = target AS correct, round(composite, 6) AS anomaly_score, round(1 - composite, 6) AS confidence, CASE WHEN round(composite, 9) >= 0.9 THEN 'ANOMALY' WHEN round(composite, 9) >= 0.45 THEN 'UNCERTAIN' ELSE 'NORMAL' END AS classification FROM sig JOIN sqn USING (block_id, pos) WHERE split = 'te'"))
def _(s, d):
    own = lifecycle(s, d).signals.where("split = 'te'").join(lifecycle(s, d).sequences, ["block_id", "pos"])
    rows = own.select("block_id", *longs("pos"), F.array_join("sequence", " ").alias("sequence"), F.col("predicted").alias("predicted_event"), F.col("target").alias("actual_event"), (F.col("predicted") == F.col("target")).alias("correct"), F.round("composite", 6).alias("anomaly_score"), F.round(1 - F.col("composite"), 6).alias("confidence"), bands.fixed_bands(F.round("composite", 9), 0.9).alias("classification"))
    return _csv(s, rows, "window-results")


@query("s08_confidence_results", check(SEQUENCES + f"SELECT block_id, pos, sequence, predicted AS predicted_event, target AS actual_event, round(msp, 6) AS confidence_score, {MSP_SQL.format(0.24, 0.22)} AS classification, {MSP_SQL.format(0.24, 0.22)} = 'UNCERTAIN' AS routed FROM sig JOIN sqn USING (block_id, pos) WHERE split = 'te'"))
def _(s, d):
    own = lifecycle(s, d).signals.where("split = 'te'").join(lifecycle(s, d).sequences, ["block_id", "pos"]).withColumn("classification", bands.msp_band(F.round("msp", 9), 0.24, 0.22))
    rows = own.select("block_id", *longs("pos"), F.array_join("sequence", " ").alias("sequence"), F.col("predicted").alias("predicted_event"), F.col("target").alias("actual_event"), F.round("msp", 6).alias("confidence_score"), "classification", (F.col("classification") == "UNCERTAIN").alias("routed"))
    return _csv(s, rows, "confidence-results")


@query("s08_session_tables", check("SELECT e.block_id, string_agg(e.event, '|' ORDER BY e.pos) AS events, b.y, count(DISTINCT e.source) AS n_sources, epoch_us(min(e.ts)) AS first_us FROM ev e JOIN blk b USING (block_id) GROUP BY e.block_id, b.y"))
def _(s, d):
    """Traces, labels and provenance written as the CSV tables that their readers expect, and read by them."""
    events, blocks = lifecycle(s, d).events, lifecycle(s, d).blocks
    paths = {name: new_path(s, name) for name in ("traces", "labels", "meta")}
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "event"))), lambda x: x["event"])
    logs.write_result(events.groupBy(F.col("block_id").alias("BlockId")).agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("Features")), paths["traces"], form="csv")
    logs.write_result(blocks.select(F.col("block_id").alias("BlockId"), F.when(F.col("y") == 1, "Anomaly").otherwise("Normal").alias("Label")), paths["labels"], form="csv")
    meta = sessions.provenance(events, "block_id")
    logs.write_result(meta.select(F.col("block_id").alias("BlockId"), F.array_join("sources", "|").alias("SourceFiles"), "n_events", F.unix_micros("first_ts").alias("first_us")), paths["meta"], form="csv")
    read_meta = s.read.csv(paths["meta"], header=True, schema="block_id string, sources string, n_events long, first_us long")
    both = logs.traces(s, paths["traces"]).join(logs.labels(s, paths["labels"]), "block_id").join(read_meta, "block_id")
    return both.select("block_id", F.array_join("events", "|").alias("events"), "y", F.size(F.split("sources", "\\|")).cast("long").alias("n_sources"), "first_us")


@query("s08_weights", check(OCCLUDED + f"SELECT w.block_id, w.event AS event_id, round(w.w, 6) AS attention_weight FROM ow w JOIN {TOPW} t ON t.block_id = w.block_id AND t.pos = w.pos WHERE t.rank = 1"))
def _(s, d):
    """The weights of the most surprising window of each test block."""
    top = ranking.most_surprising(lifecycle(s, d).signals.where("split = 'te'")).select("block_id", "pos")
    own = occluded(s, d).join(top, ["block_id", "pos"]).groupBy("block_id", F.col("event").alias("event_id")).agg(F.round(F.sum("weight"), 6).alias("attention_weight"))
    return _csv(s, own, "weights")


STATS = HD + """SELECT count(*) AS lines, count(*) FILTER (parsed) AS parsed, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id) FILTER (level = 'ERROR') AS anomalous, count(*) FILTER (parsed AND session_id IS NULL) AS dropped, count(DISTINCT component) FILTER (parsed) AS vocab FROM z"""


@query("s09_statistics", STATS)
def _(s, d):
    path = new_path(s, "statistics")
    own = logs.header_log(s, _header_paths(s, d))
    logs.write_statistics(own.agg(
        F.count("*").alias("lines"), F.count_if("parsed").alias("parsed"), F.countDistinct("session_id").alias("sessions"), F.countDistinct(F.when(F.col("level") == "ERROR", F.col("session_id"))).alias("anomalous"),
        F.count_if(F.col("parsed") & F.col("session_id").isNull()).alias("dropped"), F.countDistinct(F.when(F.col("parsed"), F.col("component"))).alias("vocab"),
    ), path)
    return s.read.json(path)


# --- parsing --------------------------------------------------------------------------------------------------------
@query("p01_flat_fields", FL + "SELECT line_no, node, content FROM g")
def _(s, d):
    lines = _events(s, d).select(F.col("event_id").alias("line_no"), F.expr(_spark(FLAT_SQL)).alias("line"))
    return parsing.flat_fields(lines).select("line_no", "node", "content")


def _header(s, d) -> DataFrame:
    source = F.when(F.col("event_id") % 3 == 0, "normal1").when(F.col("event_id") % 3 == 1, "normal2").otherwise("abnormal")
    lines = _events(s, d).select(F.col("event_id").alias("line_no"), source.alias("source"), F.concat(F.expr(_spark(HEAD_SQL)), F.lit("\r\n")).alias("line"))
    fields = parsing.header_fields(parsing.stripped(lines))
    return fields.withColumn("session_id", parsing.session_key(F.col("content")))


@query("p02_header_fields", HD + "SELECT line_no, parsed, level, component, content FROM z")
def _(s, d):
    return _header(s, d).select("line_no", "parsed", "level", "component", "content")


@query("p03_strip", HD + "SELECT line_no, line FROM z")
def _(s, d):
    return _header(s, d).select("line_no", "line")


def _masked_sql(text: str) -> str:
    for pattern in parsing.MASKS:
        text = f"regexp_replace({text}, '{pattern}', '<*>', 'g')"
    return text


@query("p04_mask", f"SELECT doc_id, sha256({_masked_sql('text')}) AS masked_sha FROM documents UNION ALL SELECT -page_id - 1, sha256({_masked_sql('url')}) FROM pages")
def _(s, d):
    texts = read(s, d, "documents").select("doc_id", "text").union(read(s, d, "pages").select(-F.col("page_id") - 1, "url"))
    return texts.select("doc_id", F.sha2(parsing.masked(F.col("text")), 256).alias("masked_sha"))


def _messages(s, d) -> DataFrame:
    lines = _events(s, d).select(F.col("event_id").alias("line_no"), F.col("user_id").cast("string").alias("session_id"), F.expr(_spark(FLAT_SQL)).alias("line"))
    return parsing.flat_fields(lines).select("line_no", "session_id", F.col("content").alias("message"))


MINED = FL + f"""
, m AS (SELECT line_no, content AS message, {_masked_sql('content')} AS masked FROM g), t AS (SELECT *, string_split(masked, ' ') AS tok FROM m),
k AS (SELECT *, len(tok) || ' ' || array_to_string(list_transform(tok[1:2], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS grp FROM t),
w AS (SELECT grp, ix FROM (SELECT DISTINCT grp, unnest(range(len(tok))) AS ix, unnest(tok) AS token FROM k) GROUP BY grp, ix HAVING count(*) > 4),
r AS (SELECT k.line_no, k.message, k.grp, unnest(range(len(tok))) AS ix, unnest(tok) AS token FROM k),
o AS (SELECT r.line_no, any_value(r.message) AS message, string_agg(CASE WHEN w.ix IS NOT NULL OR regexp_matches(r.token, '[0-9]') THEN '<*>' ELSE r.token END, ' ' ORDER BY r.ix) AS template FROM r LEFT JOIN w ON w.grp = r.grp AND w.ix = r.ix GROUP BY r.line_no) """


@query("p05_mine_templates", MINED + "SELECT line_no, template FROM o")
def _(s, d):
    return parsing.mine_templates(_messages(s, d)).select("line_no", "template")


@query("p06_catalogue", MINED + "SELECT template, n, 'E' || row_number() OVER (ORDER BY n DESC, template) AS event FROM (SELECT template, count(*) AS n FROM o GROUP BY template)")
def _(s, d):
    return parsing.template_catalogue(parsing.mine_templates(_messages(s, d)))


@query("p07_clean_template", check("SELECT event, trim(replace(' ' || raw || ' [*]', '[*]', '<...>')) AS template FROM tpl WHERE raw IS NOT NULL"))
def _(s, d):
    raw = lifecycle(s, d).vocab.where("event <> 'signup'").select("event", F.concat(F.lit(" User [*] did "), F.col("event"), F.when(F.col("event") == "error", " error on item [*]").otherwise(" on item [*]"), F.lit(" [*]")).alias("t"))
    return raw.select("event", parsing.clean_template(F.col("t")).alias("template"))


@query("p08_event_ids", "SELECT event_id, 'E' || (event_id % 30) || '|E' || (event_id % 7) AS ids, CAST(2 AS BIGINT) AS n FROM events WHERE event_id % 5 <> 0")
def _(s, d):
    text = F.when(F.col("event_id") % 5 == 0, "none here").otherwise(F.format_string("[E%d, x, E%d]", F.col("event_id") % 30, F.col("event_id") % 7))
    own = _events(s, d).select("event_id", parsing.event_ids(text).alias("ids")).where(F.size("ids") > 0)
    return own.select("event_id", F.array_join("ids", "|").alias("ids"), F.size("ids").cast("long").alias("n"))


@query("p09_session_key", HD + "SELECT line_no, coalesce(session_id, 'none') AS session_id FROM z")
def _(s, d):
    return _header(s, d).select("line_no", F.coalesce("session_id", F.lit("none")).alias("session_id"))


@query("p10_alert", FL + "SELECT line_no, alert FROM g")
def _(s, d):
    lines = _events(s, d).select(F.col("event_id").alias("line_no"), F.expr(_spark(FLAT_SQL)).alias("line"))
    return parsing.flat_fields(lines).select("line_no", parsing.alert(F.col("label")).alias("alert"))


@query("p11_coverage", HD + "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n_lines, count(*) FILTER (parsed) AS n_parsed, count(*) FILTER (NOT parsed) AS n_unparsed, count(*) FILTER (parsed AND session_id IS NOT NULL) AS n_keyed, count(*) FILTER (parsed AND session_id IS NULL) AS n_unkeyed FROM z GROUP BY ROLLUP (source)")
def _(s, d):
    return parsing.coverage(_header(s, d))


SLOTS = MINED + """
, a AS (SELECT o.line_no, o.template, CAST(e.user_id AS VARCHAR) AS session_id, unnest(range(len(string_split(template, ' ')))) AS slot, unnest(string_split(template, ' ')) AS mark, unnest(string_split(message, ' ')) AS value FROM o JOIN events e ON e.event_id = o.line_no),
q AS (SELECT * FROM a WHERE contains(mark, '<*>')) """


def _params(s, d) -> DataFrame:
    return parsing.parameters(stored(parsing.mine_templates(_messages(s, d)), "mined"))


@query("p12_parameters", SLOTS + "SELECT line_no, slot, value FROM q")
def _(s, d):
    return _params(s, d).select("line_no", *longs("slot"), "value")


TYPED = SLOTS + """
, tq AS (SELECT * FROM q WHERE CAST('0x' || substr(md5(session_id || '42'), 1, 8) AS BIGINT) % 10 < 7), u AS (SELECT template, slot, avg(CASE WHEN regexp_matches(value, '[0-9a-fA-F]{32,}') THEN 1.0 ELSE 0.0 END) AS ids, min(CASE WHEN regexp_matches(value, '^-?[0-9]+([.][0-9]+)?$') THEN 1 ELSE 0 END) AS num, count(DISTINCT value) AS n_distinct, count(DISTINCT session_id) AS n_sessions FROM tq GROUP BY template, slot),
v AS (SELECT template, slot, CASE WHEN num = 1 THEN 'numeric' ELSE 'categorical' END AS kind, n_distinct, n_sessions FROM u WHERE ids <= 0.5 AND n_distinct > 1 AND n_sessions >= 0.1 * (SELECT count(DISTINCT session_id) FROM tq)) """


@query("p13_typed_slots", TYPED + "SELECT template, slot, kind, n_distinct, n_sessions FROM v")
def _(s, d):
    return parsing.typed_slots(_training(_params(s, d))).select("template", *longs("slot"), "kind", "n_distinct", "n_sessions")


def _training(params: DataFrame) -> DataFrame:
    """Seven of ten sessions, by their hash."""
    return params.where(splits.seeded_hash(F.col("session_id")) % 10 < 7)


@query("p14_formatters", check("""
SELECT block_id, format('{:.1f}%', round(msp_mean, 9) * 100) AS pct, CASE WHEN msp_mean >= 0.7 THEN 'high' WHEN msp_mean >= 0.4 THEN 'moderate' ELSE 'low' END AS phrase, CASE band WHEN 'ANOMALY' THEN 'Suspicious' WHEN 'UNCERTAIN' THEN 'Uncertain' ELSE 'Normal' END AS label,
 CASE band WHEN 'ANOMALY' THEN 'high surprise — flagged as SUSPICIOUS for investigation.' WHEN 'UNCERTAIN' THEN 'moderate surprise — routed for additional review.' ELSE 'low surprise — consistent with normal behaviour.' END AS meaning FROM bnd JOIN sc USING (block_id)"""))
def _(s, d):
    own = _banded(s, d).join(lifecycle(s, d).wide.select("block_id", "msp_mean"), "block_id")
    return own.select("block_id", parsing.format_pct(F.round("msp_mean", 9)).alias("pct"), parsing.confidence_phrase(F.col("msp_mean")).alias("phrase"), parsing.band_label(F.concat(F.lit(" "), F.lower("band"))).alias("label"), parsing.band_text(F.col("band")).alias("meaning"))


@query("q06_slot_features", TYPED + """
SELECT q.session_id, coalesce(round(avg(CASE WHEN v.kind = 'numeric' THEN CAST(value AS DOUBLE) END) FILTER (q.slot = 2), 6), -1) AS user_mean, count(DISTINCT CASE WHEN v.kind = 'categorical' AND q.slot = 4 THEN value END) AS hosts, coalesce(round(avg(CASE WHEN v.kind = 'numeric' AND q.slot = 8 THEN TRY_CAST(value AS DOUBLE) END), 6), -1) AS took_mean
FROM q JOIN v ON v.template = q.template AND v.slot = q.slot GROUP BY q.session_id""")
def _(s, d):
    from ..operators import identity

    params = _params(s, d)
    kept = params.join(parsing.typed_slots(_training(params)).select("template", "slot", "kind"), ["template", "slot"])
    wide = identity.slot_features(kept.withColumn("slot", F.col("slot").cast("string")), ["2", "4", "8"])
    return wide.select("session_id", F.coalesce(F.round("2_mean", 6), F.lit(-1.0)).alias("user_mean"), F.col("4_distinct").alias("hosts"), F.coalesce(F.round("8_mean", 6), F.lit(-1.0)).alias("took_mean"))


RAND = MINED + """
, x AS (SELECT o.template AS a, e.event_type || CAST(e.event_id % 2 AS VARCHAR) AS b FROM o JOIN events e ON e.event_id = o.line_no),
cell AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM x GROUP BY a, b)), lefts AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM x GROUP BY a)), rights AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM x GROUP BY b)), pairs AS (SELECT count(*) * (count(*) - 1) / 2 AS s FROM x)
SELECT round((cell.s - lefts.s * rights.s / pairs.s) / ((lefts.s + rights.s) / 2 - lefts.s * rights.s / pairs.s), 6) AS ari FROM cell, lefts, rights, pairs"""


@query("j23_rand_index", RAND)
def _(s, d):
    mined = parsing.mine_templates(_messages(s, d))
    other = _events(s, d).select(F.col("event_id").alias("line_no"), F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("other"))
    return metrics.rand_index(mined.join(other, "line_no"), "template", "other").select(*r6("ari"))


@query("v11_with_templates", check("SELECT block_id, pos, coalesce(template, event) AS text FROM ev LEFT JOIN tmp USING (event)"))
def _(s, d):
    return vocab.with_templates(lifecycle(s, d).events, _templates(s, d)).select("block_id", *longs("pos"), "text")


WEIGHTS = r""", tw AS (SELECT event, regexp_extract_all(lower(coalesce(template, '')), '[a-z]+') AS ws FROM voc LEFT JOIN tmp USING (event)),
tt AS (SELECT event, unnest(ws) AS term FROM tw UNION ALL SELECT event, ws[i] || ' ' || ws[i + 1] FROM (SELECT event, ws, unnest(range(1, len(ws))) AS i FROM tw)),
tf AS (SELECT event, term, count(*) AS tf FROM tt GROUP BY ALL), dt AS (SELECT term, count(*) AS df FROM tf GROUP BY term), wr AS (SELECT event, term, tf * (ln((1.0 + (SELECT count(*) FROM voc)) / (1 + df)) + 1) AS raw FROM tf JOIN dt USING (term)),
wt AS (SELECT event, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY event)) AS w FROM wr) """
DIMS = 4


@query("v12_template_vectors", check(WEIGHTS + f"""
SELECT a.event, CAST(count(w.term) AS BIGINT) AS n_terms, least({DIMS}, (SELECT count(*) FROM dt) - 1, (SELECT count(*) FROM voc) - 1) AS dims, CASE WHEN count(w.term) > 0 THEN 1.0 ELSE 0.0 END AS length, 0.1 AS largest FROM voc a LEFT JOIN wt w USING (event) GROUP BY a.event"""))
def _(s, d):
    """Vectors by what must hold of them: places, the length beside the longest one, the largest entry of all."""
    life, templates = lifecycle(s, d), _templates(s, d)
    own = semantics.template_vectors(life.vocab, templates, DIMS).withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))
    most = own.agg(F.max("norm").alias("most"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("largest"))  # one row
    terms = semantics.term_weights(life.vocab, templates).groupBy("event").agg(F.count("*").alias("n_terms"))
    every = own.crossJoin(F.broadcast(most)).join(terms, "event", "left")
    return every.select("event", F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"), F.size("vector").cast("long").alias("dims"), F.round(F.col("norm") / F.col("most"), 6).alias("length"), *r6("largest"))


@query("v13_template_similarity", check(WEIGHTS + """
SELECT event, other, rank, round(cosine, 6) AS cosine FROM (SELECT event, other, cosine, row_number() OVER (PARTITION BY event ORDER BY round(cosine, 9) DESC, other) AS rank FROM (SELECT a.event, b.event AS other, sum(a.w * b.w) AS cosine FROM wt a JOIN wt b ON a.term = b.term AND a.event <> b.event GROUP BY ALL)) WHERE rank <= 3"""))
def _(s, d):
    weights = semantics.term_weights(lifecycle(s, d).vocab, _templates(s, d))
    return semantics.most_similar(weights, 3).select("event", "other", *longs("rank"), *r6("cosine"))


# --- cases: the most surprising window of each test block, with its evidence ----------------------------------------
CASES = f""", cs AS (SELECT w.block_id AS case_id, w.pos, w.predicted, w.target AS actual, w.p_true AS confidence, w.surprisal AS anomaly_score, b.band, b.y, b.score, w.predicted = w.target AS correct,
  (SELECT string_agg(event, '|' ORDER BY e.pos) FROM ev e WHERE e.block_id = w.block_id AND e.pos < w.pos) AS seq, coalesce(p.template, '') AS pt, coalesce(a.template, '') AS ix
FROM {TOPW} w JOIN bnd b USING (block_id) LEFT JOIN tmp p ON p.event = w.predicted LEFT JOIN tmp a ON a.event = w.target WHERE w.rank = 1) """


def _cases(s, d) -> DataFrame:
    top = ranking.most_surprising(lifecycle(s, d).signals.where("split = 'te'"))
    own = top.join(_banded(s, d).select("block_id", "band", "score"), "block_id").join(lifecycle(s, d).sequences, ["block_id", "pos"])
    cases = own.select(F.col("block_id").alias("case_id"), "pos", "sequence", "predicted", F.col("target").alias("actual"), F.col("p_true").alias("confidence"), F.col("surprisal").alias("anomaly_score"), "band", "y", "score")
    return evidence.with_involved(cases, _templates(s, d))


INVOLVED = ", iv AS (SELECT case_id, string_agg(template, ' ' ORDER BY ix) AS blob FROM (SELECT c.case_id, x.event, min(x.ix) AS ix, any_value(t.template) AS template FROM cs c, (SELECT case_id, unnest(range(len(string_split(seq || '|' || predicted || '|' || actual, '|')))) AS ix, unnest(string_split(seq || '|' || predicted || '|' || actual, '|')) AS event FROM cs) x LEFT JOIN tmp t ON t.event = x.event WHERE x.case_id = c.case_id GROUP BY c.case_id, x.event) GROUP BY case_id) "


@query("l01_involved", check(CASES + INVOLVED + "SELECT case_id, lower(blob) AS blob FROM iv"))
def _(s, d):
    return _cases(s, d).select("case_id", "blob")


def _facts(s, d) -> DataFrame:
    life = lifecycle(s, d)
    freq = vocab.normal_frequencies(life.events, life.blocks)
    total = freq.agg(F.max("total_events").alias("total_events"))
    other = ranking.most_surprising(life.signals.where("split = 'te'"), 3).where("rank > 1").join(_templates(s, d).withColumnRenamed("event", "target"), "target", "left")
    rows = other.groupBy(F.col("block_id").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("target").alias("event"), F.coalesce("template", F.lit("template unavailable")).alias("text"), "surprisal"))).alias("top_windows"))
    out = _cases(s, d).join(_percentiles(s, d).select(F.col("block_id").alias("case_id"), "percentile"), "case_id").join(rows, "case_id", "left")
    for side in ("actual", "predicted"):
        name = "actual_freq" if side == "actual" else "pred_freq"
        out = out.join(freq.select(F.col("event").alias(side), F.col("freq").alias(name)), side, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.crossJoin(F.broadcast(total))


# texts of the whole sequence
SEQT = """, sx AS (SELECT case_id, unnest(range(len(string_split(seq, '|')))) AS ix, unnest(string_split(seq, '|')) AS event, len(string_split(seq, '|')) AS n FROM cs), sy AS (SELECT sx.*, coalesce(t.template, '') AS t FROM sx LEFT JOIN tmp t USING (event)),
ob AS (SELECT case_id, CASE WHEN max(t) <> '' THEN 'The sequence is ' || CASE WHEN max(n) <= 5 THEN '' ELSE max(n) || ' events ending in ' END || string_agg(event || ' (' || CASE WHEN t = '' THEN 'template unavailable' ELSE t END || ')', ' -> ' ORDER BY ix) FILTER (ix >= n - 5) || '.'
  ELSE 'The sequence is ' || max(n) || ' events: ' || string_agg(event, ' -> ' ORDER BY ix) || '. No log templates were supplied for these EventIds.' END AS observed FROM sy GROUP BY case_id) """


FACTS = CASES + f""", fq AS (SELECT event, count(*) AS freq FROM ev JOIN spl USING (block_id) WHERE split = 'tr' AND spl.y = 0 GROUP BY event), s AS (SELECT * FROM sd),
pc AS (SELECT block_id AS case_id, {PCT} AS percentile FROM sd s WHERE split = 'te'), tw AS (SELECT block_id AS case_id, string_agg(target || ':' || CAST(rank AS VARCHAR), '|' ORDER BY rank) AS tops FROM {TOPW} WHERE rank IN (2, 3) AND split = 'te' GROUP BY block_id) """
# some evidence is missing, so that lines are left out
FACTS_TEXT = FACTS + f"""{SEQT}, sl AS (SELECT case_id, max(n) AS n, string_agg(format('  {{:2d}}. ', ix + 1) || event || ' -> ' || CASE WHEN t = '' THEN 'template unavailable' ELSE t END, chr(10) ORDER BY ix) AS listed FROM sy GROUP BY case_id),
tl AS (SELECT block_id AS case_id, string_agg(format('Surprising transition #{{}} in this block : actual {{}} -> {{}} (surprise {{:.2f}})', rank, target, coalesce(template, 'template unavailable'), round(surprisal, 9)), chr(10) ORDER BY rank) AS listed FROM {TOPW} x LEFT JOIN tmp ON tmp.event = x.target WHERE rank IN (2, 3) AND split = 'te' GROUP BY block_id)
SELECT case_id, concat_ws(chr(10), 'BEGIN_FACTS', format('Observed sequence ({{}} events, in order):', sl.n), sl.listed, '', 'Expected next event : ' || predicted || ' -> ' || CASE WHEN pt = '' THEN 'n/a' ELSE pt END, 'Actual next event   : ' || actual || ' -> ' || CASE WHEN ix = '' THEN 'n/a' ELSE ix END,
  format('Anomaly score (0-1, higher = more surprising) : {{:.2f}}', round(anomaly_score, 9)), format('Confidence score (0-1, model''s prob of the actual event) : {{:.2f}}', round(confidence, 9)),
  CASE WHEN cs.y = 1 THEN format('Block surprise percentile among NORMAL validation blocks : {{:.1f}} (100 = more surprising than every normal block)', round(percentile, 9)) END,
  'Actual event ' || actual || ' in NORMAL training data : ' || CASE WHEN coalesce(a.freq, 0) = 0 THEN 'NEVER seen' ELSE format('seen {{:,}} times', a.freq) END || format(' among {{:,}} events', (SELECT CAST(sum(freq) AS BIGINT) FROM fq)), CASE WHEN correct THEN format('Expected event {{}} in NORMAL training data : seen {{:,}} times', predicted, coalesce(p.freq, 0)) END,
  tl.listed, CASE WHEN band = 'UNCERTAIN' THEN 'Routing reason : GRU detector was not confident (UNCERTAIN band).' ELSE 'Routing reason : band ' || band END, 'END_FACTS', '', 'Give the FINAL classification (NORMAL or SUSPICIOUS) for this case using ONLY the facts above.') AS facts
FROM cs JOIN sl USING (case_id) JOIN pc USING (case_id) LEFT JOIN tl USING (case_id) LEFT JOIN fq a ON a.event = cs.actual LEFT JOIN fq p ON p.event = cs.predicted"""


@query("l02_evidence", check(FACTS + "SELECT case_id, round(percentile, 6) AS percentile, coalesce(a.freq, 0) AS actual_freq, coalesce(p.freq, 0) AS pred_freq, (SELECT CAST(sum(freq) AS BIGINT) FROM fq) AS total_events, tops FROM cs JOIN pc USING (case_id) JOIN tw USING (case_id) LEFT JOIN fq a ON a.event = cs.actual LEFT JOIN fq p ON p.event = cs.predicted"))
def _(s, d):
    tops = F.array_join(F.transform("top_windows", lambda w: F.concat(w["event"], F.lit(":"), w["rank"].cast("string"))), "|")
    return _facts(s, d).select("case_id", *r6("percentile"), "actual_freq", "pred_freq", "total_events", tops.alias("tops"))


@query("l03_keyword_rule", check(CASES + "SELECT case_id, regexp_matches(lower(ix), 'exception|error|failed|failure|timeout|denied|interrupted|abort') AS keyword FROM cs"))
def _(s, d):
    return _cases(s, d).select("case_id", evidence.keyword_rule(F.col("actual_text")).alias("keyword"))


NO = fixed_texts.NO_ROOT_CAUSE


@query("l04_root_cause", check(CASES + f"SELECT case_id, CASE WHEN actual = 'error' THEN 'The observed event template contains \"error\". The sequence does not provide enough evidence to determine a deeper root cause.' ELSE '{NO}' END AS text FROM cs"))
def _(s, d):
    return _cases(s, d).select("case_id", evidence.root_cause(F.col("actual_text")).alias("text"))


def _q(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN '' ELSE ' (\"' || {text} || '\")' END"


TAIL = "CASE WHEN pt <> '' AND ix <> '' THEN '{0}' ELSE ' " + NO + "' END"
DEV = f"""CASE WHEN correct THEN 'No workflow deviation was detected. The observed next event ' || actual || ' matches the model''s top prediction, so the event order did not change. This case was flagged by the detector''s low certainty, not by any change in the sequence of events' || CASE WHEN ix = '' THEN '.' ELSE '. Recorded operation: "' || ix || '".' END
 ELSE 'The model expected ' || predicted || {_q('pt')} || ', but the sequence continued with ' || actual || {_q('ix')} || '. In workflow terms this is the ' || predicted || ' -> ' || actual || ' transition.' || {TAIL.format(' The templates show what each step records; they do not by themselves state why the order changed.')} END"""
INT = f"""CASE WHEN correct THEN 'The observed event ' || actual || {_q('ix')} || ' is the model''s own top prediction, so the logged step matches expectation. This case was flagged because the model''s certainty was low, even though the predicted and actual events are the same.'
 ELSE 'The expected step was ' || predicted || {_q('pt')} || ', but the sequence recorded ' || actual || {_q('ix')} || ' instead — a deviation at the ' || predicted || ' -> ' || actual || ' transition.' || {TAIL.format('')} END"""
CONF = """CASE band WHEN 'ANOMALY' THEN 'The model had very low confidence in this prediction (' || pct || '), so the case was automatically flagged as a likely anomaly for review.' WHEN 'NORMAL' THEN 'The model was confident in this prediction (' || pct || '), so the case looks like normal activity.'
 ELSE 'The model is uncertain about this prediction (' || pct || ') and therefore routed this case for additional review.' END"""
STEP1 = "'Review the raw HDFS log lines matching the observed event ' || actual || CASE WHEN ix = '' THEN '.' ELSE ': \"' || ix || '\".' END"
STEP2 = "CASE WHEN correct THEN 'Confirm why the anomaly score is elevated even though the predicted and actual events both equal ' || actual || '.' ELSE 'Compare against the expected event ' || predicted || CASE WHEN pt = '' THEN '.' ELSE ': \"' || pt || '\".' END || ' Confirm whether the ' || predicted || ' -> ' || actual || ' transition is valid for this block.' END"
STEP3 = "'Verify whether this exact event sequence has occurred in known-normal traffic for the same BlockId.'"


@query("l05_deviation", check(CASES + f"SELECT case_id, {DEV} AS text FROM cs"))
def _(s, d):
    return _cases(s, d).select("case_id", evidence.deviation().alias("text"))


@query("l06_confidence_text", check(CASES + f"SELECT case_id, {CONF} AS text FROM (SELECT *, format('{{:.1f}}%', confidence * 100) AS pct FROM cs)"))
def _(s, d):
    return _cases(s, d).select("case_id", evidence.confidence_text(F.col("confidence"), F.col("band")).alias("text"))


@query("l07_steps", check(CASES + f"SELECT case_id, {STEP1} || '|' || {STEP2} || '|' || {STEP3} AS steps FROM cs"))
def _(s, d):
    return _cases(s, d).select("case_id", F.array_join(evidence.steps(), "|").alias("steps"))


@query("l08_observed_pattern", check(CASES + SEQT + "SELECT case_id, observed AS text FROM ob"))
def _(s, d):
    return _cases(s, d).select("case_id", evidence.observed_pattern().alias("text"))


@query("l09_interpretation", check(CASES + f"SELECT case_id, {INT} AS text FROM cs"))
def _(s, d):
    return _cases(s, d).select("case_id", evidence.interpretation().alias("text"))


REPORT = f""" SELECT case_id, 'Summary
  Observed Sequence Pattern: ' || observed || '

Prediction
  Expected Event    : ' || predicted || ' — ' || CASE WHEN pt = '' THEN 'template unavailable' ELSE pt END || '
  Observed Event    : ' || actual || ' — ' || CASE WHEN ix = '' THEN 'template unavailable' ELSE ix END || '
  Prediction Correct: ' || CASE WHEN correct THEN 'True' ELSE 'False' END || '

Deviation Analysis
  ' || {DEV} || '

Confidence
  Confidence Score  : ' || pct || '
  Anomaly Score     : ' || format('{{:.1f}}%', anomaly_score * 100) || '
  Classification    : ' || band || '
  Interpretation    : ' || {CONF} || '

Evidence-Based Interpretation
  ' || {INT} || '

Root Cause Assessment
  ' || CASE WHEN actual = 'error' THEN 'The observed event template contains "error". The sequence does not provide enough evidence to determine a deeper root cause.' ELSE '{NO}' END || '

Recommended Investigation
  * ' || {STEP1} || '
  * ' || {STEP2} || '
  * ' || {STEP3} AS report FROM (SELECT cs.*, ob.observed, format('{{:.1f}}%', confidence * 100) AS pct FROM cs JOIN ob USING (case_id))"""


@query("l10_report", check(CASES + SEQT + REPORT))
def _(s, d):
    return _cases(s, d).select("case_id", evidence.report().alias("report"))


FOCUS = OCCLUDED + """, fr AS (SELECT c.case_id, o.event, o.w, row_number() OVER (PARTITION BY c.case_id ORDER BY round(o.w, 12) DESC, o.event) AS r FROM ow o JOIN cs c ON c.case_id = o.block_id AND c.pos = o.pos),
fo AS (SELECT case_id, string_agg('  ' || rpad(event, 9, ' ') || format('  {:.4f}', w), chr(10) ORDER BY r) AS focus FROM fr WHERE r <= 5 GROUP BY case_id) """
ATTENTION = REPORT.replace("Root Cause Assessment", "Model Attention Focus\n  (input events the model weighted most when predicting the next event)\n' || focus || '\n\nRoot Cause Assessment").replace("JOIN ob USING (case_id))", "JOIN ob USING (case_id)) JOIN fo USING (case_id)")


@query("l10_attention_report", check(CASES + SEQT + FOCUS + ATTENTION))
def _(s, d):
    """The report with its attention section: events by how much the model's log p depends on them."""
    cases = _cases(s, d)
    each = occluded(s, d).join(cases.select(F.col("case_id").alias("block_id"), "pos"), ["block_id", "pos"])
    top = model.attribution(each.select(F.col("block_id").alias("window_id"), "event", "weight"), 5)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "event", "weight"))), lambda x: F.struct(x["event"].alias("event"), x["weight"].alias("weight")))
    focus = top.groupBy(F.col("window_id").alias("case_id")).agg(listed.alias("attention"))
    return cases.join(focus, "case_id").select("case_id", evidence.report(attention=F.col("attention")).alias("report"))


@query("l11_facts", check(FACTS_TEXT))
def _(s, d):
    some = _facts(s, d).withColumns({"percentile": F.when(F.col("y") == 1, F.round("percentile", 9)), "pred_freq": F.when(F.col("correct"), F.col("pred_freq")), "anomaly_score": F.round("anomaly_score", 9), "confidence": F.round("confidence", 9)})
    some = some.withColumn("top_windows", F.transform("top_windows", lambda w: w.withField("surprisal", F.round(w["surprisal"], 9))))
    reason = F.when(F.col("band") == "UNCERTAIN", "").otherwise(F.concat(F.lit("band "), F.col("band")))
    return some.select("case_id", evidence.facts(reason).alias("facts"))


# --- verdict texts, made from the conversations ---------------------------------------------------------------------
VERDICT = """CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN 'CLASSIFICATION: NORMAL' || chr(10) || 'CONFIDENCE: ' || (conv_id % 130) || chr(10) || 'EXPLANATION: ' || role WHEN 2 THEN 'classification : Suspicious' || chr(10) || 'Confidence: 80' WHEN 3 THEN '{"classification": "suspicious", "confidence": ' || (conv_id % 130) || ', "evidence": "e", "explanation": "x"}'
 ELSE 'CLASSIFICATION: NORMAL or SUSPICIOUS' END"""
VSQL = f"""WITH v AS (SELECT conv_id, turn, {VERDICT} AS t FROM conversations), f AS (SELECT *, upper(trim(regexp_extract(t, '(?i)CLASSIFICATION\\s*:\\s*([^\\n]+)', 1))) AS raw, upper(t) AS up, regexp_extract(t, '(?i)CONFIDENCE\\s*:\\s*([0-9]{{1,3}})', 1) AS c FROM v),
p AS (SELECT *, CASE WHEN (contains(raw, 'SUSPICIOUS') OR contains(raw, 'ANOMAL')) AND NOT contains(raw, 'NORMAL') THEN 'SUSPICIOUS' WHEN contains(raw, 'NORMAL') AND NOT (contains(raw, 'SUSPICIOUS') OR contains(raw, 'ANOMAL')) THEN 'NORMAL'
  WHEN contains(up, 'SUSPICIOUS') AND NOT contains(up, 'NORMAL') THEN 'SUSPICIOUS' WHEN contains(up, 'NORMAL') AND NOT contains(up, 'SUSPICIOUS') THEN 'NORMAL' END AS cls, CASE WHEN c <> '' THEN least(CAST(c AS DOUBLE) / 100, 1.0) END AS conf FROM f),
j AS (SELECT *, turn % 5 = 3 AS json_ok, CASE WHEN turn % 5 = 3 THEN 'SUSPICIOUS' ELSE cls END AS jcls, CASE WHEN turn % 5 = 3 THEN least((conv_id % 130) / 100.0, 1.0) ELSE conf END AS jconf FROM p) """


def _verdicts(s, d) -> DataFrame:
    text = F.expr(VERDICT.replace("(conv_id % 130)", "CAST(conv_id % 130 AS STRING)"))
    return read(s, d, "conversations").select("conv_id", "turn", text.alias("t"))


@query("l12_parse_lines", VSQL + "SELECT conv_id, turn, coalesce(cls, 'none') AS cls, coalesce(round(conf, 6), -1) AS conf FROM p")
def _(s, d):
    return _verdicts(s, d).select("conv_id", "turn", F.coalesce(evidence.parse_label(F.col("t")), F.lit("none")).alias("cls"), F.coalesce(F.round(evidence.parse_confidence(F.col("t")), 6), F.lit(-1.0)).alias("conf"))


def _parsed(s, d) -> DataFrame:
    return _verdicts(s, d).select("conv_id", "turn", "t", evidence.parse_verdict(F.col("t")).alias("v")).select("conv_id", "turn", "t", "v.*")


PARTS = ", ".join(f"CASE WHEN json_ok THEN '{v}' ELSE trim(regexp_extract(t, '(?i){n}\\s*:\\s*([^\\n]+)', 1), ' ') END AS {n}" for n, v in (("evidence", "e"), ("explanation", "x")))


@query("l13_parse_json", VSQL + f"SELECT conv_id, turn, coalesce(jcls, 'none') AS cls, coalesce(round(jconf, 6), -1) AS conf, {PARTS}, json_ok FROM j")
def _(s, d):
    return _parsed(s, d).select("conv_id", "turn", F.coalesce("cls", F.lit("none")).alias("cls"), F.coalesce(F.round("conf", 6), F.lit(-1.0)).alias("conf"), "evidence", "explanation", "json_ok")


@query("l14_majority", VSQL + "SELECT conv_id AS case_id, count(jcls) AS n_votes, count(*) FILTER (jcls = 'SUSPICIOUS') AS n_suspicious, CASE WHEN count(*) FILTER (jcls = 'SUSPICIOUS') * 2 > count(jcls) THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS cls, count(jcls) > 0 AS parse_ok FROM j GROUP BY conv_id")
def _(s, d):
    return evidence.majority(_parsed(s, d).withColumnRenamed("conv_id", "case_id"))


NARR = """text || ' The confidence score is ' || (doc_id % 10) || '.5. This likely indicates a problem! Event logged successfully. Disk failure detected. ' || CASE WHEN doc_id % 3 = 0 THEN 'Malware was found. ' WHEN doc_id % 3 = 1 THEN 'A cyber attack happened. ' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'The order deviates here.' ELSE 'It records one step.' END"""
BLOB = "CASE WHEN doc_id % 5 = 0 THEN 'disk failure on malware scan' WHEN doc_id % 5 = 1 THEN 'cyber word' ELSE 'receiving block' END"


def _narratives(s, d) -> DataFrame:
    narrative = F.expr(NARR.replace("(doc_id % 10)", "CAST(doc_id % 10 AS STRING)"))
    return read(s, d, "documents").select("doc_id", narrative.alias("t"), F.expr(BLOB).alias("blob"))


def _any(values: list[str], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{v.replace(chr(39), chr(39) * 2)}')" for v in values) + ")"


def _words(values: list[str], text: str, blob: str) -> str:
    return "(" + " OR ".join(f"(regexp_matches({text}, '\\b{v}\\b') AND NOT regexp_matches({blob}, '\\b{v}\\b'))" for v in values) + ")"


def _held(values: list[str], text: str, blob: str) -> str:
    return "(" + " OR ".join(f"(contains({text}, '{v}') AND NOT contains({blob}, '{v}'))" for v in values) + ")"


def _invented(text: str, blob: str) -> str:
    return "(" + " OR ".join(f"(contains({text}, '{v}') AND NOT regexp_matches({blob}, '\\b{v.split()[0]}\\b'))" for v in fixed_texts.SECURITY_TERMS) + ")"


SENT = f"WITH n AS (SELECT doc_id, {NARR} AS t, {BLOB} AS blob FROM documents), x AS (SELECT doc_id, blob, string_split(regexp_replace(trim(t, chr(32) || chr(9) || chr(10) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM n), y AS (SELECT doc_id, blob, unnest(range(len(p))) AS i, unnest(p) AS s FROM x), z AS (SELECT *, lower(s) AS l FROM y) "
KEEP = f"NOT {_any(fixed_texts.VERDICT_PHRASES, 'l')} AND NOT {_any(fixed_texts.SPECULATION_PHRASES, 'l')} AND NOT {_words(fixed_texts.CAUSE_TERMS, 'l', 'z.blob')} AND NOT {_held(fixed_texts.CAUSE_PHRASES, 'l', 'z.blob')} AND NOT {_invented('l', 'z.blob')}"


@query("l15_scrub", SENT + f"SELECT n.doc_id, sha256(coalesce(string_agg(s, ' ' ORDER BY i) FILTER ({KEEP}), '')) AS kept_sha FROM n LEFT JOIN z ON z.doc_id = n.doc_id GROUP BY n.doc_id")
def _(s, d):
    return _narratives(s, d).select("doc_id", F.sha2(evidence.scrub_narrative(F.col("t"), F.col("blob")), 256).alias("kept_sha"))


@query("l16_contradictions", SENT + f"SELECT n.doc_id, CASE WHEN n.doc_id % 4 < 2 THEN sha256(coalesce(string_agg(s, ' ' ORDER BY i) FILTER (NOT {_any(fixed_texts.CONTRADICTION_PHRASES, 'l')}), '')) ELSE sha256(any_value(n.t)) END AS kept_sha FROM n LEFT JOIN z ON z.doc_id = n.doc_id GROUP BY n.doc_id")
def _(s, d):
    return _narratives(s, d).select("doc_id", F.sha2(evidence.scrub_contradictions(F.col("t"), F.col("doc_id") % 4 < 2), 256).alias("kept_sha"))


@query("l17_invented", SENT + f"SELECT doc_id, {_invented('lower(t)', 'blob')} AS invented FROM n")
def _(s, d):
    return _narratives(s, d).select("doc_id", evidence.invented(F.col("t"), F.col("blob")).alias("invented"))


@query("l18_insufficient", f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN '{fixed_texts.INSUFFICIENT}' ELSE source END AS text FROM documents")
def _(s, d):
    clean = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source"))
    raw = F.when(F.col("doc_id") % 11 == 0, "There is Insufficient Evidence").otherwise(F.col("source"))
    return read(s, d, "documents").select("doc_id", evidence.with_insufficient(clean, raw).alias("text"))


PRINT = "sha256(seq || chr(1) || predicted || chr(1) || actual || chr(1) || band)"


@query("l19_fingerprints", check(CASES + f"SELECT {PRINT} AS fingerprint, min(case_id) AS case_id, count(*) AS n_cases FROM cs GROUP BY 1"))
def _(s, d):
    own = _cases(s, d).withColumn("fingerprint", evidence.fingerprint(F.array_join("sequence", "|"), F.col("predicted"), F.col("actual"), F.col("band")))
    return evidence.collapse(own)


@query("l20_call_statistics", "SELECT count(*) AS n_calls, count(*) FILTER (turn % 3 = 0) AS n_cached, count(*) FILTER (conv_id % 9 = 0) AS n_failed, round(avg(CASE WHEN turn % 3 <> 0 THEN length(text) / 100.0 END), 6) AS mean_latency FROM conversations")
def _(s, d):
    calls = read(s, d, "conversations").select((F.col("turn") % 3 == 0).alias("cached"), (F.col("conv_id") % 9 == 0).alias("failed"), (F.char_length("text") / 100.0).alias("latency"))
    return evidence.call_statistics(calls).select("n_calls", "n_cached", "n_failed", *r6("mean_latency"))


@query("l21_section", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN sha256(trim(text, chr(32) || chr(10) || chr(9) || chr(13))) ELSE sha256('') END AS section_sha FROM conversations")
def _(s, d):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("PATTERN: x\nEvidence_Based_Interpretation :\n "), F.col("text"))).otherwise(F.col("text"))
    return read(s, d, "conversations").select("conv_id", "turn", F.sha2(evidence.section(text), 256).alias("section_sha"))


@query("h01_block_text", check("SELECT block_id, string_agg(coalesce(template, event), ' | ' ORDER BY ix) AS text FROM (SELECT block_id, event, min(pos) AS ix FROM ev GROUP BY block_id, event) LEFT JOIN tmp USING (event) GROUP BY block_id"))
def _(s, d):
    own = lifecycle(s, d).events.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event"))), lambda x: x["event"]).alias("events"))
    return evidence.block_text(own, _templates(s, d))


# --- metrics of verdicts: a verdict for each conversation turn, its truth from the conversation's number -----------
RUNG = VSQL + ", r AS (SELECT conv_id, turn, 'rung' || (turn % 2) AS rung, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS truth, coalesce(jcls, 'NORMAL') AS cls, jcls IS NOT NULL AS parse_ok, jconf AS conf, CAST(length(t) AS DOUBLE) / 100 AS latency, contains(t, 'or') AS invented, length(t) % 2 = 0 AS scrubbed, conv_id % 5 = 0 AS insufficient FROM j) "


def _rungs(s, d) -> DataFrame:
    return _parsed(s, d).select(
        "conv_id", "turn", F.concat(F.lit("rung"), (F.col("turn") % 2).cast("string")).alias("rung"), (F.col("conv_id") % 3 == 0).cast("int").alias("truth"), F.coalesce("cls", F.lit("NORMAL")).alias("cls"), F.col("cls").isNotNull().alias("parse_ok"), "conf",
        (F.char_length("t") / 100.0).alias("latency"), F.contains("t", F.lit("or")).alias("invented"), (F.char_length("t") % 2 == 0).alias("scrubbed"), (F.col("conv_id") % 5 == 0).alias("insufficient"),
    )


@query("j15_verdict_metrics", RUNG + """, c AS (SELECT rung, count(*) AS n, count(*) FILTER (cls = 'SUSPICIOUS' AND truth = 1) AS tp, count(*) FILTER (cls = 'SUSPICIOUS' AND truth = 0) AS fp, count(*) FILTER (cls = 'NORMAL' AND truth = 0) AS tn, count(*) FILTER (cls = 'NORMAL' AND truth = 1) AS fn, avg(parse_ok::INT) AS pr, avg(latency) AS ml FROM r GROUP BY rung)
SELECT rung, n, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, round(pr, 6) AS parse_rate, round(ml, 6) AS mean_latency FROM c""")
def _(s, d):
    return metrics.verdict_metrics(_rungs(s, d)).select("rung", "n", *r6("accuracy", "recall", "precision", "fpr", "balanced_accuracy", "parse_rate", "mean_latency"))


@query("j16_baselines", check(FACTS + """, b AS (SELECT c.y, regexp_matches(lower(c.ix), 'exception|error|failed|failure|timeout|denied|interrupted|abort') AS kw, coalesce(a.freq, 0) = 0 OR percentile >= 99 AS odd FROM cs c JOIN pc USING (case_id) LEFT JOIN fq a ON a.event = c.actual),
r AS (SELECT 'always_normal' AS rule, y, 0 AS pred FROM b UNION ALL SELECT 'keyword', y, kw::INT FROM b UNION ALL SELECT 'extended', y, (kw OR odd)::INT FROM b)
SELECT rule, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM r GROUP BY rule"""))
def _(s, d):
    kw = evidence.keyword_rule(F.col("actual_text"))
    rules = {"always_normal": F.lit(False), "keyword": kw, "extended": kw | (F.col("actual_freq") == 0) | (F.col("percentile") >= 99)}
    long = _facts(s, d).select("y", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), c.cast("int").alias("pred")) for n, c in rules.items()))).alias("r")).select("y", "r.*")
    return metrics.confusion(long, ["rule"])


@query("j17_overrides", RUNG + "SELECT rung, count(*) FILTER (cls = 'NORMAL') AS kept, count(*) FILTER (cls = 'SUSPICIOUS') AS changed, count(*) FILTER (cls = 'SUSPICIOUS' AND truth = 1) AS correct FROM r GROUP BY rung")
def _(s, d):
    sus = F.col("cls") == "SUSPICIOUS"
    return _rungs(s, d).groupBy("rung").agg(F.count_if(~sus).alias("kept"), F.count_if(sus).alias("changed"), F.count_if(sus & (F.col("truth") == 1)).alias("correct"))


@query("j18_consistency", RUNG + ", a AS (SELECT conv_id, min_by(cls, turn) AS c0, max_by(cls, turn) AS c1 FROM r WHERE turn < 2 GROUP BY conv_id HAVING count(*) = 2) SELECT count(*) AS n, count(*) FILTER (c0 = c1) AS agree, round(count(*) FILTER (c0 = c1) / count(*), 6) AS rate FROM a")
def _(s, d):
    rows = _rungs(s, d)
    first, second = (rows.where(F.col("turn") == t).select("conv_id", F.col("cls").alias(f"c{t}")) for t in (0, 1))
    same = F.count_if(F.col("c0") == F.col("c1"))
    return first.join(second, "conv_id").agg(F.count("*").alias("n"), same.alias("agree"), F.round(same / F.count("*"), 6).alias("rate"))


@query("j25_verdict_quality", RUNG + """SELECT rung, count(*) AS n, count(*) FILTER ((cls = 'SUSPICIOUS') = (truth = 1) AND NOT invented) AS clean_correct, round(avg(scrubbed::INT), 6) AS scrubbed_share, round(avg(invented::INT), 6) AS invented_share, count(*) FILTER (NOT parse_ok) AS parse_failures, round(avg(insufficient::INT), 6) AS insufficient_share, round(avg((conf IS NULL OR conf IN (0, 1))::INT), 6) AS degenerate_share FROM r GROUP BY rung""")
def _(s, d):
    share = lambda c: F.avg(c.cast("int"))
    right = (F.col("cls") == "SUSPICIOUS") == (F.col("truth") == 1)
    return _rungs(s, d).groupBy("rung").agg(
        F.count("*").alias("n"), F.count_if(right & ~F.col("invented")).alias("clean_correct"), F.round(share(F.col("scrubbed")), 6).alias("scrubbed_share"), F.round(share(F.col("invented")), 6).alias("invented_share"), F.count_if(~F.col("parse_ok")).alias("parse_failures"),
        F.round(share(F.col("insufficient")), 6).alias("insufficient_share"), F.round(share(F.col("conf").isNull() | F.col("conf").isin(0.0, 1.0)), 6).alias("degenerate_share"),
    )
