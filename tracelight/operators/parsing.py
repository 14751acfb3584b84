"""Raw log lines to fields, masked messages, templates and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import ranked
from ..shared import stored

# The line header, identifier and mask patterns of the log formats.
HEADER = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]*)\]\s+(.*)$"
HEADER_FIELDS = ["logrecord", "date", "time", "pid", "level", "component", "addr", "content"]
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
MASKS = [UUID, r"((\d+\.){3}\d+)", r"\b[0-9a-fA-F]{32,}\b", r"(/[\w.\-]+)+/?", r"\b\d+\.\d+\b", r"\b\d+\b"]
WILDCARD = "<*>"
META_FIELDS = 9
BAND_LABELS = {"ANOMALY": "Suspicious", "UNCERTAIN": "Uncertain", "NORMAL": "Normal"}
BAND_TEXTS = {
    "ANOMALY": "high surprise — flagged as SUSPICIOUS for investigation.",
    "UNCERTAIN": "moderate surprise — routed for additional review.",
    "NORMAL": "low surprise — consistent with normal behaviour.",
}


def flat_fields(lines: DataFrame, col: str = "line") -> DataFrame:
    """Label, node and content of lines with more than nine fields; shorter ones are dropped."""
    parts = F.split(F.trim(F.regexp_replace(F.col(col), "\\s+", " ")), " ")
    cut = lines.withColumn("__f", parts).where(F.size("__f") > META_FIELDS)
    return cut.withColumns({"label": F.get("__f", F.lit(0)), "node": F.get("__f", F.lit(3)), "content": F.array_join(F.slice("__f", META_FIELDS + 1, 1_000_000), " ")}).drop("__f")


def header_fields(lines: DataFrame, col: str = "line") -> DataFrame:
    """The eight header fields and whether the line matched; lines that don't match stay, with empty fields."""
    return lines.withColumn("parsed", F.col(col).rlike(HEADER)).withColumns({n: F.regexp_extract(col, HEADER, i) for i, n in enumerate(HEADER_FIELDS, 1)})


def stripped(lines: DataFrame, col: str = "line") -> DataFrame:
    """Line ends removed, blank lines dropped."""
    clean = lines.withColumn(col, F.regexp_replace(col, "[\\r\\n]+$", ""))
    return clean.where(F.trim(F.regexp_replace(col, "\\s+", " ")) != "")


def masked(text: Column) -> Column:
    """Identifiers, addresses, digests, paths, decimals and whole numbers to a wildcard, in this order."""
    for pattern in MASKS:
        text = F.regexp_replace(text, pattern, F.lit(WILDCARD))
    return text


def mine_templates(messages: DataFrame, col: str = "message", depth: int = 2, most: int = 4) -> DataFrame:
    """``messages`` with their template text, in a batch, whatever the order of lines.

    Masked messages are grouped by token count and their first ``depth`` tokens (one with a digit counts as a
    wildcard). A position with more than ``most`` distinct tokens in its group becomes a wildcard. Tokens
    are counted over distinct masked messages, so a frequent message costs no more than a rare one.
    """
    # read twice below, and masks are dear; stored, as Spark would also make the messages anew wherever a filter or pattern names them
    known = stored(messages.withColumn("__masked", F.trim(F.regexp_replace(masked(F.col(col)), "\\s+", " "))), "masked")

    def grouped(rows: DataFrame) -> DataFrame:
        own = rows.withColumn("__tokens", F.split("__masked", " "))
        head = F.transform(F.slice("__tokens", 1, depth), lambda t: F.when(t.rlike("\\d"), WILDCARD).otherwise(t))
        return own.withColumn("__group", F.concat(F.size("__tokens").cast("string"), F.lit(" "), F.array_join(head, " ")))

    kinds = grouped(known.select("__masked").distinct())
    spread = kinds.select("__group", F.posexplode("__tokens").alias("at", "token")).distinct()
    busy = spread.groupBy("__group", "at").agg(F.count("*").alias("n")).where(F.col("n") > most)
    # stored, so that its size is known and the messages are not shuffled to meet it
    wild = stored(busy.groupBy("__group").agg(F.collect_set("at").alias("__wild")), "wild")
    out = grouped(known).join(wild, "__group", "left")
    shown = F.transform("__tokens", lambda t, i: F.when(F.coalesce(F.array_contains("__wild", i), F.lit(False)) | t.rlike("\\d"), WILDCARD).otherwise(t))
    return out.withColumn("template", F.array_join(shown, " ")).drop("__masked", "__tokens", "__group", "__wild")


def template_catalogue(parsed: DataFrame) -> DataFrame:
    """(event, template, n): identifiers E1, E2, ... by descending count, then text."""
    own = parsed.groupBy("template").agg(F.count("*").alias("n"))
    numbered = ranked(own, [F.col("n").desc(), F.col("template")], F.col("n"), "__number", descending=True)
    return numbered.withColumn("event", F.concat(F.lit("E"), F.col("__number").cast("string"))).drop("__number")


def clean_template(text: Column) -> Column:
    """Wildcard marks [*] shown as <...>, trimmed."""
    return F.trim(F.regexp_replace(text, "\\[\\*\\]", "<...>"))


def event_ids(text: Column) -> Column:
    """All E<number> identifiers of a string list."""
    return F.regexp_extract_all(text, F.lit("E\\d+"), F.lit(0))


def session_key(content: Column) -> Column:
    """The bracketed instance id, else the one of a servers URL, else null."""
    found = lambda p: F.nullif(F.regexp_extract(content, p, 1), F.lit(""))
    return F.coalesce(found(f"\\[instance:\\s*({UUID})\\]"), found(f"/servers/({UUID})"))


def alert(label: Column) -> Column:
    """P10: 0 for '-', else 1."""
    return F.when(label == "-", 0).otherwise(1)


def coverage(parsed: DataFrame) -> DataFrame:
    """Lines, parsed, unparsed, with and without session, by source and in total."""
    return parsed.rollup("source").agg(
        F.count("*").alias("n_lines"), F.count_if("parsed").alias("n_parsed"), F.count_if(~F.col("parsed")).alias("n_unparsed"), F.count_if(F.col("parsed") & F.col("session_id").isNotNull()).alias("n_keyed"), F.count_if(F.col("parsed") & F.col("session_id").isNull()).alias("n_unkeyed"),
    ).withColumn("source", F.coalesce("source", F.lit("TOTAL")))


def parameters(parsed: DataFrame, col: str = "message") -> DataFrame:
    """(…, slot, value) for each wildcard position of a template whose tokens align with the message."""
    pair = F.arrays_zip(F.split(F.trim(F.regexp_replace(col, "\\s+", " ")), " ").alias("value"), F.split("template", " ").alias("mark"))
    spread = parsed.where(F.size(F.split(F.trim(F.regexp_replace(col, "\\s+", " ")), " ")) == F.size(F.split("template", " ")))
    rows = spread.select("*", F.posexplode(pair).alias("slot", "__z"))
    return rows.where(F.contains(F.col("__z.mark"), F.lit(WILDCARD))).withColumn("value", F.col("__z.value")).drop("__z")


def typed_slots(params: DataFrame, session: str = "session_id", share: float = 0.10) -> DataFrame:
    """(template, slot, kind, n_distinct, n_sessions): slots worth keeping, from the parameters of training sessions.

    A slot is an identifier if most of its values hold a UUID or digest, numeric if all are numbers, else
    categorical. Identifiers, constants and slots seen in fewer than ``share`` of the sessions are dropped.
    """
    value = F.col("value")
    params = stored(params.select("template", "slot", "value", session), "parameters")
    values = params.groupBy("template", "slot", "value").agg(F.count("*").alias("n"))
    seen = stored(params.groupBy("template", "slot", session).agg(F.count("*").alias("n")), "slot-sessions")
    total = seen.agg(F.countDistinct(session).alias("all"))
    # patterns are tried on distinct values
    ids = F.sum(F.when(value.rlike(f"{UUID}|[0-9a-fA-F]{{32,}}"), F.col("n")).otherwise(0)) / F.sum(F.when(value.isNotNull(), F.col("n")))
    own = values.groupBy("template", "slot").agg(ids.alias("ids"), F.min(value.rlike("^-?\\d+(\\.\\d+)?$").cast("int")).alias("num"), F.count("value").alias("n_distinct"))
    own = own.join(seen.groupBy("template", "slot").agg(F.count(session).alias("n_sessions")), ["template", "slot"])
    kind = F.when(F.col("ids") > 0.5, "identifier").when(F.col("num") == 1, "numeric").otherwise("categorical")
    kept = own.crossJoin(F.broadcast(total)).withColumn("kind", kind)
    return kept.where((F.col("kind") != "identifier") & (F.col("n_distinct") > 1) & (F.col("n_sessions") >= share * F.col("all"))).select("template", "slot", "kind", "n_distinct", "n_sessions")


def format_pct(x: Column, digits: int = 1) -> Column:
    """A share as a percentage."""
    return F.format_string(f"%.{digits}f%%", x * 100)


def confidence_phrase(x: Column) -> Column:
    """High, moderate or low."""
    return F.when(x >= 0.70, "high").when(x >= 0.40, "moderate").otherwise("low")


def band_label(band: Column) -> Column:
    """The name shown for a band; others as they are."""
    key = F.upper(F.trim(band))
    out = band
    for name, shown in BAND_LABELS.items():
        out = F.when(key == name, shown).otherwise(out)
    return out


def band_text(band: Column) -> Column:
    """What a band means."""
    out = F.lit(None).cast("string")
    for name, text in BAND_TEXTS.items():
        out = F.when(band == name, text).otherwise(out)
    return out
