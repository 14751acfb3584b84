"""Evidence, report texts and verdict processing of single cases, all as column expressions.

A case has case_id, sequence (events in order), predicted, actual, confidence, anomaly_score, band. With its
templates joined it also has involved: array of (event, text), distinct events in first-seen order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_texts as fixed
from .parsing import format_pct

ARROW = " -> "


def with_involved(cases: DataFrame, templates: DataFrame, key: str = "case_id") -> DataFrame:
    """``involved`` and ``blob``, the lower-cased texts of all involved events."""
    ids = F.transform(F.concat("sequence", F.array("predicted", "actual")), lambda e: F.trim(e))
    each = cases.select(key, F.posexplode(F.array_distinct(ids)).alias("at", "event"))
    known = each.join(templates.select("event", "template"), "event", "left").select(key, "at", "event", F.coalesce("template", F.lit("")).alias("text"))
    found = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event", "text"))), lambda x: F.struct(x["event"].alias("event"), x["text"].alias("text"))).alias("involved"))
    out = cases.join(found, key)
    texts = F.filter(F.transform("involved", lambda x: x["text"]), lambda t: t != "")
    return out.withColumns({"blob": F.lower(F.array_join(texts, " ")), "predicted_text": text_of(F.col("predicted")), "actual_text": text_of(F.col("actual")), "correct": F.trim("predicted") == F.trim("actual")})


def text_of(event: Column) -> Column:
    """The template of an event of the case, empty where there is none."""
    return F.coalesce(F.get(F.filter("involved", lambda x: x["event"] == F.trim(event)), F.lit(0))["text"], F.lit(""))


def quoted(text: Column, before: str = ' ("', after: str = '")') -> Column:
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(before), text, F.lit(after)))


def keyword_rule(text: Column) -> Column:
    """Any failure token as a substring."""
    return F.lower(text).rlike("|".join(fixed.KEYWORD_TOKENS))


def root_cause(text: Column) -> Column:
    """Names the first failure token that is a whole word of the actual event's template."""
    out = F.lit(fixed.NO_ROOT_CAUSE)
    for token in reversed(fixed.ROOT_CAUSE_TOKENS):
        out = F.when(F.lower(text).rlike(rf"\b{token}\b"), fixed.ROOT_CAUSE % token).otherwise(out)
    return out


def deviation() -> Column:
    """What differs between the expected and the actual step."""
    p, a, pt, at = F.trim("predicted"), F.trim("actual"), F.col("predicted_text"), F.col("actual_text")
    same = F.concat(F.format_string(fixed.DEVIATION_SAME, a), F.when(at == "", F.lit(".")).otherwise(F.format_string(fixed.RECORDED, at)))
    tail = F.when((pt != "") & (at != ""), F.lit(fixed.DEVIATION_TAIL)).otherwise(F.lit(fixed.NO_ROOT_CAUSE))
    return F.when(F.col("correct"), same).otherwise(F.format_string(fixed.DEVIATION_OTHER, p, quoted(pt), a, quoted(at), p, a, tail))


def confidence_text(confidence: Column, band: Column) -> Column:
    """What the confidence means, by band."""
    pct = format_pct(confidence)
    shown = {b: F.format_string(t, pct) for b, t in fixed.CONFIDENCE_TEXTS.items()}
    return F.when(band == "ANOMALY", shown["ANOMALY"]).when(band == "NORMAL", shown["NORMAL"]).otherwise(shown["OTHER"])


def steps() -> Column:
    """Three things to look at."""
    p, a, pt, at = F.trim("predicted"), F.trim("actual"), F.col("predicted_text"), F.col("actual_text")
    named = lambda t: F.when(t == "", F.lit(".")).otherwise(F.concat(F.lit(': "'), t, F.lit('".')))
    second = F.when(F.col("correct"), F.format_string(fixed.STEP_CORRECT, a)).otherwise(F.format_string(fixed.STEP_WRONG, p, named(pt), p, a))
    return F.array(F.format_string(fixed.STEP_LINES, a, named(at)), second, F.lit(fixed.STEP_TRAFFIC))


def observed_pattern() -> Column:
    """The last five events with their templates."""
    n = F.size("sequence")
    ids = F.transform("sequence", lambda e: F.trim(e))
    any_text = F.exists(ids, lambda e: text_of(e) != "")
    part = lambda e: F.format_string(fixed.PATTERN_EVENT, e, F.coalesce(F.nullif(text_of(e), F.lit("")), F.lit(fixed.NO_TEMPLATE)))
    shown = F.array_join(F.transform(F.slice(ids, F.greatest(n - 4, F.lit(1)), 5), part), ARROW)
    with_texts = F.when(n <= 5, F.format_string(fixed.PATTERN_SHORT, shown)).otherwise(F.format_string(fixed.PATTERN_LONG, n, shown))
    bare = F.format_string(fixed.PATTERN_BARE, n, F.array_join(ids, ARROW))
    return F.when(n == 0, F.lit(fixed.PATTERN_EMPTY)).when(any_text, with_texts).otherwise(bare)


def interpretation() -> Column:
    """The default interpretation, from expected and actual step only."""
    p, a, pt, at = F.trim("predicted"), F.trim("actual"), F.col("predicted_text"), F.col("actual_text")
    tail = F.when((pt != "") & (at != ""), F.lit("")).otherwise(F.lit(" " + fixed.NO_ROOT_CAUSE))
    return F.when(F.col("correct"), F.format_string(fixed.INTERPRETATION_SAME, a, quoted(at))).otherwise(F.format_string(fixed.INTERPRETATION_OTHER, p, quoted(pt), a, quoted(at), p, a, tail))


def report(narrative: Column | None = None, attention: Column | None = None) -> Column:
    """The whole report; ``attention`` is an array of (event, weight), largest first, of which five are shown."""
    text = scrub_contradictions(narrative if narrative is not None else interpretation(), F.col("correct"))
    text = F.coalesce(F.nullif(text, F.lit("")), F.lit(fixed.MATCH_FALLBACK))
    named = lambda t: F.coalesce(F.nullif(F.col(t), F.lit("")), F.lit(fixed.NO_TEMPLATE))
    right = F.when(F.col("correct"), "True").otherwise("False")
    lines = F.array_join(F.transform(steps(), lambda s: F.concat(F.lit("  * "), s)), "\n")
    focus = F.lit("")
    if attention is not None:
        rows = F.transform(F.slice(attention, 1, 5), lambda x: F.concat(F.lit("  "), F.rpad(x["event"], 9, " "), F.format_string("  %.4f", x["weight"])))
        focus = F.format_string(fixed.REPORT_FOCUS, F.array_join(rows, "\n"))
    return F.format_string(
        fixed.REPORT, observed_pattern(), F.trim("predicted"), named("predicted_text"), F.trim("actual"), named("actual_text"), right, deviation(), format_pct(F.col("confidence")), format_pct(F.col("anomaly_score")),
        "band", confidence_text(F.col("confidence"), F.col("band")), text, focus, root_cause(F.col("actual_text")), lines,
    )


def facts(reason: Column | None = None) -> Column:
    """The facts message; uses percentile, actual_freq, pred_freq, total_events and top_windows (rank, event, text, surprisal) of L02.

    A line whose evidence is null is left out. ``reason`` says why the case was routed here.
    """
    shown = lambda text, other: F.coalesce(F.nullif(text, F.lit("")), F.lit(other))
    given = lambda name, *parts: F.when(F.col(name).isNotNull(), F.concat(*parts))
    numbered = F.transform("sequence", lambda e, i: F.concat(F.format_string("  %2d. ", i + 1), e, F.lit(ARROW), shown(text_of(e), fixed.NO_TEMPLATE)))
    seen = F.when(F.col("actual_freq") == 0, F.lit("NEVER seen")).otherwise(F.format_string("seen %,d times", "actual_freq"))
    windows = F.transform("top_windows", lambda w: F.format_string(fixed.FACT_WINDOW, w["rank"], w["event"], w["text"], w["surprisal"]))
    head = F.array(F.lit("BEGIN_FACTS"), F.format_string(fixed.FACT_SEQUENCE, F.size("sequence")))
    body = F.array(
        F.lit(""), F.format_string(fixed.FACT_EXPECTED, "predicted", shown(F.col("predicted_text"), "n/a")), F.format_string(fixed.FACT_ACTUAL, "actual", shown(F.col("actual_text"), "n/a")),
        F.format_string(fixed.FACT_SCORE, "anomaly_score"), F.format_string(fixed.FACT_CONFIDENCE, "confidence"), given("percentile", F.format_string(fixed.FACT_PERCENTILE, "percentile")),
        given("actual_freq", F.format_string(fixed.FACT_ACTUAL_FREQUENCY, F.col("actual"), seen, F.coalesce("total_events", F.lit(0)))), given("pred_freq", F.format_string(fixed.FACT_EXPECTED_FREQUENCY, "predicted", "pred_freq")),
    )
    why = fixed.FACT_REASON if reason is None else shown(reason, fixed.FACT_REASON)
    tail = F.array(F.concat(F.lit("Routing reason : "), F.lit(why) if reason is None else why), F.lit("END_FACTS"), F.lit(""), F.lit(fixed.FACT_QUESTION))
    # joining leaves nulls out
    return F.array_join(F.concat(head, numbered, body, F.coalesce(windows, F.array().cast("array<string>")), tail), "\n")


def field(label: str, text: Column) -> Column:
    """The rest of the line after ``label:``, empty if there is none."""
    return F.trim(F.regexp_extract(text, rf"(?i){label}\s*:\s*([^\n]+)", 1))


def parse_label(text: Column) -> Column:
    """NORMAL or SUSPICIOUS from the label line, else from the whole text; null if neither or both."""
    raw, whole = F.upper(field("CLASSIFICATION", text)), F.upper(text)
    sus, norm = raw.contains("SUSPICIOUS") | raw.contains("ANOMAL"), raw.contains("NORMAL")
    return F.when(sus & ~norm, "SUSPICIOUS").when(norm & ~sus, "NORMAL").when(whole.contains("SUSPICIOUS") & ~whole.contains("NORMAL"), "SUSPICIOUS").when(whole.contains("NORMAL") & ~whole.contains("SUSPICIOUS"), "NORMAL")


def parse_confidence(text: Column) -> Column:
    """A whole percentage as a share within [0, 1]."""
    found = F.nullif(F.regexp_extract(text, r"(?i)CONFIDENCE\s*:\s*(\d{1,3})", 1), F.lit(""))
    return F.when(found.isNotNull(), F.least(found.cast("double") / 100, F.lit(1.0)))  # least() alone would skip a null


def parse_json(text: Column) -> Column:
    """A struct (cls, conf, evidence, explanation, ok) from a JSON verdict; ok is false if it is not one."""
    obj = F.from_json(text, "classification string, confidence string, evidence string, explanation string")
    cls = F.trim(F.upper(obj["classification"]))
    ok = F.coalesce(cls.isin("NORMAL", "SUSPICIOUS"), F.lit(False))
    number = obj["confidence"].try_cast("double")
    conf = F.when(number.isNotNull(), F.least(F.greatest(number / 100, F.lit(0.0)), F.lit(1.0)))
    return F.struct(cls.alias("cls"), conf.alias("conf"), *(F.coalesce(obj[x], F.lit("")).alias(x) for x in ("evidence", "explanation")), ok.alias("ok"))


def parse_verdict(text: Column) -> Column:
    """The JSON verdict, else the line format: (cls, conf, evidence, explanation, json_ok)."""
    j = parse_json(text)
    lines = {"cls": parse_label(text), "conf": parse_confidence(text), "evidence": field("EVIDENCE", text), "explanation": field("EXPLANATION", text)}
    return F.struct(*(F.when(j["ok"], j[x]).otherwise(other).alias(x) for x, other in lines.items()), j["ok"].alias("json_ok"))


def majority(votes: DataFrame, key: str = "case_id") -> DataFrame:
    """SUSPICIOUS only if more than half of the parsed votes say so; without any, NORMAL and parse_ok false."""
    out = votes.groupBy(key).agg(F.count("cls").alias("n_votes"), F.count_if(F.col("cls") == "SUSPICIOUS").alias("n_suspicious"))
    return out.withColumn("cls", F.when(F.col("n_suspicious") * 2 > F.col("n_votes"), "SUSPICIOUS").otherwise("NORMAL")).withColumn("parse_ok", F.col("n_votes") > 0)


def _sentences(text: Column, keep: Callable[[Column], Column]) -> Column:
    """The sentences of which ``keep`` holds, given lower-cased."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", ""), "(?<=[.!?])\\s+")
    both = F.transform(parts, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    kept = F.filter(both, lambda x: (F.trim(x["s"]) != "") & keep(x["low"]))
    return F.trim(F.array_join(F.transform(kept, lambda x: x["s"]), " "))


def _holds(text: Column, phrases: list[str]) -> Column:
    return text.rlike("|".join(p.replace(".", "\\.") for p in phrases))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _unsupported_cause(sentence: Column, blob: Column) -> Column:
    """Whether a sentence names a cause that the templates don't hold. Patterns are literals, each compiled once; one
    for all terms passes over most sentences."""
    words = sentence.rlike("\\b(?:" + "|".join(fixed.CAUSE_TERMS) + ")\\b") & _any([sentence.rlike(f"\\b{t}\\b") & ~blob.rlike(f"\\b{t}\\b") for t in fixed.CAUSE_TERMS])
    return words | _any([F.contains(sentence, F.lit(p)) & ~F.contains(blob, F.lit(p)) for p in fixed.CAUSE_PHRASES])


def _unsupported_security(text: Column, blob: Column) -> Column:
    """Whether a text holds a security term of whose first word the templates know nothing."""
    return _any([F.contains(text, F.lit(t)) & ~blob.rlike(f"\\b{t.split()[0]}\\b") for t in fixed.SECURITY_TERMS])


def scrub_causes(text: Column, blob: Column) -> Column:
    """Sentences without causes that the templates (``blob``) don't hold."""
    return _sentences(text, lambda s: ~_unsupported_cause(s, blob))


def scrub_narrative(text: Column, blob: Column) -> Column:
    """Sentences left after verdict phrases, speculation, unsupported causes and security terms are dropped."""
    return _sentences(text, lambda s: ~_holds(s, fixed.VERDICT_PHRASES + fixed.SPECULATION_PHRASES) & ~_unsupported_cause(s, blob) & ~_unsupported_security(s, blob))


def scrub_contradictions(text: Column, correct: Column) -> Column:
    """Where the prediction was right, sentences that tell of a deviation are dropped."""
    return F.when(correct & (text != ""), _sentences(text, lambda s: ~_holds(s, fixed.CONTRADICTION_PHRASES))).otherwise(text)


def invented(text: Column, blob: Column) -> Column:
    """The raw text names a security term that the templates don't hold."""
    return _unsupported_security(F.lower(F.coalesce(text, F.lit(""))), blob)


def with_insufficient(explanation: Column, raw: Column) -> Column:
    """The fixed sentence where nothing is left or the text says there is insufficient evidence."""
    return F.when((explanation == "") | F.lower(raw).contains("insufficient evidence"), fixed.INSUFFICIENT).otherwise(explanation)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the case's parts."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def collapse(cases: DataFrame) -> DataFrame:
    """One row for each fingerprint, with its smallest case and the number of cases."""
    return cases.groupBy("fingerprint").agg(F.min("case_id").alias("case_id"), F.count("*").alias("n_cases"))


def call_statistics(calls: DataFrame) -> DataFrame:
    """Calls, cached, failures and mean latency of the calls made."""
    return calls.agg(F.count("*").alias("n_calls"), F.count_if("cached").alias("n_cached"), F.count_if("failed").alias("n_failed"), F.avg(F.when(~F.col("cached"), F.col("latency"))).alias("mean_latency"))


def section(text: Column) -> Column:
    """The text after the interpretation header, to the end."""
    return F.regexp_replace(F.regexp_extract(text, r"(?is)EVIDENCE_BASED_INTERPRETATION\s*:?\s*(.*)$", 1), "^\\s+|\\s+$", "")


def block_text(traces: DataFrame, templates: DataFrame, key: str = "block_id") -> DataFrame:
    """Distinct template texts of a block in first-seen order, the event id where there is none."""
    each = traces.select(key, F.posexplode(F.array_distinct("events")).alias("at", "event"))
    known = each.join(templates.select("event", "template"), "event", "left").select(key, F.struct("at", F.coalesce(F.nullif("template", F.lit("")), F.col("event")).alias("t")).alias("x"))
    return known.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " | ").alias("text"))
