"""Corpus preparation: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import common, components, language_id, line_dedup, packing, simhash, toxicity


def _passed(docs: DataFrame, added: list[str], stage: Callable[[DataFrame], DataFrame], good: str, changes: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``stage(docs)`` where ``good`` holds, with the columns of ``docs``; those that share a name with ``added`` ones keep their values."""
    hidden = {c: f"__own_{c}" for c in docs.columns if c.lower() in added}
    done = stage(docs.withColumnsRenamed(hidden)).where(good)
    done = done.withColumns({c: value for c, value in (changes or {}).items() if c in docs.columns})
    return done.select(*(F.col(hidden.get(c, c)).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go (no letter, or too far from every centroid).

    Null and empty texts hold no letter and go. Repeated rows share a fate; null identifiers are like any other.
    Without any language to learn from, every document goes. Columns of any name keep their values.
    """
    model = language_id.fit(docs)
    return _passed(docs, ["lang_pred", "score", "rejected"], lambda df: language_id.predict(df, model, df.columns), "not rejected")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier lets pass, learnt from the labels of documents that are still there.

    Null and empty texts pass. Repeated rows share a fate; null identifiers have no label but a score. Without
    both labels every document passes. Columns of any name keep their values.
    """
    model = toxicity.fit(toxicity.labelled(docs, common.read(spark, sf_dir, "labels")))
    return _passed(docs, ["score", "predicted"], lambda df: toxicity.predict(df, model, df.columns), "predicted = 0")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those that held nothing else go.

    Null texts and rows of a null identifier stay as they are; rows that repeat an identifier and a text are one
    document. ``n_chars`` follows the text; other columns of any name keep their values.
    """
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return _passed(docs, ["n_lines", "n_dropped", "n_near", "dropped_lines"], line_dedup.line_dedup, "n_dropped = 0 or n_dropped < n_lines", {"n_chars": length})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each near-duplicate group.

    Groups are those of op6 (SimHash fingerprints within 2 bits, through Golay-code keys). Copies that more was changed
    in lie beyond 2 bits, so documents whose five-word shingles have a similarity of 0.8 are linked too.
    Texts without words, null ones too, are one group. A row without an identifier goes if it is near a named
    one; rows that repeat an identifier and a text are one document. Columns of any name keep their values.
    """
    groups = components.united(simhash.near_duplicates(docs, simhash.STRICT), simhash.near_duplicates(docs, simhash.SIMILAR))
    others = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (F.xxhash64(docs["text"]) == F.col("__text_hash"))
    return docs.join(others, same, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their place in a sequence; null texts, null identifiers and repeated rows too."""
    packed = packing.pack_documents(docs, {"ids_crc32": F.crc32("ids")}, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL can express none of learnt scores, near lines or packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
