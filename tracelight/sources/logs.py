"""Readers and writers of logs, traces, labels, templates and results. Paths may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import parsing
from ..shared import stored


def event_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One named column without nulls; nothing else is read."""
    return spark.read.parquet(path).select(F.col(column).alias("event")).na.drop()


def numbered_text(spark: SparkSession, paths: str | list[str], most: int | None = None) -> DataFrame:
    """The lines of raw text files as (line_no, line, source_file), numbered from 1 in the order of the files' paths.

    Files may be split by Spark, or compressed and whole. A line's number is that of the lines before its block of
    the file and its place in it: one pass counts the lines of each block, their running sum is made in ranges
    of blocks, and the second pass numbers the lines as it reads them, without a shuffle while the table of blocks
    is small enough for Spark to broadcast. Should Spark cut the files otherwise in the second pass, the job
    fails rather than losing lines.
    """
    place = F.monotonically_increasing_id()  # grows by one from line to line of a block
    raw = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__start"), place.alias("__id"))
    block = ["source_file", "__start"]
    counted = raw.groupBy(*block).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    blocks = stored(counted.repartitionByRange(*block).withColumn("__range", F.spark_partition_id()), "log-blocks")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("__range").agg(F.sum("__n").alias("__all"))  # a row for each partition
    ranges = ranges.select("__range", F.coalesce(F.sum("__all").over(before(Window.orderBy("__range"))), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__n").over(before(Window.partitionBy("__range").orderBy(*block))), F.lit(0))
    offsets = blocks.withColumn("__inside", inside).join(ranges, "__range").select(*block, "__first", "__n", (F.col("__before") + F.col("__inside")).alias("__before"))
    found = raw.join(offsets, block, "left").withColumn("__place", F.col("__id") - F.col("__first"))
    known = F.coalesce((F.col("__place") >= 0) & (F.col("__place") < F.col("__n")), F.lit(False))
    number = F.when(known, F.col("__before") + F.col("__place") + 1).otherwise(F.raise_error(F.lit("the files were cut otherwise when they were counted")).cast("long"))
    rows = found.select(number.alias("line_no"), "line", "source_file")
    return rows.where(F.col("line_no") <= most) if most else rows


def flat_log(spark: SparkSession, paths: str | list[str], most: int | None = None) -> DataFrame:
    """Line number, label, node, content and alert of the flat-layout lines of raw files, of the first ``most`` lines only if given."""
    return parsing.flat_fields(numbered_text(spark, paths, most)).withColumn("alert", parsing.alert(F.col("label"))).select("line_no", "label", "node", "content", "alert")


def header_log(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Header-layout lines of the raw files of several sources, numbered in each, with the source's name, the parse flag, fields and session key."""
    parts = [numbered_text(spark, p).withColumn("source", F.lit(s)) for s, p in paths.items()]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    fields = parsing.header_fields(parsing.stripped(lines))
    return fields.withColumn("session_id", parsing.session_key(F.col("content"))).drop("source_file")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, events) from a CSV of BlockId and a bracketed list."""
    raw = spark.read.csv(path, header=True, schema="BlockId string, Features string")
    items = F.transform(F.split(F.regexp_replace("Features", "^\\s*\\[|\\]\\s*$", ""), ","), lambda x: F.trim(x))
    return raw.select(F.col("BlockId").alias("block_id"), F.filter(items, lambda x: x != "").alias("events"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, y) with y = 1 for 'anomaly' in any case, spaces ignored."""
    raw = spark.read.csv(path, header=True, schema="BlockId string, Label string")
    return raw.select(F.col("BlockId").alias("block_id"), F.when(F.lower(F.trim("Label")) == "anomaly", 1).otherwise(0).alias("y"))


def labelled_ids(spark: SparkSession, path: str) -> DataFrame:
    """The set of UUIDs in a free text."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(parsing.UUID), F.lit(0))).alias("session_id")).distinct()


def template_dictionary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(event, template) of the first path that exists and has both columns; no rows if none has."""
    for path in paths:
        try:
            raw = spark.read.csv(path, header=True)
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # a missing candidate is passed over
        if {"EventId", "EventTemplate"} <= set(raw.columns):
            return raw.select(F.col("EventId").alias("event"), parsing.clean_template(F.col("EventTemplate")).alias("template"))
    return spark.createDataFrame([], "event string, template string")


def write_result(df: DataFrame, path: str, by: str | None = None, form: str = "parquet") -> None:
    """A result table, partitioned by a column if named."""
    writer = df.write.mode("errorifexists")
    if by:
        writer = writer.partitionBy(by)
    writer.csv(path, header=True) if form == "csv" else writer.format(form).save(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    """Preprocessing statistics as one JSON record."""
    stats.write.mode("errorifexists").json(path)
