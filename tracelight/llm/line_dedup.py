"""Repeated and nearly repeated lines by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import common

#: Shorter lines count as repeated only if they are equal: one word of few may well be the point of a line.
LEAST_WORDS = 8
#: Bits of a bitmap that names rows: at least so many for each, between these bounds (512 kB to 32 MB); false hits
#: only cost time.
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 64, 1 << 22, 1 << 28

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ORDER = np.uint64(0xD6E8FEB86659FD93)  # odd; gives a word's hash its place in a line
_ORDER_INVERSE = np.uint64(pow(int(_ORDER), -1, 1 << 64))
_SECOND = np.uint64(0xA24BAED4963EE407)
_LINES = "doc_id long, row long, line_no int, n_words int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long"


class _Sums:
    """Hashes of any run of words from prefix sums; they depend on the words and their order only."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * common.powers(_ORDER, len(hashes)), out=self.sums[1:])
        self.inverse = common.powers(_ORDER_INVERSE, len(hashes) + 1)

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _words(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in ``body``, which ends in a space."""
    space = _SPACE[body]
    first = ~space
    first[1:] &= space[:-1]
    last = space.copy()
    last[0] = False
    last[1:] &= ~space[:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    hashes, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):  # so much of the text at a time, as hashing takes many times its size
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + common.STEP_BYTES, side="right")))
        low = starts[a]
        hashes[a:b] = common.span_hashes(body[low : ends[b - 1]], starts[a:b] - low, ends[a:b] - low)
        a = b
    return starts, ends, hashes


def _split(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines that hold words: document row, line number, first word and word after the last; and the word hashes."""
    rows = len(at) - 1
    # a line feed after each document keeps words and lines of neighbours apart
    joined = np.insert(body, at[1:], np.uint8(10))
    starts, _, hashes = _words(joined)
    feeds = np.flatnonzero(joined == 10)
    line = np.searchsorted(feeds, starts)  # over all documents
    lines, first = np.unique(line, return_index=True)
    doc_start = at[:-1] + np.arange(rows)
    doc = np.searchsorted(doc_start, feeds[lines], side="right") - 1
    before = np.searchsorted(feeds, doc_start)
    return doc, lines - before[doc], first, np.append(first[1:], len(starts)), hashes


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """Hashes of every line with words, and of its halves, which any two lines one word apart share one of.

    Two lines within one inserted, deleted or changed word have equal first or last halves, a half being
    floor(n / 2) words of either, or floor((n - 1) / 2) of the longer.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = common.raw_bytes(common.text_column(batch, "text"))
            for a, b in common.steps(at):
                doc, line, start, end, hashes = _split(body[at[a] : at[b]], at[a : b + 1] - at[a])
                if not len(doc):
                    continue
                one, two, n = _Sums(hashes), _Sums(common.mixed(hashes + _SECOND)), end - start
                own = pa.array(doc)
                columns = [*(batch.column(k).slice(a, b - a).take(own) for k in (0, 1)), pa.array(line.astype(np.int32)), pa.array(n.astype(np.int32)), _signed(common.mixed(one.run(start, end))), _signed(common.mixed(two.run(start, end)))]
                for kind, half in ((1, n // 2), (1, (n - 1) // 2), (2, n // 2), (2, (n - 1) // 2)):
                    run = one.run(start, start + half) if kind == 1 else one.run(end - half, end)
                    columns.append(_signed(common.mixed(run + half.astype(np.uint64) * np.uint64(2 * kind + 1) + np.uint64(kind))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "line_no", "n_words", "h1", "h2", "k0", "k1", "k2", "k3"])

    return docs.select("doc_id", "row", "text").mapInArrow(make, _LINES)


def slots(row: np.ndarray, line_no: np.ndarray, bits: int) -> np.ndarray:
    return (common.mixed(row.astype(np.int64).view(np.uint64) * _ORDER + line_no.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


def bitmap(firsts: DataFrame) -> np.ndarray:
    """A bitmap of (row, line_no), sized by their number up to a fixed most; built on the executors."""
    n = firsts.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_ROW * n):
        bits *= 2

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(np.left_shift(np.int64(1), s & 63))], ["at", "bits"])

    rows = firsts.select("row", "line_no").mapInArrow(make, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits"))
    found = rows.toArrow()  # plain numbers: rows of Python objects would take many times their size
    out = np.zeros(bits >> 6, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out


def marked(bits: np.ndarray, row: np.ndarray, line_no: np.ndarray) -> np.ndarray:
    """Which of (row, line_no) a bitmap names."""
    s = slots(row, line_no, 64 * len(bits))
    return (bits[s >> 6] >> (s & 63) & 1).astype(bool)


def _candidate_texts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The text of the lines named in ``firsts`` (doc_id, row, line_no); documents are read again, not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(firsts))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids, rows, col = batch.column(0).to_numpy(), batch.column(1).to_numpy(), common.text_column(batch, "text").cast(pa.large_binary())
            found: list[tuple[int, int, int, bytes]] = []
            for doc_id, row, text in zip(ids.tolist(), rows.tolist(), col):
                lines = text.as_py().split(b"\n")
                for k in np.flatnonzero(marked(bits, np.full(len(lines), row), np.arange(len(lines)))).tolist():
                    found.append((doc_id, row, k, b" ".join(lines[k].split())))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else ([], [], [], []), kinds)], ["doc_id", "row", "line_no", "words"])

    found = docs.select("doc_id", "row", "text").mapInArrow(make, "doc_id long, row long, line_no int, words binary")
    # rows that repeat an identifier and a text have the same lines
    place = ["doc_id", "row", "line_no"]
    return found.join(firsts.select(*place), place, "left_semi").dropDuplicates(place)


def variants(lines: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(variant, gap, doc_id, row, line_no): each line as it is (gap -1), and without each of its words in turn.

    With a bitmap of variants only those that it names.
    """
    shared = lines.sparkSession.sparkContext.broadcast(bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 2048):
                part = batch.slice(x, 2048)
                body, at = common.raw_bytes(pa.concat_arrays([part.column(3).cast(pa.large_binary())]))
                _, _, start, end, hashes = _split(body, at)
                sums, n = _Sums(hashes), end - start
                rows = np.repeat(np.arange(len(n)), n + 1)
                gap = np.arange(len(rows)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1) - 1
                s, e = start[rows], end[rows]
                cut = s + np.maximum(gap, 0)
                after = np.where(gap < 0, cut, cut + 1)
                left, size = sums.run(s, cut), n[rows] - (gap >= 0)
                right = sums.run(after, e) * common.powers(_ORDER, int(n.max(initial=0)) + 1)[cut - s]
                key = common.mixed(left + right + size.astype(np.uint64) * _SECOND)
                if shared.value is not None:
                    kept = marked(shared.value, key.view(np.int64), np.zeros(len(key), np.int64))
                    key, gap, rows = key[kept], gap[kept], rows[kept]
                own = pa.array(rows)
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(gap.astype(np.int32)), *(part.column(k).take(own) for k in range(3))], ["variant", "gap", "doc_id", "row", "line_no"])

    return lines.select("doc_id", "row", "line_no", "words").mapInArrow(make, "variant long, gap int, doc_id long, row long, line_no int")


def within_one_word(a: bytes, b: bytes) -> bool:
    """Whether the word-level edit distance of two lines is at most one."""
    x, y = a.split(), b.split()
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > 1:
        return False
    k = next((i for i in range(len(y)) if x[i] != y[i]), len(y))
    return x[k + 1 :] == (y[k + 1 :] if len(x) == len(y) else y[k:])


def _near_later(docs: DataFrame, texts: DataFrame, least_words: int) -> DataFrame:
    """First places (doc_id, row, line_no) of texts that are one word from a text with an earlier first place."""
    place = F.struct("doc_id", "row", "line_no")
    long = texts.where(F.col("n_words") >= least_words)
    keys = long.select("doc_id", "row", "line_no", F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    firsts = common.stored(keys.join(shared, "k").select("doc_id", "row", "line_no").distinct(), "line-halves")
    lines = common.stored(_candidate_texts(docs, firsts), "line-texts")

    # counted first, by the key alone; then only variants of two lines or more are made again with their places
    again = common.stored(variants(lines).groupBy("variant").agg(F.count("*").alias("n")).where("n > 1").select("variant"), "shared-variants")
    every = common.stored(variants(lines, bitmap(again.select(F.col("variant").alias("row"), F.lit(0).alias("line_no")))), "line-variants")
    # without the word at one place the lines are equal: each is one changed word from the earliest of them
    changed = every.where("gap >= 0").groupBy("variant", "gap").agg(F.min(place).alias("one"), F.count("*").alias("n")).where("n > 1")
    pairs = every.join(changed, ["variant", "gap"]).select(place.alias("a"), F.col("one").alias("b"))
    # a line that equals another without one word
    whole = every.where("gap < 0").select("variant", place.alias("b"))
    pairs = pairs.union(every.where("gap >= 0").select("variant", place.alias("a")).join(whole, "variant").select("a", "b"))
    later, earlier = F.greatest("a", "b"), F.least("a", "b")
    pairs = pairs.where("a <> b").select(later.alias("a"), earlier.alias("b")).distinct()

    named = lines.select(place.alias("place"), "words")
    sides = pairs.join(named.select(F.col("place").alias("a"), F.col("words").alias("x")), "a").join(named.select(F.col("place").alias("b"), F.col("words").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one_word(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(4))]
            yield batch.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))

    return sides.select("a.*", "x", "y").mapInArrow(verify, "doc_id long, row long, line_no int").distinct()


def row_key(doc_id: Column, text: Column) -> Column:
    """Names the rows of an identifier and a text."""
    return F.xxhash64(doc_id, text)


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, row, line_no, near) of the lines that go, of a frame with columns doc_id, row (see ``row_key``) and text (see ``line_dedup``)."""
    named = docs.where("doc_id is not null").select("doc_id", "row", "text")
    lines = common.stored(hashed_lines(named), "lines")
    place = F.struct("doc_id", "row", "line_no")
    same = [F.min(k).alias(k) for k in ("n_words", "k0", "k1", "k2", "k3")]
    texts = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), *same)
    texts = common.stored(texts.select("h1", "h2", "n", "n_words", "k0", "k1", "k2", "k3", "first.*"), "line-kinds")
    near = _near_later(named, texts, least_words).withColumn("near", F.lit(True))
    going = texts.join(near, ["doc_id", "row", "line_no"], "left").where("n > 1 or near")
    going = going.select("h1", "h2", place.alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    return lines.join(going, ["h1", "h2"]).where(F.col("near") | (place != F.col("first"))).select("doc_id", "row", "line_no", "near")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without repeated lines; columns n_lines, n_dropped, n_near and dropped_lines are added.

    Lines are split at line feeds and compared by their words, so white space makes no difference. In the
    order of (identifier, row, line number), a line goes if an earlier one is equal or, both having at
    least ``least_words`` words, is one inserted, deleted or changed word away; ``least_words=1`` compares all
    lines so. Lines without words stay and are not counted. Rows of one identifier with different texts are
    told apart, in a fixed order; rows that repeat an identifier and its text count as one document and get
    equal results. Null texts stay null, and a null identifier keeps its row as it is. An empty table gives an
    empty result. Columns of the input are kept, except the four names above, which are replaced.
    """
    added = ["n_lines", "n_dropped", "n_near", "dropped_lines"]
    kept = docs.drop(*added)
    key = row_key(F.col(id_col).cast("long"), F.col(text_col))
    gone = repeated_lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("row"), F.col(text_col).alias("text")), least_words)
    gone = gone.dropDuplicates(["doc_id", "row", "line_no"]).groupBy(F.col("doc_id").alias("__doc_id"), F.col("row").alias("__row")).agg(F.sort_array(F.collect_list("line_no")).alias("dropped_lines"), F.count_if("near").cast("int").alias("n_near"))
    own = (F.col(id_col).cast("long") == F.col("__doc_id")) & (key == F.col("__row"))
    joined = kept.join(gone, own, "left").drop("__doc_id", "__row")
    return _without_lines(joined, text_col).withColumn("n_dropped", F.size("dropped_lines")).select(*kept.columns, *added)


def _without_lines(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with the text left when ``dropped_lines`` go, and n_lines, the lines with words before that; one pass over a text."""
    others = [c for c in rows.columns if c not in (text_col, "dropped_lines", "n_near")]
    source = rows.select(*others, text_col, F.coalesce("dropped_lines", F.array().cast("array<int>")).alias("dropped_lines"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    schema = StructType([*source.schema.fields, StructField("n_lines", IntegerType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, (a, b) in ((batch, part) for batch in batches for part in common.steps(common.raw_bytes(common.text_column(batch, text_col))[1])):
            batch = whole.slice(a, b - a)
            texts, counts = [], []
            for text, dropped in zip(batch.column(len(others)), batch.column(len(others) + 1)):
                lines = (text.as_py() or "").encode().split(b"\n")
                counts.append(sum(1 for line in lines if line.strip()))  # bytes: ASCII white space
                if len(dropped):
                    left = np.ones(len(lines), bool)
                    left[dropped.values.to_numpy()] = False
                    texts.append(b"\n".join(lines[i] for i in np.flatnonzero(left).tolist()).decode())
                else:
                    texts.append(text.as_py())
            new = pa.array(texts, batch.schema.field(len(others)).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], new, *batch.columns[len(others) + 1 :], pa.array(counts, pa.int32())], schema.names)

    return source.mapInArrow(make, schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
