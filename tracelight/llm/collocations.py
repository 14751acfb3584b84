"""Collocations: phrases counted by Rabin-Karp fingerprints, level by level; only frequent ones ever become text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, line_dedup

#: Words of the longest phrase, its least number of occurrences, and the phrases returned for each language.
MOST_WORDS, LEAST_COUNT, TOP = 3, 10, 2000
#: A longer phrase with at least this percentage of a candidate's occurrences stands for it.
COVERED = 50
#: Phrases of a language are ranked in so many parts, then the first ones of each in fewer, then all that are left.
PARTS = (256, 16, 1)

_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = re.compile(rb"[^\x20\x09-\x0D.,;:!?]*")
_MORE = re.compile(rb"[\x20\x09]+[^\x20\x09-\x0D.,;:!?]+")
_PRIME = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a fingerprint; tests make collisions with fewer.
FINGERPRINT_BITS = 64


def slices(body: bytes, most_bytes: int = common.STEP_BYTES, more_words: int = MOST_WORDS - 1) -> Iterator[tuple[bytes, int]]:
    """Parts of a text and how many of their bytes are their own: the rest shows how phrases go on that begin there.

    No word is cut.
    """
    start = 0
    while len(body) - start > most_bytes:
        end = _TAIL.match(body, start + most_bytes).end()
        stop = end
        for _ in range(more_words):
            more = _MORE.match(body, stop)
            stop = more.end() if more else stop
        yield body[start:stop], end - start
        start = end
    yield body[start:], len(body) - start


class Words:
    """The words of several texts, told by place and by two unrelated hashes."""

    def __init__(self, texts: list[bytes], own: np.ndarray):
        at = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        self.body = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        ends = _ENDS_WORD[self.body]
        first, last = ~ends, ends.copy()
        first[1:] &= ends[:-1]
        last[0] = False
        last[1:] &= ~ends[:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last)
        self.text = np.searchsorted(at, self.start, side="right") - 1
        self.own = self.start < (at[:-1] + own)[self.text]
        self.piece = np.searchsorted(np.flatnonzero(_ENDS_PIECE[self.body]), self.start)
        self.prefix = line_dedup._Sums(common.span_hashes(self.body, self.start, self.end))
        self.second = self._second()

    def _second(self) -> np.ndarray:
        """Hashes by mixing eight bytes after eight, for all words in step."""
        padded = np.append(self.body, np.zeros(8, np.uint8))
        size = self.end - self.start
        out = common.mixed(size.astype(np.uint64))
        going = np.arange(len(size))
        for k in range(0, int(size.max(initial=0)), 8):
            going = going[size[going] > k]
            chunk = padded[(self.start[going] + k)[:, None] + np.arange(8)].view("<u8")[:, 0]
            left = np.minimum(size[going] - k, 8).astype(np.uint64)
            chunk = chunk & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
            out[going] = common.mixed(out[going] * _PRIME + chunk)
        return out

    def phrases(self, n: int) -> np.ndarray:
        """First words of all runs of ``n`` words of a piece that begin in a text's own part."""
        first = np.arange(max(0, len(self.start) - n + 1))
        return first[self.own[: len(first)] & (self.piece[first] == self.piece[first + n - 1])]

    def hashes(self, first: np.ndarray, n: int, salt: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of runs of ``n`` words from the prefix polynomial, and second hashes. ``salt`` has a number for each text."""
        salted = salt[self.text[first]].astype(np.int64).view(np.uint64) + np.uint64(n)
        fingerprint = common.mixed(self.prefix.run(first, first + n) + salted) >> np.uint64(64 - bits)
        other = common.mixed(salted * _PRIME)
        for k in range(n):
            other = common.mixed(other * _PRIME + self.second[first + k])
        return fingerprint.view(np.int64), other.view(np.int64)

    def phrase(self, first: int, n: int) -> str:
        return b" ".join(self.body[self.start[i] : self.end[i]].tobytes() for i in range(first, first + n)).decode()


def _runs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by ``h1``, and in it the first place and the length of each run of equal hashes."""
    order = np.argsort(h1, kind="stable")
    h1, h2 = h1[order], h2[order]
    first = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(h1)])
    return order, first, np.diff(np.append(first, len(h1)))


def _steps(batch: pa.RecordBatch, more_words: int) -> Iterator[tuple[Words, np.ndarray]]:
    """The words of a bounded part of the column ``text`` at a time, and the row of each text in it."""
    col = common.text_column(batch, "text").cast(pa.large_binary())
    _, at = common.raw_bytes(col.cast(pa.large_string()))
    for a, b in common.steps(at):
        if b == a + 1:  # maybe a huge one
            for body, own in slices(col[a].as_py(), more_words=more_words):
                yield Words([body], np.array([own])), np.array([a])
        else:
            yield Words(col.slice(a, b - a).to_pylist(), np.diff(at[a : b + 1])), np.arange(a, b)


def _level(texts: DataFrame, n: int, shorter: Broadcast | None, bits: int) -> DataFrame:
    """(h1, h2, mark, n): occurrences of phrases of ``n`` words, by fingerprint and second hash, and one text that holds them.

    ``shorter`` is a bitmap of the frequent phrases one word shorter: phrases whose parts it lacks are not frequent.
    With single words, a row without h2 has the number of all words of the language of hash h1.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts, marks = (batch.column(k).to_numpy() for k in (1, 2))
            for words, row in _steps(batch, n - 1):
                salt = salts[row]
                first = words.phrases(n)
                for shift in (0, 1) if shorter is not None else ():
                    first = first[line_dedup.marked(shorter.value, *words.hashes(first + shift, n - 1, salt, bits))]
                h1, h2 = words.hashes(first, n, salt, bits)
                order, run, many = _runs(h1, h2)
                one = order[run]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[one], h2[one], marks[row][words.text[first[one]]], many)], names)
                if n == 1:
                    own, many = np.unique(salt[words.text[first]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64()), pa.array(many)], names)

    names = ["h1", "h2", "mark", "n"]
    counted = texts.select("text", "salt", "mark").mapInArrow(make, "h1 long, h2 long, mark long, n long")
    return counted.groupBy("h1", "h2").agg(F.min("mark").alias("mark"), F.sum("n").alias("n"))


def _bits(rows: DataFrame, a: str, b: str) -> Broadcast:
    """A bitmap of (a, b), of at most 32 MB."""
    return rows.sparkSession.sparkContext.broadcast(line_dedup.bitmap(rows.select(F.col(a).alias("row"), F.col(b).alias("line_no"))))


def _shown(texts: DataFrame, frequent: DataFrame, most_words: int, bits: int) -> DataFrame:
    """(h1, h2, salt, lang, phrase): frequent phrases, some of them repeatedly, read in the texts that ``frequent`` points at."""
    wanted = _bits(frequent, "h1", "mark")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts, marks = (batch.column(k).to_numpy() for k in (1, 2))
            for words, row in _steps(batch, most_words - 1):
                salt = salts[row]
                for n in range(1, most_words + 1):
                    first = words.phrases(n)
                    h1, h2 = words.hashes(first, n, salt, bits)
                    here = line_dedup.marked(wanted.value, h1, marks[row][words.text[first]])
                    first, h1, h2 = first[here], h1[here], h2[here]
                    order, run, _ = _runs(h1, h2)
                    one = order[run]
                    own = row[words.text[first[one]]]
                    shown = pa.array([words.phrase(i, n) for i in first[one].tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(h1[one]), pa.array(h2[one]), pa.array(salts[own]), batch.column(3).take(pa.array(own)), shown], ["h1", "h2", "salt", "lang", "phrase"])

    return texts.select("text", "salt", "mark", "lang").mapInArrow(make, "h1 long, h2 long, salt long, lang string, phrase string")


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, fingerprint_bits: int = FINGERPRINT_BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, a, n): phrases of up to ``most_words`` words with a >= ``least`` occurrences; n words in all.

    A phrase occurs only where its parts do, so each length counts the phrases whose parts, one word shorter, are
    frequent. Counts are grouped by fingerprint and a second hash of another kind (mixing, not a polynomial), which
    tells phrases of one fingerprint apart; each group points at one text, where the phrase is read.
    """
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    texts = docs.select(docs[text_col].alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("salt"), F.xxhash64(docs[id_col], docs[text_col]).alias("mark"))
    levels, shorter = [], None
    for n in range(1, most_words + 1):
        found = common.stored(_level(texts, n, shorter, fingerprint_bits).where((F.col("n") >= least) | F.col("h2").isNull()), f"phrases-{n}")
        levels.append(found.where("h2 is not null").withColumn("words", F.lit(n)))
        if n == 1:
            totals = found.where("h2 is null").select(F.col("h1").alias("salt"), "n")
        if n < most_words:
            shorter = _bits(levels[-1], "h1", "h2")
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.union(level)
    shown = _shown(texts, frequent, most_words, fingerprint_bits).dropDuplicates(["h1", "h2"])
    found = shown.join(frequent.withColumnRenamed("n", "a"), ["h1", "h2"]).join(totals, "salt")
    return common.stored(found.select("lang", "phrase", "words", "a", "n"), "phrases")


def _part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("list", start, size), " ")


def collocations(
    docs: DataFrame,
    most_words: int = MOST_WORDS,
    least: int = LEAST_COUNT,
    covered: int = COVERED,
    top: int = TOP,
    fingerprint_bits: int = FINGERPRINT_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n and score.

    A-Z are lower-cased, texts cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A
    candidate has 2 to ``most_words`` words and a >= ``least`` occurrences. Cut after k words, its parts have l and r
    occurrences and score floor(1000000 * a * a / (l * r)), exact up to 1e32 for a * a; the lowest cut counts, of
    equal ones the first. A candidate goes if a longer one that holds it has ``covered`` percent of its
    occurrences. Ranks follow score, a (both descending) and phrase (bytes); n is the number of words of the language.

    A null language is ``und``, null and empty texts have no words, repeated rows count each, null identifiers count,
    an empty table gives an empty result, and further columns are not read. Huge texts are read in slices.
    """
    phrases = phrase_counts(docs, most_words, least, fingerprint_bits, id_col, text_col, lang_col)
    candidates = phrases.where("words > 1").withColumn("list", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "n", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, number in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(number)), ["lang", side])
    wide = "decimal(38,0)"
    product = F.lit(1_000_000).cast(wide) * F.col("a").cast(wide) * F.col("a").cast(wide)
    cuts = cuts.withColumns({"top": product, "below": F.col("l").cast(wide) * F.col("r").cast(wide)}).withColumn("score", F.expr("top div below"))
    scored = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    sizes = F.explode(F.sequence(F.lit(2), F.col("words") - 1))
    inside = candidates.where("words > 2").select("lang", "a", "words", "list", sizes.alias("size"))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inside = inside.groupBy("lang", _part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    for parts in PARTS:
        group = ["lang"] if parts == 1 else ["lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))]
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"), "phrase")
        kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), sizes AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang
), found AS (
  SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM lists, (VALUES (1), (2), (3)) AS v(size))
), counted AS (
  SELECT lang, size, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM found GROUP BY lang, size, phrase HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counted WHERE size > 1) c
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : k], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1 : c.size], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, part AS phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS part FROM counted WHERE size = 3) GROUP BY lang, part
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, s.n, k.score::BIGINT AS score
FROM kept k JOIN sizes s ON s.lang = k.lang
QUALIFY rank <= 2000
"""
