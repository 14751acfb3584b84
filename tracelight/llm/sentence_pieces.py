"""SentencePiece encoding and decoding as a relational lattice of word substrings."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..shared import new_path
from . import common

SPACE = "▁"
UNKNOWN_SCORE = -1e6
#: Longer words than both together are encoded in chunks that begin so many characters apart and share so many.
CHUNK_STEP, CHUNK_OVERLAP = 64, 48
#: Distinct words of one task, so that their lattices fit in memory.
WORDS_PER_TASK = 20_000
#: Text of one group of rows that share their distinct words.
GROUP_BYTES = 32 << 20
_GROUP = "__group"
#: Words of one Arrow batch; bytes of text that are put together at a time; edges that are folded at a time.
_ROWS, _STRETCH, _EDGES = 50_000, 4 << 20, 200_000
_Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def model_spec(path: str) -> tuple[tuple[tuple[str, int, float, int | None], ...], dict]:
    """The pieces (text, id, score, byte value) of a model file, and how it treats text."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = model.SentencePiece
    pieces = []
    for i, p in enumerate(model.pieces):
        if p.type == kinds.BYTE:
            pieces.append((p.piece, i, p.score, int(p.piece[3:5], 16)))
        elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
            pieces.append((p.piece, i, p.score, None))
    norm, train = model.normalizer_spec, model.trainer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
        raise ValueError("only models that leave text as it is are supported")
    return tuple(pieces), {"prefix": norm.add_dummy_prefix, "kind": {1: "unigram", 2: "bpe"}[train.model_type], "unk": train.unk_id, "fallback": train.byte_fallback}


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, score, rank, byte) of the model, a fixed number of rows; rank 0 scores best."""
    return with_ranks(spark.createDataFrame(list(model_spec(path)[0]), "piece string, id int, score double, byte int"))


def with_ranks(pieces: DataFrame) -> DataFrame:
    """``pieces`` (piece, id, score, byte) with their place by score, the smaller id first of equal ones."""
    rows = sorted(pieces.select("piece", "id", "score", "byte").collect(), key=lambda r: (-r["score"], r["id"]))
    return pieces.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(rows)], "piece string, id int, score double, byte int, rank int")


@lru_cache(maxsize=4)
def joined_characters(path: str) -> str:
    """Characters that pieces put side by side, directly or through others: the largest such set, spaces left out.

    No piece holds one of them beside any other character but a space, so text can be cut there.
    """
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for piece, _, _, byte in model_spec(path)[0]:
        for x, y in zip(piece, piece[1:]):
            if byte is None and SPACE not in (x, y):
                root[find(x)] = find(y)
    sets: dict[str, list[str]] = {}
    for x in sorted(root):
        sets.setdefault(find(x), []).append(x)
    return "".join(max(sets.values(), key=len, default=[]))


@lru_cache(maxsize=4)
def word_pattern(joined: str = "") -> str:
    """Spaces and what follows up to the next one, cut between characters of ``joined`` and others; for Java and Python alike."""
    own = re.escape(joined)
    return (f"{SPACE}*[{own}]+|" if own else "") + f"{SPACE}*[^{SPACE}{own}]+|{SPACE}+"


def split_words(text: Column, prefix: bool, joined: str = "") -> Column:
    """The words of a text with spaces as U+2581 (see ``word_pattern``).

    No piece of these models holds a space after another character, so words are encoded apart.
    """
    marked = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(SPACE))
    shown = F.when(marked == "", F.lit("")).otherwise(F.concat(F.lit(SPACE if prefix else ""), marked))
    return F.regexp_extract_all(shown, F.lit(word_pattern(joined)), F.lit(0))


def _edges(words: DataFrame, pieces: DataFrame, longest: int, carried: str | None = None) -> DataFrame:
    """(word, size, first, a, len, rank, id, score): the pieces in each word, and every single character.

    Substrings of up to ``longest`` characters are exploded, where their first three characters begin a piece of that
    length, and equi-joined to the piece table, which has a fixed size and is broadcast. A character that is no piece is
    an edge without rank, id and score. Neither explode nor join moves rows, so the edges of a word stay side by side,
    those that begin further left first, and its first character, which is marked ``first``, before all others.
    A column ``carried`` of the words is kept.
    """
    known = pieces.where("byte is null").select("piece", "rank", "id", "score")
    long = known.where(F.char_length("piece").between(3, longest))
    begins = long.groupBy(F.substring("piece", 1, 3).alias("begin")).agg(F.collect_set(F.char_length("piece")).alias("lengths"))
    own = ["word", "size", *([carried] if carried else [])]
    begun = words.withColumn("size", F.char_length("word")).select(*own, F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("a"))
    begun = begun.withColumn("begin", F.substring("word", F.col("a") + 1, F.lit(3))).join(F.broadcast(begins), "begin", "left")
    lengths = F.concat(F.array(F.lit(1), F.lit(2)), F.coalesce("lengths", F.array().cast("array<int>")))
    cut = begun.select(*own, "a", F.explode(lengths).alias("len")).where(F.col("a") + F.col("len") <= F.col("size"))
    cut = cut.withColumn("piece", F.substring("word", F.col("a") + 1, F.col("len")))
    found = cut.join(F.broadcast(known), "piece", "left").where("id is not null or len = 1")
    return found.select(*own, ((F.col("a") == 0) & (F.col("len") == 1)).alias("first"), "a", "len", "rank", "id", "score")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, size, edges): the edges of each distinct word in one row, as (rank, a, b, id, score), for folds in SQL."""
    edge = F.struct("rank", "a", (F.col("a") + F.col("len")).alias("b"), "id", "score")
    return _edges(words, pieces, longest).groupBy("word", "size").agg(F.collect_list(edge).alias("edges"))


def _best(size: Column, edges: Column, score: Callable[[Column], Column], start: Column, further: Callable[[Column, Column], Column]) -> Column:
    """What ``further`` makes of ``start`` along the best-scoring path: a fold over word positions that keeps the best way to each."""

    def extend(ways: Column, b: Column) -> Column:
        own = F.transform(F.filter(edges, lambda e: e["b"] == b), lambda e: F.struct((F.get(ways, e["a"])["s"] + F.coalesce(score(e), F.lit(UNKNOWN_SCORE))).alias("s"), (-e["a"]).alias("o")))
        # through an array of one, so that the best is worked out once
        return F.concat(ways, F.transform(F.array(F.array_max(own)), lambda x: F.struct(x["s"].alias("s"), further(F.get(ways, -x["o"])["x"], b).alias("x"))))

    return F.get(F.aggregate(F.sequence(F.lit(1), size), F.array(F.struct(F.lit(0.0).alias("s"), start.alias("x"))), extend), size)["x"]


def viterbi(size: Column, edges: Column, score: Callable[[Column], Column] = lambda e: e["score"]) -> Column:
    """Cuts of the best-scoring path.

    A character without a piece is an edge of a low score. Of equal paths the one whose last piece begins
    first stays.
    """
    return _best(size, edges, score, F.array(F.lit(0)), lambda cuts, b: F.array_append(cuts, b))


def viterbi_pieces(size: Column, edges: Column, score: Callable[[Column], Column] = lambda e: e["score"]) -> Column:
    """The number of pieces of that path."""
    return _best(size, edges, score, F.lit(0), lambda n, _: n + 1)


def zipf(e: Column) -> Column:
    """The logarithm of a piece's probability in a unigram model where it falls with the rank, as words' do; for merge models, whose scores are ranks."""
    return -F.log(e["rank"] + F.lit(2.0))


class _Folds:
    """Folds over the edges of many words at once; the edges of a word are side by side, those that begin further left first.

    A fold takes the k-th edge of every word that has so many in step k, in an order of its own.
    """

    def __init__(self, size: np.ndarray, n_edges: np.ndarray, a: np.ndarray, length: np.ndarray):
        self.base = _bounds(size + 1)  # of each word's places: before, between and after its characters
        self.word = np.repeat(np.arange(len(size)), n_edges)
        self.at = self.base[self.word] + a
        self.to = self.at + length

    def _steps(self, edges: np.ndarray, key: np.ndarray) -> Iterator[np.ndarray]:
        """Of the given edges, for each step one of every word that has any left, ordered by key and then as they are."""
        edges = edges[np.argsort((self.word[edges] << 32) | key[edges], kind="stable")]
        n = np.bincount(self.word[edges], minlength=len(self.base) - 1)
        first, most = _bounds(n)[:-1], np.argsort(-n, kind="stable")
        first, left = first[most], np.searchsorted(-n[most], -np.arange(n.max(initial=0)))
        for k, words in enumerate(left):
            yield edges[first[:words] + k]

    def merges(self, rank: np.ndarray) -> np.ndarray:
        """Which edges are the stretches that merging leaves: a fold over the pieces in the order of their rank, the leftmost first of equal ones.

        The first cuts are all character bounds. A piece drops the one cut inside it if it spans just two stretches by
        then. One pass is enough: the parts that a piece can be merged from rank before it.
        """
        cut, following = np.ones(self.base[-1], bool), np.arange(1, self.base[-1] + 1)
        for e in self._steps(np.flatnonzero(self.to - self.at > 1), rank):
            at, to = self.at[e], self.to[e]
            inner = following[at]
            merged = cut[at] & (following[inner] == to)
            following[at[merged]] = to[merged]
            cut[inner[merged]] = False
        return cut[self.at] & (following[self.at] == self.to)

    def best(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which edges are the best-scoring path, and its number of edges by word. Of equal paths the one whose last piece begins first stays."""
        top, n, by = np.full(self.base[-1], -np.inf), np.zeros(self.base[-1], np.int32), np.zeros(self.base[-1], np.int64)
        top[self.base[:-1]] = 0
        for e in self._steps(np.arange(len(self.at)), self.to - self.base[self.word]):
            s = top[self.at[e]] + score[e]
            e = e[s > top[self.to[e]]]
            top[self.to[e]], n[self.to[e]], by[self.to[e]] = top[self.at[e]] + score[e], n[self.at[e]] + 1, e
        used, place = np.zeros(len(self.at), bool), self.base[1:] - 1
        counts = n[place]
        while len(place := place[n[place] > 0]):
            used[by[place]] = True
            place = self.at[by[place]]
        return used, counts


def _whole_words(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Some batches at a time, cut where ``column`` is true, so that what begins there stays whole."""
    held, rows, enough = [], 0, _EDGES
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(table[column].to_numpy())[-1])
            if last:
                yield table.slice(0, last)
            held, rows = table.slice(last).to_batches(), len(table) - last
            enough = max(_EDGES, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _tokenised(words: DataFrame, spark: SparkSession, path: str, fold: str | None, carried: str | None = None, places: bool = False) -> DataFrame:
    """(word, ids of its merged or best path, number of pieces of the Viterbi path) of distinct words of bounded length.

    With ``places`` a column ``tokens`` holds (a, b, ids) of each stretch. Edges come from Spark, one row each; tasks fold those of many words at once.
    """
    pieces, spec = model_spec(path)
    fold = fold or {"bpe": "merges", "unigram": "viterbi"}[spec["kind"]]
    longest = max(len(p) for p, _, _, byte in pieces if byte is None)
    first_byte = next((i for _, i, _, byte in pieces if byte == 0), None) if spec["fallback"] else None
    table = piece_table(spark, path)
    score = zipf if spec["kind"] == "bpe" else lambda e: e["score"]
    ranked = table.select("rank", "id", score(table).alias("score")).orderBy("rank").collect()
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in ranked], np.int32), np.array([*(r["score"] for r in ranked), UNKNOWN_SCORE])))  # the piece table, of a fixed size

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = shared.value
        for table in _whole_words(batches, "first"):
            a, length, rank = (table[c].to_numpy() for c in ("a", "len", "rank"))
            first = table["first"].to_numpy()
            begins = table.filter(table["first"])
            own = pa.concat_arrays(begins["word"].cast(pa.large_string()).chunks)
            size, n_edges = pc.utf8_length(own).to_numpy(), np.diff(np.append(np.flatnonzero(first), len(first)))
            folds = _Folds(size, n_edges, a, length)
            if not first[0] or (np.bincount(folds.word[length == 1], minlength=len(size)) != size).any() or (np.diff(folds.at) < 0).any():
                raise ValueError("the edges of a word are not side by side")
            used, n_best = folds.best(scores[rank])
            used = np.flatnonzero(folds.merges(rank) if fold == "merges" else used)
            # every stretch is an edge, as single characters are
            known, char = rank[used] >= 0, _bounds(size)[folds.word[used]] + a[used]
            body, _ = common.raw_bytes(own)
            starts = np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))
            n = np.where(known | (first_byte is None), 1, starts[char + 1] - starts[char])
            at, found = _bounds(n), np.full(n.sum(), spec["unk"], np.int32)
            found[at[:-1][known]] = ids[rank[used[known]]]
            if first_byte is not None:
                found[_spread(at[:-1][~known], n[~known])] = body[_spread(starts[char[~known]], n[~known])].astype(np.int32) + first_byte
            of_word = _bounds(np.bincount(folds.word[used], minlength=len(size)))
            columns = [begins["word"].combine_chunks(), pa.ListArray.from_arrays(pa.array(at[of_word], pa.int32()), pa.array(found)), pa.array(n_best)]
            if places:
                parts = [pa.array(a[used]), pa.array(a[used] + length[used]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found))]
                columns.append(pa.ListArray.from_arrays(pa.array(of_word, pa.int32()), pa.StructArray.from_arrays(parts, ["a", "b", "ids"])))
            if carried:
                columns.append(begins[carried].combine_chunks())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = StructType.fromDDL("word string, ids array<int>, n_best int" + (", tokens array<struct<a int, b int, ids array<int>>>" if places else ""))
    if carried:
        schema = schema.add(words.schema[carried])
    shown = lambda c: F.when(F.col("first"), F.col(c)).alias(c)  # noqa: E731 - once a word
    edges = _edges(words, table, longest, carried).select("first", "a", "len", F.coalesce("rank", F.lit(-1)).alias("rank"), shown("word"), *([shown(carried)] if carried else []))
    return edges.mapInArrow(make, schema)


def best_path(word: str, scores: dict[str, float], longest: int) -> list[int]:
    """The cuts that ``viterbi`` gives, in time and memory that grow with the word alone: for words too long for a lattice in one row."""
    best, back = [0.0], [0]
    for b in range(1, len(word) + 1):
        top, at = -math.inf, b - 1
        for a in range(max(0, b - longest), b):  # of equal paths the one whose last piece begins first
            score = scores.get(word[a:b], UNKNOWN_SCORE if b - a == 1 else None)
            if score is not None and best[a] + score > top:
                top, at = best[a] + score, a
        best.append(top)
        back.append(at)
    cuts = [len(word)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _with_paths(words: DataFrame, path: str, with_ids: bool) -> DataFrame:
    """(word, ids, n_best) of long words: n_best from the best path of the whole word, ids too if asked for."""
    pieces, spec = model_spec(path)
    ranked = sorted(pieces, key=lambda x: (-x[2], x[1]))  # bytes too, as ``with_ranks``
    scores = {p: -math.log(k + 2.0) if spec["kind"] == "bpe" else score for k, (p, _, score, byte) in enumerate(ranked) if byte is None}
    known, longest = {p: i for p, i, _, byte in pieces if byte is None}, max(map(len, scores))
    first_byte = next((i for _, i, _, byte in pieces if byte == 0), None) if spec["fallback"] else None
    shared = words.sparkSession.sparkContext.broadcast((scores, known))  # the piece table, of a fixed size

    def coded(text: str) -> list[int]:
        if text in shared.value[1]:
            return [shared.value[1][text]]
        return [spec["unk"]] if first_byte is None else [first_byte + b for b in text.encode()]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, word in enumerate(batch.column(0).to_pylist()):
                cuts = best_path(word, shared.value[0], longest)
                ids = pa.array([[i for a, b in zip(cuts, cuts[1:]) for i in coded(word[a:b])]], pa.list_(pa.int32())) if with_ids else batch.column(1).slice(k, 1)
                yield pa.RecordBatch.from_arrays([pa.array([word]), ids, pa.array([len(cuts) - 1], pa.int32())], ["word", "ids", "n_best"])

    rows = words.select("word", F.lit(None).cast("array<int>").alias("ids")) if with_ids else words.select("word", "ids")
    return rows.mapInArrow(make, "word string, ids array<int>, n_best int")


def encode_words(words: DataFrame, spark: SparkSession, path: str, fold: str | None = None, step: int = CHUNK_STEP, overlap: int = CHUNK_OVERLAP, carried: str | None = None) -> DataFrame:
    """(word, ids, n_best) of distinct words, and their column ``carried``; ``fold`` is ``merges`` for merge models, ``viterbi`` for unigram ones.

    Words of over ``step + overlap`` characters are too long for a lattice in one row. Their Viterbi path is found by
    ``best_path``. For merges they are encoded in chunks that overlap, and spliced at the first token that both
    chunks have at the same place. That is exact: ids are those of the whole word if each two neighbours are what
    their joint text is merged to, and every two neighbours stand side by side in one chunk. Where two chunks share
    no token, the word is done again with chunks and overlaps four times as long, up to the whole word.
    """
    fold = fold or {"bpe": "merges", "unigram": "viterbi"}[model_spec(path)[1]["kind"]]
    short = words.where(F.char_length("word") <= step + overlap)
    done = _tokenised(short, spark, path, fold, carried)
    held = words.where(F.char_length("word") > step + overlap)
    long = held.select("word")

    def with_held(part: DataFrame) -> DataFrame:
        return part.join(held.select("word", carried), "word") if carried else part

    if fold == "viterbi":
        return done.unionByName(with_held(_with_paths(long, path, True)))
    left = common.stored(long.withColumn("wid", F.monotonically_increasing_id()), "long-words")
    parts = []
    while left.limit(1).count():
        size = F.char_length("word")
        last = F.greatest(F.ceil((size - overlap) / step).cast("int") - 1, F.lit(0))
        chunks = left.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
        chunks = chunks.select("wid", "k", F.substring(F.col("word"), F.col("k") * step + 1, F.when(F.col("k") < last, F.lit(step + overlap)).otherwise(size)).alias("part"))
        coded = _tokenised(chunks.select(F.col("part").alias("word")).distinct(), spark, path, fold, places=True)
        coded = common.stored(chunks.join(coded, chunks["part"] == coded["word"]).select("wid", "k", F.transform("tokens", lambda t: F.struct((t["a"] + F.col("k") * step).alias("a"), (t["b"] + F.col("k") * step).alias("b"), t["ids"].alias("ids"))).alias("tokens")), "word-chunks")
        after = coded.select("wid", (F.col("k") - 1).alias("k"), F.col("tokens").alias("next"))
        shared = F.filter("tokens", lambda t: F.exists("next", lambda n: (n["a"] == t["a"]) & (n["b"] == t["b"])))
        cuts = coded.join(after, ["wid", "k"]).select("wid", (F.col("k") + 1).alias("k"), F.get(shared, F.lit(0))["a"].alias("cut"))
        cuts = common.stored(cuts, "word-splices")
        failed = cuts.where("cut is null").select("wid").distinct()
        good = coded.join(failed, "wid", "left_anti")
        good = good.join(cuts.withColumnRenamed("cut", "from"), ["wid", "k"], "left").join(cuts.select("wid", (F.col("k") - 1).alias("k"), F.col("cut").alias("to")), ["wid", "k"], "left")
        own = F.filter("tokens", lambda t: (t["a"] >= F.coalesce("from", F.lit(0))) & (F.col("to").isNull() | (t["a"] < F.col("to"))))
        whole = good.select("wid", "k", F.flatten(F.transform(own, lambda t: t["ids"])).alias("ids")).groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        parts.append(left.join(whole, "wid").select("word", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")))
        left = common.stored(left.join(failed, "wid", "left_semi"), "long-words")
        step, overlap = 4 * step, 4 * overlap
    for part in parts:
        done = done.unionByName(with_held(_with_paths(part, path, False)))
    return done


def words_of(text: str | None, prefix: bool, joined: str = "") -> list[str]:
    """What ``split_words`` gives for one text."""
    marked = (text or "").replace(" ", SPACE)
    return re.findall(word_pattern(joined), (SPACE if prefix else "") + marked) if marked else []


def chunks_of(text: str | None, prefix: bool) -> list[str]:
    """A text cut after its runs of non-spaces; ``words_of_chunk`` gives the words of each, which together are ``words_of`` the text."""
    if not text:
        return []
    if prefix and SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
        return text.split(" ")
    found = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", (SPACE if prefix else "") + text.replace(" ", SPACE))
    return [c[1:] for c in found] if prefix else found  # with a prefix every chunk begins with a space, which is left out


def words_of_chunk(chunk: str, prefix: bool, joined: str = "") -> list[str]:
    return re.findall(word_pattern(joined), (SPACE if prefix else "") + chunk)


def _chunks(texts: pa.Array, prefix: bool) -> tuple[pa.Array, np.ndarray]:
    """``chunks_of`` some texts, one after the other, and how many each has; plain texts are cut by Arrow."""
    texts = pc.fill_null(texts, "")
    odd = [pc.match_substring(texts, SPACE), pc.match_substring(texts, "  "), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.equal(texts, "")]
    odd = np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in odd]) | (not prefix)
    found = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    if odd.any():
        other = pa.array([chunks_of(t, prefix) for t in texts.filter(pa.array(odd)).to_pylist()], found.type)
        place = np.empty(len(texts), np.int64)
        place[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
        found = pa.concat_arrays([found, other]).take(pa.array(place))
    return found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False)


def _words(chunks: pa.Array, prefix: bool, joined: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some chunks in any order, and for each chunk the place of its first, which the others follow, and their number."""
    one = np.zeros(len(chunks), bool)
    if joined:  # most are a single word
        one = pc.match_substring_regex(chunks, rf"\A{SPACE}*[{re.escape(joined)}]+\z").to_numpy(zero_copy_only=False)
    whole = chunks.filter(pa.array(one))
    if prefix:
        whole = pc.binary_join_element_wise(pa.scalar(SPACE, chunks.type), whole, pa.scalar("", chunks.type))
    other = [words_of_chunk(c, prefix, joined) for c in chunks.filter(pa.array(~one)).to_pylist()]
    n = np.ones(len(chunks), np.int64)
    n[~one] = [len(own) for own in other]
    first = np.empty(len(chunks), np.int64)
    first[one], first[~one] = np.arange(len(whole)), len(whole) + _bounds(n[~one])[:-1]
    return pa.concat_arrays([whole, pa.array([w for own in other for w in own], chunks.type)]), first, n


def _asked_words(rows: DataFrame, text_col: str, prefix: bool, joined: str) -> DataFrame:
    """(group, word): the distinct words of each stretch of rows; several times where a group comes in several stretches."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, chunks, size = None, [], 0

        def words() -> Iterator[pa.RecordBatch]:
            if chunks:
                own = _words(pa.chunked_array(chunks).unique(), prefix, joined)[0].unique()
                own = own.take(pc.array_sort_indices(own))  # sorted text is smaller on disk
                for k in range(0, len(own), _ROWS):
                    part = own.slice(k, _ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), group, np.int32)), part], [_GROUP, "word"])
                chunks.clear()

        for batch in batches:
            groups, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in _in_stretches(groups, sizes):
                if groups[a] != group or size > 2 * GROUP_BYTES:
                    yield from words()
                    group, size = groups[a], 0
                chunks.append(_chunks(texts.slice(a, b - a), prefix)[0].unique())
                size += sum(sizes[a:b])
        yield from words()

    return rows.select(_GROUP, text_col).mapInArrow(make, f"{_GROUP} int, word string")


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, .. of runs of lengths ``n``, one run after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _bounds(n: np.ndarray | list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


class _Answers:
    """The answers of one group: ids and number of Viterbi pieces of its words."""

    def __init__(self, path: str, group: int, prefix: bool, joined: str):
        files, root = pa.fs.FileSystem.from_uri(f"{path}/{_GROUP}={group}")
        found = files.get_file_info(pa.fs.FileSelector(root, allow_not_found=True))
        tables = [pq.ParquetFile(files.open_input_file(f.path)).read(["word", "ids", "n_best"]) for f in found if f.path.endswith(".parquet")]
        columns = {name: [c for table in tables for c in table[name].chunks] for name in ("word", "ids", "n_best")}
        self.words = pa.concat_arrays(columns["word"]) if columns["word"] else pa.array([], pa.string())
        self.ids = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in columns["ids"])])
        self.bounds = _bounds(np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in columns["ids"])]))
        self.best = np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in columns["n_best"])])
        self.prefix, self.joined = prefix, joined

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """ids and n_best of some texts; each distinct chunk of them is looked up once."""
        chunks, n_chunks = _chunks(texts, self.prefix)
        coded = chunks.dictionary_encode()
        words, first, n_words = _words(coded.dictionary, self.prefix, self.joined)
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            raise ValueError("texts have changed between the two times they were read")
        at, of_chunk = at.to_numpy().astype(np.int64)[_spread(first, n_words)], _bounds(n_words)
        n = self.bounds[at + 1] - self.bounds[at]
        chunk_ids, chunk_best = self.ids[_spread(self.bounds[at], n)], np.diff(_bounds(self.best[at])[of_chunk])
        chunk_bounds, asked, of_text = _bounds(n)[of_chunk], coded.indices.to_numpy(), _bounds(n_chunks)
        n = np.diff(chunk_bounds)[asked]
        ids, best = chunk_ids[_spread(chunk_bounds[asked], n)], _bounds(chunk_best[asked])
        return pa.ListArray.from_arrays(pa.array(_bounds(n)[of_text], pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(best[of_text]), pa.int64())


def _in_stretches(groups: list[int], sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Row ranges of one group each and of about ``_STRETCH`` bytes at most."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and (groups[k] != groups[start] or total + size > _STRETCH):
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _answered(rows: DataFrame, schema: StructType, text_col: str, answers: str, prefix: bool, joined: str, then: _Step | None = None) -> DataFrame:
    """``rows`` less their group, with ids and n_best put together from the answers that their groups have in the shared folder, and what ``then`` adds to them."""
    names = [f.name for f in schema.fields][: len(rows.columns) + 1]
    at, text_at = rows.columns.index(_GROUP), rows.columns.index(text_col)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = None, None
        for batch in batches:
            groups, texts = batch.column(at).to_pylist(), batch.column(text_at)
            for a, b in _in_stretches(groups, pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                if groups[a] != group:
                    known = None  # before the next is read
                    group, known = groups[a], _Answers(answers, groups[a], prefix, joined)
                coded = known.encode(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for k, c in enumerate(batch.columns) if k != at), *coded], names)

    return rows.mapInArrow((lambda batches: then(make(batches))) if then else make, schema)


def encode(texts: DataFrame, path: str | None = None, text_col: str = "text", fold: str | None = None, decoded: bool = False) -> DataFrame:
    """``texts`` with columns ``ids`` (array<int>), the ids that the SentencePiece library gives for the whole text, and ``n_best``.

    ``n_best`` is the number of pieces on the Viterbi paths of its words: of a unigram model itself, or, for a merge
    model, of the unigram model with the same pieces whose probabilities fall with their rank. With ``decoded`` the same
    tasks ``decode`` the ids too, a stretch of rows at a time, so that texts and ids are not handed over once more.

    Rows are dealt to groups of bounded text (beyond it only where one and the same row repeats): by the stretch of the
    file that they come from, and by a hash of all their columns. A group asks once for each of its distinct words, and each distinct word of all groups is encoded once; so occurrences are never shuffled, and a frequent word
    costs no more than a rare one. Answers are written to the shared folder by group, and the task that reads a group's
    texts reads them there (by pyarrow, which must know the folder's file system), so texts are not shuffled. Rows
    that come from no file are stored first. ``texts`` is
    read twice and must give the same rows each time. A null or empty text has no ids; repeated rows are kept, null
    identifiers are like any other; existing columns ``ids`` and ``n_best`` are replaced, others of any name kept. An
    empty table gives an empty result. Long words, such as texts without spaces, are encoded in chunks (see
    ``encode_words``).
    """
    spark, path = texts.sparkSession, path or default_path()
    prefix, joined, kept = model_spec(path)[1]["prefix"], joined_characters(path), texts.drop("ids", "n_best", *(["decoded"] if decoded else []))
    sizes = F.sum(F.octet_length(text_col)).alias("size"), F.count_distinct("block").alias("blocks"), F.min(F.length("file")).alias("named")
    block, file = F.xxhash64(F.input_file_name(), F.input_file_block_start()), F.input_file_name().alias("file")
    found = kept.select(text_col, block.alias("block"), file).agg(*sizes).first()
    if found["named"] == 0:
        kept = common.stored(kept, "texts")
        found = kept.select(text_col, block.alias("block"), file).agg(*sizes).first()
    # rows of one stretch of a file share most words; a hash of the row deals those of large stretches
    hashed = F.xxhash64(*(c for c, kind in kept.dtypes if "map<" not in kind))
    parts = max(1, math.ceil((found["size"] or 0) / GROUP_BYTES / max(1, found["blocks"])))
    rows = kept.withColumn(_GROUP, F.hash(block, F.pmod(hashed, F.lit(parts))))  # two groups of one number share their words
    rows = rows.sortWithinPartitions(_GROUP) if parts > 1 else rows
    asked = common.stored(_asked_words(rows, text_col, prefix, joined), "asked-words")
    tasks = max(1, math.ceil(asked.agg(F.approx_count_distinct("word", 0.02)).first()[0] / WORDS_PER_TASK))
    dealt = asked.repartition(tasks, "word").groupBy("word").agg(F.collect_set(_GROUP).alias("groups"))
    known = encode_words(dealt, spark, path, fold, carried="groups").select(F.explode("groups").alias(_GROUP), "word", "ids", "n_best")
    answers = new_path(spark, "answers")
    known.repartition(_GROUP).sortWithinPartitions(_GROUP, "word").write.partitionBy(_GROUP).parquet(answers)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("ids array<int>, n_best long" + (", decoded string" if decoded else "")).fields])
    return _answered(rows, schema, text_col, answers, prefix, joined, _joiner(spark, path, [*kept.columns, "ids", "n_best"], "ids") if decoded else None)


def _joiner(spark: SparkSession, path: str, names: list[str], ids_col: str) -> _Step:
    """Adds ``decoded`` to batches of the columns ``names``."""
    pieces, spec = model_spec(path)
    known = {i: bytes([byte]) if byte is not None else p.encode() for p, i, _, byte in pieces}
    own_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
    own_bytes.append(b"")  # of ids without text
    shared = spark.sparkContext.broadcast(pa.array(own_bytes, pa.binary()))  # the piece table, of a fixed size
    prefix, at = spec["prefix"], names.index(ids_col)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, nothing = shared.value, len(shared.value) - 1
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()
            for a, b in _in_stretches([0] * len(lengths), [4 * n for n in lengths]):
                ids = pc.fill_null(batch.column(at).slice(a, b - a).flatten(), -1).to_numpy(zero_copy_only=False)
                raw, ends = common.raw_bytes(known.take(pa.array(np.where((ids >= 0) & (ids < nothing), ids, nothing))).cast(pa.large_binary()))
                ends = ends[_bounds(lengths[a:b])]
                found = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(ends), pa.py_buffer(raw))
                try:
                    found.validate(full=True)
                except pa.ArrowInvalid:  # bytes that are no text
                    found = pa.array([raw[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(ends, ends[1:])], pa.large_string())
                found = pc.replace_substring(found, SPACE, " ").cast(pa.string())
                if prefix:
                    found = pc.if_else(pc.starts_with(found, " "), pc.utf8_slice_codeunits(found, 1), found)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), found], [*names, "decoded"])

    return join


def decode(coded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``coded`` with a column ``decoded``: the text of its ids.

    The pieces' bytes, byte pieces included, are joined in order; U+2581 becomes a space, and the one that encoding
    puts first is left out. Ids without text (control, unknown, out of range) give nothing; null ids give an empty
    text. Repeated rows are kept; an existing column ``decoded`` is replaced, others of any name are kept; an empty
    table gives an empty result. No shuffle.
    """
    kept = coded.drop("decoded")
    join = _joiner(coded.sparkSession, path or default_path(), kept.columns, ids_col)
    return kept.mapInArrow(join, StructType([*kept.schema.fields, StructField("decoded", StringType())]))


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, decoded=True)
    same = F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" ")) == F.col("decoded")
    return done.select("doc_id", F.size("ids").alias("n_tokens"), "ids", same.alias("round_trip"), F.col("n_best").alias("n_viterbi"))
