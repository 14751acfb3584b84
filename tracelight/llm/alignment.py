"""Cross-tokenizer alignment: byte groups that two tokenizers cut alike, links of overlapping tokens and their corpus counts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

#: Commonest id pairs whose counts every task gets at 16 bytes each; all others meet their counts in a join.
MOST_PAIRS = 1 << 20
#: Every so many-th end of the shorter list is searched first, those between from its place.
STRIDE = 16
#: Stretches and ids that a task keeps at most, and characters that are encoded in one call.
MOST_UNITS, MOST_IDS, CALL_CHARS = 1 << 19, 1 << 22, 1 << 16
#: A stretch ends before each space that follows a character other than white space. No token of either tokenizer goes
#: on there, so both encode one stretch like another wherever it stands.
_UNIT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
_CUT = re.compile(r"(?<=\S) ")
#: A pair of ids is one number: A's shifted by so many bits, and B's.
PAIR_BITS = 20


def ranks(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each value of ``few`` the number of smaller ones in ``many`` (both increasing), by galloping.

    Every ``STRIDE``-th value is searched first, in the same way. The others start at the place of the one before them:
    a search doubles its step until it has passed its value, then halves the last one. All go in step with each other.
    """
    n = len(many)
    before = np.repeat(ranks(few[::STRIDE], many), STRIDE)[: len(few)] if len(few) > 1 else np.zeros(len(few), np.int64)
    step = np.ones(len(few), np.int64)
    going, at, value = np.arange(len(few)), before, few
    for k in range(64):
        ahead = at + (1 << k)
        short = ahead < n
        short[short] = many[ahead[short]] < value[short]
        going, at, value = going[short], at[short], value[short]
        if not len(going):
            break
        step[going] = 2 << k
    low, high = before + (step >> 1) * (step > 1), np.minimum(before + step, n)
    out, going, value = low.copy(), np.arange(len(few)), few
    while len(going):
        middle = low + high >> 1
        less = low < high
        less[less] = many[middle[less]] < value[less]
        low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(middle, high))
        done = low >= high
        out[going[done]] = low[done]
        left = ~done
        going, low, high, value = going[left], low[left], high[left], value[left]
    return out


class Alignment:
    """Groups and links of two tokenizations of the same bytes, given the ends of their tokens."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray):
        swap = len(a_ends) > len(b_ends)
        few, many = (b_ends, a_ends) if swap else (a_ends, b_ends)
        rank = ranks(few, many)
        common_end = many[rank] == few  # both lists end at the last byte, so a rank is a place
        self.few_common, self.many_common = np.flatnonzero(common_end), rank[common_end]
        # a token of few overlaps those of many from the first that ends after its start to the first that ends at or after its end
        first = np.append(0, rank[:-1] + common_end[:-1])
        width = rank - first + 1
        f = np.repeat(np.arange(len(few)), width)
        m = np.arange(len(f)) - np.repeat(np.cumsum(width) - width, width) + first[f]
        self.a_common, self.b_common = (self.many_common, self.few_common) if swap else (self.few_common, self.many_common)
        self.a, self.b = (m, f) if swap else (f, m)


class Digits:
    """Decimal forms of ids below ``n``, with room for one byte after each."""

    def __init__(self, n: int):
        text = np.char.mod("%d", np.arange(n)).astype("S")
        self.width = text.dtype.itemsize + 1
        self.size = np.char.str_len(text)
        self.table = np.zeros((n, self.width), np.uint8)
        self.table[:, :-1] = text.view(np.uint8).reshape(n, -1)
        self.shown = np.arange(self.width) <= self.size[:, None]

    def joined(self, ids: np.ndarray, after: np.ndarray) -> bytes:
        """The ids, each followed by its byte of ``after``."""
        rows = self.table[ids]
        rows[np.arange(len(ids)), self.size[ids]] = after
        return rows[self.shown[ids]].tobytes()


def groups_text(a: np.ndarray, b: np.ndarray, aligned: Alignment, digits: Digits) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``: the ids of each group in order, and the place after each group."""
    a_ends, b_ends = aligned.a_common + 1, aligned.b_common + 1
    a_sizes, b_sizes = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    ids = np.empty(len(a) + len(b), np.int64)
    a_at = np.arange(len(a)) + np.repeat(b_ends - b_sizes, a_sizes)
    b_at = np.arange(len(b)) + np.repeat(a_ends, b_sizes)
    ids[a_at], ids[b_at] = a, b
    after = np.full(len(ids), ord(","), np.uint8)
    after[a_at[aligned.a_common]] = ord("|")
    after[b_at[aligned.b_common]] = ord(";")
    ends = np.cumsum(digits.size[ids] + 1)
    return digits.joined(ids, after), ends[b_at[aligned.b_common]]


class Pair:
    """Both tokenizers over the same texts, A with a space before each and B, which adds that space itself."""

    def __init__(self, bpe_path: str, piece_path: str):
        self.a = bpe.load(bpe_path, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.entries = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [self.a.sizes, np.fromiter(map(len, self.entries), np.int64, len(pieces))]
        if any(re.search("[^\u2581]\u2581", p) for p in pieces) or len(pieces) > 1 << PAIR_BITS:
            raise ValueError("pieces of the second tokenizer must end at a word's end and number at most 2 ** 20")
        self.digits = Digits(max(len(self.a.entries), len(pieces)))
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat = [np.zeros(1 << 16, np.int64) for _ in range(2)]
        self.used = [0, 0]
        self.start = [np.zeros(1 << 12, np.int64) for _ in range(2)]
        self.size = [np.zeros(1 << 12, np.int64) for _ in range(2)]  # of B -1 where bytes differ from the text's

    def _keep(self, units: list[str], side: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of new stretches, ``sizes`` of them for each."""
        end, last = self.used[side] + len(ids), len(self.codes) + len(units)
        while end > len(self.flat[side]):
            self.flat[side] = np.concatenate([self.flat[side], np.zeros_like(self.flat[side])])
        while last > len(self.start[side]):
            for kept in (self.start, self.size):
                kept[side] = np.concatenate([kept[side], np.zeros_like(kept[side])])
        self.flat[side][self.used[side] : end] = ids
        self.start[side][len(self.codes) : last] = self.used[side] + np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        self.size[side][len(self.codes) : last] = sizes
        self.used[side] = end

    def _learn(self, units: list[str]) -> None:
        """Encode new stretches together; one by one where bytes differ."""
        text = "".join(units)
        body = text.encode()
        a = self.a.ids(text).astype(np.int64)
        b = np.array(self.b.encode(text[1:]) if len(text) > 1 else [self.b.piece_to_id("\u2581")], np.int64)
        cuts = np.cumsum([len(u.encode()) for u in units])
        if b"".join(map(self.a.entries.__getitem__, a.tolist())) == body and b"".join(map(self.entries.__getitem__, b.tolist())) == body:
            for side, ids in enumerate((a, b)):
                self._keep(units, side, ids, np.diff(np.searchsorted(np.cumsum(self.sizes[side][ids]), cuts) + 1, prepend=0))
        elif len(units) > 1:
            for unit in units:
                self._learn([unit])
            return
        else:
            self._keep(units, 0, a[:0], np.zeros(1, np.int64))
            self._keep(units, 1, b[:0], np.full(1, -1))
        for unit in units:
            self.codes[unit] = len(self.codes)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts one after the other and their numbers for each text, of A and of B.

        A text that is empty, or where the joined bytes of either differ from the text with a space before it, has none.
        """
        if len(self.codes) > MOST_UNITS or max(self.used) > MOST_IDS:
            self._forget()
        units = [_UNIT.findall(" " + t) if t else [] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(own) for own in units])
        flat = list(chain.from_iterable(units))
        codes = np.fromiter(map(self.codes.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0).tolist()
        new: list[str] = []
        chars = 0
        for unit in dict.fromkeys(map(flat.__getitem__, missing)):
            if unit[-1].isspace():  # the end of a text; nothing may follow it
                self._learn([unit])
                continue
            if new and chars + len(unit) > CALL_CHARS:
                self._learn(new)
                new, chars = [], 0
            new.append(unit)
            chars += len(unit)
        if new:
            self._learn(new)
        codes[missing] = [self.codes[flat[i]] for i in missing]
        good = np.ones(len(texts), bool)
        good[owner[self.size[1][codes] < 0]] = False
        codes, owner = codes[good[owner]], owner[good[owner]]
        ids, numbers = [], []
        for side in range(2):
            size = self.size[side][codes]
            places = np.repeat(self.start[side][codes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            ids.append(self.flat[side][places])
            numbers.append(np.bincount(owner, size, len(texts)).astype(np.int64))
        return ids, numbers


@lru_cache(maxsize=2)
def load(bpe_path: str, piece_path: str) -> Pair:
    """One pair for each Python worker and files."""
    return Pair(bpe_path, piece_path)


def segments(text: str, most_bytes: int = common.STEP_BYTES) -> Iterator[str]:
    """Parts of a text at ends of stretches, where tokens of both end as well: encoded one by one they give what the whole gives.

    A stretch longer than ``most_bytes`` characters is not cut.
    """
    start = 0
    while len(text) - start > most_bytes:
        cut = _CUT.search(text, start + most_bytes)
        if cut is None or cut.end() == len(text):  # a space at the end needs what is before it
            break
        yield text[start : cut.start()]
        start = cut.end()  # the space is put first again
    yield text[start:]


class _Measured:
    """Numbers, group text and id pairs of some texts."""

    def __init__(self, pair: Pair, texts: list[str]):
        (a, b), (self.n_a, self.n_b) = pair.encode(texts)
        aligned = Alignment(np.cumsum(pair.sizes[0][a]), np.cumsum(pair.sizes[1][b]))
        self.text, ends = groups_text(a, b, aligned, pair.digits)
        docs = len(texts)
        a_owner = np.repeat(np.arange(docs), self.n_a)
        self.n_groups = np.bincount(a_owner[aligned.a_common], minlength=docs)
        self.last = np.append(0, ends)[np.cumsum(self.n_groups)]
        link_owner = a_owner[aligned.a]
        self.n_links = np.bincount(link_owner, minlength=docs)
        self.pairs, self.times = np.unique(link_owner << 2 * PAIR_BITS | a[aligned.a] << PAIR_BITS | b[aligned.b], return_counts=True)

    def groups(self) -> Iterator[bytes]:
        """The group text of each text."""
        for first, last in zip([0, *self.last[:-1].tolist()], self.last.tolist()):
            yield self.text[first : last - 1] if last > first else b""


def _huge(pair: Pair, text: str, most_bytes: int) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    """Numbers, digest, id pairs and their times of a text that is measured segment by segment."""
    numbers, digest, known, times = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for segment in segments(text, most_bytes):
        own = _Measured(pair, [segment])
        if not own.n_a[0]:
            return [0] * 4, "", known[:0], times[:0]
        digest.update((b";" if numbers.any() else b"") + next(own.groups()))
        numbers += [own.n_a[0], own.n_b[0], own.n_groups[0], own.n_links[0]]
        known, at = np.unique(np.concatenate([known, own.pairs]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, own.times])).astype(np.int64)
    return numbers.tolist(), digest.hexdigest(), known, times


def _aligned(rows: DataFrame, paths: tuple[str, str], most_bytes: int) -> DataFrame:
    """Numbers of tokens, groups and links of each row, the digest of its groups, its id pairs and how often each is linked."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(*paths)
        for batch in batches:
            col = common.text_column(batch, "text")
            _, at = common.raw_bytes(col)
            for start, end in common.steps(at, most_bytes):
                if at[end] - at[start] > most_bytes:  # one text
                    numbers, digest, pairs, times = _huge(pair, col[start].as_py(), most_bytes)
                    made, digests, places = [[x] for x in numbers], [digest], [0, len(pairs)]
                else:
                    own = _Measured(pair, col.slice(start, end - start).to_pylist())
                    made = [own.n_a, own.n_b, own.n_groups, own.n_links]
                    digests = [hashlib.sha256(x).hexdigest() if x else "" for x in own.groups()]
                    places = np.searchsorted(own.pairs, np.arange(end - start + 1) << 2 * PAIR_BITS)
                    pairs, times = own.pairs & (1 << 2 * PAIR_BITS) - 1, own.times
                columns = [pa.array(np.asarray(x, np.int64)) for x in made] + [pa.array(digests, pa.string())]
                columns += [pa.ListArray.from_arrays(pa.array(np.asarray(places, np.int32)), pa.array(x)) for x in (pairs, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, end - start) for k in (0, 1)), *columns], ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    added = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return rows.mapInArrow(make, f"doc_id long, row long, {added}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows an id pair is linked, and whether no pair of its A id is in more."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    counts = aligned.select("pairs").mapInArrow(make, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = common.stored(counts.withColumn("a", F.shiftright("pair", PAIR_BITS)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most A's vocabulary
    return common.stored(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _commonest(counts: DataFrame, most_pairs: int) -> DataFrame:
    """The pairs above the least eighth of a power of two beyond which there are at most ``most_pairs``."""
    level = F.floor(8 * F.log2("n")).cast("int")
    left, least = most_pairs, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).orderBy(F.desc("level")).collect():  # at most 504 rows
        left -= row["pairs"]
        if left < 0:
            break
        least = row["level"]
    return counts.where(F.lit(False) if least is None else level >= least)


def align(
    docs: DataFrame,
    bpe_path: str | None = None,
    piece_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_pairs: int = MOST_PAIRS,
    most_bytes: int = common.STEP_BYTES,
) -> DataFrame:
    """Alignment of two tokenizations of every whole text, one row per input row.

    A is a byte-level BPE file over the text with a space before it, B a SentencePiece BPE model over the text, which
    adds that space; strings of special tokens are ordinary text. Byte offsets where tokens of both end cut them
    into groups; tokens whose bytes overlap are links. Returned: doc_id, n_a and n_b (tokens), n_groups, n_links,
    n_best (links of an id pair that no other pair of the same A id exceeds in the number of rows it is linked in),
    count_sum (those numbers summed over links) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    Null and empty texts, and those where the joined token bytes of A or B differ from the text's (B takes U+2581
    for a space), have zeros and an empty digest. A null identifier stays null, repeated rows count each and give
    repeated results, an empty table gives none, further columns are not read. ``most_pairs`` pairs at most are
    broadcast; all others meet their counts in a join, which gives the same. A text of more than ``most_bytes`` is
    measured segment by segment, so memory does not grow with it but for stretches without a space and its distinct id pairs.
    """
    paths = bpe_path or bpe.default_path(), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), docs[text_col].alias("text"))
    aligned = common.stored(_aligned(rows, paths, most_bytes), "aligned")
    counts = pair_counts(aligned)
    known = _commonest(counts, most_pairs).toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast([known[c].to_numpy() for c in ("pair", "n", "best")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_pairs, known_n, known_best = shared.value
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy() for k in (6, 7))
            sizes = np.diff(batch.column(6).offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.searchsorted(known_pairs, pairs)
            found = np.zeros(len(pairs), bool)
            if len(known_pairs):
                found = known_pairs[np.minimum(at, len(known_pairs) - 1)] == pairs
            n_best, count_sum = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            own, many, at = owner[found], times[found].astype(np.int64), at[found]
            np.add.at(count_sum, own, many * known_n[at])
            np.add.at(n_best, own, many * known_best[at])
            ends = pa.array(np.append(0, np.cumsum(np.bincount(owner[~found], minlength=batch.num_rows))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(ends, pa.array(x[~found])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(n_best), pa.array(count_sum), *rest, batch.column(8)], names)

    names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "pairs", "times", "groups_sha256"]
    added = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, pairs array<long>, times array<int>, groups_sha256 string"
    source = aligned.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", "groups_sha256")
    scored = common.stored(source.mapInArrow(score, added), "scored")
    rest = scored.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    filled = scored.where(F.size("pairs") > 0).join(rest, "row").withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    return scored.where(F.size("pairs") == 0).select(*out).union(filled.select(*out))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.read(spark, sf_dir, "documents"))
