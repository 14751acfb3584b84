"""The corpus operators against brute force, on small frames with nulls, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tracelight.llm import ann, bpe, common, components, exact_dedup, golay, language_id, line_dedup, minhash, packing, quality, registry, sentence_pieces, simhash, token_counts, toxicity

ODD = "special <|endoftext|> 日本 ﬁ 0x41   tab\tend"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [words(rng, rng.randint(1, 300)) for _ in range(60)]
    out += [None, "", " \n\t ", ODD, "x" * 5000, out[0], out[0] + " ", "\n".join(out[:3]), words(rng, 40_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "src", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int, run int, ids int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def full(texts):
    return [t or "" for t in texts]


# --- 9 and 2: tokens ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_both_libraries_agree_on_every_code_point(library):
    encoder = bpe.load(bpe.default_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 50_000):
        batch = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}.{chr(c)}  {chr(c)}\n {chr(c)}'s" for c in points[i : i + 50_000]]
        for text, want in zip(batch, library.encode_batch(batch, add_special_tokens=False)):
            assert encoder.ids(text).tolist() == want.ids


def test_chunks_splice_to_the_whole_encoding(library):
    rng = random.Random(1)
    encoder = bpe.load(bpe.default_path())
    for alphabet in ("ab é日 \n\t'", "abc   ", "ab"):
        text = "".join(rng.choices(alphabet, k=3000)) + " <|endoftext|> end"
        want = library.encode(text, add_special_tokens=False).ids
        for chunk, overlap in ((64, 1), (64, 16), (500, 200)):
            assert encoder.ids(text, chunk, overlap).tolist() == want
            assert encoder.count(text, chunk, overlap) == len(want)


def test_token_counts(docs, texts, empty, library):
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, chunk_chars=1000, overlap_chars=8).collect()}
    for i, t in enumerate(full(texts)):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 512)
    assert token_counts.token_counts(empty).count() == 0


def test_packing(docs, texts, empty, library):
    rows = packing.pack_documents(docs, {"crc": F.crc32("ids")}, shard_pieces=40).toPandas()
    for i, t in enumerate(full(texts)):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        own = rows[rows["doc_id"] == i].sort_values("piece")
        assert own["length"].sum() == len(ids) and own["length"].max() <= 1024
        if len(ids) > 1024:
            assert (own["length"].iloc[1:] == 1024).all()
        else:
            assert len(own) == 1
        for r in own.itertuples():
            assert r.crc == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist() and own["length"].sum() <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_sum_of_squares_is_near_the_lower_bound():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1024, 5000)
    bins, offsets = packing.sum_of_squares(sizes)
    filled = np.bincount(bins, sizes)
    assert filled.max() <= 1024 and len(filled) <= 1.02 * sizes.sum() / 1024 + 1 + (sizes > 512).sum() * 0.02
    for b in range(0, len(filled), 97):
        own = np.argsort(offsets[bins == b])
        assert np.array_equal(offsets[bins == b][own], np.append(0, np.cumsum(sizes[bins == b][own]))[:-1])


def test_each_piece_goes_where_the_squares_become_smallest():
    rng = np.random.default_rng(5)
    for capacity, n in ((20, 120), (64, 200)):
        sizes = rng.integers(1, capacity, n)
        gaps: list[int] = []  # of all bins, full ones too
        for s in sorted(sizes.tolist(), reverse=True):

            def squares(i):
                after = [g - s * (k == i) for k, g in enumerate(gaps)]
                return sum(c * c for g, c in zip(*np.unique([g for g in after if g], return_counts=True)))

            fitting = [(squares(i), g, i) for i, g in enumerate(gaps) if g >= s]
            if fitting:
                gaps[min(fitting)[2]] -= s
            else:
                gaps.append(capacity - s)
        bins, _ = packing.sum_of_squares(sizes, capacity)
        assert sorted(np.bincount(bins, sizes).astype(int).tolist()) == sorted(capacity - g for g in gaps)


def test_packing_of_repeated_rows_and_null_identifiers(spark):
    rows = spark.createDataFrame([(None, "a b c", 1)] * 3 + [(7, "same text", 2)] * 90, "doc_id long, text string, length int")
    got = packing.pack_documents(rows, shard_pieces=10).toPandas()
    assert len(got) == 93 and got["doc_id"].isna().sum() == 3
    assert not got.duplicated(["sequence_id", "offset"]).any() and got["sequence_id"].nunique() < 93
    with pytest.raises(ValueError):
        packing.pack(rows.withColumn("offset", F.lit(1)))


def test_token_counts_of_repeated_rows_and_null_identifiers(spark):
    rows = spark.createDataFrame([(None, "one two", 1), (3, "one two", 2), (3, "one two", 3)], "doc_id long, text string, n_tokens int")
    got = token_counts.token_counts(rows).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == [(-1, 2), (3, 2), (3, 2)] and got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}


# --- 10: exact copies -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_dedup(spark, docs, texts, empty, partitions):
    hot = spark.createDataFrame([(1000 + i, "the  same\ttext", "s", 0, 0, 0) for i in range(300)], docs.schema)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs.union(hot), partitions=partitions).collect()}
    groups: dict[str, list[int]] = {}
    for i, t in [*enumerate(full(texts)), *((1000 + i, "the  same\ttext") for i in range(300))]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    assert len(got) == len(texts) + 300
    for t, own in groups.items():
        for i in own:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(own), len(own), i == min(own), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_exactly_one_row_of_equal_texts_stays(spark, partitions):
    rows = [(None, "no name"), (None, "no  name"), (None, "both"), (9, "both"), (4, "again"), (4, "again"), (5, "again"), (6, None), (6, "")] + [(8, "hot")] * 200
    got = exact_dedup.exact_dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, run string, kept int").repartition(4), partitions=partitions).collect()
    kept = sorted((r["doc_id"] is None, r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"])
    assert len(got) == len(rows)
    assert kept == [(False, 4, 4, 3), (False, 6, 6, 2), (False, 8, 8, 200), (False, 9, 9, 2), (True, None, None, 2)]


# --- 6: SimHash -----------------------------------------------------------------------------------------------------
def brute_fingerprint(text: str, k: int = 3) -> int:
    own = text.encode().lower().split()
    if not own:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(own[i : i + k]), 42) for i in range(max(1, len(own) - k + 1))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_golay_keys_are_all_codewords_within_four_bits():
    check, _ = golay.tables()
    codewords = (np.arange(4096) << 11) | check
    assert min(np.bitwise_count(codewords[1:])) == 7
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 300)
    for word, keys in zip(x, golay.keys(x)):
        near = np.flatnonzero(np.bitwise_count(codewords ^ word) <= 4)
        assert sorted(k for k in keys if k >= 0) == near.tolist()


def test_close_fingerprints_always_share_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in x], np.uint64)
    shared = np.zeros(len(x), bool)
    for t, (_, first, second, exact) in enumerate(simhash.STRICT.tables):
        pairs = [set(zip(*(a.tolist() for a in simhash.bucket_keys(v.view(np.int64), t, first, second, exact)))) for v in (x, x ^ flips)]
        for row, _ in pairs[0] & pairs[1]:
            shared[row] = True
    assert shared.all()


def test_close_fingerprints_share_a_part_of_their_free_bits():
    rng = random.Random(1)
    for t, (_, first, _, _) in enumerate(simhash.STRICT.tables):
        masks = simhash.free_parts(simhash.STRICT, t)
        held = ((1 << simhash.SEGMENTS[first]) - 1) << sum(simhash.SEGMENTS[first + 1 :])
        assert len(masks) == 3 and sum(masks) == (1 << 64) - 1 - held and all(m.bit_count() in (14, 15) for m in masks)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample([b for b in range(64) if not held >> b & 1], 2))
            assert any(x & m == y & m for m in masks)


def component_of(prints: dict[int, int], radius: int) -> dict[int, int]:
    left, out = sorted(prints), {}
    while left:
        group, queue = [left[0]], [left[0]]
        left = left[1:]
        while queue:
            x = queue.pop()
            near = [y for y in left if (prints[x] ^ prints[y]).bit_count() <= radius]
            left = [y for y in left if y not in set(near)]
            queue += near
            group += near
        out |= {x: min(group) for x in group}
    return out


@pytest.mark.parametrize("paired", [24, 1])
def test_near_duplicates(spark, docs, texts, empty, monkeypatch, paired):
    rng = random.Random(9)
    base = words(rng, 500).split()
    near = []
    for i in range(60):  # close copies, so that chains of links and large buckets arise
        own = list(base)
        own[rng.randrange(500)] = "zz"
        near.append((2000 + i, " ".join(own)))
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    if paired == 1:  # every shared bucket through spanning forests, in cells of few members
        own_links = simhash.links
        monkeypatch.setattr(simhash, "links", lambda nodes, scheme: own_links(nodes, scheme, 1, 16))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame).collect()}
    prints = {i: brute_fingerprint(t) for i, t in [*enumerate(full(texts)), *near]}
    assert {i: r["w0"] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == component_of(prints, 2)
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_scheme_finds_near_copies_and_leaves_others(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        base = words(rng, 400).split()
        rows.append((10 * i, " ".join(base)))
        own = list(base)
        for _ in range(2):
            own[rng.randrange(400)] = "changed"
        rows.append((10 * i + 1, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), simhash.SIMILAR).collect()}
    assert sum(got[10 * i + 1] == 10 * i for i in range(40)) >= 38
    assert all(got[10 * i] == 10 * i for i in range(40))


def jaccard(a: str, b: str, k: int = 5) -> float:
    x, y = ({tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} for own in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def brute_groups(rows: dict[int, str | None]) -> dict[int, int]:
    """The smallest identifier that links of five-word shingle similarity 0.8 or more reach, from all pairs."""
    sets = {}
    for i, t in rows.items():
        own = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(rows):
        for b in (b for b in rows if b > a):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {i: find(i) for i in rows}


def planted(rng, at: float) -> tuple[str, str]:
    """A text of 300 words and a copy with a changed stretch of words, at a similarity of ``at`` or just above."""
    base = words(rng, 300).split()
    size = max(m for m in range(1, 100) if (296 - m - 4) / (296 + m + 4) >= at)
    k = rng.randrange(5, 290 - size)
    return " ".join(base), " ".join(base[:k] + [f"new{i}x" for i in range(size)] + base[k + size :])


@pytest.mark.parametrize("large", [False, True])
def test_similar_pairs_are_those_of_brute_force(spark, monkeypatch, large):
    rng = random.Random(21)
    rows, wanted = {}, {}
    for level in (0.70, 0.75, 0.78, 0.80, 0.85, 0.90):
        for _ in range(30):
            i = 10 * len(rows)
            rows[i], rows[i + 1] = planted(rng, level)
            wanted[i + 1] = jaccard(rows[i], rows[i + 1]) >= 0.8
    passage = " ".join(["one passage that comes again and again"] * 200)
    for i in (100_000, 100_010):  # the same repeated passage, and little else in common
        rows[i] = f"{passage} {words(rng, 60)}"
    assert sum(wanted.values()) == 90
    if large:  # every shared bucket by spanning forests, in cells
        own_links = minhash.links
        monkeypatch.setattr(minhash, "links", lambda r, nodes, scheme: own_links(r, nodes, scheme, 1, 400))
    frame = spark.createDataFrame([*rows.items(), (100_020, None), (100_030, ""), (None, rows[0])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame, simhash.SIMILAR).collect()}
    assert {i: got[i] == i - 1 for i in wanted} == wanted
    assert all(got[i] == i for i in rows if i not in wanted)
    assert (got[100_020], got[100_030], got[None]) == (100_020, 100_020, 0)


def test_forest_joins_what_all_links_join():
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 1 << 62, 40)).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.append(b[rng.random(40) > 0.08], rng.integers(0, 1 << 62, 2).astype(np.uint64))) for b in base for _ in range(12)]
    u, v = minhash.forest(np.arange(len(sets)), sets)
    root = list(range(len(sets)))
    want = list(range(len(sets)))
    for _ in sets:
        for a, b in zip(u, v):
            root[a] = root[b] = min(root[a], root[b])
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    want[a] = want[b] = min(want[a], want[b])
    assert root == want and len(u) <= len(sets)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {x: r for x, r in root.items() if x != r} == got


# --- 7: lines -------------------------------------------------------------------------------------------------------
def brute_lines(rows: dict[int, str | None], least: int) -> dict[int, set[int]]:
    places: dict[tuple, tuple] = {}
    every = [(i, n, tuple(x.split())) for i in sorted(rows) for n, x in enumerate((rows[i] or "").split("\n")) if x.split()]
    for i, n, w in every:
        places.setdefault(w, (i, n))
    long = [w for w in places if len(w) >= least]
    gone = {w for w in long if any(places[v] < places[w] and line_dedup.within_one_word(" ".join(v).encode(), " ".join(w).encode()) for v in long if v != w)}
    out: dict[int, set[int]] = {}
    for i, n, w in every:
        if w in gone or places[w] != (i, n):
            out.setdefault(i, set()).add(n)
    return out


def test_line_dedup(spark, empty):
    rng = random.Random(7)
    pool = [words(rng, rng.randint(1, 14), "abc") for _ in range(40)]
    for x in list(pool):
        own = x.split()
        k = rng.randrange(len(own))
        pool += [" ".join(own[:k] + own[k + 1 :]), " ".join([*own[:k], "new", *own[k:]]), " ".join([*own[:k], "other", *own[k + 1 :]])]
    rows = {i: "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 9))) for i in range(60)} | {100: None, 101: "", 102: "\n\n", 103: words(rng, 3000)}
    frame = spark.createDataFrame([(i, t, 5, 6) for i, t in rows.items()] + [(None, "left as it is", 5, 6)], "doc_id long, text string, n_lines int, n int")
    want = brute_lines(rows, 8)
    assert sum(map(len, want.values())) > 20
    for r in line_dedup.line_dedup(frame).collect():
        if r["doc_id"] is None:
            assert r["text"] == "left as it is"
            continue
        gone, t = want.get(r["doc_id"], set()), rows[r["doc_id"]]
        assert set(r["dropped_lines"]) == gone
        assert r["text"] == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
        assert r["n_lines"] == sum(bool(x.split()) for x in (t or "").split("\n")) and r["n"] == 6
    assert line_dedup.line_dedup(empty).count() == 0


def test_rows_that_share_an_identifier_are_told_apart(spark):
    rows = [(7, "alpha unique one two three four five six seven\ncommon tail"), (7, "hello there\nother text"), (3, "hello there"), (3, "hello there"), (2, "common tail")]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(7, "alpha unique one two three four five six seven"), (7, "other text"), (3, "hello there"), (3, "hello there"), (2, "common tail")])


def test_every_line_is_compared_with_a_bound_of_one_word(spark):
    rng = random.Random(17)
    rows = {i: "\n".join(" ".join(rng.choices("abcd", k=rng.randint(1, 4))) for _ in range(5)) for i in range(12)}
    got = {r["doc_id"]: set(r["dropped_lines"]) for r in line_dedup.line_dedup(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), least_words=1).collect()}
    want = brute_lines(rows, 1)
    assert got == {i: want.get(i, set()) for i in rows}


# --- 1: pieces ------------------------------------------------------------------------------------------------------
def test_pieces_equal_the_library_and_come_back(spark, texts, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(31)
    own = [*full(texts), "  two  spaces ", "▁a ▁", "éà 日本語 \U0001f600", "the theatre then 123 4567", "<s> <0x41>"]
    own += ["x" * 100_000, "".join(rng.choices("日本語中文字漢国人大的一是", k=20_000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=30_000)), "ab" * 3000, "-" * 777 + "the" * 500]
    frame = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in enumerate(own)] + [(999, None, 5, 6, 7), (0, own[0], 5, 6, 7)], "doc_id int, text string, ids int, decoded int, word int")
    rows = sentence_pieces.decode(sentence_pieces.encode(frame)).collect()
    assert len(rows) == len(own) + 2
    for r in rows:
        t = r["text"] or ""
        assert r["ids"] == library.encode(t)
        assert r["decoded"] == t.replace("▁", " ") and r["word"] == 7
    assert sentence_pieces.decode(sentence_pieces.encode(empty)).count() == 0


def test_chunks_that_share_no_token_are_done_again_longer(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(32)
    own = ["x" * 301, "ab" * 200, "".join(rng.choices("abcde", k=700)), "".join(rng.choices("theing", k=500))]
    words = spark.createDataFrame([(sentence_pieces.SPACE + w,) for w in own], "word string")
    for step, overlap in ((5, 2), (16, 16), (64, 48)):
        got = {r["word"][1:]: r["ids"] for r in sentence_pieces.encode_words(words, spark, sentence_pieces.default_path(), step=step, overlap=overlap).collect()}
        assert got == {w: library.encode(w) for w in own}


def test_every_word_of_the_documents_equals_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = common.read(spark, sf.replace("0.001", "0.01"), "documents")
    words = docs.select(F.explode(sentence_pieces.split_words(F.col("text"), True)).alias("word")).distinct()
    rows = sentence_pieces.encode_words(words, spark, sentence_pieces.default_path()).collect()
    assert len(rows) > 10_000
    for r in rows:
        got = library.encode(r["word"][1:] if r["word"].startswith(sentence_pieces.SPACE) else r["word"])
        if r["word"].startswith(sentence_pieces.SPACE):
            assert r["ids"] == got, r["word"]


def test_op1_covers_all_documents(spark, sf):
    want = sorted(r["doc_id"] for r in common.read(spark, sf, "documents").select("doc_id").collect())
    rows = registry.queries()["op1_sentence_pieces"](spark, sf).select("doc_id", "round_trip", "n_tokens", "n_viterbi").collect()
    assert sorted(r["doc_id"] for r in rows) == want and all(r["round_trip"] for r in rows)
    assert sum(r["n_viterbi"] for r in rows) <= 1.2 * sum(r["n_tokens"] for r in rows)


def test_texts_meet_their_words_without_a_shuffle(spark, sf, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    done = sentence_pieces.encode(common.read(spark, sf, "documents").select("doc_id", "text"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    assert all(r["ids"] == library.encode(r["text"] or "") for r in done.collect())


def test_large_stretches_are_cut_into_groups_and_small_ones_meet_in_a_task(spark, tmp_path, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(35)
    own = [" ".join("".join(rng.choices("abcdeé,▁", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    spark.createDataFrame(list(enumerate(own)), "i int, text string").repartition(3).write.parquet(f"{tmp_path}/texts")
    monkeypatch.setattr(sentence_pieces, "GROUP_BYTES", 2_000)
    rows = sentence_pieces.encode(spark.read.parquet(f"{tmp_path}/texts")).collect()
    assert sorted(r["i"] for r in rows) == list(range(300))
    assert all(r["ids"] == library.encode(r["text"]) for r in rows)
    for prefix in (True, False):
        for t in own:
            assert [w for c in sentence_pieces.chunks_of(t, prefix) for w in sentence_pieces.words_of_chunk(c, prefix, "abcdeé")] == sentence_pieces.words_of(t, prefix, "abcdeé")


def test_words_are_cut_where_no_piece_goes_on(spark, texts):
    path = sentence_pieces.default_path()
    joined = sentence_pieces.joined_characters(path)
    assert {"a", "é"} <= set(joined) and not set(joined) & set(" ,.!1\n" + sentence_pieces.SPACE)
    held = {p[i : i + 2] for p, _, _, byte in sentence_pieces.model_spec(path)[0] if byte is None for i in range(len(p) - 1)}
    own = [*full(texts), "▁a ▁", "éà, 日本語! \U0001f600x", "a-b's (c) 12,34.5x\n\n end ", "  ] ^ \\ - [&&"]
    frame = spark.createDataFrame(list(enumerate(own)), "i int, text string")
    for r in frame.select("text", sentence_pieces.split_words(F.col("text"), True, joined).alias("words")).collect():
        assert r["words"] == sentence_pieces.words_of(r["text"], True, joined)
        assert "".join(r["words"]) == (sentence_pieces.SPACE + r["text"].replace(" ", sentence_pieces.SPACE) if r["text"] else "")
        assert not any(a[-1] + b[0] in held for a, b in zip(r["words"], r["words"][1:]))


def test_viterbi_finds_the_best_path(spark):
    rng = random.Random(3)
    pieces = {"".join(rng.choices("ab", k=rng.randint(1, 4))): -rng.random() * 5 for _ in range(15)}
    table = spark.createDataFrame([(p, i, s, None) for i, (p, s) in enumerate(pieces.items())], "piece string, id int, score double, byte int")
    own = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(40)})
    got = sentence_pieces.lattice(spark.createDataFrame([(w,) for w in own], "word string"), sentence_pieces.with_ranks(table), 4)
    score = lambda p: pieces.get(p, sentence_pieces.UNKNOWN_SCORE if len(p) == 1 else -1e18)
    for r in got.select("word", sentence_pieces.viterbi(F.col("size"), F.col("edges")).alias("cuts"), sentence_pieces.viterbi_pieces(F.col("size"), F.col("edges")).alias("n")).collect():
        best = [0.0] + [-1e30] * len(r["word"])
        for b in range(1, len(best)):
            best[b] = max(best[a] + score(r["word"][a:b]) for a in range(max(0, b - 4), b))
        assert abs(sum(score(r["word"][a:b]) for a, b in zip(r["cuts"], r["cuts"][1:])) - best[-1]) < 1e-6
        assert r["n"] == len(r["cuts"]) - 1


# --- 4: neighbours --------------------------------------------------------------------------------------------------
def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)) + 3 * rng.standard_normal((8, 24))[rng.integers(0, 8, 1500)]
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [None] * 24), (5400, []), (None, [1.0] * 24)]
    base = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    found = ann.nearest(base.where("vec_id % 100 = 0"), base, block=400, query_block=8).toPandas()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        own = found[found["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own["score"], d[own["vec_id"]], rtol=0, atol=1e-12)
        hits += len(set(want) & set(own["vec_id"]))
    assert hits >= 0.9 * 150 and set(found["query_id"]) == set(range(0, 1500, 100))
    tied = found[found["query_id"] == 100].sort_values("rank")["vec_id"].tolist()
    assert tied == list(range(101, 111))
    few = ann.nearest(base.where("vec_id = 0"), base.where("vec_id < 4"))
    assert few.count() == 3
    assert ann.nearest(base.where("vec_id < 0"), base).count() == 0
    assert ann.nearest(base.where("vec_id = 0"), base.where("vec_id < 0")).count() == 0


def test_neighbours_of_repeated_rows_other_lengths_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 8))
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)] + [(1, x[1].tolist(), 1, 2)] * 300 + [(1, (x[1] + 9).tolist(), 1, 2), (500, x[0].tolist()[:5], 1, 2), (501, x[1].tolist()[:5], 1, 2)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, region int")
    found = ann.nearest(base.where("vec_id in (0, 500)"), base, block=16, query_block=2).toPandas()
    d = np.sqrt(((x.astype(np.float32).astype(float) - x[0].astype(np.float32)) ** 2).sum(1))
    want = [i for i in np.argsort(d).tolist() if i][:10]
    assert found[found["query_id"] == 0].sort_values("rank")["vec_id"].tolist() == want
    assert found[found["query_id"] == 500]["vec_id"].tolist() == [501]


def test_queries_reach_few_regions_of_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = 30 * rng.standard_normal((16, 64))
    x = centres[rng.integers(0, 16, 4000)] + rng.standard_normal((4000, 64))
    line = x @ ann.axes(64)
    tree = ann.median_tree(line[:, :4])
    at = np.zeros(len(x), np.int64)
    for level in range(4):
        at = 2 * at + 1 + (line[:, level] >= tree[at])
    low, high = (np.stack([f(line[at == r], axis=0) for r in np.unique(at)]) for f in (np.min, np.max))
    half = ann.half_width(10.0, line[0])
    met = [((low <= c + half) & (high >= c - half)).sum(1) >= ann.COLLIDING for c in line[:200]]
    assert len(low) > 8 and np.mean(met) < 0.5


# --- 3, 5, 8: classifiers -------------------------------------------------------------------------------------------
def accuracy(rows, guess, truth):
    held = rows[rows["held_out"]]
    return (held[guess] == held[truth]).mean()


def test_language(spark, sf, empty):
    docs = common.read(spark, sf.replace("0.001", "0.01"), "documents")
    rows = language_id.op3_language_id(spark, sf.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert accuracy(rows, "lang_pred", "lang") > 0.97 and rows["score"].between(0, 1).all()
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 !?", 0), (4, "the and of " * 20_000, 0)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "en"
    assert language_id.predict(odd, language_id.fit(empty)).where("lang_pred = 'und'").count() == 4


def test_huge_text_counts_like_a_whole(monkeypatch):
    import pyarrow as pa

    text = pa.array([words(random.Random(1), 3000) + "12é, ß  x"], pa.large_string())
    whole = next(language_id._batches(text, 4096))[2]
    for size in (1000, 997, 64):
        monkeypatch.setattr(common, "STEP_BYTES", size)
        assert np.array_equal(whole, next(language_id._batches(text, 4096))[2])


def test_language_by_brute_force(spark, sf):
    docs = common.read(spark, sf, "documents")
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        text = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in (r["text"] or "").lower().encode())
        counts = np.zeros(len(model.idf))
        for w in text.split():
            padded = b" " + w + b" "
            grams = [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]
            for g in grams:
                counts[int(common.mixed(np.array([int.from_bytes(g, "big") + (len(g) << 32)], np.uint64))[0] % np.uint64(len(counts)))] += 1
        x = np.log1p(counts) * model.idf
        near = model.centres @ (x / max(np.linalg.norm(x), 1e-12))
        if got[r["doc_id"]]["lang_pred"] != "und":
            assert abs(got[r["doc_id"]]["score"] - near.max()) < 1e-4
            assert near[[i for i, k in enumerate(model.language) if model.languages[k] == got[r["doc_id"]]["lang_pred"]]].max() > near.max() - 1e-4


def test_language_rejects_strange_texts_and_keeps_short_ones(spark, sf):
    docs = common.read(spark, sf.replace("0.001", "0.01"), "documents")
    model, rng = language_id.fit(docs), random.Random(6)
    noise = "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6000))
    strange = [noise, " ".join(noise[i : i + 7] for i in range(0, 6000, 7)), "これは日本語の文章です。" * 20, "Это предложение на русском языке. " * 20]
    clean = [t[:n] for n in (20, 80, 400) for t in [r["text"] for r in docs.where("length(text) > 400 and lang in ('en', 'fr', 'de', 'es')").limit(60).collect()]]
    rows = [(i, t, "x") for i, t in enumerate([*strange, *clean, *clean[:2]])]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, rejected string"), model).collect()}
    assert all(got[i]["rejected"] for i in range(len(strange)))
    assert sum(got[i]["rejected"] for i in range(len(strange), len(rows))) <= 2
    assert got[len(rows) - 1]["score"] == got[len(strange) + 1]["score"]


def learn(spark, sf, name, column, guess="predicted"):
    labels = common.read(spark, sf, "labels").groupBy("doc_id").agg(F.max(column).alias("truth"))
    return registry.queries()[name](spark, sf).join(labels, "doc_id").toPandas()


def test_toxicity(spark, sf, empty):
    rows = learn(spark, sf.replace("0.001", "0.1"), "op5_toxicity", "toxic")
    held = rows[rows["held_out"]]
    hits = ((held["predicted"] == 1) & (held["truth"] == 1)).sum()
    assert hits / held["truth"].sum() > 0.8 and hits / (held["predicted"] == 1).sum() > 0.85 and rows["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 200_000)], "doc_id long, text string")
    none = toxicity.fit(toxicity.labelled(empty, spark.createDataFrame([], "doc_id long, toxic int")))
    assert [r["predicted"] for r in toxicity.predict(odd, none).collect()] == [0, 0, 0]


def test_toxicity_by_brute_force(spark, sf):
    """Every window compressed by itself, without batches or memory, gives the same scores."""
    import zstandard

    docs = common.read(spark, sf.replace("0.001", "0.01"), "documents")
    model = toxicity.fit(toxicity.labelled(docs, common.read(spark, sf.replace("0.001", "0.01"), "labels")))

    def length(content, window):
        trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(level=toxicity.LEVEL)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False).compress(model.base[-160:-64] + b" " + window + b" " + model.base[-40:-16]))

    rows = docs.where("length(text) < 1500").limit(25).select("doc_id", "text").collect() + docs.sparkSession.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string").collect()
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    seen = {}
    for r in rows:
        own = [w.encode() for w in "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in (r["text"] or "").lower()).split(" ") if w]
        faint = clear = 0
        for w in own:
            seen[w] = d = seen.get(w, None) if w in seen else length(model.base, w) - length(model.toxic + model.base, w)
            low, high = model.limits[min(len(w), len(model.limits) - 1)]
            faint, clear = faint + (d >= low), clear + (d >= high)
        x = [1, np.log1p(faint), np.log1p(clear), np.log1p(1000 * faint / max(len(own), 20)), np.log1p(1000 * clear / max(len(own), 20))]
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.dot(x, model.weights)))) < 1e-9


def test_toxicity_of_repeated_rows_and_clashing_columns(spark, sf):
    docs = common.read(spark, sf, "documents")
    model = toxicity.fit(toxicity.labelled(docs, common.read(spark, sf, "labels")))
    rows = spark.createDataFrame([(5, "some text", "x", 1), (5, "some text", "y", 2), (None, "some text", "z", 3)], "doc_id long, text string, score string, predicted int")
    got = toxicity.predict(rows, model, rows.columns).collect()
    assert len(got) == 3 and len({r["score"] for r in got}) == 1 and 0 <= got[0]["score"] <= 1
    assert toxicity.predict(rows.limit(0), model).count() == 0


def test_quality_by_brute_force(spark):
    """One shard against a plain loop over dictionaries, and scores against plain sums."""
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(3, 40), "abc" if i % 3 else "xyz!"), int(i % 3 > 0)) for i in range(60)] + [(60, None, 1), (61, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    size = 1 << 12
    got = quality.fit(frame, size)

    def slots(text):
        import pyarrow as pa

        return [int(x) for _, _, _, at in quality._steps(pa.array([text or ""], pa.large_string()), size) for x in at]

    of_doc = {i: slots(t) for i, t, _ in rows}
    h = {r["doc_id"]: r["h"] for r in frame.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: h[r[0]])
    n = {label: sum(r[2] == label for r in rows) for label in (0, 1)}
    z, g2 = {}, {}

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= quality.L1 else -(v - np.sign(v) * quality.L1) / ((quality.BETA + np.sqrt(g2.get(k, 0.0))) / quality.ALPHA + quality.L2)

    for epoch in range(quality.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(ordered)):
            doc, _, y = ordered[i]
            own = of_doc[doc]
            x = {k: own.count(k) / len(own) * 8 for k in set(own)} | {size: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x)))
            for k in x:
                g = np.sqrt(len(rows) / (2 * n[y])) * (p - y) * x[k]
                sigma = (np.sqrt(g2.get(k, 0.0) + g * g) - np.sqrt(g2.get(k, 0.0))) / quality.ALPHA
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                g2[k] = g2.get(k, 0.0) + g * g
    want = np.array([weight(k) for k in range(size + 1)])
    assert np.allclose(got, want, atol=1e-9)


def test_quality_of_repeated_rows_and_clashing_columns(spark):
    weights = np.random.default_rng(1).standard_normal(quality.SLOTS + 1)
    rows = spark.createDataFrame([(5, "some Text, here", 0.5), (5, "some Text, here", 0.7), (None, "some Text, here", 0.1)], "doc_id long, text string, score double")
    got = quality.predict(rows, weights).collect()
    assert len({r["score"] for r in got}) == 1 and got[0].asDict().keys() == {"doc_id", "score", "predicted"}
    assert quality.predict(rows.limit(0), weights).count() == 0


def test_quality(spark, sf, empty):
    rows = learn(spark, sf.replace("0.001", "0.1"), "op8_quality", "quality")
    assert accuracy(rows, "predicted", "truth") > 0.95 and rows["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!! " * 100_000)], "doc_id long, text string")
    none = quality.fit(quality.labelled(empty, spark.createDataFrame([], "doc_id long, quality int"), "quality"))
    assert quality.predict(odd, none).count() == 3


# --- the pipeline ---------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, sf):
    docs = common.read(spark, sf, "documents")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf), "test-stage")
        if name == "packing":
            break
        assert docs.columns == columns and docs.count() <= len(before)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "lines":
            gone = brute_lines(before, 8)
            want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in before.items()}
            assert now == {i: t for i, t in want.items() if i not in gone or t.split()}
        else:
            assert all(before[i] == t for i, t in now.items()) and len(now) > 0.5 * len(before)
        if name == "near_duplicates":
            assert set(now) == set(brute_groups(before).values())
        before = now
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)


def test_near_duplicates_of_the_documents_by_brute_force(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in common.read(spark, sf, "documents").select("doc_id", "text").collect()}
    rng = random.Random(77)
    for i, t in list(rows.items())[:60]:  # copies with a few words changed
        own = (t or "").split()
        for _ in range(max(1, len(own) // 60)):
            if own:
                own[rng.randrange(len(own))] = "other"
        rows[1_000_000 + i] = " ".join(own)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), simhash.SIMILAR).collect()}
    assert got == brute_groups(rows) and len(set(got.values())) < len(rows) - 30


def test_fingerprints_of_repeated_rows_null_identifiers_and_clashing_columns(spark):
    rows = spark.createDataFrame([(4, "a b c d", 1, 2), (4, "a b c d", 1, 2), (None, "a b c d", 1, 2), (None, "only here and nowhere else", 1, 2), (2, "", 1, 2), (3, None, 1, 2)], "doc_id long, text string, w0 int, component_id int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(rows).collect() if r["component_id"] is not None)
    assert got == [(False, 2, 2), (False, 3, 2), (False, 4, 4), (False, 4, 4), (True, 0, 4)]
    assert simhash.near_duplicates(rows).count() == 6


CLASHES = {"score": "x", "Rejected": "y", "lang_pred": "z", "predicted": "p", "n_lines": "q", "dropped_lines": "r", "run": "s", "row": "t", "component_id": "u", "text_hash": "v", "word": "w"}


def test_stages_keep_columns_that_share_a_name_with_theirs(spark, sf):
    docs = common.read(spark, sf, "documents").withColumns({c: F.lit(v) for c, v in CLASHES.items()})
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf), "clash-stage")
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(*CLASHES).distinct().collect()} == {tuple(CLASHES.values())}, name
        assert out.count() <= docs.count()
    assert corpus_pipeline.pack_sequences(spark, docs, sf).where("doc_id is null").count() > 0


def test_language_and_toxicity_stages_reject_what_they_should(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = common.read(spark, sf, "documents")
    rng = random.Random(9)
    strange = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=4000)), "日本語の文章がここにあります。" * 30, "Ещё одно предложение на другом языке. " * 30, "1234 5678", "", None]
    extra = spark.createDataFrame([(9_000_000 + i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(extra, allowMissingColumns=True), sf).select("doc_id").collect()}
    assert not left & {9_000_000 + i for i in range(len(strange))} and len(left) > 0.97 * docs.count()
    stay = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    labels = {r["doc_id"]: r["t"] for r in common.read(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("t")).collect()}
    clean, toxic = [i for i, t in labels.items() if t == 0], [i for i, t in labels.items() if t == 1]
    assert sum(i in stay for i in clean) > 0.95 * len(clean) and sum(i not in stay for i in toxic) > 0.6 * len(toxic)


def test_a_copy_takes_no_other_text_of_its_identifier(spark):
    rng = random.Random(12)
    first, copy = planted(rng, 0.9)
    own = words(rng, 300)
    rows = [(1, first), (2, copy), (2, own), (None, own + " more"), (None, first)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, first), (2, own)]


def test_the_pipeline_drops_what_golay_keys_link_and_what_hangs_on_it(spark):
    rng = random.Random(31)
    passage = " ".join(["one passage that comes again and again"] * 200)
    one, two = (f"{passage} {words(rng, 60)}" for _ in range(2))
    three = f"{two} {words(rng, 8)}"  # near the second only by its set of shingles
    other = words(rng, 300)
    assert jaccard(one, two) < 0.8 <= jaccard(two, three) and jaccard(one, three) < 0.8
    assert (brute_fingerprint(one) ^ brute_fingerprint(two)).bit_count() <= 2
    rows = [(5, one), (6, two), (7, three), (7, other), (8, one), (None, two), (None, other + " more"), (None, other), (9, words(rng, 300))]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(5, one), (7, other), rows[-1]]


def test_pipeline_runs_on_empty_documents(spark, empty, sf):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf), "empty-stage")
    assert docs.count() == 0
