"""SuperMinHash near duplicates, phrase collocations and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tracelight.llm import alignment, collocations, line_dedup, sentence_pieces, super_minhash

ODD = [None, "", " ", " \n\t ", "one", "one", "One\ttwo", "special <|endoftext|> <s> 日本 ﬁ 0x41   tab\tend", "a▁b", "▁", "x" * 3000, "a\0b", "é é   x  y", "  two  spaces ", "tail \n \t", "\x1c y \x85 z"]


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n long")


# --- 11: near duplicates ------------------------------------------------------------------------------------------
def pairs_of(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(found[i : i + 2]) for i in range(max(1, len(found) - 1))} if found else set()


def brute_components(ids, texts):
    sets = [pairs_of(t) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return [(ids[i], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else ids[i]) for i in range(len(ids))]


def near_texts(rng):
    out = list(ODD)
    for n in (3, 9, 10, 40, 200):
        for _ in range(6):
            base = words(rng, n).split()
            out.append(" ".join(base))
            for share in (0.03, 0.06, 0.09, 0.12, 0.2):
                changed = [w if rng.random() > share else words(rng, 1) for w in base]
                out.append(" ".join(changed))
            out += ["  ".join(base).upper(), " ".join(base + words(rng, n // 5 + 1).split())]
    chain = words(rng, 60).split()
    for _ in range(20):  # each links with the next, the ends do not
        out.append(" ".join(chain))
        chain = chain[5:] + words(rng, 5).split()
    return out


def test_super_minhash_finds_the_components_of_brute_force(spark, empty):
    rng = random.Random(11)
    texts = near_texts(rng)
    ids = [1000 - i for i in range(len(texts))]
    ids[5] = None
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in zip(ids, texts)], "doc_id long, text string, node int, keys int").repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in super_minhash.near_duplicates(df).collect()), key=str)
    want = sorted(brute_components(ids, texts), key=str)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 60
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in super_minhash.near_duplicates(df).where("doc_id is not null").collect())
    assert super_minhash.near_duplicates(empty).count() == 0


def test_super_minhash_repeated_rows_and_large_groups(spark):
    rng = random.Random(12)
    base = words(rng, 100).split()
    rows = [(i, " ".join(base)) for i in range(50)] + [(3, " ".join(base)), (3, "another text"), (None, "only null")]
    rows += [(100 + i, " ".join([*base[:-1], f"w{i}"])) for i in range(60)]
    got = {}
    for r in super_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    assert got[None] == [(None, True)] and sorted(got[3]) == [(0, False), (0, False), (3, True)]
    assert all(got[i] == [(0, i == 0)] for i in range(50) if i != 3) and all(got[100 + i] == [(0, False)] for i in range(60))


def slow_signature(own, size):
    """One element and one draw at a time, with no early stop."""
    out = [None] * size
    for x in own.tolist():
        places = list(range(size))
        for j in range(size):
            h = int(super_minhash.common.mixed(np.array([(x + (j + 1) * int(super_minhash._GOLDEN)) % (1 << 64)], np.uint64))[0])
            k = j + ((h & 0xFFFFFF) * (size - j) >> 24)
            places[j], places[k] = places[k], places[j]
            value = (j << 56) | (h >> 8)
            out[places[j]] = value if out[places[j]] is None else min(out[places[j]], value)
    return out


def test_signatures_equal_the_plain_loop_and_vary_less():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 7, 0, 40, 300)]
    at = np.append(0, np.cumsum([len(s) for s in sets]))
    got = super_minhash.signatures(np.concatenate(sets), at, 40)
    for row, own in zip(got.tolist(), sets):
        assert row == slow_signature(own, 40) if len(own) else set(row) == {(1 << 64) - 1}
    errors = []
    for _ in range(150):
        values = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
        a, b = super_minhash.signatures(np.concatenate([values[:24], values[6:]]), np.array([0, 24, 48]), 100)
        errors.append((a == b).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.75 * 0.6 * 0.4 / 100


def test_union_find_keeps_what_joins():
    rng = np.random.default_rng(2)
    u, v = rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    kept = super_minhash.spanning(u, v)

    def groups(pairs):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[find(x)] = find(y)
        return {frozenset(x for x in root if find(x) == r) for r in map(find, list(root))}

    every = groups(zip(u.tolist(), v.tolist()))
    assert {g for g in groups(zip(u[kept].tolist(), v[kept].tolist())) if len(g) > 1} == {g for g in every if len(g) > 1} and len(kept) < 60


# --- 13: alignment --------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def token_bytes(libraries, text):
    a, b = libraries
    symbol = alignment.bpe._byte_symbols()
    first = a.encode(" " + text, add_special_tokens=False).ids
    second = b.encode(text)
    sides = [[bytes(symbol[c] for c in a.id_to_token(i)) for i in first]]
    pieces = [b.id_to_piece(i) for i in second]
    sides.append([bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x..>", p) else p.replace("▁", " ").encode() for p in pieces])
    return first, second, sides


def brute_alignment(libraries, texts):
    rows, seen = [], Counter()
    for text in texts:
        a, b, sides = token_bytes(libraries, text or "")
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, begin = [], [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends[s]) if begin < e <= end) for s, ids in enumerate((a, b))))
            begin = end
        starts = [[0, *e[:-1]] for e in ends]
        for i in range(len(a)):
            for j in range(len(b)):
                if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]:
                    links.append((a[i], b[j]))
        rows.append((len(a), len(b), groups, links))
        seen.update(set(links))
    most = Counter()
    for (i, _), n in seen.items():
        most[i] = max(most[i], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        out.append((n_a, n_b, len(groups), len(links), sum(seen[x] == most[x[0]] for x in links), sum(seen[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_alignment_equals_brute_force(spark, empty, libraries):
    rng = random.Random(13)
    texts = [words(rng, rng.randint(1, 60), "abcdeé日ß'") for _ in range(40)]
    texts += ODD + ["".join(rng.choices("ab .,'é\n\t 日 ", k=300)) for _ in range(10)] + texts[:5]
    want = brute_alignment(libraries, texts)
    assert sum(w[0] == 0 for w in want) >= 4 and sum(w[0] > 0 for w in want) > 40
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, row int, pairs int").repartition(3)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for most in (1 << 20, 40, 0):  # all pairs broadcast, some, none
        got = {r["doc_id"]: tuple(r[c] for c in names) for r in alignment.align(df, most_pairs=most).collect()}
        assert [got[i] for i in range(len(texts))] == want
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in alignment.align(df, most_bytes=20).collect()}  # nearly all in segments
    assert [got[i] for i in range(len(texts))] == want
    assert alignment.align(empty).count() == 0
    assert [r["n_a"] for r in alignment.align(df.where("coalesce(text, '') = ''")).collect()] == [0, 0]
    repeated = alignment.align(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert [r["count_sum"] for r in repeated] == [4, 4]


def test_stretches_encode_like_whole_texts(libraries):
    rng = random.Random(14)
    pair = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["".join(rng.choices("ab  \n\t \x1c\x85.'1é日", k=rng.randint(1, 80))) for _ in range(3000)] + [words(rng, 30_000)]
    (a, b), (n_a, n_b) = pair.encode(texts)
    a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    for i, t in enumerate(texts):
        first, second, sides = token_bytes(libraries, t)
        if all(b"".join(s) == (" " + t).encode() for s in sides):
            assert a[a_at[i] : a_at[i] + n_a[i]].tolist() == first and b[b_at[i] : b_at[i] + n_b[i]].tolist() == second
        else:
            assert not n_a[i] and not n_b[i]


def test_galloping_ranks():
    rng = np.random.default_rng(3)
    for _ in range(300):
        few, many = (np.unique(rng.integers(0, 3000, rng.integers(0, 900))) for _ in range(2))
        assert np.array_equal(alignment.ranks(few, many), np.searchsorted(many, few))


# --- 12: collocations -----------------------------------------------------------------------------------------------
def brute_collocations(rows, most_words, least, covered, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            found = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(found)
            for n in range(1, most_words + 1):
                for i in range(len(found) - n + 1):
                    counts[lang, tuple(found[i : i + n])] += 1
    frequent = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        score, _, left, right = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        longer = (b for (other, q), b in frequent.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if not any(100 * b >= covered * a for b in longer):
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def phrase_rows(rng):
    vocabulary = [words(rng, 1, "abcé") for _ in range(9)] + ["\x1c", "日本", "x" * 40, "x" * 41]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 120)):
            text += rng.choice(vocabulary[: rng.randint(1, 13)]) if rng.random() < 0.9 else "new york city"
            text += rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b"])
        rows.append((rng.choice(["en", "en", "de", None]), text.upper() if i % 7 == 0 else text))
    return [*rows, ("en", None), (None, ""), ("fr", " . "), *rows[:3]]


def test_collocations_equal_brute_force(spark, empty):
    rng = random.Random(15)
    rows = phrase_rows(rng)
    df = spark.createDataFrame([(i, t, lang, 4, 5) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, mark int, n int").repartition(4)

    def run(**options):
        return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())

    want = brute_collocations(rows, 3, 10, 50, 2000)
    assert len(want) > 100
    assert run() == want
    assert run(fingerprint_bits=7) == want  # nearly every fingerprint collides
    assert run(most_words=4, least=3, covered=70, top=9) == brute_collocations(rows, 4, 3, 70, 9)
    assert collocations.collocations(empty).count() == 0


def test_slices_keep_phrases_whole():
    rng = random.Random(16)
    text = "".join(rng.choice(["ab", "c", "de", "f"]) + rng.choice([" ", "  ", "\t", ". ", ",", "\n"]) for _ in range(500)).encode()
    whole = collocations.Words([text], np.array([len(text)]))
    for n in (1, 2, 3):
        want = sorted(whole.phrase(i, n) for i in whole.phrases(n).tolist())
        got = []
        for body, own in collocations.slices(text, 50, n - 1):
            part = collocations.Words([body], np.array([own]))
            got += [part.phrase(i, n) for i in part.phrases(n).tolist()]
        assert sorted(got) == want
    assert [own for _, own in collocations.slices(b"x" * 500, 50)] == [500, 0]


# --- 7: texts that made the plan run away ---------------------------------------------------------------------------
def test_blank_lines_and_repeated_lines_take_linear_time(spark):
    huge = [(1, " " * 5_000_000 + "\nx"), (2, "again and again\n" * 300_000), (3, None), (4, "y" * 6_000_000 + " z\n"), (5, "again and again")]
    df = spark.createDataFrame(huge, "doc_id long, text string").repartition(5)
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert time.time() - began < 60
    assert [got[i]["n_lines"] for i in range(1, 6)] == [1, 300_000, 0, 1, 1]
    assert [got[i]["n_dropped"] for i in range(1, 6)] == [0, 299_999, 0, 0, 1]
    assert got[2]["text"] == "again and again\n" and got[3]["text"] is None and got[5]["text"] == "" and got[1]["text"] == huge[0][1]
    once = line_dedup._without_lines(df.select("doc_id", "text").withColumns({"dropped_lines": F.when(F.col("doc_id") == 2, F.sequence(F.lit(1), F.lit(299_999))), "n_near": F.lit(0)}), "text")
    once.write.format("noop").mode("overwrite").save()  # warm
    began = time.time()
    once.write.format("noop").mode("overwrite").save()
    assert time.time() - began < 10


# --- 1: words too long for a lattice ---------------------------------------------------------------------------------
def test_the_viterbi_path_of_a_long_word_is_that_of_the_whole(spark):
    rng = random.Random(17)
    path = sentence_pieces.default_path()
    long = ["▁" + "".join(rng.choices(letters, k=n)) for letters, n in (("abcdeé", 301), ("tionheras", 150), ("日本x", 130), ("ab", 113))]
    df = spark.createDataFrame([(w,) for w in [*long, "▁the", "▁token"]], "word string")
    for fold in ("merges", "viterbi"):
        parts = {r["word"]: (r["ids"], r["n_best"]) for r in sentence_pieces.encode_words(df, spark, path, fold).collect()}
        whole = {r["word"]: (r["ids"], r["n_best"]) for r in sentence_pieces.encode_words(df, spark, path, fold, 400, 48).collect()}
        assert parts == whole and all(parts[w][1] < len(w) for w in long)


def test_folds_over_many_words_equal_the_folds_in_sql(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(41)
    path = sentence_pieces.default_path()
    own = sorted({"▁" + "".join(rng.choices("theingrao日é", k=rng.randint(1, 30))) for _ in range(400)})
    words = spark.createDataFrame([(w,) for w in own], "word string")
    size, edges = F.col("size"), F.col("edges")
    plain = sentence_pieces.lattice(words, sentence_pieces.piece_table(spark, path), 16).select("word", sentence_pieces.viterbi_pieces(size, edges, sentence_pieces.zipf).alias("n"))
    best = {r["word"]: r["n"] for r in plain.collect()}
    got = {r["word"]: (r["ids"], r["n_best"]) for r in sentence_pieces.encode_words(words, spark, path).collect()}
    assert got == {w: (library.encode(w[1:]), best[w]) for w in own}
    plan = sentence_pieces.encode_words(words, spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan  # edges go to the folds as rows
    long = "".join(rng.choices("theing", k=2000))
    row = sentence_pieces.encode_words(spark.createDataFrame([("▁" + long,)], "word string"), spark, path, step=6000).first()
    assert row["ids"] == library.encode(long)


def test_edges_are_folded_by_whole_words():
    batches = [pa.RecordBatch.from_pydict({"first": f}) for f in ([True, False, False], [False, True], [False, False, True, True], [False])]
    for enough in (1, 3, 100):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(sentence_pieces, "_EDGES", enough)
            tables = [t["first"].to_pylist() for t in sentence_pieces._whole_words(iter(batches), "first")]
        assert sum(tables, []) == [v for b in batches for v in b["first"].to_pylist()] and all(t[0] for t in tables)
    assert not list(sentence_pieces._whole_words(iter([]), "first"))


def test_decoding_in_the_same_tasks_gives_the_same_texts(spark):
    frame = spark.createDataFrame([(1, "two  spaces ▁ é"), (2, None), (3, "the <0x41>\n日本"), (3, "the <0x41>\n日本"), (4, "")], "i int, text string")
    at_once = sentence_pieces.encode(frame, decoded=True)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, sentence_pieces.decode(sentence_pieces.encode(frame)).collect()))
    assert str(at_once._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    bad = spark.createDataFrame([([230, 3, -1, 10**6],), ([3 + 0xE2, 3 + 0x96, 3 + 0x81, 400],), (None,)], "ids array<int>")
    texts = {str(r["ids"]): r["decoded"] for r in sentence_pieces.decode(bad).collect()}
    pieces = {i: bytes([b]) if b is not None else p.encode() for p, i, _, b in sentence_pieces.model_spec(sentence_pieces.default_path())[0]}
    for ids in ([230, 3, -1, 10**6], [3 + 0xE2, 3 + 0x96, 3 + 0x81, 400], None):
        text = b"".join(pieces.get(i, b"") for i in ids or []).decode("utf-8", "replace").replace("▁", " ")
        assert texts[str(ids)] == text.removeprefix(" ")
