"""The text operators against brute force, round trips and held-out rows; and on odd tables."""

import hashlib
import itertools
import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import base, bpe, components, exact, idfiles, learning, library, near, packing, substrings, tokens, vectors

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, kept boolean, digest string"
ODD = [
    (1, "The quick brown fox.\nIt jumps  over\tthe lazy dog's back <|endoftext|> now"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "Überraschung für José — 日本語 テスト 😀 é a\x1cb\x85c\xa0d"),
    (6, "a" * 5000),
    (7, "x y z"),
    (8, "x y z"),
    (8, "x y z"),
    (None, "x y z"),
    (9, "X Y Z"),
    (10, "I'll don't we've <|startoftext|>he's 12,345.67!!! %%%"),
    (11, " ".join(f"w{i}" for i in range(3000))),
    (12, "x\x00y \x01 z İΣΑΣ"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, True, "q") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


# ------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def library_ids():
    t = Tokenizer.from_file(BYTE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'ab<|endoftext|>.é　"), st.characters(codec="utf-8")), max_size=60))
def test_coders_agree_with_the_library(text):
    t = bpe.worker(bpe.Merger, BYTE)
    one = _TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(t.encode(text), "<u4").tolist() == one
    assert bpe.worker(bpe.Counter, BYTE).count(text) == len(one)
    assert t.decode(one) == text
    assert np.frombuffer(library.worker(BYTE, True).encode([text])[0], "<u4").tolist() == one
    assert np.frombuffer(library.worker(WORD, False).encode([text])[0], "<u4").tolist() == _WORDS.encode(text, add_special_tokens=False).ids


_TOKENIZER, _WORDS = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def test_counts(odd, nothing, library_ids):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(odd, BYTE).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 1024) for i, t in ODD)
    assert tokens.token_counts(nothing, BYTE).count() == 0


def test_round_trip(odd, nothing, library_ids):
    got = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in tokens.encoded(odd, BYTE).collect())
    assert got == sorted((str(i), np.array(library_ids(t), "<u4").tobytes(), t or "") for i, t in ODD)
    digests = {(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.digests(odd, BYTE).collect()}
    assert digests == {(i, len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, b, t in got}
    assert tokens.digests(nothing, BYTE).count() == 0


# ------------------------------------------------------------ packing


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9000))
def test_cuts(n):
    parts = packing.cuts(n, 2048, 1 / 64)
    assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
    assert all(2048 - (2048 // p) * p < 64 for p in parts)


def test_packing(spark, odd, nothing):
    docs = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.expr("repeat('some words here ', cast(id * 7 % 900 AS int))").alias("text"), F.lit(True).alias("kept"), F.lit("q").alias("digest")))
    want = {r.doc_id: [*_WORDS.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs, WORD).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert by_doc.keys() == want.keys()
    for i, x in by_doc.items():
        x.sort(key=lambda r: r.start)
        assert [r.start for r in x] == [0, *np.cumsum([r.length for r in x])[:-1].tolist()] and sum(r.length for r in x) == len(want[i]) == x[0].doc_tokens
    for x in by_sequence.values():
        x.sort(key=lambda r: r.offset)
        assert [r.offset for r in x] == [0, *np.cumsum([r.length for r in x])[:-1].tolist()] and sum(r.length for r in x) <= 2048
    assert sum(r.length for r in rows) / (2048 * len(by_sequence)) > 0.95
    assert packing.pack(nothing, WORD).count() == 0
    assert packing.pack(odd, WORD).filter("doc_id = 8").count() == 2


# ------------------------------------------------------------ id files


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.integers(0, 32))
def test_blocks(values, shift):
    v = np.array(values, np.uint32) >> np.uint32(min(shift, 31))
    data = idfiles.packed(v)
    assert (idfiles.unpacked(data) == v).all()
    assert (idfiles.unpacked(data, 1, 2) == v[256:512]).all()


def test_files(spark, odd, nothing, library_ids):
    folder = base.scratch(spark, "ids")
    idfiles.write_ids(odd, BYTE, True, 2, folder)
    rows = sorted(idfiles.read_ids(spark, folder).collect(), key=lambda r: r.start)
    keyed = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert [r.doc_id for r in rows] == [i for i, _ in keyed]
    assert [bytes(r.ids) for r in rows] == [np.array([*library_ids(t), 2], "<u4").tobytes() for _, t in keyed]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    whole = b"".join(bytes(r.ids) for r in rows)
    for first, last in ((0, 10**9), (5, 6), (300, 1111), (10**9, 10**9 + 1)):
        parts = sorted(idfiles.ids_between(spark, folder, first, last).collect(), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == whole[4 * first : 4 * last]
    empty = base.scratch(spark, "ids")
    idfiles.write_ids(nothing, BYTE, True, 2, empty)
    assert idfiles.read_digests(spark, empty).count() == 0


def test_words_are_asked_for_once():
    e = library.Encoder(BYTE, True, size=1000)
    texts = [" ".join(f"w{(i * 7 + j) % 400}" for j in range(50)) for i in range(300)]
    want = [np.array(_TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == want
    asked = e.asked
    assert asked <= 900 and e.encode(texts) == want and e.asked == asked
    rare = library.Encoder(BYTE, True, size=10)  # generations change all the time
    assert [rare.encode([t])[0] for t in texts] == want


def test_files_with_a_repeated_id(spark):
    rows = [(7, f"text {i}") for i in range(60)] + [(None, "n"), (None, None), (1, "one")]
    folder = base.scratch(spark, "ids")
    idfiles.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, True, 2, folder)
    got = sorted(idfiles.read_digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1] + [7] * 60
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    crc = lambda t: zlib.crc32(np.array([*_TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted(r.ids_crc32 for r in got) == sorted(crc(t) for _, t in rows)


# ------------------------------------------------------------ exact duplicates


def test_exact(odd, nothing):
    got = exact.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))].append(i)
    want = sorted((str(i), max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.keep_id) for r in got)
    assert exact.exact_dedup(nothing).count() == 0


def test_index_outlives_its_handle(spark):
    folder = base.scratch(spark, "index")
    one = exact.DigestIndex(spark, folder, 4)
    one.ingest(spark.createDataFrame([(b"a", 2), (b"b", 3)], "digest binary, keep_id long"))
    before = one.rows()
    one.close()
    two = exact.DigestIndex(spark, folder)
    assert two.buckets == 4
    two.ingest(spark.createDataFrame([(b"b", 9), (b"c", 4)], "digest binary, keep_id long"))
    assert sorted((bytes(r.digest), r.keep_id) for r in two.rows().collect()) == [(b"a", 2), (b"b", 3), (b"c", 4)]
    assert before.count() == 2
    two.close()
    with pytest.raises(ValueError, match="4 buckets"):
        exact.DigestIndex(spark, folder, 3)


def test_later_batches(spark):
    folder, conf = base.scratch(spark, "index"), spark.conf.get("spark.sql.shuffle.partitions")
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    read = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(batch(rows), folder).collect())
    first = [(1, "hello"), (2, "x"), (3, "X"), *((10 + i, f"t{i}") for i in range(10))]
    want = sorted([(1, 1, 1, True), (2, 3, 2, False), (3, 3, 2, True), *((10 + i, 10 + i, 1, True) for i in range(10))])
    try:
        assert read(first) == want
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert read(first) == want
        assert read([(9, "HELLO"), (8, "hello"), (7, "new"), *((50 + i, f"t{i}") for i in range(10))]) == sorted([(9, 1, 2, False), (8, 1, 2, False), (7, 7, 1, True), *((50 + i, 10 + i, 1, False) for i in range(10))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_hot_keys_are_looked_up(spark):
    left = spark.range(5000).select((F.when(F.col("id") < 2500, 0).otherwise(F.col("id"))).alias("k"), "id")
    right = base.saved(left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")), "right")
    got = base.looked_up(left, right, "k", "n", 5000)
    assert got.count() == 5000 and got.filter("k = 0 AND m = 2499").count() == 2500


# ------------------------------------------------------------ components, near duplicates


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_components(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in pairs:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in pairs if u != v for x in (u, v)}


def test_path_in_order(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components.components(edges).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def corpus(seed=0, bases=40):
    """Texts with exact copies, near copies at every distance, shared passages and a large group."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"v{w}" for w in rng.zipf(1.3, n) % 5000]
    shared, out = word(60), []
    for b in range(bases):
        text = word(int(rng.integers(5, 300)))
        if b % 3 == 0:
            at = int(rng.integers(0, len(text)))
            text[at:at] = shared[: int(rng.integers(10, 60))]
        for copy in range(30 if b == 0 else int(rng.integers(1, 5))):
            t = list(text)
            for at in rng.integers(0, len(t), int(rng.integers(0, max(2, len(t) // 25)))) if copy else []:
                t[at] = f"n{rng.integers(1 << 30)}"
            out.append(" ".join(t) + ("\n" if copy == 3 else ""))
    order = rng.permutation(len(out))
    return [(int(i), out[k]) for i, k in enumerate(order)]


def linked(texts, words):
    """Shingle sets, and the smallest place of each one's component, by brute force."""
    sets, parent = [], list(range(len(texts)))
    for t in texts:
        w = t.lower().encode().split()
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= 80 * max(len(sets[i]), len(sets[j])):
                same = len(sets[i] & sets[j])
                if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same) and find(i) != find(j):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return sets, [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("words", [4, 5])
def test_near(spark, odd, nothing, words):
    rows = sorted(corpus(1))
    sets, root = linked([t for _, t in rows], words)
    find = root.__getitem__
    sets = dict(enumerate(sets))
    forest = near.Forest(words=words)
    got = {r.doc_id: r for r in near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), forest).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in sets}
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == r.component_id) for i, r in got.items())
    assert len(set(map(find, sets))) < len(sets) - 30
    odd_rows = near.near_dedup(odd, forest).collect()
    assert len(odd_rows) == len(ODD)
    assert {(r.doc_id, r.component_id, r.kept) for r in odd_rows if r.doc_id in (7, 8, 9, None)} == {(7, 7, True), (8, 7, False), (9, 7, False), (None, 7, False)}
    assert {(r.doc_id, r.n_shingles, r.kept) for r in odd_rows if r.doc_id in (2, 3, 4)} == {(2, 0, True), (3, 0, True), (4, 0, True)}
    assert near.near_dedup(nothing).count() == 0


def scattered(words, changes, seed):
    """words, so many of them replaced, no two of which are in one shingle."""
    out, step = list(words), len(words) // changes
    for k, at in enumerate(np.random.default_rng(seed).integers(5, step - 5, changes)):
        out[k * step + at] = f"n{seed}x{k}"
    return out


def test_near_hub(spark):
    """2000 copies, each similar enough to the original (0.85) and to no other copy (0.72)."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words if i == 1000 else scattered(words, 8, i))) for i in range(2001)]
    forest = near.Forest(words=4)
    hub = near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), forest).collect()
    assert len(hub) == 2001 and {r.component_id for r in hub} == {0}
    none = near.near_dedup(spark.createDataFrame(rows[:400], "doc_id long, text string").repartition(5), forest).collect()
    assert len(none) == 400 and all(r.kept for r in none)


def test_near_dense_groups(spark):
    """Two groups of 220 texts near the threshold, where most pairs of a group have nearly 0.8 in common."""
    rng, texts = np.random.default_rng(3), []
    for g in range(2):
        words = [f"g{g}v{i}" for i in range(150)]
        texts += [" ".join(scattered(words, int(rng.integers(2, 5)), 1000 * g + i)) for i in range(220)]
    _, root = linked(texts, 4)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near.near_dedup(rows, near.Forest(words=4)).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_near_rows_with_one_id(spark):
    words = [f"v{i}" for i in range(60)]
    near_copy = [*words[:-1], "other"]
    rows = [(5, " ".join(words)), (5, "quite another text that has nothing to do with it"), (7, " ".join(near_copy)), (None, " ".join(words)), (9, None), (9, ""), (None, "alone with no id at all here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near.near_dedup(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, 5, False), (9, 9, True), (9, 9, True), (None, None, False)], key=str)
    left = near.without_near(df.withColumn("row", F.lit("x")))
    assert left.columns == ["doc_id", "text", "row"]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([rows[0], rows[1], *rows[4:]], key=str)


# ------------------------------------------------------------ substrings


def removed(rows, k=13):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = words_of(t)
        mask, mine = np.zeros(len(w), bool), []
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            if seen.get(x, i) < i:
                mask[j : j + k] = True
            mine.append(x)
        for x in mine:
            seen.setdefault(x, i)
        out[i] = (len(w), int(mask.sum()), hashlib.sha256(b" ".join(x for x, m in zip(w, mask, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize(("together", "parts"), [(4_000_000, 1), (2_000, 6)])
def test_substrings(spark, monkeypatch, together, parts):
    monkeypatch.setattr(substrings, "_TOGETHER", together)
    rows = corpus(2, 60)
    rows += [(1000 + i, " ".join(["one", "two", "three"] * (3 + i)) + f" tail{i}") for i in range(8)]
    got = substrings.kept_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(rows)


def test_substrings_with_hot_minimizers(spark, monkeypatch):
    """A passage that every document has, in other surroundings: each chunk has its minimizers."""
    monkeypatch.setattr(substrings, "_TOGETHER", 1_500)
    monkeypatch.setattr(substrings, "_HOT_ROWS", 3)
    rng = np.random.default_rng(8)
    line = [f"line{i}" for i in range(25)]
    rows = []
    for i in range(200):
        words = [f"o{rng.integers(40)}" for _ in range(int(rng.integers(0, 40)))]
        at = int(rng.integers(0, len(words) + 1))
        rows.append((i, " ".join(words[:at] + line[: int(rng.integers(10, 26))] + words[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    hot = substrings._hot(df.select(F.col("doc_id").alias("row"), "doc_id", "text"), 13, 4)
    assert len(hot) > 3
    got = substrings.kept_digests(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(rows)


def test_substrings_believe_words_not_hashes(spark, monkeypatch):
    """All windows collide: nothing that differs from its source may go."""
    monkeypatch.setattr(base, "word_hashes", lambda words: np.full(len(words), 7, np.uint64))
    chunk = substrings._Chunk(pa.array([0, 1, 2]), pa.array([0, 1, 2]), pa.array([" ".join(f"{c}{i}" for i in range(20)) for c in "aba"]), 13)
    rows = substrings._Rows()
    chunk.paths(rows, 4, np.empty(0, np.uint64))
    done = [x for b in rows.batches() for x in b.to_pylist() if x["r"] is None and x["n"] and x["n"] > 0]
    assert [(x["row"], x["first"], x["n"]) for x in done] == [(2, 0, 1)]  # the one window that the first of all equals
    words = [b"w%d" % i for i in range(20)]
    wrong = [(0, 2, substrings._digest([b"x", *words[1:]], 0, 2, 13))]
    assert substrings._kept(words, wrong, 13) == words
    assert substrings._kept(words, [(2, 1, substrings._digest(words, 2, 1, 13))], 13) == words[:2] + words[15:]


def test_substrings_of_rows_with_one_id(spark):
    w = [f"v{i}" for i in range(40)]
    rows = [(1, " ".join(w)), (2, " ".join([*w, "z"])), (2, "a b c"), (2, " ".join(w[5:30])), (None, " ".join(w)), (3, " ".join(w)), (3, " ".join(w))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.kept_digests(df).collect()), key=str)
    assert got == sorted([(1, 40, 0), (2, 41, 40), (2, 3, 0), (2, 25, 25), (None, 40, 0), (3, 40, 40), (3, 40, 40)], key=str)


def test_substrings_of_a_very_long_text(spark):
    """More than 2^24 words, most of them one passage again and again."""
    n = (1 << 24) // 40 + 100
    loop = " ".join(f"p{i}" for i in range(40))
    df = spark.range(2).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit(loop + " "), n), F.concat(F.lit("end"), F.col("id").cast("string"))).alias("text"))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.kept_digests(df).collect()}
    assert got == {0: (40 * n + 1, 0), 1: (40 * n + 1, 40 * n)}


def test_substrings_of_odd_rows(spark, odd, nothing):
    got = substrings.substring_dedup(odd).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == sorted((str(i), len(words_of(t)), 0, t or "") for i, t in ODD)
    assert substrings.kept_digests(nothing).count() == 0
    assert substrings.without_repeats(nothing).count() == 0
    w = " ".join(f"v{i}" for i in range(15))
    clash = spark.createDataFrame([(1, w, "r", 1, "d"), (2, w + " tail", None, 2, "e"), (2, None, "x", 3, "f")], "doc_id long, text string, row string, spans int, _doc string")
    left = substrings.without_repeats(clash)
    assert left.columns == clash.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, w, "r", 1, "d"), (2, "tail", None, 2, "e"), (2, None, "x", 3, "f")], key=str)


# ------------------------------------------------------------ vectors


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [rng.normal(size=16) for _ in range(300)]
    data += [data[i % 7] + rng.normal(size=16) * rng.uniform(0, 0.5) for i in range(250)]
    data += [data[3]] * 40 + [data[4] * 2.5] * 3
    x = np.array(data) / np.linalg.norm(data, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    for _ in range(50):
        label = np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])
    rows = [(i, [float(v) for v in d * (1e200 if i % 3 == 1 else 1e-200 if i % 3 == 2 else 1)], None) for i, d in enumerate(data)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(1000 + i, b, 1) for i, b in enumerate(bad)] + [(None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    for tile in (1024, 50):
        monkeypatch.setattr(vectors, "TILE", tile)
        got = {r.vec_id: r for r in vectors.near_vectors(df, vectors.Tables(miss=1e-6)).collect()}
        assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == list(zip(linked.sum(axis=1).tolist(), label.tolist(), strict=True))
        assert all((got[1000 + i].n_links, got[1000 + i].kept) == (0, True) for i in range(len(bad)))
        assert got[None].n_links == 0 and not got[None].kept and len(got) == len(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_dense_vectors(spark):
    """5,000 vectors of one region, with the parameters of the query."""
    rng = np.random.default_rng(6)
    one = rng.normal(size=32)
    x = (one + rng.normal(size=(5000, 32)) * 0.33).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = vectors.near_vectors(df).toPandas().set_index("vec_id").sort_index()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    assert got.n_links.tolist() == (linked.sum(axis=1) - 1).tolist()
    assert (got.component_id[linked.sum(axis=1) > 1] == got.component_id[0]).mean() > 0.999


# ------------------------------------------------------------ classifiers


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos, neg = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = learning.op6_quality(spark, sf).join(base.table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.97 and (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(3000):
        w = [f"w{x}" for x in rng.zipf(1.4, 40) % 3000]
        toxic = i % 10 == 0
        if toxic:
            w[int(rng.integers(40))] = ["Vile!", "awful", "NASTY"][int(rng.integers(3))]
        rows.append((i, " ".join(w), "l", "s"))
        if i % 3:
            labels.append((i, 1 if toxic else 0, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, toxic int, quality int")
    got = learning.toxicity(docs, marks).toPandas().set_index("doc_id").sort_index()
    truth = np.array([i % 10 == 0 for i in range(3000)])
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(3000)]
    assert got.predicted[truth].mean() > 0.95 and got.predicted[~truth].mean() < 0.01
    assert learning.without_toxic(docs, marks).columns == docs.columns


def test_risk_and_its_gradient():
    """By differences, on both sides of the cut at 0."""
    rng = np.random.default_rng(1)
    kind = np.array([1] * 6 + [0] * 14)
    row, col = np.repeat(np.arange(20), 3), rng.integers(0, 5, 60)
    sides = set()
    for prior, scale in ((0.2, 1.0), (0.9, 1.0), (0.9, -2.0), (0.5, 0.1)):
        model, w, b = learning.NonNegativePU(), rng.normal(size=5) * scale, 0.3
        plus, rest, g = model.risk(w, b, row, col, kind, prior)
        f = np.array([b + sum(w[c] for r, c in zip(row, col, strict=True) if r == i) for i in range(20)])
        assert np.isclose(plus, prior * np.mean([np.log(1 + np.exp(-x)) for x in f[:6]]))
        assert np.isclose(rest, np.mean([np.log(1 + np.exp(x)) for x in f[6:]]) - prior * np.mean([np.log(1 + np.exp(x)) for x in f[:6]]))
        sides.add(rest >= 0)

        def goal(theta):
            a, c, _ = model.risk(theta[:-1], theta[-1], row, col, kind, prior)
            return a + c if rest >= 0 else -c

        at = np.append(w, b)
        want = [(goal(at + e) - goal(at - e)) / 2e-6 for e in np.eye(6) * 1e-6]
        assert np.allclose(g, want, atol=1e-6)
    assert sides == {True, False}


def test_scores_by_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(("bad" if i % 2 and rng.random() < 0.3 else f"w{x}") for x in rng.integers(0, 60, 30))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, ""), (1001, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    pu, sub = learning.NonNegativePU(), learning.SubwordEmbeddings()
    weights, bias = pu.fit(docs, marks)
    assert weights[pu.bucket("bad")] > 1
    for r in learning.toxicity(docs, marks).collect():
        text = dict(rows).get(r.doc_id, "")
        f = bias + sum(weights.get(pu.bucket(w), 0) for w in {*text.lower().split()})
        assert abs(r.score - 1 / (1 + np.exp(-f))) < 1e-9 and r.predicted == (r.score >= 0.5)
    part, bias = sub.fit(docs, marks)
    for r in learning.quality(docs, marks).collect():
        words, total = dict(rows).get(r.doc_id, "").split(), 0.0
        for w in words:
            s = f"<{w}>"
            at = [s, *(s[i : i + 3] for i in range(len(s) - 2)), *(s[i : i + 4] for i in range(len(s) - 3))]
            total += np.mean([part[xxhash.xxh32_intdigest(x) % (sub.buckets - 1) + 1] for x in at])
        total += sum(float(part[sub.pairs([a, c])[0]]) for a, c in itertools.pairwise(words))
        f = bias + (total / (2 * len(words) - 1) if words else 0)
        assert abs(r.score - 1 / (1 + np.exp(-f))) < 1e-5 and r.predicted == (r.score >= 0.3)


def test_repeated_ids_teach_once(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(2, "x"), (4, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, kind int")
    assert sorted((r.kind, r.text) for r in learning._taught(docs, ids).collect()) == [(0, "text 0"), (0, "x"), (1, "text 0")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = learning.op3_toxicity(spark, sf).join(base.table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.96
    assert got.predicted[got.toxic == 1].mean() > 0.85 and got.predicted[got.toxic == 0].mean() < 0.01


def test_classifiers_without_labels(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in learning.toxicity(odd, none).collect()} == {(0.0, 0)}
    assert {(r.score, r.predicted) for r in learning.quality(odd, none).collect()} == {(0.5, 1)}
    one = spark.createDataFrame([(1, 1, 1), (7, 0, 0), (8, 0, 0), (11, 1, 1), (12, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (learning.toxicity, learning.quality):
        assert f(odd, one).filter("score BETWEEN 0 AND 1").count() == len(ODD)
        assert f(nothing, one).count() == 0


# ------------------------------------------------------------ the pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = base.table(spark, "/root/testdata/sf0.001", "documents")
    kept = [docs]
    for name, stage in cp.STAGES[:-1]:
        kept.append(base.saved(stage(spark, kept[-1], "/root/testdata/sf0.001"), name))
        assert kept[-1].columns == docs.columns
    toxic_free, distinct, near_free, short = kept[1:]
    lower = lambda df: {(r.text or "").lower() for r in df.collect()}
    assert lower(distinct) == lower(toxic_free) and distinct.count() == len({hashlib.sha256((r.text or "").encode().lower()).digest() for r in toxic_free.collect()})
    assert near_free.count() == near.near_dedup(distinct).filter("kept").count()
    want = removed([(r.doc_id, r.text) for r in near_free.collect()])
    assert {r.doc_id: hashlib.sha256(b" ".join(words_of(r.text))).hexdigest() for r in short.collect()} == {i: x[2] for i, x in want.items()}
    packed = cp.STAGES[-1][1](spark, short, "")
    assert packed.select("doc_id").distinct().count() == short.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, repeated ids and rows, clashing names, an empty table."""
    import corpus_pipeline as cp

    w = " ".join(f"v{i}" for i in range(40))
    rows = [(1, "same", 4), (1, "other text", 10), (2, "SAME", 4), (3, "twice", 5), (3, "twice", 5), (4, None, 0), (4, "", 0), (None, "no id", 5), (None, w, 1), (5, w, 1), (6, w + " and a tail that is longer than all of it " * 3, 1), (7, " \t", 2)]
    schema = "doc_id long, text string, n_chars long, row string, _doc int, spans int, kept string, digest string"
    for name, data in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        docs = spark.createDataFrame([(*r, "r", 1, 2, "k", "d") for r in data], schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        for stage, f in cp.STAGES[:-1]:
            docs = base.saved(f(spark, docs, folder), stage)
            assert docs.columns == ["doc_id", "text", "n_chars", "row", "_doc", "spans", "kept", "digest"]
            if stage == "exact_dedup":
                got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
                texts = {(1, "other text"), (2, "SAME"), (3, "twice"), (None, "no id"), (5, w), (6, rows[10][1]), (7, " \t")} if data else set()
                assert {x for x in got if x[0] != 4} == texts and len([x for x in got if x[0] == 4]) == bool(data) and len(got) == len(texts) + bool(data)
        if data:
            assert {(r.doc_id, r.text) for r in docs.collect()} >= {(1, "other text"), (2, "SAME"), (3, "twice"), (5, w), (6, "and a tail that is longer than all of it and a tail that is longer than all of it and a tail that is longer than all of it")}
        packed = cp.run(spark, folder)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
