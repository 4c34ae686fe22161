"""Exact and near duplicates against plain Python over small tables."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from causeway.llm import exact_dedup, near_dedup
from causeway.llm._components import connected_components
from causeway.llm._text import shingle_sets, utf8

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    n = min(size, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def brute_components(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {(i, len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_all_pairs(spark, size):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_dedup.near_duplicates(docs, size)) == brute_components(rows, size, 80)


def test_chains_and_edges(spark):
    """A chain of small edits whose ends aren't similar is one component; ties at exactly 0.8 count."""
    pick = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    rows, text = [], words[:]
    for k in range(60):
        rows.append((k, " ".join(text)))
        text[int(pick.integers(60))] = f"x{k}"
    rows += [(100, None), (101, ""), (102, "  \n"), (103, "One"), (104, "one"), (105, "ONE two"), (106, "é a"), (107, "É a")]
    rows += [(110, " ".join(f"t{k}" for k in range(10))), (111, " ".join(f"t{k}" for k in range(9)))]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2)
    assert got(out) == brute_components(rows, 2, 80)
    assert {r.doc_id for r in out.where("kept").collect()} == {c for _, _, c in got(out)}


@pytest.mark.parametrize("slot", [1024, 7])
def test_pairs_between_parts_by_distance_from_a_head(spark, monkeypatch, slot):
    """All pairs of variants around 0.8, by their differences from one of them, the head or an unlike one."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_dedup, "SLOT", slot)
    pick = np.random.default_rng(12)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(70):
        text = base[: int(pick.integers(80, 101))]
        for at in pick.integers(0, len(text), int(pick.integers(0, 14))):
            text[at] = f"x{k if k % 2 else int(at)}"
        rows.append((k, " ".join(text)))
    rows += [(70, "one"), (71, " ".join(f"v{k}" for k in range(90)))]
    sets = {i: shingles(t, 2) for i, t in rows}
    held = [(head, i, i % 9) for head in (3, 71) for i, _ in rows]
    texts = spark.createDataFrame(rows, "id long, text string")
    side = near_dedup.apart(spark.createDataFrame(held, "head long, id long, part long"), texts, 2)
    pairs = near_dedup.close_pairs(side, 80).select(F.least("id_x", "id_y"), F.greatest("id_x", "id_y")).collect()
    both = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2) if a % 9 != b % 9}
    want = {(a, b) for (a, b), n in both.items() if n * 100 >= 80 * (len(sets[a]) + len(sets[b]) - n)}
    assert len(pairs) == 2 * len(want) and {tuple(p) for p in pairs} == want and 100 < len(want) < len(both) - 100


def test_near_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, None), (4, "q r s")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, component_id int, key int, id int")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 2).collect()), key=str)
    assert out == [(3, 3, True), (3, 3, True), (4, 4, True), (None, None, True), (None, None, True)]
    assert near_dedup.near_duplicates(df.limit(0), 2).count() == 0


def test_shingle_sets_follow_the_words():
    import pyarrow as pa

    texts = ["The the  THE the", "", None, "a b c", "x", "p q r p q r p q"]
    found = [len(x) for x in shingle_sets(np.frombuffer(b"".join(lowered(t).encode() for t in texts), np.uint8), utf8(pa.array(texts))[1], 2)]
    assert found == [len(shingles(t, 2)) for t in texts]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    out = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {(k, 0) for k in range(51)} | {(k, 100) for k in range(100, 140)} | {(200, 200), (201, 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    return {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_exact_groups(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(100_000 + k, t and t.upper()) for k, (_, t) in enumerate(rows[:40])] + [(200_000, None), (200_001, ""), (200_002, "É"), (200_003, "é")]
    pick = np.random.default_rng(1)
    rows += [(300_000 + k, "".join(chr(97 + c) for c in pick.integers(0, 26, 400_000))) for k in range(2)]
    rows += [(300_010 + k, rows[-2][1][: 399_999 + k]) for k in range(2)] + [(300_020, "z" * 300_000), (300_021, "Z" * 300_000)]
    out = exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()} == brute_exact(rows)


def test_exact_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "A", 5), (None, "a", 5), (None, "b", 5), (None, "B", 5)], "doc_id long, text string, keep_id int")
    out = exact_dedup.exact_duplicates(df)
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in out.collect()) == [(False, 3, False), (False, 3, False), (False, 3, True), (True, 2, False), (True, 2, True)]
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_a_digest_that_names_two_pieces_is_drawn_anew(spark, monkeypatch):
    """verified_key passes over keys under which digests collide."""
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    monkeypatch.setattr(exact_dedup, "chunks", lambda d, text, sizes, key: spark.createDataFrame([(b"x" if key < 2 else x, x) for x in (b"a", b"b")], "digest binary, piece binary"))
    assert exact_dedup.verified_key(df) == 2


def thue_morse(a, b, doublings=10):
    x, y = a, b
    for _ in range(doublings):
        x, y = x + y, y + x
    return x, y


def test_words_that_fool_polynomial_hashes_are_apart(spark):
    """A Thue-Morse word and its complement have equal sums of byte values times powers modulo 2**64."""
    x, y = thue_morse("a", "b")
    u, v = thue_morse("c", "d", 5)
    rows = [(1, x), (2, y), (3, f"{x} q"), (4, f"{y} q"), (5, u), (6, v), (7, x.upper())]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2)
    assert got(out) == brute_components(rows, 2, 80) and {c for _, _, c in got(out)} == {1, 2, 3, 4, 5, 6}


def test_links_need_both_hashes(spark, monkeypatch):
    """Where the first hash of words collides, the second one keeps unlike texts apart."""
    whole = near_dedup.shingle_sets
    monkeypatch.setattr(near_dedup, "shingle_sets", lambda data, offsets, words, key=0: [x >> np.uint64(62) for x in whole(data, offsets, words, key)] if not key else list(whole(data, offsets, words, key)))
    texts = spark.createDataFrame([(1, "a b c"), (2, "p q r"), (3, "A B C")], "id long, text string")
    sets = {r.id: (set(r.shingles), set(r.others)) for r in near_dedup.shingle_arrays(texts, 5).collect()}
    assert sets[1] == sets[3] and not sets[1][1] & sets[2][1]


def test_signatures_up_to_the_distance_share_a_key(spark):
    """Every pair that differs in at most DISTANCE symbols meets, wherever the symbols stand."""
    pick = np.random.default_rng(8)
    n = near_dedup.CHUNKS * near_dedup.SYMBOLS
    rows = []
    for k in range(400):
        x = pick.integers(0, 256, n, dtype=np.uint8)
        y = x.copy()
        at = pick.permutation(n)[: k % (near_dedup.DISTANCE + 1)] if k < 300 else np.arange(near_dedup.DISTANCE) * n // near_dedup.DISTANCE
        y[at] ^= pick.integers(1, 256, len(at), dtype=np.uint8)
        for i, z in ((2 * k, x), (2 * k + 1, y)):
            wide = np.zeros((near_dedup.CHUNKS, 8), np.uint8)
            wide[:, : near_dedup.SYMBOLS] = z.reshape(near_dedup.CHUNKS, -1)
            rows.append((i, wide.view("<i8").ravel().tolist()))
    keys = near_dedup.chunk_keys(spark.createDataFrame(rows, "id long, signature array<long>"))
    met = keys.groupBy("key").agg({"id": "collect_set"}).collect()
    assert {i // 2 for r in met for i in r[1] if i ^ 1 in r[1]} == set(range(400))


def test_variants_just_below_the_threshold(spark):
    """A group of variants that mostly lie below 0.8 of each other, where several rounds of draws leave mixed buckets."""
    pick = np.random.default_rng(12)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(150):
        text = base[:]
        for at in pick.permutation(120)[: int(pick.integers(3, 9))]:
            text[at] = f"v{k}x{at}"
        rows.append((k, " ".join(text)))
    assert got(near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2)) == brute_components(rows, 2, 80)
