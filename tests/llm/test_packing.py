"""Packing and BPE against the libraries called on whole texts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from causeway.llm import bpe, packing

SMALL = "/root/testdata/sf0.001"
JSON = P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a", "a  b\n c \n\n  d", "it's <|endoftext|> there <|endoftext|>", "x" * 5000, "     é 　ü a b \x1c c\x85 d", "日本語 テキスト 123 456", "a" + " " * 3000 + "b", "tab\t x\r\n y", "﻿ z é \U0001f600 !?"]


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + ODD


def test_token_ids_equal_the_library_on_whole_texts(spark):
    coder = Tokenizer.from_file(JSON)
    all_ = texts(spark)
    want = [x.ids for x in coder.encode_batch([t or "" for t in all_], add_special_tokens=False)]
    assert [x.tolist() for x in packing.token_ids(pa.array(all_), JSON)] == want
    words = P.path("word_bpe_49k.json")
    want = [x.ids for x in Tokenizer.from_file(words).encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert [x.tolist() for x in packing.token_ids(pa.array(ODD), words)] == want


@pytest.mark.parametrize("shard", [1 << 14, 1 << 20])
def test_every_token_is_packed_once(spark, shard):
    rows = [(k, t, "x") for k, t in enumerate(texts(spark))] + [(None, "a b", "x"), (None, None, "x"), (7000, "long " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = [r.asDict() for r in packing.pack_documents(df, JSON, 1, shard_tokens=shard).collect()]
    sequences, documents = {}, {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            documents.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
    short = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        short += 2048 - at
    total = sum(r["length"] for r in out)
    assert short <= 2048 * max(1, round(total / shard))
    coder = Tokenizer.from_file(JSON)
    for k, t, _ in rows:
        if k is not None:
            ids = b"".join(x for _, x, _ in sorted(documents[k]))
            assert np.frombuffer(ids, "<u4").tolist() == [*coder.encode(t or "", add_special_tokens=False).ids, 1]
            at = 0
            for start, x, n in sorted(documents[k]):
                assert start == at and 4 * n == len(ids)
                at += len(x) // 4
    assert sum(r["length"] for r in out if r["doc_id"] is None) == len(coder.encode("a b").ids) + 2
    assert packing.pack_documents(df.limit(0), JSON, 1).count() == 0


def test_neighbours_come_by_score():
    """A seed's window takes the piece that shares its rare tokens before others."""
    pieces = [np.array([5, 6, 7]), np.array([1, 1, 2]), np.array([6, 7, 9]), np.array([2, 3, 4])]
    windows = list(packing.fill_windows(pieces, 6, np.ones(10), 3.0))
    assert windows[0] == [(0, 0, 3), (2, 0, 3)] and windows[1] == [(1, 0, 3), (3, 0, 3)]
    scores = packing.Bm25(pieces, np.ones(10), 3.0).scores(0)
    assert scores[0] > scores[2] > scores[1] == scores[3] == 0
    # one term of weight idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
    assert np.isclose(scores[2], 2 * 1 * (packing.K1 + 1) / (1 + packing.K1))


def test_planted_neighbours_share_sequences_in_many_shards(spark):
    """Documents of one topic meet in sequences however many shards there are, and large topics are cut."""
    pick = np.random.default_rng(4)
    rows = []
    for k in range(1200):
        topic = k // 4 if k < 800 else 1000
        ids = np.concatenate([pick.integers(1, 400, 180), np.full(8, 500 + topic), np.full(4, 2000 + topic), [1]])
        rows.append((k, len(ids), pick.permutation(ids).astype("<u4").tobytes()))
    df = spark.createDataFrame([rows[k] for k in pick.permutation(len(rows))], "doc_id long, tokens long, ids binary").repartition(7)
    out = packing.pack(packing.keep(df, "tokens"), 512, 1 << 13).collect()
    mates = {}
    for r in out:
        mates.setdefault(r.sequence_id, set()).add(r.doc_id)
    assert len({s >> 33 for s in mates if s % 2}) > 20
    met = {(a, b) for s in mates.values() for a in s for b in s if a < b}
    topics = [any((a, b) in met for a in range(4 * t, 4 * t + 4) for b in range(a + 1, 4 * t + 4)) for t in range(200)]
    assert sum(topics) >= 195
    sizes = {}
    for r in out:
        sizes[r.sequence_id >> 33] = sizes.get(r.sequence_id >> 33, 0) + r.length
    assert max(sizes.values()) < 2 * (1 << 13) and sum(sizes.values()) == sum(n for _, n, _ in rows)


def test_bpe_round_trip(spark, monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    all_ = [*texts(spark), ("word " * 40_000) + "  " + "tail　x " * 9000, "no_space" * 20_000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(all_)], "doc_id long, text string, token_ids int")
    coder = bpe.encoding(path, P.PATTERN)
    want = {}
    for k, t in enumerate(all_):
        ids = coder.encode_ordinary(t or "")
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), (t or "").encode())
    out = bpe.round_trip(df, path, P.PATTERN).collect()
    assert {r.doc_id: (r.n_tokens, hashlib.sha256(r.token_ids).hexdigest(), bytes(r.decoded)) for r in out} == want
    apart = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in apart.collect()} == {k: w[2] for k, w in want.items()}
    nothing = spark.createDataFrame([(1, None)], "doc_id long, token_ids binary")
    assert bpe.decode(nothing, path, P.PATTERN).first().decoded is None
    assert zlib.crc32(b"") == 0


def test_safe_pieces_do_not_change_matches():
    coder = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for t in ODD[1:]:
        assert "".join(bpe.safe_pieces(t, 3)) == t
        assert [i for x in bpe.safe_pieces(t, 3) for i in coder.encode_ordinary(x)] == coder.encode_ordinary(t)
