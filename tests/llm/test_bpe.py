"""Encoding and decoding against the library on whole texts."""

import public_tokenizers
import pytest

from causeway.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, n_tokens int, decoded string"
LONG = "Größe, 12345 and 東京!\n\n  " * 20_000
TEXTS = [(None, "Hello world"), (1, None), (2, ""), (3, "same"), (3, "same"), (3, "other"), (4, "\U0001f600 é\u0000 \t\r\n"), (5, LONG), (6, "x" * 100_000), (7, "<|endoftext|>"), (8, " " * 5000)]


@pytest.fixture(scope="module")
def coder():
    return bpe.encoding(PATH, PATTERN)


def test_nulls_repeats_and_long_texts(spark, coder):
    df = spark.createDataFrame([(*r, 1, "x") for r in TEXTS], SCHEMA)
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.token_ids), bytes(r.decoded)) for r in bpe.round_trip(df, PATH, PATTERN).collect()), key=repr)
    want = []
    for i, t in TEXTS:
        ids = coder.encode_ordinary(t or "")
        want.append((i, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), (t or "").encode()))
    assert got == sorted(want, key=repr)


def test_an_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH, PATTERN).collect() == []
