"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._io import require
from causeway.llm._text import slices

#: Characters after which a long text is cut at the next safe boundary.
LONG_TEXT = 1 << 16

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token and rank on each line), kept by each worker."""
    if (ranks_path, pattern) not in _encodings:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        _encodings[ranks_path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[ranks_path, pattern]


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Cuts a long text where the split pattern always ends a match.

    Such a place is just before a space that a character other than white space follows: the
    space belongs to the match that begins there, whatever stands before it. A text without
    such a place stays whole.
    """
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut >= 0 and (cut + 1 == len(text) or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_text(coder: tiktoken.Encoding, text: str) -> np.ndarray:
    """Token ids of one text as little-endian unsigned 32-bit integers."""
    if len(text) <= LONG_TEXT:
        return np.array(coder.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(coder.encode_ordinary(x), "<u4") for x in safe_pieces(text)])


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of whole texts: carry, n_tokens (long), token_ids (binary, little-endian uint32).

    Null and empty texts give no tokens. Rows are kept one for one, repeated rows and null
    ids included; other columns than `carry` are left out, so that names can't clash.
    Text that spells a special token is ordinary text.
    """
    require(df, text, *carry)
    picked = df.select(*[F.col(c) for c in carry], F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks_path, pattern)
        for batch in slices(batches, "__text"):
            ids = [encode_text(coder, x or "") for x in batch.column("__text").to_pylist()]
            yield _with(
                batch.drop_columns(["__text"]),
                n_tokens=pa.array([len(x) for x in ids], pa.int64()),
                token_ids=pa.array([x.tobytes() for x in ids], pa.binary()),
            )

    return picked.mapInArrow(run, picked.drop("__text").withColumns({"n_tokens": F.lit(0).cast("long"), "token_ids": F.lit(b"")}).schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, token_ids: str = "token_ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Raw bytes of token ids: carry, decoded (binary). Null ids give null; an unknown id fails."""
    require(df, token_ids, *carry)
    picked = df.select(*[F.col(c) for c in carry], F.col(token_ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks_path, pattern)
        for batch in slices(batches, "__ids"):
            out = [None if x is None else coder.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column("__ids").to_pylist()]
            yield _with(batch.drop_columns(["__ids"]), decoded=pa.array(out, pa.binary()))

    return picked.mapInArrow(run, picked.drop("__ids").withColumn("decoded", F.lit(None).cast("binary")).schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode() and decode() in one pass over the texts: carry, n_tokens, token_ids, decoded."""
    require(df, text, *carry)
    picked = df.select(*[F.col(c) for c in carry], F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks_path, pattern)
        for batch in slices(batches, "__text"):
            ids = [encode_text(coder, x or "") for x in batch.column("__text").to_pylist()]
            yield _with(
                batch.drop_columns(["__text"]),
                n_tokens=pa.array([len(x) for x in ids], pa.int64()),
                token_ids=pa.array([x.tobytes() for x in ids], pa.binary()),
                decoded=pa.array([coder.decode_bytes(x.tolist()) for x in ids], pa.binary()),
            )

    added = {"n_tokens": F.lit(0).cast("long"), "token_ids": F.lit(b""), "decoded": F.lit(b"")}
    return picked.mapInArrow(run, picked.drop("__text").withColumns(added).schema)
