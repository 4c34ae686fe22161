"""Exact duplicates by content-defined chunk recipes.

A normalised text is cut into chunks by content; a chunk is named by a 128-bit digest. The
names are verified: the distinct (digest, bytes) pairs of the corpus are grouped by digest, and
should any digest name two byte strings, all are drawn anew under another key. A text is then
the ordered list of its chunks' names, its recipe, and texts are equal when recipes are. The
bytes of a document move once, as distinct chunks; grouping and joining move recipes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._chunks import mask_cuts
from causeway.llm._io import keep, require
from causeway.llm._text import lower, slices, utf8

#: Bytes in a chunk: on average, at least and at most.
CHUNK = (2048, 512, 1 << 16)


def _digest(piece: bytes, key: int) -> bytes:
    return hashlib.blake2b(piece, digest_size=16, key=b"" if not key else key.to_bytes(4, "little")).digest()


def _cut(column: pa.Array, sizes: tuple[int, int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The normalised bytes, the chunks' ends, and the number of chunks before each row."""
    data, offsets = utf8(column)
    data = lower(data)
    cuts = mask_cuts(data, offsets, *sizes)
    return data.tobytes(), cuts, np.searchsorted(cuts, offsets, "right")


def chunks(df: DataFrame, text: str = "text", sizes: tuple[int, int, int] = CHUNK, key: int = 0) -> DataFrame:
    """All chunks of the normalised texts: digest, piece (both binary), without repeats in a slice."""
    require(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, cuts, _ = _cut(batch.column("text"), sizes)
            pieces = {data[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False)}
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x, key) for x in pieces], pa.binary()), pa.array(pieces, pa.binary())], names=["digest", "piece"])

    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "digest binary, piece binary")


def verified_key(df: DataFrame, text: str = "text", sizes: tuple[int, int, int] = CHUNK) -> int:
    """The first key under which each digest of the corpus names one byte string only."""
    key = 0
    while True:
        distinct = chunks(df, text, sizes, key).groupBy("digest", "piece").agg(F.count("*").alias("n"))
        if distinct.groupBy("digest").count().where("count > 1").isEmpty():
            return key
        key += 1


def recipes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", sizes: tuple[int, int, int] = CHUNK, key: int = 0) -> DataFrame:
    """For each row: doc_id, n_bytes, recipe (the chunks' digests in order), text_sha256 of the normalised text."""
    require(df, text, doc_id)
    picked = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, cuts, at = _cut(batch.column("__text"), sizes)
            ends, rows = [0, *cuts.tolist()], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                piece = data[ends[a] : ends[b]]
                names = b"".join(_digest(data[ends[k] : ends[k + 1]], key) for k in range(a, b))
                rows.append((len(piece), names, hashlib.sha256(piece).hexdigest()))
            n, names, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(sha)], names=["doc_id", "n_bytes", "recipe", "text_sha256"])

    return picked.mapInArrow(run, picked.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("recipe"), F.lit("").alias("text_sha256")).schema)


def exact_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", sizes: tuple[int, int, int] = CHUNK) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal
    texts the row with the largest doc_id stays (keep_id); a null id is below all others. Of
    rows that repeat that id too, one stays. Other columns are left out, so that names can't clash.
    """
    found = recipes(df, text, doc_id, sizes, verified_key(df, text, sizes))
    found = keep(found.withColumn("row", F.monotonically_increasing_id()), "recipes")
    best = found.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("size")).where("size > 1")
    return found.join(best, "recipe", "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_bytes",
    )
