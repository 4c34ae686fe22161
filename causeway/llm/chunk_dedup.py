"""Repeated passages by content-defined chunking with a gear rolling hash.

Texts are cut where the rolling hash has a local peak, so that a passage is cut alike wherever
it stands and an insertion moves no boundary beyond its surroundings. Chunks are named by a
128-bit digest. Of the chunks with one name the first stays (smallest doc_id, then position);
the later ones are repeats. A single repeated chunk of a few words means little: repeats are
removed in runs of neighbouring chunks of at least `least_run` bytes together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm import _bloom
from causeway.llm._chunks import peak_cuts
from causeway.llm._io import keep, require
from causeway.llm._text import slices, utf8

#: A boundary is the peak among this many places on either side; chunks are longer than it.
REACH = 16
#: Bytes of neighbouring repeats that are removed together at least. A passage loses about 110 bytes
#: at its ends, and one of just over 50 words may have little more than 200.
LEAST_RUN = 80
#: Blocks of the filter of documents that may lose bytes: at most 2**20 rows of 12 bytes.
BLOCKS = 1 << 20


def _ends(column: pa.Array, reach: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All bytes, the chunks' ends, and the number of chunks before each row."""
    data, offsets = utf8(column)
    cuts = peak_cuts(data, offsets, reach)
    return data.tobytes(), cuts, np.searchsorted(cuts, offsets, "right")


def chunk_names(df: DataFrame, text: str = "text", doc_id: str = "doc_id", reach: int = REACH) -> DataFrame:
    """One row for each chunk: doc_id, chunk (number in the row's text), size (bytes), hi and lo (its digest), again.

    again: whether the chunk stands earlier in the same text.
    """
    require(df, text, doc_id)
    picked = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, cuts, at = _ends(batch.column("__text"), reach)
            ends = [0, *cuts.tolist()]
            names = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:], strict=False))
            names = np.frombuffer(names, "<i8").reshape(-1, 2)
            n = np.diff(at)
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((names[:, 1], names[:, 0], row))
            same = (row[order][1:] == row[order][:-1]) & (names[order][1:] == names[order][:-1]).all(1)
            again = np.zeros(len(names), bool)
            again[order[1:][same]] = True  # the sort is stable: the first of equal ones comes first
            chunk = np.arange(len(names)) - np.repeat(at[:-1], n)
            size = np.diff(cuts, prepend=0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(chunk.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(again)], names=["doc_id", "chunk", "size", "hi", "lo", "again"])

    long = F.lit(0).cast("long")
    shape = picked.select("doc_id", F.lit(0).alias("chunk"), F.lit(0).alias("size"), long.alias("hi"), long.alias("lo"), F.lit(True).alias("again"))
    return picked.mapInArrow(run, shape.schema)


def repeated_chunks(names: DataFrame) -> DataFrame:
    """doc_id, chunk and size of every chunk whose digest stands earlier: before it in its own text, or in a smaller doc_id.

    Of a text's equal chunks only the first is compared with other texts.
    """
    first = names.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max("again").alias("twice"))
    first = first.where("first_id < last_id OR twice").select("hi", "lo", "first_id")
    return names.join(first, ["hi", "lo"]).where("again OR doc_id > first_id").select("doc_id", "chunk", "size")


def _longest_run(repeats: Column) -> Column:
    """Bytes of the longest run of neighbouring chunks among (chunk, size), sorted."""
    none = F.struct(F.lit(-2).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("most"))

    def longer(so_far: Column, x: Column) -> Column:
        run = F.when(x.chunk == so_far.last + 1, so_far.run).otherwise(F.lit(0).cast("long")) + x["size"]
        return F.struct(x.chunk.alias("last"), run.alias("run"), F.greatest(so_far.most, run).alias("most"))

    return F.aggregate(repeats, none, longer, lambda so_far: so_far.most)


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", reach: int = REACH, least_run: int = LEAST_RUN) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_chunks, n_removed, n_spans, spans, kept.

    spans (array of struct start, length) are the removed bytes and kept (binary) the others;
    a boundary may fall within a character. Null counts as empty. Rows with a null
    doc_id are kept whole and make nothing a repeat. Rows that repeat a doc_id count as one
    document's parts with the same chunk numbers: a chunk that each of them holds once stays.

    Chunks are cut anew in each pass over df instead of being written, and only texts that may lose
    bytes are shuffled.
    """
    picked = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    named = picked.where("doc_id IS NOT NULL")
    marks = repeated_chunks(chunk_names(named, "__text", "doc_id", reach)).groupBy("doc_id")
    marks = keep(marks.agg(F.array_sort(F.collect_list(F.struct("chunk", "size"))).alias("__repeats")), "marks")  # as many as the document has chunks
    # The rows of a repeated doc_id have each other's chunk numbers, with sizes of their own.
    several = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    open_ = marks.where(_longest_run(F.col("__repeats")) >= least_run).select("doc_id").union(several)
    marked = _bloom.mark(picked, "doc_id", _bloom.build(open_, "doc_id", BLOCKS), BLOCKS, "__open")
    chunks = marks.select("doc_id", F.col("__repeats.chunk").alias("__repeats"))
    cut = marked.where("__open").join(chunks, "doc_id", "left").select("doc_id", "__text", "__repeats")
    joined = cut.union(marked.where("NOT __open").select("doc_id", "__text", F.lit(None).cast("array<int>").alias("__repeats")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, cuts, at = _ends(batch.column("__text"), reach)
            ends = np.concatenate([[0], cuts])
            out = []
            for row, repeats in enumerate(batch.column("__repeats").to_pylist()):
                mine = ends[at[row] : at[row + 1] + 1]
                base, size = int(mine[0]), int(mine[-1] - mine[0])
                numbers = np.unique(np.array(repeats or [], np.int64))
                numbers = numbers[numbers < len(mine) - 1]  # those of a longer text with the same doc_id don't exist here
                spans = _runs(numbers, mine - base, least_run)
                kept, to = [], 0
                for a, b in spans:
                    kept.append(data[base + to : base + a])
                    to = b
                kept.append(data[base + to : base + size])
                out.append((size, len(mine) - 1, sum(b - a for a, b in spans), len(spans), [{"start": a, "length": b - a} for a, b in spans], b"".join(kept)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", "spans", "kept"])

    shape = "n_bytes bigint, n_chunks bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,length:bigint>>, kept binary"
    return joined.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {shape}")


def _runs(repeats: np.ndarray, ends: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte ranges of runs of neighbouring repeated chunks of at least `least` bytes."""
    if not len(repeats):
        return []
    cut = np.flatnonzero(np.diff(repeats) > 1)
    first, last = repeats[np.concatenate([[0], cut + 1])], repeats[np.concatenate([cut, [len(repeats) - 1]])]
    spans = zip(ends[first].tolist(), ends[last + 1].tolist(), strict=True)
    return [(a, b) for a, b in spans if b - a >= least]
