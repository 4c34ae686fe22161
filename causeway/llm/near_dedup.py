"""Near duplicates by MinHash and a multi-index Hamming join over b-bit signatures.

A text's signature has CHUNKS chunks of SYMBOLS minhashes, of which 8 bits each are kept. Two
signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols have, by the pigeonhole
principle, a chunk that differs in at most ERRORS = 1. The allowed errors of a chunk are
enumerated by leaving out each of its symbols in turn: equal keys (chunk, place left out, other
symbols) find every such pair. At the similarity of 0.8 a chunk of 7 has at most one error with
probability 0.58, so that a pair has no key in common with probability 0.42**12 = 3e-5, and
less above it.

Shingles are named by two 64-bit hashes under different keys. Every pair found is decided on the
full sets of both: a link needs enough of either in common, so that a collision alone links nothing.

Pairs of a bucket are not all emitted; see causeway.llm._buckets. Those between components that
the draws left apart are decided, without exception, by how their sets differ from one member's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm import _bloom
from causeway.llm._buckets import BLOCKS, link_buckets
from causeway.llm._io import keep, require
from causeway.llm._text import lists, lower, mix, shingle_sets, slices, utf8

CHUNKS, SYMBOLS = 12, 7
#: Signature distance up to which all pairs are found.
DISTANCE = CHUNKS * 2 - 1
#: Members of a bucket that are held against all its others in one partition.
SLOT = 1024

#: The key of the second hash of words.
SECOND = 0x5DEECE66D

_FACTORS = np.random.default_rng(3).integers(0, 2**63, CHUNKS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(members: np.ndarray) -> np.ndarray:
    """The low 8 bits of scrambled minima of CHUNKS * SYMBOLS hash functions over a set."""
    least = np.full(len(_FACTORS), np.uint64(2**64 - 1))
    for at in range(0, len(members), 2048):
        h = members[at : at + 2048, None] * _FACTORS
        least = np.minimum(least, h.min(0))
    return (mix(least) & np.uint64(255)).astype(np.uint8)


def signatures(df: DataFrame, words: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each row: doc_id, n_shingles, set_id (128-bit digest of the set), signature.

    signature: CHUNKS integers, each with SYMBOLS bytes; null for the empty set.
    """
    picked = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, offsets = utf8(batch.column("__text"))
            data = lower(data)
            n, ids, signs = [], [], []
            for members, others in zip(shingle_sets(data, offsets, words), shingle_sets(data, offsets, words, SECOND), strict=True):
                n.append(len(members))
                ids.append(hashlib.blake2b(members.tobytes() + others.tobytes(), digest_size=16).digest())
                parts = np.zeros((CHUNKS, 8), np.uint8)
                parts[:, :SYMBOLS] = minhash(members).reshape(CHUNKS, SYMBOLS)
                signs.append(parts.view("<i8").ravel() if len(members) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "signature"])

    shape = {"n_shingles": F.lit(0).cast("long"), "set_id": F.lit(b""), "signature": F.lit(None).cast("array<bigint>")}
    return picked.mapInArrow(run, picked.drop("__text").withColumns(shape).schema)


def chunk_keys(signed: DataFrame) -> DataFrame:
    """key and id for every chunk and every place left out, from (id, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column("signature").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, CHUNKS)
            s = s.view(np.uint8).reshape(len(s), CHUNKS, 8)[:, :, :SYMBOLS].astype(np.int64)
            keys = []
            for left_out in range(SYMBOLS):
                k = np.zeros(s.shape[:2], np.int64)
                for place in range(SYMBOLS):
                    if place != left_out:
                        k = (k << 8) | s[:, :, place]
                keys.append(k + ((np.arange(CHUNKS, dtype=np.int64) * SYMBOLS + left_out) << 48))
            keys = np.stack(keys, 2).reshape(len(s), -1)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(s)), keys.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), ids], names=["key", "id"])

    signed = signed.select("id", "signature")
    return signed.mapInArrow(run, signed.select(F.lit(0).cast("long").alias("key"), "id").schema)


def shingle_arrays(df: DataFrame, words: int) -> DataFrame:
    """id, shingles and others (array<long>, distinct: by either hash) from (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            data = lower(data)
            sets = [lists([x.view(np.int64) for x in shingle_sets(data, offsets, words, key)], pa.int64()) for key in (0, SECOND)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *sets], names=["id", "shingles", "others"])

    df, none = df.select("id", "text"), F.array(F.lit(0).cast("long"))
    return df.mapInArrow(run, df.select("id", none.alias("shingles"), none.alias("others")).schema)


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= percent * union.

    Shingles are computed for documents that a pair names only: a Bloom filter drops nearly all
    others before the shuffle, the joins drop the rest.
    """
    named = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    few = _bloom.mark(texts, "id", _bloom.build(named, "id", BLOCKS), BLOCKS, "__named").where("__named")
    sets = shingle_arrays(few, words)
    a, b = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"), F.col("others").alias(f"o{c}")) for c in "ab")
    joined = pairs.join(b, "b").join(a, "a")
    both = F.least(F.size(F.array_intersect("sa", "sb")), F.size(F.array_intersect("oa", "ob")))
    return joined.select("a", "b", (F.size("sa") + F.size("sb")).alias("all"), both.alias("both")).where(F.col("both") * 100 >= (F.col("all") - F.col("both")) * percent).select("a", "b").distinct()


def apart(held: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """held (head, id, part) with n, the size of id's set, and away: the shingles that only one of id and head has.

    Members of a bucket are mostly variants of one text, so that these are few where whole sets are large.
    """
    few = _bloom.mark(texts, "id", _bloom.build(held.select("id"), "id", BLOCKS), BLOCKS, "__named").where("__named")
    sets = shingle_arrays(few, words)
    member, head = sets.select("id", "shingles"), sets.select(F.col("id").alias("head"), F.col("shingles").alias("of_head"))
    away = F.concat(F.array_except("shingles", "of_head"), F.array_except("of_head", "shingles"))
    return held.join(member, "id").join(head, "head").select("head", "id", "part", F.size("shingles").alias("n"), away.alias("away"))


def close_pairs(side: DataFrame, percent: int) -> DataFrame:
    """The pairs of different parts under one head that are similar enough by what sets them apart from it.

    What two sets differ in is what either differs from the head in, but for what both do: their
    difference follows from sizes and the intersection of two short arrays, exactly. It is
    no less than the difference of sizes and of distances from the head, which is tested first.
    Heads of many members are dealt to slots: a member in its own is held against all others there.
    """
    slots = side.groupBy("head").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    dealt = keep(side.join(slots, "head"), "apart")
    own, every = F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    x, y = (dealt.select("head", slot.alias("slot"), *[F.col(c).alias(f"{c}_{end}") for c in ("id", "part", "n", "away")]) for slot, end in ((own, "x"), (every, "y")))
    total = F.col("n_x") + F.col("n_y")

    def enough(differ: Column) -> Column:
        return (total - differ) * 100 >= (total + differ) * percent

    least = F.greatest(F.abs(F.col("n_x") - F.col("n_y")), F.abs(F.size("away_x") - F.size("away_y")))
    differ = F.size("away_x") + F.size("away_y") - 2 * F.size(F.array_intersect("away_x", "away_y"))
    return x.join(y, ["head", "slot"]).where((F.col("part_x") < F.col("part_y")) & enough(least) & enough(differ)).select("id_x", "id_y")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space and 9-13 after lower-casing A-Z. A text's set holds
    its distinct runs of `words` words; with fewer words, the whole sequence. Texts without
    words, null ones included, have the empty set and are linked with nothing. component_id is
    the smallest doc_id reachable over links (the row's own where there is none); kept says
    whether it is the row's own. Rows with a null doc_id take no part: no component, kept.
    Rows that repeat a doc_id are judged each by its own text. Other columns are left out.
    """
    require(df, text, doc_id)
    signed = keep(signatures(df, words, text, doc_id), "signatures")
    first = signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("id"))
    rows = keep(signed.join(first, "set_id", "left").select("doc_id", "n_shingles", "signature", "id"), "sets")

    # One document of each set from here on.
    alone = rows.where(F.col("doc_id") == F.col("id"))
    texts = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def across(mixed: DataFrame) -> DataFrame:
        heads = mixed.groupBy("key").agg(F.min("id").alias("head"))
        held = keep(mixed.join(heads, "key").select("head", "id", "part").distinct(), "held")
        return close_pairs(apart(held, texts, words), percent)

    parts = link_buckets(chunk_keys(alone), lambda pairs: verify(pairs, texts, words, percent), across)
    found = rows.join(parts.withColumnRenamed("node", "id"), "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
