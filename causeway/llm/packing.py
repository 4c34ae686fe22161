"""Packing token sequences by lexical retrieval.

Documents are cut into windows of the sequence length; whole windows are sequences of their own.
What remains of each document goes to a shard of a BM25 inverted index, whose terms are token
ids. Within a shard the next unused piece is a seed: the index returns the other unused pieces
by score, and they fill the seed's window in that order, the last of them cut to fit, so that
only a shard's last sequence can be short.

Remainders are dealt to shards by content: in order of their rarest term that another document
has too, then of the second rarest, cut into shards of even size. What shares its rarest terms
is in one shard or in neighbouring ones, whatever their number; only keys of more than
a fraction of a shard are cut, first by the second term, then by rows. Each piece is in one
shard, so that neighbours by other terms alone may be missed.

Document frequencies and the mean length are those of all documents; there are as many terms as
the vocabulary has ids, and that bounds what the driver holds. A shard has about SHARD_TOKENS
tokens whatever the corpus: its number grows, not its size.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from causeway.llm._io import keep, require
from causeway.llm._text import slices, utf8
from causeway.llm.bpe import safe_pieces

#: Tokens of remainders in a shard of the index.
SHARD_TOKENS = 1 << 20
#: Keys of less than this share of a shard aren't cut.
WHOLE_KEY = 0.25
#: Parts by the second rarest term of a key that is cut.
PARTS = 64
#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: How the tokenizers library's byte-level pre-tokenizer splits text; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_engines: dict[str, object] = {}


def _byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _as_ranks(said: dict) -> tiktoken.Encoding | None:
    """The same tokenizer as ranks, if the file holds a plain byte-level BPE whose merges are made in the order of their ids."""
    model, before = said["model"], said.get("pre_tokenizer") or {}
    added = said.get("added_tokens", [])
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
    plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added):
        return None
    vocabulary, special = model["vocab"], {t["content"]: t["id"] for t in added}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocabulary[m] for m in made]
    letters = _byte_of_letter()
    ordinary = {t: i for t, i in vocabulary.items() if t not in special}
    if order != sorted(order) or len(set(order)) != len(order) or {*letters, *made} != set(ordinary):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in ordinary.items()}, special_tokens=special)


def _engine(path: str):
    """What encodes a text by a tokenizer file; kept by each worker."""
    if path not in _engines:
        with open(path, encoding="utf-8") as file:
            ranks = _as_ranks(json.load(file))
        if ranks is not None:

            def encode(text: str) -> np.ndarray:
                return np.concatenate([ranks.encode_to_numpy(x, allowed_special="all") for x in safe_pieces(text)])
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            loaded = Tokenizer.from_file(path)

            def encode(text: str) -> np.ndarray:
                return np.array(loaded.encode(text, add_special_tokens=False).ids, np.uint32)

        _engines[path] = encode
    return _engines[path]


def token_ids(column: pa.Array, path: str) -> list[np.ndarray]:
    """Token ids of each text by a file of the tokenizers library, without special tokens added.

    Where the file is a plain byte-level BPE, its own vocabulary is run as tiktoken ranks, which
    give the same ids in a fourth of the time; long texts are cut at safe boundaries. Any other
    file is run by the library itself.
    """
    encode = _engine(path)
    return [encode(t or "") for t in column.to_pylist()]


def tokenize(df: DataFrame, path: str, closing: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, tokens (long) and ids (binary, little-endian uint32) of whole texts, each closed by an id.

    Null and empty texts have the closing id alone.
    """
    require(df, text, doc_id)
    picked = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            ids = [np.append(x, np.uint32(closing)).astype("<u4") for x in token_ids(batch.column("__text"), path)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "tokens", "ids"])

    return picked.mapInArrow(run, picked.drop("__text").withColumns({"tokens": F.lit(0).cast("long"), "ids": F.lit(b"")}).schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows together, and the offsets of rows in them."""
    data, offsets = utf8(column)
    return np.frombuffer(data.tobytes(), "<u4"), offsets // 4


def document_frequencies(tokenized: DataFrame) -> DataFrame:
    """token and df: the number of documents that hold each token id, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids, offsets = _flat(batch.column("ids"))
            if not len(ids):
                continue
            width = int(ids.max()) + 1
            key = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets)) * np.uint64(width) + ids
            key.sort()
            first = np.concatenate([[True], key[1:] != key[:-1]])
            found = np.bincount((key[first] % np.uint64(width)).astype(np.int64), minlength=len(total))
            found[: len(total)] += total
            total = found
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(total[have])], names=["token", "df"])

    return tokenized.select("ids").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


class Bm25:
    """An inverted index over the pieces of one shard."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(pieces)
        size = np.array([len(x) for x in pieces])
        terms = np.concatenate(pieces).astype(np.int64)
        width = len(idf)
        cell, tf = np.unique(np.repeat(np.arange(self.n), size) * width + terms, return_counts=True)
        doc, term = cell // width, cell % width
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean_length))
        self.own, self.bounds = term, np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.term = doc[order], weight[order], term[order]
        self.places = np.arange(width + 1)
        self.posting = np.searchsorted(self.term, self.places)

    def without(self, used: np.ndarray) -> None:
        """Takes the postings of used pieces out."""
        live = ~used[self.doc]
        self.doc, self.weight, self.term = self.doc[live], self.weight[live], self.term[live]
        self.posting = np.searchsorted(self.term, self.places)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece for the seed's distinct terms."""
        terms = self.own[self.bounds[seed] : self.bounds[seed + 1]]
        spans = [slice(a, b) for a, b in zip(self.posting[terms].tolist(), self.posting[terms + 1].tolist(), strict=True) if a < b]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), minlength=self.n)


def _best_first(scores: np.ndarray) -> Iterator[int]:
    """Places in order of falling scores, equal ones in their own order; the best few are sorted alone."""
    most = 32
    bound = np.partition(scores, -most)[-most] if len(scores) > most else -np.inf
    best = np.flatnonzero(scores >= bound)
    yield from best[np.argsort(-scores[best], kind="stable")].tolist()
    others = np.flatnonzero(scores < bound)
    yield from others[np.argsort(-scores[others], kind="stable")].tolist()


def fill_windows(pieces: list[np.ndarray], length: int, idf: np.ndarray, mean_length: float) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, from, to) that use every token of the pieces once.

    Postings of used pieces are taken out of the index whenever a fourth of them are.
    """
    index = Bm25(pieces, idf, mean_length)
    size = np.array([len(x) for x in pieces])
    used = np.zeros(len(pieces), np.int64)
    indexed = len(pieces)
    for seed in range(len(pieces)):
        while used[seed] < size[seed]:
            window, room = [(seed, int(used[seed]), int(size[seed]))], length - int(size[seed] - used[seed])
            used[seed] = size[seed]
            if room:
                free = np.flatnonzero(used < size)
                if len(free) < indexed * 3 / 4:
                    index.without(used >= size)
                    indexed = len(free)
                for place in _best_first(index.scores(seed)[free]):
                    other = int(free[place])
                    take = min(room, int(size[other] - used[other]))
                    window.append((other, int(used[other]), int(used[other]) + take))
                    used[other] += take
                    room -= take
                    if not room:
                        break
            yield window


def rarest(ids: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and second smallest rank (by token id) of each row's ids, none of them without any."""
    ranks = rank[ids]
    first = np.minimum.reduceat(ranks, offsets[:-1])
    ranks[ranks == np.repeat(first, np.diff(offsets))] = len(rank)
    return first, np.minimum.reduceat(ranks, offsets[:-1])


def _laid_out(counts, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, the place among all tokens where each begins, and the tokens it is spread over; from key and n.

    A key of less than WHOLE_KEY of a shard is put in its middle as a whole.
    """
    counts = counts.sort_values("key")
    n = counts["n"].to_numpy(np.float64)
    start = np.cumsum(n) - n
    small = n < WHOLE_KEY * size
    return counts["key"].to_numpy(np.int64), np.where(small, start + n / 2, start), np.where(small, 0.0, n)


def pack(tokenized: DataFrame, length: int = 2048, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of sequences of at most `length` tokens, from (doc_id, tokens, ids).

    One row for each piece: doc_id, start (ids of its document before it), length, doc_tokens,
    sequence_id, offset (in its sequence, gapless from 0) and ids (binary, little-endian
    uint32). Each id of each document is in exactly one piece. Null and repeated doc_ids are
    documents of their own. Rows must be read again unchanged: give a written table.
    """
    require(tokenized, "doc_id", "tokens", "ids")
    tokenized = tokenized.select("doc_id", "tokens", "ids")
    size = tokenized.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.col("tokens") % length), F.lit(0)).alias("left")).first()
    counts = document_frequencies(tokenized).toPandas()  # one row for each id of the vocabulary at most
    df = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1)
    df[counts["token"].to_numpy(np.int64)] = counts["df"]
    idf = np.log1p((size["n"] - df + 0.5) / (df + 0.5)).clip(min=0)
    mean_length = max(1.0, size["all"] / max(1, size["n"]))
    shards = max(1, round(size["left"] / shard_tokens))

    whole = tokenized.where(F.col("tokens") >= length).select("doc_id", "tokens", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"tokens div {length} - 1"))).alias("k"))
    whole = whole.select(
        "doc_id", (F.col("k") * length).alias("start"), F.lit(length).cast("long").alias("length"), F.col("tokens").alias("doc_tokens"),
        (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.substring("ids", (F.col("k") * (4 * length) + 1).cast("int"), F.lit(4 * length)).alias("ids"),
    )

    names = whole.columns

    def run(key, shard):
        shard = shard.sort_by("row")
        pieces = [np.frombuffer(x, "<u4") for x in shard.column("ids").to_pylist()]
        base, tokens = shard.column("start").to_numpy(), shard.column("tokens")
        doc, start, n, at, sequence, offset, ids = [], [], [], [], [], [], []
        for k, window in enumerate(fill_windows(pieces, length, idf, mean_length)):
            place = 0
            for piece, a, b in window:
                doc.append(piece)
                start.append(base[piece] + a)
                n.append(b - a)
                sequence.append(2 * ((key[0].as_py() << 32) + k) + 1)
                offset.append(place)
                ids.append(pieces[piece][a:b].tobytes())
                place += b - a
        at = pa.array(doc, pa.int64())
        return pa.table([shard.column("doc_id").take(at), pa.array(start, pa.int64()), pa.array(n, pa.int64()), tokens.take(at), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(ids, pa.binary())], names=names)

    rest = tokenized.withColumn("row", F.monotonically_increasing_id()).where(F.col("tokens") % length > 0)
    start = F.expr(f"tokens - tokens % {length}")
    rest = rest.select("doc_id", "tokens", "row", start.alias("start"), F.expr(f"substring(ids, cast(4 * (tokens - tokens % {length}) + 1 as int))").alias("ids"))
    if shards == 1:
        rest = rest.withColumn("shard", F.lit(0).cast("long"))
    else:
        rest = _dealt(rest, df, shards, size["left"])
    return whole.union(rest.groupBy("shard").applyInArrow(run, whole.schema))


def _dealt(rest: DataFrame, df: np.ndarray, shards: int, total: int) -> DataFrame:
    """rest with the column shard, by content."""
    size = total / shards
    # Terms in order of rarity; those of a single document join nothing and come last.
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), np.where(df > 1, df, np.inf)))] = np.arange(len(df))
    rank[df <= 1] = len(df)

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, offsets = _flat(batch.column("ids"))
        first, second = rarest(ids, offsets, rank)
        return first, first * PARTS + second * PARTS // (len(rank) + 1), np.diff(offsets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, part, n = keys(batch)
                part, at = np.unique(part, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.bincount(at, n).astype(np.int64))], names=["part", "n"])

    parts = keep(rest.select("ids").mapInArrow(counted, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")), "keys")
    whole_key = F.col("part") - F.col("part") % PARTS
    key_sizes = parts.groupBy(whole_key.alias("key")).agg(F.sum("n").alias("n"))
    large = key_sizes.where(F.col("n") >= WHOLE_KEY * size).select("key")  # at most shards / WHOLE_KEY
    # One row for each id of the vocabulary, and PARTS for each large key, at most.
    fine = parts.withColumn("key", whole_key).join(large, "key").select(F.col("part").alias("key"), "n")
    coarse = key_sizes.join(large, "key", "left_anti")
    cut = np.sort(np.array([r.key for r in large.collect()], np.int64))
    order, begin, spread = _laid_out(coarse.union(fine).toPandas(), size)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, part, _ = keys(batch)
                at = np.searchsorted(order, np.where(np.isin(first * PARTS, cut), part, first * PARTS))
                draw = batch.column("draw").to_numpy(zero_copy_only=False) / 2.0**20
                shard = np.minimum((begin[at] + draw * spread[at]) // size, shards - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(shard)], names=[*names, "shard"])

    names = rest.columns
    drawn = rest.withColumn("draw", F.pmod(F.xxhash64("row"), F.lit(1 << 20)))
    return drawn.mapInArrow(placed, rest.withColumn("shard", F.lit(0).cast("long")).schema)


def pack_documents(df: DataFrame, path: str, closing: int, length: int = 2048, text: str = "text", doc_id: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """tokenize() and pack() of whole documents, with the tokens written once in between."""
    return pack(keep(tokenize(df, path, closing, text, doc_id), "tokens"), length, shard_tokens)
