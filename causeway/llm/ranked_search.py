"""Ranked lexical search: the best documents of every item, over a document FP-tree.

A document is restricted to the items' terms, ordered by how many documents hold them, most
first: documents that share leading terms share a path of the tree. They are dealt out by ranges
of these paths, ties by row, so that each task holds a stretch of the whole tree and a group of
copies is spread over several. A node knows the largest count of each term below it and the
smallest length norm; a score grows with counts and shrinks with the norm, so that both together
bound every score below. An item goes depth first, best bound first, and leaves out the nodes
that are bounded below its k-th best score so far. It starts from a floor, the k-th best score in
a sample of documents, which can only be too low: no document of the result is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm._io import keep, require
from causeway.llm._text import lists

#: Bytes of items that are searched for at once; their terms go to every task.
ITEM_BYTES = 1 << 22
#: Counts (document and term) in a task's stretch of the tree, at about the most.
SHARD_COUNTS = 1 << 20
#: Documents under one leaf, unless more have the very same terms.
LEAF_DOCUMENTS = 64
#: Documents that the floors are taken from, at about the most.
SAMPLE = 20_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RESTRICTED = "doc_id long, n long, terms array<int>, counts array<int>"


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of digits, letters and non-ASCII characters in order, A-Z lower-cased."""
    return [] if text is None else text.encode().translate(_FOLD).split()


def weight(n_documents: int, holding: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) for each df."""
    return np.floor(1000 * np.log((2 * n_documents + 2) / (2 * np.asarray(holding, np.float64) + 1))).astype(np.int64)


def norm(n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """100 - 50 + ((50 n N) div L) for each document's number of terms n."""
    return 50 + 50 * np.asarray(n, np.int64) * n_documents // n_terms


class Node:
    """Entries, which are documents (in a leaf) or nodes, each with a norm and counts by term."""

    def __init__(self, first: int, entries: list[Node] | None):
        self.first, self.entries = first, entries

    def fill(self, norms: np.ndarray, term: np.ndarray, entry: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        term, self.norms, self.entry, self.count = term[order], norms, entry[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.terms, self.at = term[at], np.append(at, len(term))
        # What bounds the whole node in the one above.
        self.most, self.least = np.maximum.reduceat(self.count, at) if len(at) else self.count, norms.min()

    def scores(self, asked: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of documents, or bounds of nodes, for an item's terms (ascending)."""
        at = np.searchsorted(self.terms, asked)
        hit = np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == asked) if len(self.terms) else at[:0]
        start, size = self.at[at[hit]], self.at[at[hit] + 1] - self.at[at[hit]]
        total = int(size.sum())
        some = np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)
        entry, count = self.entry[some], self.count[some]
        part = np.repeat(weights[hit], size) * (1_000_000_000 * count // (1000 * count + 20 * self.norms[entry]))
        # Sums stay far below 2**53, where doubles are exact.
        return np.bincount(entry, part, len(self.norms)).astype(np.int64)


def grow(path: np.ndarray, at: np.ndarray, count: np.ndarray, norms: np.ndarray) -> Node:
    """The tree of documents in the order of their paths; document k has path[at[k]:at[k+1]]."""
    size = np.diff(at)

    def leaf(a: int, b: int) -> Node:
        node, span = Node(a, None), slice(at[a], at[b])
        node.fill(norms[a:b], path[span], np.repeat(np.arange(b - a), size[a:b]), count[span])
        return node

    root, inner = Node(0, []), []
    todo = [(root, 0, len(norms))]
    while todo:
        node, a, b = todo.pop()
        inner.append(node)
        one, other = path[at[a] : at[a + 1]], path[at[b - 1] : at[b]]
        both = min(len(one), len(other))
        differ = np.flatnonzero(one[:both] != other[:both])
        depth = int(differ[0]) if len(differ) else both  # what the first and the last share, all between them do
        ends = size[a:b] == depth
        branch = np.where(ends, -1, path[np.minimum(at[a:b] + depth, len(path) - 1)])
        cuts = [a, *(a + 1 + np.flatnonzero(branch[1:] != branch[:-1])).tolist(), b]
        start = a
        for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if high - low > LEAF_DOCUMENTS and not (ends[low - a] or low == a and high == b):
                if start < low:
                    node.entries.append(leaf(start, low))
                child = Node(low, [])
                node.entries.append(child)
                todo.append((child, low, high))
                start = high
            elif k + 2 == len(cuts) or cuts[k + 2] - start > LEAF_DOCUMENTS:
                node.entries.append(leaf(start, high))
                start = high
    for node in reversed(inner):  # children before those above them
        sizes = [len(e.terms) for e in node.entries]
        node.fill(np.array([e.least for e in node.entries]), np.concatenate([e.terms for e in node.entries]), np.repeat(np.arange(len(sizes)), sizes), np.concatenate([e.most for e in node.entries]))
    return root


def best(root: Node, ids: np.ndarray, asked: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best documents with a score of floor or more, ties to the smaller id."""
    floor = max(floor, 1)
    found, score = np.zeros(0, ids.dtype), np.zeros(0, np.int64)
    todo: list[tuple[int, Node]] = [(floor, root)]
    while todo:
        bound, node = todo.pop()
        if bound < floor:
            continue
        own = node.scores(asked, weights)
        passed = np.flatnonzero(own >= floor)
        if node.entries is not None:
            todo.extend((int(own[e]), node.entries[e]) for e in passed[np.argsort(own[passed], kind="stable")].tolist())
        elif len(passed):
            found, score = np.append(found, ids[node.first + passed]), np.append(score, own[passed])
            if len(found) > k:
                order = np.lexsort((found, -score))[:k]
                found, score = found[order], score[order]
            if len(found) == k:
                floor = max(floor, int(score.min()))
    return found, score


def _restricted(documents: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Each document's number of terms, and the counts of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, counts = [], [], []
            for value in batch.column("text"):
                have = Counter(terms(value.as_py()))
                own = {vocabulary[t]: have[t] for t in have.keys() & vocabulary.keys()}
                n.append(have.total())
                found.append(np.fromiter(own.keys(), np.int32, len(own)))
                counts.append(np.fromiter(own.values(), np.int32, len(own)))
            if n:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), lists(found, pa.int32()), lists(counts, pa.int32())], names=["doc_id", "n", "terms", "counts"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _RESTRICTED)


def _by_frequency(vectors: DataFrame, rank: np.ndarray, n_documents: int, n_terms: int) -> DataFrame:
    """doc_id, norm, path (ranks of terms, ascending) and counts of the documents that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            if held.num_rows:
                column = held.column("terms")
                at = np.asarray(column.offsets) - column.offsets[0].as_py()
                path, count = rank[np.asarray(column.flatten())], np.asarray(held.column("counts").flatten())
                order = np.lexsort((path, np.repeat(np.arange(held.num_rows), np.diff(at))))
                columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x[order])) for x in (path, count)]
                yield pa.RecordBatch.from_arrays([held.column("doc_id"), pa.array(norm(np.asarray(held.column("n")), n_documents, n_terms)), *columns], names=["doc_id", "norm", "path", "counts"])

    return vectors.mapInArrow(run, "doc_id long, norm long, path array<int>, counts array<int>")


def _searched(stretches: DataFrame, items: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> DataFrame:
    """item (place in the list), doc_id and score of each item's k best in each partition; items: terms, weights, floor.

    A partition's rows are in the order of their paths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("norm", pa.int64()), ("path", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])).combine_chunks()
        if not rows.num_rows:
            return
        ids = np.asarray(pc.fill_null(rows.column("doc_id"), -(2**63)))
        at = np.append(0, np.cumsum(np.asarray(pc.list_value_length(rows.column("path")))))
        path, count = (np.asarray(pc.list_flatten(rows.column(c))).astype(np.int64) for c in ("path", "counts"))
        root = grow(path, at, count, np.asarray(rows.column("norm")))
        for item, (asked, weights, floor) in enumerate(items):
            found, score = best(root, ids, asked, weights, k, floor)
            if len(found):
                known = pa.array(found, pa.int64(), mask=found == -(2**63))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item, np.int32)), known, pa.array(score)], names=["item", "doc_id", "score"])

    return stretches.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _stretches(vectors: DataFrame, shards: int) -> DataFrame:
    tied = vectors.withColumn("__tie", F.monotonically_increasing_id())
    return tied.repartitionByRange(shards, "path", "__tie").sortWithinPartitions("path").drop("__tie")


def _block(spark, items: dict[object, list[bytes]], documents: DataFrame, doc_id: str, text: str, k: int) -> DataFrame | None:
    """item, rank, doc_id and score for a block of items, item being the place in the dictionary; None without rows."""
    names = sorted(set().union(*items.values()))
    vectors = keep(_restricted(documents, doc_id, text, {t: i for i, t in enumerate(names)}), "restricted")
    n_documents, n_terms, n_counts, n_holding = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum(F.size("terms")), F.count_if(F.size("terms") > 0)).first()
    if not n_counts:
        return None
    holding = np.zeros(len(names), np.int64)  # a number for each of the items' terms
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[r[0]] = r[1]
    rank = np.empty(len(names), np.int32)
    rank[np.argsort(-holding, kind="stable")] = np.arange(len(names))
    weights = weight(n_documents, holding)
    at = {t: i for i, t in enumerate(names)}
    asked = []
    for own in items.values():
        own = np.array([at[t] for t in own], np.int64)
        own = own[np.argsort(rank[own])]
        asked.append((rank[own].astype(np.int64), weights[own], 0))
    paths = keep(_by_frequency(vectors, rank, n_documents, n_terms), "paths")

    one_of = math.ceil(n_holding / SAMPLE)
    sample = paths.where(F.pmod(F.xxhash64("doc_id", "norm", "path"), F.lit(one_of)) == 0) if one_of > 1 else paths
    floors = _ranked(_searched(_stretches(sample, math.ceil(n_counts / one_of / SHARD_COUNTS)), asked, k), k).where(F.col("rank") == k)
    for r in floors.select("item", "score").collect():  # one row for each item at most
        asked[r.item] = (*asked[r.item][:2], r.score)
    return _ranked(_searched(_stretches(paths, math.ceil(n_counts / SHARD_COUNTS)), asked, k), k)


def search(items: DataFrame, documents: DataFrame, k: int = 50, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0.

    Both tables have `text`. Equal scores go by ascending doc_id (an integer), null first. Every
    row of documents is a document of its own, so that a repeated id may come up repeatedly; rows
    of items that share an id are one item with the terms of all. Null texts and texts without
    terms are never found and find nothing, nor do items with terms that no document holds; an
    empty table gives no rows. Other columns are left out, so that names can't clash. Items are
    searched for in blocks of about ITEM_BYTES of their texts, each against all documents.
    """
    require(items, item_id, text)
    require(documents, doc_id, text)
    spark = documents.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    blocks = math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES)
    item_type = asked.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for block in range(blocks):
        own: dict[object, set[bytes]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():  # about ITEM_BYTES
            own.setdefault(r.item_id, set()).update(terms(r.text))
        own = {i: t for i, t in own.items() if t}
        found = _block(spark, own, documents, doc_id, text, k) if own else None
        if found is not None:
            ids = spark.createDataFrame(list(enumerate(own)), f"item int, item_id {item_type}")
            out = out.union(keep(found, "found").join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    return out
