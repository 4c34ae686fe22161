"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES hash tables cuts space by PROJECTIONS Gaussian projections into cells of one
width. A query visits, in each table, its own cell and cells perturbed by one step in some
projections, in the order of the squared distances to the borders that are crossed, an estimate
of the order of success. All candidates of all tables are ranked by exact distance.

The index is dealt out by cell: a cell's vectors and the queries that visit it meet in one
group, cells share groups by hash, and a cell that holds too many vectors is split over several,
to which its queries are sent. A group returns its k nearest for each query only, so that
candidates are never rows. Width and number of probes are fitted on a bounded sample.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm._io import keep, require

TABLES, PROJECTIONS = 4, 8
#: Vectors in a group, and in one part of a cell, at about the most.
GROUP_VECTORS = 1 << 15
#: Vectors that width and probes are fitted on (those with the smallest hash of the id), and
#: queries among them.
SAMPLE, SAMPLE_QUERIES = 4096, 128
#: Share of true neighbours that the fit asks for on the sample.
RECALL = 0.97
#: The cell width in median distances to the k-th neighbour of the sample.
WIDTHS = 1.8


@dataclass(frozen=True)
class Index:
    """Projections (table, projection, component), their offsets, the cell width, probes for each table."""

    directions: np.ndarray
    shift: np.ndarray
    width: float
    probes: int

    @property
    def dimension(self) -> int:
        return self.directions.shape[2]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell coordinates (row, table, projection) and places within the cells, 0 to 1."""
        at = (np.einsum("nd,tpd->ntp", x, self.directions) + self.shift) / self.width
        cell = np.floor(np.clip(at, -(2**40), 2**40))
        return cell.astype(np.int64), at - cell

    @staticmethod
    def names(cells: np.ndarray) -> np.ndarray:
        """A 64-bit name for each cell, over the last axis."""
        h = np.zeros(cells.shape[:-1], np.uint64)
        for k in range(cells.shape[-1]):
            h = (h ^ cells[..., k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Names of the cells that each query visits: (row, table, probe)."""
        cells, place = self.cells(x)
        sets = perturbations(PROJECTIONS, self.probes)
        cost = np.concatenate([place**2, (1 - place) ** 2], 2)  # one step down, one step up
        step = np.concatenate([np.eye(PROJECTIONS, dtype=np.int64) * -1, np.eye(PROJECTIONS, dtype=np.int64)])
        order = np.argsort(cost, 2, kind="stable")
        out = np.empty((len(x), cells.shape[1], self.probes), np.int64)
        for q in range(len(x)):
            for t in range(cells.shape[1]):
                total = np.where(sets >= 0, cost[q, t, order[q, t]][sets], 0).sum(1)
                move = np.where((sets >= 0)[:, :, None], step[order[q, t]][sets], 0).sum(1)
                clash = (np.where((sets >= 0)[:, :, None], np.abs(step[order[q, t]][sets]), 0).sum(1) > 1).any(1)
                total[clash] = np.inf  # both steps of one projection
                best = np.argsort(total, kind="stable")[: self.probes]
                out[q, t] = self.names(cells[q, t] + move[best])
        return out


_sets: dict[tuple[int, int], np.ndarray] = {}


def perturbations(projections: int, probes: int) -> np.ndarray:
    """Sets of positions in the sorted list of 2 * projections border distances, padded with -1.

    They are drawn in the order of the expected sum of squared distances of uniform places,
    twice as many as are visited, since sets that take both steps of one projection drop out.
    """
    if (projections, probes) not in _sets:
        m = projections
        expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
        expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
        found, heap = [()], [(expected[0], (0,))]
        while heap and len(found) < 2 * probes + 2:
            cost, s = heapq.heappop(heap)
            if all(2 * m - 1 - j not in s for j in s):
                found.append(s)
            if s[-1] + 1 < 2 * m:
                heapq.heappush(heap, (cost - expected[s[-1]] + expected[s[-1] + 1], (*s[:-1], s[-1] + 1)))
                heapq.heappush(heap, (cost + expected[s[-1] + 1], (*s, s[-1] + 1)))
        out = np.full((len(found), max(map(len, found)) or 1), -1)
        for k, s in enumerate(found):
            out[k, : len(s)] = s
        _sets[projections, probes] = out
    return _sets[projections, probes]


def _matrix(column, dimension: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to many, from differences in double precision."""
    return np.sqrt(((x - q) ** 2).sum(1))


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows, ties to the smaller id, one row for each id."""
    rough = (x * x).sum(1) - 2 * (x @ q)
    if len(rough) > 4 * k:
        bound = np.partition(rough, k - 1)[k - 1]
        some = np.flatnonzero(rough <= bound + 1e-9 * (abs(bound) + (q * q).sum() + 1))
    else:
        some = np.arange(len(rough))
    d = distances(q, x[some])
    order = np.lexsort((ids[some], d))
    return ids[some][order][:k], d[order][:k]


def fit(vectors: DataFrame, k: int, recall: float = RECALL) -> Index | None:
    """Width and probes from a sample of at most SAMPLE vectors; None without vectors.

    The dimension is the sample's most frequent length (of two, the longer).
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(rows):
        return None
    sizes, counts = np.unique([len(v) for v in rows], return_counts=True)
    dimension = int(sizes[counts == counts.max()].max())
    x = np.stack([v for v in rows if len(v) == dimension]).astype(np.float64)
    draw = np.random.default_rng(11)
    directions = draw.normal(size=(TABLES, PROJECTIONS, dimension))
    queries = np.arange(min(SAMPLE_QUERIES, len(x)))
    near = []
    for q in queries:
        d = distances(x[q], x)
        d[q] = np.inf
        near.append(np.argsort(d, kind="stable")[: min(k, len(x) - 1)])
    far = np.median([distances(x[q], x[n])[-1] for q, n in zip(queries, near, strict=True)]) if len(x) > 1 else 1.0
    width = WIDTHS * float(far) if far > 0 else 1.0
    shift = draw.uniform(0, width, (TABLES, PROJECTIONS))
    probes, most = 8, 3**PROJECTIONS
    while True:
        index = Index(directions, shift, width, min(probes, most))
        if probes >= most or len(x) < 2:
            return index
        own = index.names(index.cells(x)[0])
        visits = index.visits(x[queries])
        hit = [np.any([np.isin(own[n, t], visits[i, t]) for t in range(TABLES)], 0).mean() for i, n in enumerate(near)]
        if np.mean(hit) >= recall:
            return index
        probes = math.ceil(probes * 1.5)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))


def search(df: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", index: Index | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest found, nearest first.

    queries has the columns of df. Candidates are all rows of df with another id; ties go to the
    smaller id; of rows that repeat an id the nearest counts. Vectors that are null, zero, of
    another length than most, or hold null or non-finite components take no part, nor do null
    ids. A query that finds fewer than k is held against all rows, so that a small table gives
    all candidates.
    """
    require(df, vec_id, vector)
    require(queries, vec_id, vector)
    spark = df.sparkSession
    rows, asked = usable(df, vec_id, vector), usable(queries, vec_id, vector)
    index = index or fit(rows, k)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    shape = f"query_id {id_type}, vec_id {id_type}, score double"
    if index is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    dimension = index.dimension
    rows, asked = rows.where(F.size("vector") == dimension), asked.where(F.size("vector") == dimension).dropDuplicates(["vec_id"])
    groups = max(1, math.ceil(rows.count() / GROUP_VECTORS))

    def own_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.names(index.cells(_matrix(batch.column("vector"), dimension))[0])
                n = cells.shape[1]
                take = pa.array(np.repeat(np.arange(batch.num_rows), n))
                table = pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays([table, pa.array(cells.ravel()), *[c.take(take) for c in batch.columns]], names=["table", "cell", "vec_id", "vector"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.visits(_matrix(batch.column("vector"), dimension))
                n = cells.shape[1] * cells.shape[2]
                take = pa.array(np.repeat(np.arange(batch.num_rows), n))
                table = pa.array(np.tile(np.repeat(np.arange(cells.shape[1], dtype=np.int32), cells.shape[2]), batch.num_rows))
                yield pa.RecordBatch.from_arrays([table, pa.array(cells.ravel()), batch.column("vec_id").take(take)], names=["table", "cell", "vec_id"])

    placed = rows.mapInArrow(own_cells, f"table int, cell bigint, vec_id {id_type}, vector array<double>")
    large = placed.groupBy("table", "cell").count().where(F.col("count") > GROUP_VECTORS).select("table", "cell", F.ceil(F.col("count") / GROUP_VECTORS).cast("int").alias("parts"))
    large = keep(large, "cells")
    group = F.pmod(F.xxhash64("table", "cell", "part"), F.lit(groups * TABLES)).alias("group")
    placed = placed.join(large, ["table", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    placed = placed.select(group, "table", "cell", "part", "vec_id", "vector")
    probing = asked.mapInArrow(visited, f"table int, cell bigint, vec_id {id_type}").join(large, ["table", "cell"], "left")
    probing = probing.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    probing = probing.groupBy("vec_id", group).agg(F.collect_list(F.struct("table", "cell", "part")).alias("visits"))  # probes at most, by their number
    probing = probing.join(asked, "vec_id").select("group", "vec_id", "vector", "visits")

    def cell_names(table, cell, part) -> np.ndarray:
        return Index.names(np.stack([np.asarray(table, np.int64), np.asarray(cell, np.int64), np.asarray(part, np.int64)], 1))

    def rank(have, want):
        found = []
        if have.num_rows and want.num_rows:
            x, ids = _matrix(have.column("vector"), dimension), np.asarray(have.column("vec_id"))
            name = cell_names(have.column("table"), have.column("cell"), have.column("part"))
            order = np.argsort(name, kind="stable")
            name, x, ids = name[order], x[order], ids[order]
            start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            cell, end = name[start], np.append(start[1:], len(name))
            asked_for = _matrix(want.column("vector"), dimension)
            for q, query_id, visits in zip(asked_for, want.column("vec_id").to_pylist(), want.column("visits").to_pylist(), strict=True):
                mine = cell_names(*[[v[c] for v in visits] for c in ("table", "cell", "part")])
                at = np.searchsorted(cell, mine)
                hit = np.unique(at[(at < len(cell)) & (cell[np.minimum(at, len(cell) - 1)] == mine)])
                if len(hit):
                    some = np.concatenate([np.arange(start[h], end[h]) for h in hit])
                    some = some[ids[some] != query_id]
                    if len(some):
                        # every table may name a vector, and ids may repeat: one row for each id
                        n, d = nearest(q, x[some], ids[some], k * TABLES)
                        n, d = _distinct(n, d, k) if len(np.unique(n)) >= min(k, len(some)) else _distinct(*nearest(q, x[some], ids[some], len(some)), k)
                        found.append((np.full(len(n), query_id), n, d))
        parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(p) for p in parts], names=["query_id", "vec_id", "score"]).cast(pa.schema([("query_id", want.schema.field("vec_id").type), ("vec_id", want.schema.field("vec_id").type), ("score", pa.float64())]))

    found = keep(placed.groupBy("group").cogroup(probing.groupBy("group")).applyInArrow(rank, shape), "found")
    counts = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    lacking = keep(asked.join(counts, F.col("vec_id") == F.col("query_id"), "left_anti"), "lacking")
    if not lacking.isEmpty():
        # The few that found too little, against all rows in blocks dealt out at random.
        everything = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("group"), F.lit(0).alias("table"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("part"), "vec_id", "vector")
        wanted = lacking.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "vec_id", "vector", F.array(F.struct(F.lit(0).alias("table"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("part"))).alias("visits"))
        found = found.union(everything.groupBy("group").cogroup(wanted.groupBy("group")).applyInArrow(rank, shape))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _distinct(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k rows with ids not seen before."""
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], d[first]
