"""Near duplicates of embeddings through a robust-pruned flat graph.

Vectors of one label are dealt to overlapping cluster shards: each to its OVERLAP nearest of a
bounded number of centroids, a cluster of too many vectors to several parts. A shard links every
vector with near ones of it, robust-pruned, with a few drawn ones, and both ways; a vector's lists
of all its shards are united. A search starts at a shard's medoid and at the vector's own node, goes
greedily through the united graph, and where it comes within range it expands to all that lies
within range. Pairs within range are verified in double precision. A bounded set of vectors is
held against all others; where too few of their links were found, the graph is built anew with
more overlap and wider searches, up to all shards and all vectors.

Copies of a vector are one node with a count, and a shard returns a count and a component for each
vector, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._components import connected_components
from causeway.llm._io import keep, require
from causeway.llm._text import lists

#: Vectors of a cluster that the fit aims at, centroids at most, and vectors in a part of a cluster at about the most.
CLUSTER_VECTORS, MOST_CLUSTERS, PART_VECTORS = 2048, 4096, 1 << 14
#: Vectors (those with the smallest hash of the row) for each centroid that centroids are fitted on.
SAMPLE = 16
#: Nearest vectors that are pruned, their edges that stay, drawn ones besides, and the pruning's slack.
POOL, DEGREE, DRAWN, ALPHA = 64, 24, 4, 1.2
#: Vectors whose links are counted by brute force, of all and of those with links, and the share that must be found.
AUDIT, RECALL = 128, 0.95
_BLOCK = 256


@dataclass(frozen=True)
class Settings:
    """Clusters that a vector belongs to, and nodes that a search keeps."""

    overlap: int = 2
    beam: int = 8


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column, all of one length, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def units(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1, for the search."""
    largest = np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    x = x / largest
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with many, in double precision."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(1, keepdims=True)
    return (x * q).sum(1) / (math.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def centroids(u: np.ndarray, k: int) -> np.ndarray:
    """k directions by spherical k-means; empty clusters keep their centroid."""
    at = u[np.random.default_rng(7).permutation(len(u))[:k]].copy()
    for _ in range(8 if len(at) > 1 else 1):
        near = np.concatenate([(u[a : a + 4096] @ at.T).argmax(1) for a in range(0, len(u), 4096)])
        total = np.zeros_like(at)
        np.add.at(total, near, u)
        size = np.sqrt((total * total).sum(1))
        at[size > 1e-6] = total[size > 1e-6] / size[size > 1e-6, None]
    return at


def pruned(u: np.ndarray) -> np.ndarray:
    """For each of a shard's vectors DEGREE robust-pruned near ones and DRAWN drawn ones, padded with -1."""
    n = len(u)
    pool, out = min(POOL, n - 1), np.full((n, DEGREE + DRAWN), -1, np.int32)
    if not pool:
        return out
    draw = np.random.default_rng(n)
    for a in range(0, n, _BLOCK):
        own = np.arange(a, min(a + _BLOCK, n))
        s = u[own] @ u.T
        s[own - a, own] = -np.inf
        near = np.argpartition(-s, pool - 1, 1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), 1, kind="stable"), 1)
        away = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(s, near, 1), 0))
        between = np.sqrt(np.maximum(2 - 2 * np.matmul(u[near], u[near].transpose(0, 2, 1)), 0))
        alive, row = np.ones(near.shape, bool), np.arange(len(own))
        for k in range(min(DEGREE, pool)):
            first = alive.argmax(1)
            some = alive[row, first]
            out[own[some], k] = near[row, first][some]
            alive &= ALPHA * between[row, first] > away  # what the picked one is much nearer to goes
            alive[row, first] = False
            if not alive.any():
                break
        other = draw.integers(0, n, (len(own), DRAWN))
        out[own, DEGREE:] = np.where(other == own[:, None], -1, other)
    return out


def both_ways(near: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each node along and against the edges, without repeats; of the edges against, 2 * DEGREE at most."""
    src, at = np.nonzero(near >= 0)
    dst = near[src, at]
    order = np.argsort(dst, kind="stable")
    back, to = src[order], dst[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    back, to = back[place < 2 * DEGREE], to[place < 2 * DEGREE]
    edges = np.unique(np.concatenate([src * len(near) + dst, to.astype(np.int64) * len(near) + back]))
    return np.split(edges % len(near), np.searchsorted(edges, np.arange(1, len(near)) * len(near)))


class Shard:
    """A part of the united graph: ids (ascending), vectors and, for each, the neighbours that are in the part too."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, neighbours: pa.ChunkedArray):
        self.ids, self.x, self.u = ids, x, units(x)
        flat = neighbours.combine_chunks()
        row, to = np.repeat(np.arange(len(ids)), np.asarray(flat.value_lengths())), np.asarray(flat.flatten())
        at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        row, at = row[ids[at] == to], at[ids[at] == to]
        self.start = np.searchsorted(row, np.arange(len(ids) + 1))
        self.to = at
        degree = np.diff(self.start)
        self.wide = np.full((len(ids), max(1, degree.max())), -1, np.int32)
        self.wide[row, np.arange(len(row)) - self.start[row]] = at
        middle = self.u.sum(0)
        self.medoid = int((self.u @ middle).argmax())

    def within(self, x: np.ndarray, own: np.ndarray, least: float, beam: int) -> Iterator[np.ndarray]:
        """For each query the nodes within range that are found, but for its own; own: its node, -1 if it is elsewhere."""
        u, loose = units(x), np.float32(least - 1e-5)
        n, width = len(self.ids), min(beam, len(self.ids))
        for a in range(0, len(u), _BLOCK):
            q, mine = u[a : a + _BLOCK], own[a : a + _BLOCK]
            row = np.arange(len(q))
            seen = np.zeros((len(q), n + 1), bool)  # the last column is what pads
            seen[:, n] = True
            start = np.stack([np.full(len(q), self.medoid), np.where(mine < 0, self.medoid, mine)], 1)
            near = np.full((len(q), width + 2), n)
            score = np.full((len(q), width + 2), -np.inf, np.float32)
            near[:, :2] = start
            score[:, :2] = np.einsum("qkd,qd->qk", self.u[start], q)
            score[start[:, 0] == start[:, 1], 1] = -np.inf
            seen[row[:, None], start] = True
            hits = [np.stack([x[score[:, :2] >= loose] for x in (np.repeat(row, 2).reshape(-1, 2), start)])]
            done = score == -np.inf
            while True:
                best = np.where(done, -np.inf, score).argmax(1)
                live = np.flatnonzero(~done[row, best])
                if not len(live):
                    break
                done[live, best[live]] = True
                to = self.wide[near[live, best[live]]]
                new = ~seen[live[:, None], to]  # padding is column -1, which counts as seen
                seen[live[:, None], to] = True
                r, c = np.nonzero(new)
                s = np.full(to.shape, -np.inf, np.float32)
                s[r, c] = np.einsum("ed,ed->e", self.u[to[r, c]], q[live[r]])
                hit = s[r, c] >= loose
                hits.append(np.stack([live[r[hit]], to[r, c][hit]]))
                all_near = np.concatenate([near[live], to], 1)
                all_score = np.concatenate([score[live], s], 1)
                all_done = np.concatenate([done[live], s == -np.inf], 1)
                top = np.argpartition(-all_score, width - 1, 1)[:, :width]
                near[live, :width], score[live, :width], done[live, :width] = (np.take_along_axis(v, top, 1) for v in (all_near, all_score, all_done))
                near[live, width:], score[live, width:], done[live, width:] = n, -np.inf, True
            who, what = np.concatenate(hits, 1)
            order = np.argsort(who, kind="stable")
            for k, found in enumerate(np.split(what[order], np.searchsorted(who[order], np.arange(1, len(q))))):
                found = np.unique(found)
                yield self._expanded(found[found != mine[k]], q[k], x[a + k], mine[k], least, loose)

    def _expanded(self, found: np.ndarray, q: np.ndarray, x: np.ndarray, mine: int, least: float, loose: np.float32) -> np.ndarray:
        """found with all that is reached through nodes within range."""
        if not len(found):
            return found
        seen = np.zeros(len(self.ids), bool)
        seen[found] = True
        if mine >= 0:
            seen[mine] = True
        rounds, frontier = [found], found
        while len(frontier):
            to = np.unique(np.concatenate([self.to[self.start[f] : self.start[f + 1]] for f in frontier.tolist()]))
            to = to[~seen[to]]
            seen[to] = True
            frontier = to[self.u[to] @ q >= loose]
            rounds.append(frontier)
        found = np.concatenate(rounds)
        return found[cosines(x, self.x[found]) >= least]


def _search(shard: Shard, copies: np.ndarray, homes: np.ndarray, cluster: int, ids: np.ndarray, x: np.ndarray, query_homes: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, links and component of the queries that have links here.

    A link counts in the first of the query's clusters that both belong to. The component is
    the smallest node that is reachable within the shard.
    """
    every = np.union1d(shard.ids, ids)
    place, root = np.searchsorted(every, shard.ids), np.arange(len(every))
    at = np.searchsorted(shard.ids, ids)
    own = np.where(shard.ids[np.minimum(at, len(shard.ids) - 1)] == ids, at, -1)
    linked, links = [], []
    for k, found in enumerate(shard.within(x, own, least, beam)):
        if not len(found):
            continue
        earlier = query_homes[k][: int(np.flatnonzero(query_homes[k] == cluster)[0])]
        counted = found[~np.isin(homes[found], earlier).any(1)] if len(earlier) else found
        linked.append(ids[k])
        links.append(int(copies[counted].sum()))
        q = root[np.searchsorted(every, ids[k])]
        others = np.unique(root[place[found]])
        if len(others) > 1 or others[0] != q:
            together = np.append(others, q)
            root[np.isin(root, together)] = together.min()
    nodes = np.array(linked, np.int64)
    # those found by others only are linked too
    rest = np.setdiff1d(every[root != np.arange(len(every))], nodes)
    nodes = np.append(nodes, rest)
    return nodes, np.append(np.array(links, np.int64), np.zeros(len(rest), np.int64)), every[root[np.searchsorted(every, nodes)]]


def _placed(points: DataFrame, at: np.ndarray, overlap: int) -> DataFrame:
    """points with homes: the nearest clusters, nearest first; vectors of another length have one of their own."""
    overlap = min(overlap, len(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch.column("vector")))
            for length in np.unique(size).tolist():
                part = batch.filter(pa.array(size == length))
                if length == at.shape[1]:
                    s = units(matrix(part.column("vector"))) @ at.T
                    homes = np.argsort(-s, 1, kind="stable")[:, :overlap]
                else:
                    homes = np.full((part.num_rows, 1), -length)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(list(homes.astype(np.int32)), pa.int32())], names=[*part.schema.names, "homes"])

    return points.mapInArrow(run, points.withColumn("homes", F.array(F.lit(0))).schema)


def _found(points: DataFrame, at: np.ndarray, settings: Settings, least: float) -> DataFrame:
    """node, links and component, a row for each vector with links and shard; links add up."""
    placed = keep(_placed(points, at, settings.overlap), "placed")
    counts = placed.select("label", F.explode("homes").alias("cluster")).groupBy("label", "cluster").count()
    large = keep(counts.where(F.col("count") > PART_VECTORS).select("label", "cluster", F.ceil(F.col("count") / PART_VECTORS).cast("int").alias("parts")), "parts")
    parts = F.coalesce("parts", F.lit(1))
    members = placed.withColumn("cluster", F.explode("homes")).join(large, ["label", "cluster"], "left").withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node"), parts).cast("int")})

    def build(key, rows):
        ids = np.asarray(rows.column("node"))
        near = [ids[x] for x in both_ways(pruned(units(matrix(rows.column("vector")))))]
        return pa.table([rows.column("node"), lists(near, pa.int64())], names=["node", "near"])

    edges = members.select("label", "cluster", "part", "node", "vector").groupBy("label", "cluster", "part").applyInArrow(build, "node long, near array<long>")
    # a list for each of a vector's clusters: OVERLAP at most
    graph = keep(edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    # A part meets each part's vectors: those of its own as they stand in it, the others as visitors.
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    nodes = members.join(graph, "node").withColumn("block", F.explode(every)).select("label", "cluster", "part", "block", "node", "vector", "homes", "copies", "near")
    visitors = members.where("parts > 1").withColumnRenamed("part", "block").withColumn("part", F.explode(every)).where("part <> block").select(*[F.col(c).alias(c) for c in ("label", "cluster", "part", "block", "node", "vector", "homes")])
    shape = "node long, links long, component long"

    def search(key, have, asked):
        out = (np.zeros(0, np.int64),) * 3
        if have.num_rows and (key[2].as_py() == key[3].as_py() or asked.num_rows):
            have = have.sort_by("node")
            asked = have if key[2].as_py() == key[3].as_py() else asked
            shard = Shard(np.asarray(have.column("node")), matrix(have.column("vector")), have.column("near"))
            homes = [np.asarray(t.column("homes").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (have, asked)]
            out = _search(shard, np.asarray(have.column("copies")), homes[0], key[1].as_py(), np.asarray(asked.column("node")), matrix(asked.column("vector")), homes[1], least, settings.beam)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["node", "links", "component"])

    by = ["label", "cluster", "part", "block"]
    return keep(nodes.groupBy(*by).cogroup(visitors.groupBy(*by)).applyInArrow(search, shape), "found")


def audited(points: DataFrame, found: DataFrame, least: float) -> float:
    """The share of links found, by brute force for at most 2 * AUDIT vectors; 1 if they have none."""
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    some = points.select("node", F.xxhash64("node").alias("h")).orderBy("h").limit(AUDIT).select("node")
    those = links.where("links > 0").orderBy(F.xxhash64("node")).limit(AUDIT).select("node")
    chosen = some.union(those).distinct().join(links, "node", "left").join(points.select("node", "label", "vector"), "node").collect()  # 2 * AUDIT rows
    asked = [(r.node, r.label, np.array(r.vector, np.float64), r.links or 0) for r in chosen]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            label, node, copies = batch.column("label").to_pylist(), np.asarray(batch.column("node")), np.asarray(batch.column("copies"))
            size = np.asarray(batch.column("vector").value_lengths())
            label = np.array([str(x) for x in label])
            for k, (own, tag, q, _) in enumerate(asked):
                same = np.flatnonzero((label == str(tag)) & (size == len(q)) & (node != own))
                if len(same):
                    x = matrix(batch.column("vector").take(pa.array(same)))
                    total[k] += copies[same][cosines(q, x) >= least].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.array(total)], names=["k", "n"])

    true = {r.k: r.n for r in points.select("label", "node", "copies", "vector").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    most = sum(true.values())
    return sum(min(a[3], true.get(k, 0)) for k, a in enumerate(asked)) / most if most else 1.0


def near_duplicates(df: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()) -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id and kept.

    Two vectors are linked when they are found, their labels are equal and not null, and their
    cosine in double precision is threshold (above 0) or more. n_links counts the other vectors
    linked directly, component_id is the smallest vec_id reachable by links, and kept is
    vec_id = component_id. Vectors that are null, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different lengths with each other. Rows that repeat a
    vec_id are vectors of their own; a null vec_id takes part, is never a component_id unless all of
    its component are null, and is kept in that case alone. Other columns are left out, so that
    names can't clash. An empty table gives no rows. At least RECALL of the links of the audited
    vectors are found.
    """
    require(df, vec_id, vector, label)
    sound = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    usable = F.col("label").isNotNull() & F.forall("vector", sound) & F.exists("vector", lambda v: v != 0)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    rows = keep(rows.withColumns({"row": F.monotonically_increasing_id(), "vector": F.when(usable, F.col("vector"))}), "vectors")
    points = rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    points = keep(points, "points")
    alone = (F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sizes = points.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return rows.select("vec_id", *alone, F.lit(True).alias("kept"))

    most = points.groupBy("label").count().agg(F.max("count")).first()[0]
    while True:
        k = max(1, min(MOST_CLUSTERS, math.ceil(settings.overlap * most / CLUSTER_VECTORS)))
        drawn = points.where(F.size("vector") == sizes["size"]).orderBy(F.xxhash64("node")).limit(SAMPLE * k).select("vector").toPandas()["vector"]
        found = _found(points, centroids(units(np.stack(list(drawn)).astype(np.float64)), k), settings, threshold)
        if audited(points, found, threshold) >= RECALL or settings.overlap >= k and settings.beam >= most:
            break
        settings = replace(settings, overlap=settings.overlap + 1, beam=settings.beam * 4)

    parts = connected_components(found.select("node", "component"), "node", "component")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = keep(points.select("node", "least").join(parts, "node"), "named")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    told = points.join(links, "node", "left").join(named, "node", "left")
    told = told.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.where("vector IS NULL").select("vec_id", *alone).union(rows.where("vector IS NOT NULL").join(told, ["label", "vector"]).select("vec_id", "n_links", "component_id"))
    return out.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
