"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

A shard's graph is stored as flat neighbour arrays. Points are inserted in
batches: a batch walks the graph in lockstep, numpy computing one step of all
its walks at once, and queries walk it the same way. Shards are dealt by hash;
their size grows with the table up to a bound, so that their number, and with it
the walks of a query, stays small. Every shard is searched, as broadly as its
size asks, and the results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memory import lean
from ._store import Scratch
from ._text import mix

LINKS = 16
#: Points that a walk keeps: while building, and in a search at least; a search of n points keeps 2 sqrt(n).
BREADTH_BUILD, BREADTH_SEARCH = 80, 96
#: A table has about SHARDS shards, of so many vectors at least and at most.
SHARDS = 64
SHARD_VECTORS = (1 << 14, 1 << 20)
#: Queries that walk at once, and bytes of marks that their walks may take.
QUERY_BLOCK, MARKS = 256, 1 << 25
BATCH = 128
NEIGHBOURS = 10
QUERY_EVERY = 100
#: Points that a walk opens at each step.
OPENED = 4


@dataclass
class Graph:
    """``links[l]`` is a points x width array of neighbours (-1: none) on level l; level 0 has twice the width."""

    vectors: np.ndarray
    levels: np.ndarray
    links: list[np.ndarray]
    entry: int

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = self.vectors[ids]
        d -= queries[:, None, :]
        return np.einsum("qmd,qmd->qm", d, d)

    def walk(self, queries: np.ndarray, start: np.ndarray, level: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest found (ids, squared distances), nearest first, -1 where there are fewer."""
        n, links = len(queries), self.links[level]
        seen = np.zeros((n, len(self.vectors) + 1), dtype=bool)
        ids = np.full((n, breadth), -1, dtype=np.int64)
        dist = np.full((n, breadth), np.inf, dtype=np.float32)
        opened = np.ones((n, breadth), dtype=bool)
        k = start.shape[1]
        ids[:, :k] = start
        dist[:, :k] = np.where(start < 0, np.inf, self._distances(queries, start))
        opened[:, :k] = start < 0
        np.put_along_axis(seen, start, True, axis=1)
        live = np.arange(n)
        wide = min(OPENED, breadth)
        while len(live):
            order = np.argsort(np.where(opened[live], np.inf, dist[live]), axis=1, kind="stable")[:, :wide]
            fresh = ~np.take_along_axis(opened[live], order, axis=1)
            go = fresh[:, 0]
            live, order, fresh = live[go], order[go], fresh[go]
            if not len(live):
                break
            picked = np.where(fresh, ids[live[:, None], order], -1)
            opened[live[:, None], order] = True
            near = np.where((picked >= 0)[:, :, None], links[picked], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            d = np.where(near < 0, np.inf, self._distances(queries[live], near)).astype(np.float32)
            all_d = np.concatenate([dist[live], d], axis=1)
            all_i = np.concatenate([ids[live], near], axis=1)
            all_o = np.concatenate([opened[live], near < 0], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :breadth]
            ids[live] = np.take_along_axis(all_i, best, axis=1)
            dist[live] = np.take_along_axis(all_d, best, axis=1)
            opened[live] = np.take_along_axis(all_o, best, axis=1)
        ids[~np.isfinite(dist)] = -1
        return ids, dist

    def descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """The nearest found on the levels above ``level``, as one start for each query."""
        at = np.full((len(queries), 1), self.entry, dtype=np.int64)
        for l in range(len(self.links) - 1, level, -1):
            at = self.walk(queries, at, l, 1)[0]
        return at

    def search(self, queries: np.ndarray, breadth: int | None = None) -> np.ndarray:
        """Each query's nearest found; by default as broadly as the graph's size asks."""
        breadth = breadth or max(BREADTH_SEARCH, int(2 * len(self.vectors) ** 0.5))
        block = max(1, min(QUERY_BLOCK, MARKS // (len(self.vectors) + 1)))
        parts = [self.walk(q, self.descend(q, 0), 0, breadth)[0] for q in (queries[at : at + block] for at in range(0, len(queries), block))]
        return np.concatenate(parts) if parts else np.zeros((0, breadth), dtype=np.int64)

    def _choose(self, own: np.ndarray, ids: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` of one point's candidates (nearest first): those nearer to it than to any chosen one, then the nearest rest."""
        if len(ids) <= width:
            return ids
        points = self.vectors[ids]
        square = np.einsum("kd,kd->k", points, points)
        nearer = square[:, None] + square[None, :] - 2 * (points @ points.T) < dist[:, None]
        left = np.ones(len(ids), dtype=bool)
        chosen = np.zeros(len(ids), dtype=bool)
        for _ in range(width):
            k = int(left.argmax())
            if not left[k]:
                break
            chosen[k] = True
            left[k] = False
            left &= ~nearer[:, k]
        rest = np.flatnonzero(~chosen)[: width - int(chosen.sum())]
        chosen[rest] = True
        return ids[chosen]


def build(vectors: np.ndarray, keys: np.ndarray) -> Graph:
    """The graph of ``vectors``; ``keys`` (any uint64) give the levels, so that a build repeats itself."""
    vectors = np.ascontiguousarray(vectors, dtype=np.float32)
    n = len(vectors)
    unit = ((mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    levels = np.minimum((-np.log(unit) / np.log(LINKS)).astype(np.int64), 8)
    order = np.argsort(-levels, kind="stable")
    vectors, levels = vectors[order], levels[order]
    graph = Graph(vectors, levels, [np.full((n, 2 * LINKS if l == 0 else LINKS), -1, dtype=np.int64) for l in range(int(levels.max(initial=0)) + 1)], 0)
    filled = [np.zeros(n, dtype=np.int64) for _ in graph.links]
    # The highest point comes first and is the entry; levels fall from there.
    at = 1
    while at < n:
        stop = min(n, at + min(BATCH, at))
        batch = np.arange(at, stop)
        # All walks come first, on the graph as it is, so that none starts at a point of its own batch.
        walks = []
        for level in range(int(levels[at]), -1, -1):
            own = batch[levels[batch] >= level]
            walks.append((level, own, graph.walk(vectors[own], graph.descend(vectors[own], level), level, BREADTH_BUILD)[0]))
        for level, own, found in walks:
            q = vectors[own]
            # Points of one batch may be neighbours too: earlier ones are candidates of later ones.
            mates = np.where(own[None, :] < own[:, None], own[None, :], -1)
            cand = np.concatenate([found, mates], axis=1)
            dist = np.where(cand < 0, np.inf, graph._distances(q, cand))
            rank = np.argsort(dist, axis=1, kind="stable")[:, :BREADTH_BUILD]
            cand, dist = np.take_along_axis(cand, rank, axis=1), np.take_along_axis(dist, rank, axis=1)
            links = graph.links[level]
            for k, i in enumerate(own.tolist()):
                good = np.isfinite(dist[k])
                picked = graph._choose(q[k], cand[k][good][:48], dist[k][good][:48], LINKS)
                links[i, : len(picked)] = picked
                filled[level][i] = len(picked)
            # Each link is returned; a full row keeps a choice of its links and the new one.
            for i in own.tolist():
                for j in links[i, : filled[level][i]].tolist():
                    have = filled[level][j]
                    if have < links.shape[1]:
                        links[j, have] = i
                        filled[level][j] = have + 1
                        continue
                    ids = np.append(links[j], i)
                    d = ((vectors[ids] - vectors[j]) ** 2).sum(axis=1)
                    near = np.argsort(d, kind="stable")
                    kept = graph._choose(vectors[j], ids[near], d[near], links.shape[1] - 4)
                    links[j] = -1
                    links[j, : len(kept)] = kept
                    filled[level][j] = len(kept)
        at = stop
    # Back to the caller's numbering.
    home = np.append(order, -1).astype(np.int32)
    out = [np.full_like(x, -1) for x in graph.links]
    for new, old in zip(out, graph.links, strict=True):
        new[order] = home[old]
    back_vectors, back_levels = np.empty_like(vectors), np.empty_like(levels)
    back_vectors[order], back_levels[order] = vectors, levels
    return Graph(back_vectors, back_levels, out, int(order[0]) if n else -1)


def dumps(graph: Graph) -> tuple[bytes, bytes]:
    """(levels as bytes, flat neighbour arrays as int32): level 0 for all points, upper levels for their points in order."""
    flat = [x[graph.levels >= l].astype("<i4").reshape(-1) for l, x in enumerate(graph.links)]
    return graph.levels.astype(np.uint8).tobytes(), np.concatenate([*flat, np.array([graph.entry], dtype="<i4")]).tobytes()


def loads(vectors: np.ndarray, levels: bytes, flat: bytes) -> Graph:
    level = np.frombuffer(levels, dtype=np.uint8).astype(np.int64)
    numbers = np.frombuffer(flat, dtype="<i4")
    links, at = [], 0
    for l in range(int(level.max()) + 1):
        width = 2 * LINKS if l == 0 else LINKS
        own = np.flatnonzero(level >= l)
        x = np.full((len(level), width), -1, dtype=np.int32)
        x[own] = numbers[at : at + len(own) * width].reshape(-1, width)
        links.append(x)
        at += len(own) * width
    return Graph(vectors, level, links, int(numbers[at]))


def _usable(embeddings: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, components as they are (float or double)."""
    kind = "float" if embeddings.schema[vector].dataType.simpleString() == "array<float>" else "double"
    return (
        embeddings.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
        .where("id is not null and v is not null")
        .where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
        .distinct()
    )


def _matrix(column: pa.ChunkedArray, dim: int, dtype: str) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim)


def _scaled(vectors: np.ndarray, exponent: int) -> np.ndarray:
    """float32 of the vectors over a power of two, which keeps wide doubles finite and changes no order."""
    return np.ldexp(vectors, -exponent).astype(np.float32)


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, last axis the components; of differences beyond squaring by their largest."""
    d = points.astype(np.float64) - queries.astype(np.float64)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = np.sqrt((d * d).sum(axis=-1))
        top = np.abs(d).max(axis=-1, initial=0.0)
        odd = (top > 0) & ((top > 1e150) | (top < 1e-150))
        if odd.any():
            out[odd] = top[odd] * np.sqrt(((d[odd] / top[odd][..., None]) ** 2).sum(axis=-1))
    return out


GRAPH_SCHEMA = "dim int, shard int, kind int, levels binary, links binary, vectors binary, counts binary, ids binary"


def build_index(vectors: DataFrame, tmp: Scratch, *, shard_vectors: int | None = None, neighbours: int = NEIGHBOURS) -> tuple[DataFrame, int]:
    """A row for each shard (GRAPH_SCHEMA, kind 0) and the number of shards.

    Equal vectors are one point; a point lists its ``neighbours + 1`` smallest
    ids, all that any result can name, so no group of copies is gathered.
    """
    dtype = "<f4" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    named = vectors.selectExpr("id", "v", "row_number() over (partition by v order by id) as turn").where(F.col("turn") <= neighbours + 1)
    points = tmp.keep(named.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    n = points.count()
    shards = max(1, -(-n // (shard_vectors or min(max(-(-n // SHARDS), SHARD_VECTORS[0]), SHARD_VECTORS[1]))))
    dealt = points.select(F.size("v").alias("dim"), F.expr(f"cast(pmod(xxhash64(v), {shards}) as int)").alias("shard"), "v", "ids")

    def make(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        v = _matrix(table["v"], dim, dtype)
        lists = table["ids"].combine_chunks()
        first = lists.flatten().to_numpy()[np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()]
        order = np.argsort(first, kind="stable")
        v, lists = v[order], lists.take(pa.array(order))
        levels, links = dumps(build(_scaled(v, int(np.frexp(np.abs(v).max())[1])), first[order].view(np.uint64)))
        ids = lists.flatten().to_numpy().astype("<i8")
        counts = np.diff(np.asarray(lists.offsets)).astype("<u1")
        binary = [pa.array([x], pa.binary()) for x in (levels, links, v.tobytes(), counts.tobytes(), ids.tobytes())]
        numbers = [pa.array([x], pa.int32()) for x in (dim, table["shard"][0].as_py(), 0)]
        return pa.table([*numbers, *binary], names=[x.split(" ")[0] for x in GRAPH_SCHEMA.split(", ")])

    # A partition for each shard: building is work by the point, which small bytes would hide from a coalescing planner.
    index = dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(make, GRAPH_SCHEMA)
    return tmp.keep(index, "index"), shards


def nearest(spark: SparkSession, embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", query_every: int = QUERY_EVERY, neighbours: int = NEIGHBOURS, shard_vectors: int | None = None, breadth: int | None = None) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): each query's nearest found, by Euclidean distance.

    Queries are the rows whose id is divisible by ``query_every``; candidates
    all rows with another id. Scores are computed in double precision on the
    original components (float or double); ties go to the smaller id. Vectors
    that are null, zero or hold null or non-finite components take no part, nor
    rows with a null id; vectors of different lengths never meet. Repeated rows
    count once; of one id's several vectors the nearest counts. Fewer candidates
    than ``neighbours``: all that were found. An empty table gives no rows.
    """
    tmp = Scratch(spark, "ann")
    usable = tmp.keep(_usable(embeddings, vec_id, vector), "usable")
    dtype = "<f4" if usable.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    index, shards = build_index(usable, tmp, shard_vectors=shard_vectors, neighbours=neighbours)
    asked = usable.where(F.col("id") % query_every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    lots = asked.select(F.size("v").alias("dim"), F.expr(f"cast(pmod(xxhash64(id), {blocks}) as int)").alias("block"), "id", "v")

    def lay(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        return pa.table({"dim": pa.array([dim], pa.int32()), "vectors": pa.array([_matrix(table["v"], dim, dtype).tobytes()], pa.binary()), "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary())})

    asked = lots.groupBy("dim", "block").applyInArrow(lay, "dim int, vectors binary, ids binary")
    to_shards = asked.selectExpr("dim", f"explode(sequence(0, {shards - 1})) as shard", "1 as kind", "cast(null as binary) as levels", "cast(null as binary) as links", "vectors", "cast(null as binary) as counts", "ids")
    # Each shard's graph comes first, then the blocks of queries that walk it.
    keys = ["dim", "shard"]
    met = index.union(to_shards).repartition(shards, *keys).sortWithinPartitions(*keys, "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, graph = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                dim, shard, kind = (batch.column(c)[k].as_py() for c in range(3))
                vectors = np.frombuffer(batch.column(5)[k].as_py(), dtype=dtype).reshape(-1, dim)
                ids = np.frombuffer(batch.column(7)[k].as_py(), dtype="<i8")
                if not kind:
                    exponent = int(np.frexp(np.abs(vectors).max())[1])
                    graph = loads(_scaled(vectors, exponent), batch.column(3)[k].as_py(), batch.column(4)[k].as_py())
                    counts = np.frombuffer(batch.column(6)[k].as_py(), dtype="<u1").astype(np.int64)
                    at, points, members, first = (dim, shard), vectors, ids, np.cumsum(counts) - counts
                elif at == (dim, shard):
                    found = graph.search(_scaled(vectors, exponent), breadth)
                    score = np.where(found < 0, np.inf, distances(points[found], vectors[:, None, :]))
                    yield _ranked(ids, found, score, members, first, counts, neighbours)

    near = met.mapInArrow(lean(search), "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = near.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score, vec_id) as int) as rank", "vec_id", "score")
    out = tmp.keep(ranked.where(F.col("rank") <= neighbours), "out")
    tmp.drop("usable", "points", "index")
    return out


def _ranked(ids: np.ndarray, found: np.ndarray, score: np.ndarray, members: np.ndarray, first: np.ndarray, counts: np.ndarray, neighbours: int) -> pa.RecordBatch:
    """(query_id, vec_id, score): each query's nearest members of the points found, its own id left out."""
    rows: list[tuple[int, int, float]] = []
    for q, own in enumerate(ids.tolist()):
        best: list[tuple[float, int]] = []
        for j in np.argsort(score[q], kind="stable").tolist():
            if not np.isfinite(score[q, j]) or (len(best) >= neighbours and score[q, j] > best[neighbours - 1][0]):
                break
            p = found[q, j]
            best += [(float(score[q, j]), x) for x in members[first[p] : first[p] + counts[p]].tolist() if x != own]
            best.sort()
        rows += [(own, x, s) for s, x in best[:neighbours]]
    return pa.RecordBatch.from_pydict({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})
