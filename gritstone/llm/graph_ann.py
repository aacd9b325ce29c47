"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt to shards by a hash of their id. In a shard, equal vectors are one node (which keeps the smallest ids,
one more than a query can need). Nodes enter the graph in batches of growing size: a greedy beam search from the medoid
proposes neighbours, and relaxed distance pruning (an edge goes if a kept neighbour is ``ALPHA`` times nearer to its end)
keeps at most ``DEGREE`` diverse ones; reverse edges are pruned likewise. Every query runs a beam search in every
shard; the shards' nearest are merged. All steps of a batch are vectorised, and a shard's rows are bounded.

Nearness is the cosine, given in double precision over the original components. Defined results: vectors that are null,
empty, zero, or hold null or non-finite components take no part; vectors of other lengths than the query's are no
candidates; ties go to the smaller id; rows that repeat an id are one row of that id for each distinct vector; a null id
takes no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.storage import ship

DEGREE = 24
BEAM = 56
#: Edges a node may hold before it is pruned back to DEGREE.
ROOM = 40
ALPHA = 1.2
EXPAND = 4
#: Rows of a shard: at least and at most. Recall has been measured at both ends; see ``query_beam``.
SHARD_ROWS = (2_000, 20_000)


class Graph:
    """A robust-pruned graph over the rows of ``points``, which have length 1."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7):
        self.points, self.degree, self.beam, self.alpha = points.astype(np.float32), degree, beam, np.float32(alpha)
        n = len(points)
        self.edges = np.full((n, ROOM), -1, np.int32)
        self.start = int(np.argmax(self.points @ self.points.mean(axis=0))) if n else 0
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int64) if n else order
        done, most = 1, max(64, n // 50)
        while done < n:
            batch = order[done : done + min(done, most, 512)]
            self._insert(batch)
            done += len(batch)

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(2 - 2 * np.einsum("...d,...d->...", a, b), 0)

    def search(self, queries: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of each query's beam, nearest first; -1 and infinity where it has fewer."""
        m, beam = len(queries), beam or self.beam
        queries = queries.astype(np.float32)
        seen = np.zeros((m, len(self.points) + 1), bool)
        ids, far, open_ = np.full((m, beam), -1), np.full((m, beam), np.inf, np.float32), np.zeros((m, beam), bool)
        ids[:, 0], open_[:, 0], seen[:, self.start] = self.start, True, True
        far[:, 0] = self._far(self.points[self.start], queries)
        live = np.arange(m)
        while len(live):
            k, rows = live, np.arange(len(live))[:, None]
            pick = np.argsort(~open_[k], axis=1, kind="stable")[:, :EXPAND]  # the nearest that are not expanded yet
            valid = open_[k][rows, pick]
            nodes = np.where(valid, ids[k][rows, pick], -1)
            open_[k[:, None], pick] = False
            next_ = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(k), -1)
            next_ = np.sort(next_, axis=1)
            fresh = (next_ >= 0) & ~seen[k[:, None], next_]
            fresh[:, 1:] &= next_[:, 1:] != next_[:, :-1]
            seen[k[:, None], np.where(fresh, next_, -1)] = True
            gap = np.where(fresh, self._far(self.points[next_], queries[k][:, None, :]), np.inf)
            all_far, all_ids = np.concatenate([far[k], gap], axis=1), np.concatenate([ids[k], next_], axis=1)
            all_open = np.concatenate([open_[k], fresh], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[k], ids[k] = all_far[rows, best], np.where(np.isfinite(all_far[rows, best]), all_ids[rows, best], -1)
            open_[k] = all_open[rows, best]
            live = k[open_[k].any(axis=1)]
        return ids, far

    def _prune(self, near: np.ndarray, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
        """For each row's point: of the candidates, nearest first, those that no kept one shadows."""
        order = np.argsort(far, axis=1, kind="stable")
        rows = np.arange(len(ids))[:, None]
        ids, far = ids[rows, order], far[rows, order]
        alive = (ids >= 0) & np.isfinite(far) & (ids != near[:, None])
        cloud, kept = self.points[ids], np.full((len(ids), self.degree), -1, np.int32)
        for j in range(self.degree):
            first = np.argmax(alive, axis=1)
            any_ = alive[np.arange(len(ids)), first]
            if not any_.any():
                break
            chosen = ids[np.arange(len(ids)), first]
            kept[any_, j] = chosen[any_]
            alive &= self.alpha * self._far(cloud, self.points[chosen][:, None, :]) > far
            alive[np.arange(len(ids)), first] = False
        return kept

    def _insert(self, batch: np.ndarray) -> None:
        ids, far = self.search(self.points[batch])
        kept = self._prune(batch, ids, far)
        self.edges[batch, : self.degree] = kept
        source, slot = np.nonzero(kept >= 0)
        ends, begins = kept[source, slot].astype(np.int64), batch[source]
        order = np.argsort(ends, kind="stable")
        ends, begins = ends[order], begins[order]
        nodes, first, count = np.unique(ends, return_index=True, return_counts=True)
        used = (self.edges[nodes] >= 0).sum(axis=1)
        fits = used + count <= ROOM  # used slots come first
        column = np.repeat(used - first, count) + np.arange(len(ends))
        small = np.repeat(fits, count)
        self.edges[ends[small], column[small]] = begins[small]
        over = np.flatnonzero(~fits)
        over = over[np.argsort(count[over], kind="stable")]
        for at in range(0, len(over), 128):
            some = over[at : at + 128]
            pool = np.full((len(some), ROOM + int(count[some].max())), -1, np.int64)
            pool[:, :ROOM] = self.edges[nodes[some]]
            rows = np.repeat(np.arange(len(some)), count[some])
            inner = np.arange(len(rows)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            pool[rows, ROOM + inner] = begins[np.repeat(first[some], count[some]) + inner]
            gap = np.where(pool >= 0, self._far(self.points[pool], self.points[nodes[some]][:, None, :]), np.inf)
            self.edges[nodes[some]] = -1
            self.edges[nodes[some], : self.degree] = self._prune(nodes[some], pool, gap)


def query_beam(n: int) -> int:
    """The beam of queries in a graph of n nodes: BEAM up to 2,000, 158 at 20,000, where BEAM alone would find 0.89 of the nearest."""
    return max(BEAM, int(BEAM * (n / 2000) ** 0.45))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same pair gives the same number wherever it is computed."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


class Shard:
    """The distinct vectors of a shard, their smallest ids, and their graph."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1))
        again = np.append(False, ~new[1:] & (ids[1:] == ids[:-1]))
        group = np.cumsum(new) - 1
        place = np.cumsum(~again) - 1
        rank = place - place[np.flatnonzero(new)][group]
        keep = ~again & (rank <= k)
        self.vectors, self.k = vectors[new], k
        self.ids = np.full((len(self.vectors), k + 1), np.iinfo(np.int64).max)
        self.ids[group[keep], rank[keep]] = ids[keep]
        wide = self.vectors.astype(np.float64)
        self.graph = Graph(wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True)))

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, id, score) of each query's k nearest rows here, its own row left out."""
        wide = queries.astype(np.float64)
        nodes, _ = self.graph.search(wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True)), query_beam(len(self.vectors)))
        nodes = nodes[:, : 4 * self.k]
        score = np.where(nodes >= 0, cosines(self.vectors[nodes], queries[:, None, :]), -np.inf)
        ids = np.where(nodes[:, :, None] >= 0, self.ids[nodes], np.iinfo(np.int64).max).reshape(len(queries), -1)
        score = np.repeat(score, self.ids.shape[1], axis=1)
        score = np.where((ids == np.iinfo(np.int64).max) | (ids == query_ids[:, None]), -np.inf, score)
        order = np.lexsort((ids, -score), axis=1)[:, : self.k]
        rows = np.arange(len(queries))[:, None]
        ids, score = ids[rows, order], score[rows, order]
        ok = np.isfinite(score)
        return np.repeat(query_ids, ok.sum(axis=1)), ids[ok], score[ok]


def _search(k: int, block: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shards = None, [], None

        def matrices(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            lists, ids = part.column("vector"), np.asarray(part.column("id"))
            sizes = np.asarray(lists.value_lengths())
            flat, begin = np.asarray(lists.flatten()), np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                yield ids[rows], flat[begin[rows][:, None] + np.arange(size)]

        for batch in batches:
            shard, kind = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if shard[a] != now:
                    now, held, shards = shard[a], [], None
                part = batch.slice(a, z - a)
                if kind[a] == 0:
                    held += matrices(part)
                    continue
                if shards is None:
                    sizes = {v.shape[1] for _, v in held}
                    shards = {s: Shard(np.concatenate([i for i, v in held if v.shape[1] == s]), np.concatenate([v for _, v in held if v.shape[1] == s]), k) for s in sizes}
                    held = []
                for ids, vectors in matrices(part):
                    if (found := shards.get(vectors.shape[1])) is None:
                        continue
                    for at in range(0, len(ids), block):
                        q, v, s = found.nearest(ids[at : at + block], vectors[at : at + block])
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: tuple[int, int] = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` selects, its k nearest other rows."""
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    chosen = vectors.filter(vectors[id_col].isNotNull() & usable(vectors[vector_col]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard = min(max(vectors.count() // parts, shard_rows[0]), shard_rows[1])
    n = max(1, -(-vectors.count() // per_shard))
    kind = "array<float>" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "array<double>"  # scores are of the vectors as given
    rows = chosen.select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    asked = chosen.filter(queries).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), F.lit(1).alias("kind"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    dealt = rows.unionAll(asked).repartition(min(n, parts), "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
