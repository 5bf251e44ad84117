"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Vectors are dealt to shards by their norm, in bands within a factor of two (about 1, as of unit vectors, lies in the middle of one), and within a band by
the hash of their content, so that a few very long vectors don't bend the graph of the others and
copies of one vector come together as one node. Each shard gets a directed graph: points are
inserted in batches; greedy searches from the middle propose neighbours, and robust pruning keeps
a neighbour only if none that is kept already is nearer to it by a factor, so that the edges stay
diverse. Distances within a graph are Euclidean, on vectors scaled to the shard's largest norm,
after one more coordinate has brought all to that norm, which turns the largest inner product
into the nearest. Every query searches every shard with a beam (shards of few nodes are read
whole); the best found are scored in double precision on the original vectors and merged.

There are as many shards as the session has cores, so that they are built side by side, but none
has more than a number of nodes that fits a task's memory. A task holds one shard and reads its
queries in blocks, so its memory is bounded whatever the number of queries. `recall` measures the
result against brute force.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components
take no part, nor do rows with a null id; only vectors with as many components are compared;
of rows that repeat an id the smallest vector counts; of copies the smallest ids come first;
a score that overflows is infinite, as the products in double precision are; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, table

SHARD = 200_000  # nodes in a shard at most, about
LEAST = 2048  # nodes in a shard below which more shards gain nothing
SCANNED = 512  # nodes in a shard that is read whole
DEGREE, BEAM, RELAX = 32, 64, 1.2
BLOCK = 1024  # queries that a task searches together, fewer in large shards
CELLS = 1 << 26  # of the table that marks which query has seen which node


class Graph:
    """A Vamana graph over the rows of x."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> None:
        norms = np.einsum("ij,ij->i", x, x)
        lift = np.sqrt(np.maximum(norms.max() - norms, 0)) if len(x) else norms
        self.x = np.concatenate([x, lift[:, None]], axis=1).astype(np.float32)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        self.degree, self.relax = degree, relax
        n = len(x)
        self.near = np.full((n, degree), -1, np.int32)
        self.middle = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
        order = np.random.default_rng(7).permutation(n)
        order = order[order != self.middle]
        at, size = 0, 1
        while at < len(order):
            batch = order[at : at + size]
            at += len(batch)
            size = max(1, min(2 * size, 512, CELLS // n))
            self._insert(batch, beam)

    def _distances(self, a: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared, from each row of a to the nodes in the same row of ids; infinite for -1."""
        out = self.sq[ids] - 2 * np.einsum("bd,bkd->bk", a, self.x[ids]) + np.einsum("bd,bd->b", a, a)[:, None]
        out[ids < 0] = np.inf
        return out

    def search(self, a: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each row of a at the end, nearest first, and all nodes it expanded."""
        b = len(a)
        rows = np.arange(b)[:, None]
        ids = np.full((b, beam), -1, np.int32)
        ids[:, 0] = self.middle
        dist = self._distances(a, ids)
        done = np.ones((b, beam), bool)
        done[:, 0] = False
        seen = np.zeros((b, len(self.x)), bool)
        seen[:, self.middle] = True
        expanded = []
        live = np.arange(b)
        while len(live):
            front = np.where(done[live], np.inf, dist[live]).argmin(axis=1)
            open_ = ~done[live, front]
            live, front = live[open_], front[open_]
            if not len(live):
                break
            node = ids[live, front]
            done[live, front] = True
            mark = np.full(b, -1, np.int32)
            mark[live] = node
            expanded.append(mark)
            new = self.near[node]
            new = np.where((new >= 0) & ~seen[live[:, None], new], new, -1)
            sorted_ = np.sort(new, axis=1)  # a node may be listed once only
            seen[np.repeat(live, new.shape[1])[(new >= 0).ravel()], new[new >= 0]] = True
            new = np.where(np.concatenate([np.zeros((len(live), 1), bool), sorted_[:, 1:] == sorted_[:, :-1]], axis=1), -1, sorted_)
            all_dist = np.concatenate([dist[live], self._distances(a[live], new)], axis=1)
            keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            dist[live] = np.take_along_axis(all_dist, keep, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], new], axis=1), keep, axis=1)
            done[live] = np.take_along_axis(np.concatenate([done[live], new < 0], axis=1), keep, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        return ids[rows, order], np.stack(expanded, axis=1) if expanded else np.full((b, 1), -1, np.int32)

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        found, expanded = self.search(self.x[batch], beam)
        self.near[batch] = self._pruned(batch, np.concatenate([found, expanded], axis=1))
        targets = self.near[batch]
        source = np.repeat(batch, self.degree)[targets.ravel() >= 0]
        target = targets.ravel()[targets.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, n)
        extra = np.full((len(nodes), int(n.max())), -1, np.int32) if len(nodes) else np.zeros((0, 0), np.int32)
        extra[np.repeat(np.arange(len(nodes)), n), place] = source
        have = (self.near[nodes] >= 0).sum(axis=1)
        roomy = have + n <= self.degree
        for k in np.flatnonzero(roomy):  # without pruning, as there is room
            self.near[nodes[k], have[k] : have[k] + n[k]] = extra[k, : n[k]]
        full = np.flatnonzero(~roomy)
        for k in range(0, len(full), 256):
            part = full[k : k + 256]
            self.near[nodes[part]] = self._pruned(nodes[part], np.concatenate([self.near[nodes[part]], extra[part]], axis=1))

    def _pruned(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning of each point's candidates."""
        candidates = np.where(candidates == points[:, None], -1, candidates)
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        dist = self._distances(self.x[points], candidates)
        most = min(candidates.shape[1], 2 * BEAM)
        keep = np.argsort(dist, axis=1, kind="stable")[:, :most]
        candidates, dist = np.take_along_axis(candidates, keep, axis=1), np.take_along_axis(dist, keep, axis=1)
        v = self.x[candidates]
        sq = self.sq[candidates]
        between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        out = np.full((len(points), self.degree), -1, np.int32)
        left = dist.copy()
        rows = np.arange(len(points))
        for k in range(self.degree):
            at = left.argmin(axis=1)
            good = np.isfinite(left[rows, at])
            if not good.any():
                break
            out[good, k] = candidates[rows, at][good]
            left[rows, at] = np.inf
            covered = self.relax**2 * between[rows, at] <= dist
            left[covered & good[:, None]] = np.inf
        return out


class Shard:
    """Different vectors and a graph over them, scaled to the largest norm."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        most = np.abs(x).max()
        scaled = x / most
        self.graph = Graph(scaled / np.sqrt((scaled**2).sum(axis=1).max())) if len(x) > SCANNED else None
        self.block = int(max(1, min(BLOCK, CELLS // 8 // max(1, len(x)))))

    def search(self, q: np.ndarray, k: int, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each query the nodes among the k best found, and their inner products in double precision.

        The beam is wider in larger shards: by twice the root of the number of nodes.
        """
        beam = max(beam, k, int(2 * len(self.x) ** 0.5))
        for part in (q[a : a + self.block] for a in range(0, len(q), self.block)):
            if self.graph:
                unit = part / np.abs(part).max(axis=1)[:, None]
                unit = unit / np.sqrt((unit**2).sum(axis=1))[:, None]
                found, _ = self.graph.search(np.concatenate([unit, np.zeros((len(unit), 1))], axis=1).astype(np.float32), beam)
            else:
                found = np.broadcast_to(np.arange(len(self.x)), (len(part), len(self.x)))
            for row, ids in zip(part, found, strict=True):
                ids = ids[ids >= 0]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = self.x[ids] @ row
                best = np.argsort(-score, kind="stable")[:k]
                yield ids[best], score[best]


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def log_norm(vector: Column) -> Column:
    """The binary logarithm of the norm, without overflow on the way."""
    most = F.array_max(F.transform(vector, F.abs))
    sums = F.element_at(F.transform(F.array(most), lambda m: F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / m) * (x / m))), 1)
    return F.log2(most) + F.log2(sums) / 2


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding", least: int = LEAST) -> DataFrame:
    """Per query its k nearest found but itself: query_id, rank, vec_id, score. is_query is on vec_id."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("band", F.floor(log_norm(F.col("v")) + 0.5).cast("int")), "vectors")
    sizes = {r.band: r.n for r in rows.groupBy("band").agg(F.count("*").alias("n")).collect()}  # a row for each power of two of a double at most
    size = min(shard, max(least, -(-sum(sizes.values()) // spark.sparkContext.defaultParallelism)))
    first, shards = [], 0
    for band, n in sorted(sizes.items()):
        first.append((band, shards, -(-n // size)))
        shards += -(-n // size)
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # copies: the k + 1 smallest ids of each vector, of which one may be the query's own
    few = rows.withColumn("__c", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("__c") <= k + 1)
    few = few.join(F.broadcast(spark.createDataFrame(first, "band int, first int, parts int")), "band")
    nodes = few.withColumn("shard", F.col("first") + F.pmod(F.xxhash64(F.lit("shard"), "v"), F.col("parts")).cast("int")).select("shard", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v")
    queries = rows.filter(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v")
    together = nodes.union(queries).withColumn("d", F.size("v"))
    # four times as many partitions as shards, so that few share one
    dealt = together.select("d", "shard", "kind", "id", "v").repartition(min(4 * shards, max(shards, 4000)), F.xxhash64("d", "shard")).sortWithinPartitions("d", "shard", "kind", "id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, ids, starts, query_ids, q in _blocks(batches):
            out: tuple[list, list, list] = ([], [], [])
            for query, (at, score) in zip(query_ids, one.search(q, k + 1, beam), strict=True):
                for node, s in zip(at, score, strict=True):
                    copies = ids[starts[node] : starts[node + 1]]
                    copies = copies[copies != query]
                    out[0].append(np.full(len(copies), query))
                    out[1].append(copies)
                    out[2].append(np.full(len(copies), s))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    hits = dealt.mapInArrow(found, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each shard: its vectors, the ids of each one's copies, and a block of queries."""
    now, vectors, ids, built = None, [], [], None
    query_ids, queries = [], []

    def flush() -> Iterator[tuple]:
        nonlocal built
        if query_ids and vectors:
            if built is None:
                built = _built(vectors, ids)
            yield (*built, np.array(query_ids, np.int64), np.array(queries))
        query_ids.clear()
        queries.clear()

    for batch in batches:
        d, shard, kind, row_ids = (batch.column(c).to_numpy() for c in range(4))
        flat, offsets = batch.column(4).flatten().to_numpy(), batch.column(4).offsets.to_numpy()
        offsets = offsets - offsets[0]
        for r in range(batch.num_rows):
            if now != (here := (d[r], shard[r])):
                yield from flush()
                now, built = here, None
                vectors.clear()
                ids.clear()
            v = flat[offsets[r] : offsets[r + 1]]
            if kind[r] == 0:
                vectors.append(v)
                ids.append(row_ids[r])
            else:
                query_ids.append(row_ids[r])
                queries.append(v)
                if len(queries) >= BLOCK:
                    yield from flush()
    yield from flush()


def _built(vectors: list[np.ndarray], ids: list[int]) -> tuple[Shard, np.ndarray, np.ndarray]:
    x, of = np.unique(np.array(vectors) + 0.0, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.lexsort((np.array(ids), of))
    starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(x)))])
    return Shard(x), np.array(ids, np.int64)[order], starts


def recall(x: np.ndarray, ids: np.ndarray, found: dict[int, list[int]], k: int) -> float:
    """The share of the k truly nearest that were found, over the queries of `found`."""
    at = {int(i): n for n, i in enumerate(ids)}
    hits = total = 0
    for query, got in found.items():
        score = x @ x[at[query]]
        score[at[query]] = -np.inf
        true = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        hits += len(set(ids[true].tolist()) & set(got))
        total += len(true)
    return hits / max(1, total)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
