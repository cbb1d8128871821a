"""Operator 1: nearest neighbours by vantage-point trees, one for each shard of the vectors.

A tree's node holds a vantage point and two children, with the least and greatest
distance of each child's points to the vantage point.  By the triangle inequality
no point of a child is nearer to a query than the gap between the query's own
distance and that range.  A child is skipped when ``factor`` times the gap exceeds
the distance of the k-th neighbour found so far: factor one is exact search,
larger factors prune more and may lose neighbours.

Shards are dealt by a hash of the id and hold a bounded number of vectors, so
neither a popular vector nor a large table makes a large shard.  Queries go in blocks
to every shard; each shard's k best are merged by a rank.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.shared import materialize, prepare

#: Queries of a block meet a shard's tree together, and so do the LANE blocks of a task, which a tree is sent to once; they are searched in groups that bound the memory.
SHARD_ROWS, BLOCK_QUERIES, LANE, GROUP, LEAF = 8192, 4096, 64, 256, 64


class Tree:
    """A vantage-point tree over rows of ``points`` (double) with ``ids``; rows are kept in the tree's own order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, ranges: np.ndarray):
        self.ids, self.points, self.order, self.nodes, self.ranges = ids, points, order, nodes, ranges

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, seed: int = 1) -> Tree:
        """nodes: (vantage row, or -1 in a leaf; first row; end; left child; right child); ranges: least and greatest distance in the left and right child.

        Children are halves by rank of distance, so equal vectors split evenly too.
        """
        rng, order = np.random.default_rng(seed), np.arange(len(ids))
        nodes, ranges = [[-1, 0, len(ids), -1, -1]], [[0.0] * 4]
        todo = [0]
        while todo:
            n = todo.pop()
            _, a, b, _, _ = nodes[n]
            if b - a <= LEAF:
                continue
            # The vantage point is the farthest of a few rows from a random one: it lies at the rim, where ranges are narrow.
            some = order[rng.integers(a, b, 16)]
            v = some[_near(points[some[:1]], points[some])[0].argmax()]
            own = order[a:b]
            d = _near(points[v : v + 1], points[own])[0]
            sort = np.argsort(d, kind="stable")
            order[a:b], d = own[sort], d[sort]
            mid = (b - a) // 2
            nodes[n][0], nodes[n][3], nodes[n][4] = v, len(nodes), len(nodes) + 1
            ranges[n] = [d[0], d[mid - 1], d[mid], d[-1]]
            todo += [len(nodes), len(nodes) + 1]
            nodes += [[-1, a, a + mid, -1, -1], [-1, a + mid, b, -1, -1]]
            ranges += [[0.0] * 4, [0.0] * 4]
        return cls(ids, points, order, np.array(nodes, dtype=np.int64), np.array(ranges))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, points=self.points.astype(np.float32) if (self.points == self.points.astype(np.float32)).all() else self.points, order=self.order.astype(np.int32), nodes=self.nodes, ranges=self.ranges)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes | pa.Buffer) -> Tree:
        with np.load(io.BytesIO(memoryview(data))) as z:
            return cls(z["ids"], z["points"].astype(np.float64), z["order"], z["nodes"], z["ranges"])

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best of each query: distances and rows of the tree by (distance, id), filled up with infinity and -1; and how many distances were computed.

        Rows with the query's own id take no part; other rows that share an id are each found for themselves.
        """
        n = len(queries)
        best, who, seen = np.full((n, k), np.inf), np.full((n, k), -1, dtype=np.int64), 0
        bound = np.full(n, np.inf)
        # First each query goes down to the leaf on its own side; the k-th distance there bounds it from the start.
        todo = [(0, np.arange(n))]
        while todo:
            node, rows = todo.pop()
            v, a, b, left, right = self.nodes[node].tolist()
            if v < 0:
                if b - a > k:
                    bound[rows] = np.partition(self._leaf(ids, queries, rows, a, b), k - 1, axis=1)[:, k - 1]
                continue
            d = _near(queries[rows], self.points[v : v + 1])[:, 0]
            near = d - self.ranges[node, 1] <= self.ranges[node, 2] - d
            todo += [(c, r) for c, r in ((left, rows[near]), (right, rows[~near])) if len(r)]
        # Then all queries that a node can't exclude visit it together.
        todo = [(0, np.arange(n), np.zeros(n))]
        while todo:
            node, rows, gap = todo.pop()
            # A little slack for rounding: a tie at the k-th distance counts.
            rows = rows[factor * gap <= bound[rows] * (1 + 1e-9) + 1e-12]
            if not len(rows):
                continue
            v, a, b, left, right = self.nodes[node].tolist()
            if v < 0:
                d = self._leaf(ids, queries, rows, a, b)
                seen += d.size
                some = d.min(axis=1) <= bound[rows] * (1 + 1e-9) + 1e-12
                rows, d = rows[some], d[some]
                if len(rows):
                    all_d = np.concatenate([best[rows], d], axis=1)
                    all_r = np.concatenate([who[rows], np.broadcast_to(self.order[a:b], d.shape)], axis=1)
                    top = np.lexsort((all_r, self.ids[all_r], all_d), axis=1)[:, :k]
                    best[rows], who[rows] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_r, top, 1)
                    bound[rows] = np.minimum(bound[rows], best[rows, -1])
                continue
            d = _near(queries[rows], self.points[v : v + 1])[:, 0]
            seen += len(d)
            low_l, high_l, low_r, high_r = self.ranges[node].tolist()
            sides = [(left, rows, np.maximum(np.maximum(low_l - d, d - high_l), 0)), (right, rows, np.maximum(np.maximum(low_r - d, d - high_r), 0))]
            todo += sides if (d - high_l > low_r - d).mean() > 0.5 else sides[::-1]  # the side that most queries are on is taken first
        who[np.isinf(best)] = -1
        return best, who, seen

    def _leaf(self, ids: np.ndarray, queries: np.ndarray, rows: np.ndarray, a: int, b: int) -> np.ndarray:
        own = self.order[a:b]
        d = scores_between(queries[rows], self.points[own])
        d[self.ids[own][None, :] == ids[rows][:, None]] = np.inf
        return d


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    diff = a[:, None, :] - b[None]
    return np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


def scores_between(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The distances that rank and are reported: squares added in the order of the components, so that they don't depend on how rows are grouped."""
    out = np.zeros((len(queries), len(points)))
    for j in range(queries.shape[1]):
        diff = queries[:, j, None] - points[None, :, j]
        out += diff * diff
    return np.sqrt(out)


def valid(embedding: Column) -> Column:
    """Not null, finite throughout and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """dim, shard, tree: every valid row of ``vectors`` (vec_id, embedding) is in one tree.

    Rows with a null id or an invalid vector (see valid()) take no part; vectors of
    different lengths are never compared.
    """
    prepare(vectors.sparkSession)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).withColumn("dim", F.size("embedding"))
    sizes = own.groupBy("dim").agg(F.count("*").alias("n")).collect()  # a row for each length of vectors
    shards = F.create_map(*[F.lit(x) for r in sizes for x in (r.dim, -(-r.n // shard_rows))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.element_at(shards, F.col("dim"))).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        points = t.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        tree = Tree.build(t.column("vec_id").to_numpy(), points)
        return pa.table({"dim": pa.array([points.shape[1]], pa.int32()), "shard": t.column("shard").slice(0, 1), "tree": pa.array([tree.dump()], pa.binary())})

    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row of ``queries`` (vec_id, embedding), besides itself.

    Nearest first, ties to the smaller vec_id; fewer rows where there are fewer
    candidates.  ``index`` is what build_index() made, best written to a table.
    Invalid queries find nothing; a query id that repeats is answered once, for
    its smallest vector of its shortest length.  Index rows that share an id are found each for
    itself, with its own score; those with the query's id take no part.  An empty
    index or no queries give no rows.
    """
    spark = index.sparkSession
    prepare(spark)
    own = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    own = own.groupBy("vec_id").agg(F.min(F.struct(F.size("embedding").alias("dim"), "embedding")).alias("v")).select("vec_id", "v.embedding")
    n = own.count()
    blocks = max(1, -(-n // block_queries))
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks))
    grouped = own.withColumn("dim", F.size("embedding")).withColumn("block", block).groupBy("dim", "block").agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("points"))  # about block_queries rows
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))  # a row for each length of vectors
    sent = grouped.withColumn("lane", F.floor(F.col("block") / LANE).cast("int")).join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).select("dim", "shard", "lane", F.lit(1).alias("kind"), "ids", "points", F.lit(None).cast("binary").alias("tree"))
    # A tree comes first in its lane, and the lane's blocks after it, so it is sent and read once for LANE blocks.
    lanes = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // LANE)))
    trees = index.select("dim", "shard", lanes.alias("lane"), F.lit(0).alias("kind"), F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<double>").alias("points"), "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at = tuple(batch.column(c)[i].as_py() for c in ("dim", "shard", "lane"))
                if batch.column("kind")[i].as_py() == 0:
                    held, tree = at, Tree.load(batch.column("tree")[i].as_buffer())
                    continue
                if at != held:
                    continue  # a shard that no row fell into has no tree
                all_ids = batch.column("ids")[i].values.to_numpy()
                all_points = batch.column("points")[i].values.to_numpy().reshape(len(all_ids), -1)
                for g in range(0, len(all_ids), GROUP):
                    ids, points = all_ids[g : g + GROUP], all_points[g : g + GROUP]
                    best, who, _ = tree.search(ids, points, k, factor)
                    full = ~np.isinf(best)
                    q, rows = np.nonzero(full)[0], who[full]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(tree.ids[rows]), pa.array(best[full])], names=["query_id", "vec_id", "score"])

    placed = trees.unionByName(sent).repartition("dim", "shard", "lane").sortWithinPartitions("dim", "shard", "lane", "kind")
    found = placed.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score (see search_index()).  Queries: the rows of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``; candidates: all rows.

    Null ids and vectors that are null, empty, zero or hold null or non-finite
    components take no part; ties go to the smaller vec_id; further columns are
    ignored; an empty table gives none.
    """
    index = materialize(build_index(vectors), "trees")
    return search_index(index, vectors.where(F.col("vec_id") % every == 0), k, factor)


def recall(found: pd.DataFrame, exact: pd.DataFrame) -> float:
    """The share of the exact (query_id, vec_id) pairs that were found."""
    keys = ["query_id", "vec_id"]
    return len(found[keys].merge(exact[keys], on=keys)) / max(1, len(exact))
