"""Exact top-k inner-product search with two cover trees.

Vectors are dealt into compact blocks by their nearest *pivot* (a bounded, fixed
draw of vectors); what is more than a block is split by a hash.  Each block of
candidates and each block of queries gets a cover tree.  A dual traversal meets
pairs of nodes: with centres c, d and covering radii r, s no pair below them scores
more than ``c.d + r|d| + s|c| + r s``, so the pair is dropped when that is less than
the worst k-th score of the query group.  Remaining buckets are scored in integers.

1. Every query block searches the candidate block whose root promises most.
2. Root bounds against the k-th scores found there rule out pairs of blocks before
   any vectors are joined; each remaining pair is a row of a key join (the stated
   query set against all rows, in blocks), and starts from those k-th scores.

A task holds one pair of blocks.  Vectors without cluster structure (independent
random directions) have no node small enough for these bounds: all pairs of the
query set are then compared, as matrix products.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotoflow.llm.common import Tables

BLOCK = 2048
#: Queries are fewer than candidates and every block of them meets many blocks, so their blocks are larger.
QUERY_BLOCK = 8192
BUCKET = 64
#: Children with fewer points stay in their parent's bucket.
MIN_CHILD = 8
#: Pivots that blocks are dealt by: one for each block that the vectors would fill, at most so many.
PIVOTS = 512
#: Children's radii are this share of their parent's.
SHRINK = 0.6
SCALE = 256
_LONG = 2**63 - 1


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    lo: int = 0
    hi: int = 0
    #: rows of its own bucket, lo to hi; children cover the rest of what it covers
    children: list[Node] = field(default_factory=list)


class CoverTree:
    """Cover tree over the rows of ``points``; ``order`` lists rows bucket by bucket.

    A node's children are a greedy net: centres further apart than the child
    radius, covering every point.  Children of a few points stay in their
    parent's bucket, where every point is a node of radius 0.
    """

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order: list[int] = []
        self.root = self._build(np.arange(len(points))) if len(points) else None
        self.order = np.array(self.order, dtype=np.int64)

    def _build(self, rows: np.ndarray) -> Node:
        x = self.points[rows]
        first = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
        centre = x[first]
        far = np.sqrt(((x - centre) ** 2).sum(axis=1))
        # slack for rounding: a bound must never be too small
        node = Node(centre, float(np.sqrt(centre @ centre)) * (1 + 1e-9), float(far.max()) * (1 + 1e-9) + 1e-9, len(self.order))
        if len(rows) <= BUCKET or far.max() == 0:
            self.order += rows.tolist()
            node.hi = len(self.order)
            return node
        reach, left, groups, stay = far.max() * SHRINK, np.arange(len(rows)), [], []
        pick = first
        while len(left):
            near = np.sqrt(((x[left] - x[pick]) ** 2).sum(axis=1)) <= reach
            mine = left[near]
            (groups if MIN_CHILD <= len(mine) < len(rows) else stay).append(rows[mine])
            left = left[~near]
            if len(left):
                pick = left[0]
        for g in stay:
            self.order += g.tolist()
        node.hi = len(self.order)
        node.children = [self._build(g) for g in groups]
        return node


def _scores(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they saturate."""
    if not len(q) or not len(r):
        return np.zeros((len(q), len(r)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(r).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ r.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


class Search:
    """Best k candidates of every query of a block, over one block of candidates.

    ``start``: (score, found, some) of an earlier search by the same query tree;
    ``fresh`` tells which of the results are new.
    """

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, q_tree: CoverTree, r: np.ndarray, r_ids: np.ndarray, r_tree: CoverTree, k: int, start=None):
        self.q, self.q_ids, self.r, self.r_ids, self.k = q[q_tree.order], q_ids[q_tree.order], r[r_tree.order], r_ids[r_tree.order], k
        self.points = self.r.astype(np.float64)
        self.norms = np.sqrt((self.points**2).sum(axis=1)) * (1 + 1e-9)
        n = len(self.q)
        if start is None:
            start = np.full((n, k), -_LONG - 1, dtype=np.int64), np.full((n, k), _LONG, dtype=np.int64), np.zeros((n, k), dtype=bool)
        self.score, self.found, self.some = (x.copy() for x in start)
        self.fresh = np.zeros((n, k), dtype=bool)
        self.compared = 0
        if q_tree.root and r_tree.root:
            self._pair(q_tree.root, r_tree.root)

    def _worst(self, node: Node) -> float:
        own = self.score[node.lo : node.hi, -1]
        got = [float(own.min())] if len(own) else []
        return min(got + [self._worst(c) for c in node.children])

    @staticmethod
    def _bound(a: Node, b: Node, ra: float) -> float:
        c = float(a.centre @ b.centre)
        return c + ra * b.norm + b.radius * a.norm + ra * b.radius + 1e-6 * (1 + abs(c))

    def _pair(self, a: Node, b: Node) -> None:
        if self._bound(a, b, a.radius) < self._worst(a):
            return
        if a.hi > a.lo:
            self._group(a, b)
        for child in a.children:
            self._pair(child, b)

    def _group(self, a: Node, b: Node) -> None:
        """The bucket of query node a against all below candidate node b."""
        if self._bound(a, b, a.radius) < float(self.score[a.lo : a.hi, -1].min()):
            return
        if b.hi > b.lo:
            self._base(a, slice(b.lo, b.hi))
        for child in sorted(b.children, key=lambda c: -self._bound(a, c, a.radius)):
            self._group(a, child)

    def _base(self, a: Node, rs: slice) -> None:
        """A query bucket against a candidate bucket, whose points are nodes of radius 0."""
        qs = slice(a.lo, a.hi)
        if a.radius > 1e-6:
            c = self.points[rs] @ a.centre
            near = np.flatnonzero(c + a.radius * self.norms[rs] + 1e-6 * (1 + np.abs(c)) >= float(self.score[qs, -1].min())) + rs.start
            if not len(near):
                return
        else:
            near = np.arange(rs.start, rs.stop)
        new = _scores(self.q[qs], self.r[near])
        self.compared += new.size
        ids = np.broadcast_to(self.r_ids[near], new.shape)
        ok = ids != self.q_ids[qs][:, None]
        score = np.concatenate([self.score[qs], new], axis=1)
        found = np.concatenate([self.found[qs], ids], axis=1)
        some = np.concatenate([self.some[qs], ok], axis=1)
        fresh = np.concatenate([self.fresh[qs], ok], axis=1)
        if score.shape[1] > 4 * self.k:
            # only what reaches the k-th best needs sorting
            valued = np.where(some, np.maximum(score, -_LONG), -_LONG - 1)
            kth = -np.partition(-np.maximum(valued, -_LONG), self.k - 1, axis=1)[:, self.k - 1]
            width = int((valued >= kth[:, None]).sum(axis=1).max())
            keep = np.argpartition(-np.maximum(valued, -_LONG), min(width, score.shape[1]) - 1, axis=1)[:, :width] if width < score.shape[1] else None
            if keep is not None:
                score, found, some, fresh = (np.take_along_axis(x, keep, axis=1) for x in (score, found, some, fresh))
        best = np.lexsort((found, -np.maximum(score, -_LONG), ~some), axis=1)[:, : self.k]
        take = lambda x: np.take_along_axis(x, best, axis=1)
        self.score[qs], self.found[qs], self.some[qs], self.fresh[qs] = np.where(take(some), take(score), -_LONG - 1), take(found), take(some), take(fresh) & take(some)


def quantized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v``: floor(256 x) of every vector that has only finite components."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0)).where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _pivots(rows: DataFrame, size: int) -> list[tuple[int, int, list[int]]]:
    """(dim, pivot, vector): as many vectors of each length as blocks of ``size`` hold all, PIVOTS at most, drawn by a hash of the id."""
    n = max(1, min(PIVOTS, -(-rows.count() // size)))
    drawn = rows.select(F.size("v").alias("dim"), "v", F.xxhash64("vec_id").alias("h"))
    first = F.min_by(F.struct("v"), "h")  # one for each of n hash classes: a partial aggregation
    found = drawn.groupBy("dim", F.pmod("h", F.lit(n)).alias("pivot")).agg(first["v"].alias("at"))
    return [(r["dim"], r["pivot"], list(r["at"])) for r in found.collect()]


def _blocks(rows: DataFrame, tables: Tables, name: str, size: int) -> DataFrame:
    """``dim, block, part, n, centre, norm, radius, data``: cover tree, ids and vectors of each block.

    Vectors go to their nearest pivot; pivots with more than ``size`` vectors are
    split into parts by a hash of id and vector.
    """
    by_dim: dict[int, tuple[list, list]] = {}
    for dim, pivot, at in _pivots(rows, size):
        by_dim.setdefault(dim, ([], []))[0].append(pivot)
        by_dim[dim][1].append(at)
    known = {d: (np.array(p), np.array(a, dtype=np.float64)) for d, (p, a) in by_dim.items()}

    def near(batches):
        for batch in batches:
            lists = batch.column(1)
            dims = lists.value_lengths().to_numpy()
            values, first = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(dims)))[:-1]
            block = np.zeros(len(dims), dtype=np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = values[first[at][:, None] + np.arange(d)].astype(np.float64)
                names, points = known[d]
                block[at] = names[np.argmin((points**2).sum(axis=1) - 2 * x @ points.T, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(block), batch.column(0), lists], names=["dim", "block", "vec_id", "v"])

    dealt = tables.write(rows.mapInArrow(near, "dim int, block long, vec_id long, v array<long>"), f"{name}-dealt")
    parts = dealt.groupBy("dim", "block").agg(F.ceil(F.count("*") / size).alias("parts"))
    keyed = dealt.join(F.broadcast(parts), ["dim", "block"]).select("dim", "block", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).alias("part"), "vec_id", "v")

    def build(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for dim, block, part, name, v in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                held.setdefault((dim, block, part), []).append((name, v.values.to_numpy()))
        for (dim, block, part), got in sorted(held.items()):
            got.sort(key=lambda x: (x[0], x[1].tolist()))
            ids, vec = np.array([g[0] for g in got], dtype=np.int64), np.stack([g[1] for g in got])
            tree = CoverTree(vec)
            tree.points = None
            data = pickle.dumps((ids, vec.astype(np.int16) if np.abs(vec).max() < 2**15 else vec, tree))
            root = tree.root
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([block], pa.int64()), pa.array([part], pa.int64()), pa.array([root.centre.tolist()], pa.list_(pa.float64())), pa.array([root.norm]), pa.array([root.radius]), pa.array([data], pa.binary())],
                names=["dim", "block", "part", "centre", "norm", "radius", "data"],
            )

    # a block is the whole content of its partition, so a task builds few trees
    n = parts.agg(F.sum("parts")).head()[0] or 1
    built = keyed.repartition(max(1, min(n, 4096)), "dim", "block", "part").mapInArrow(build, "dim int, block long, part long, centre array<double>, norm double, radius double, data binary")
    return tables.write(built, name)


def _bound(q: str, r: str) -> Column:
    """No query below root ``q`` scores more with a candidate below root ``r``."""
    c = F.aggregate(F.zip_with(f"{q}.centre", f"{r}.centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    q_norm, q_radius, r_norm, r_radius = (F.col(f"{x}.{y}") for x in (q, r) for y in ("norm", "radius"))
    return c + q_radius * r_norm + r_radius * q_norm + q_radius * r_radius + 1e-6 * (1 + F.abs(c))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best candidates by integer inner product.

    Candidates are all rows but those with the query's own id; ties go to the
    smaller id; fewer than k candidates give fewer rows.  Vectors that are null,
    empty or hold null or non-finite components, and rows without an id, take no
    part.  Vectors meet only vectors of their own length.  Repeated rows are
    candidates each, and a repeated query row is answered each time.  Scores
    beyond 64 bits saturate.  Other columns are ignored.
    """
    with Tables(vectors.sparkSession) as tables:
        rows = quantized(vectors, id_col, vec_col)
        asked = quantized(vectors.where(F.coalesce(is_query, F.lit(False))), id_col, vec_col)
        refs, queries = _blocks(rows, tables, "topk-candidates", block), _blocks(asked, tables, "topk-queries", query_block)
        roots = ["dim", "block", "part", "centre", "norm", "radius"]
        q, r = queries.select(roots).alias("q"), refs.select(roots).alias("r")
        # one row for each query block: a few numbers for thousands of queries
        met = r.join(F.broadcast(q), F.col("q.dim") == F.col("r.dim"))
        key = [F.col("q.dim").alias("dim"), F.col("q.block").alias("block"), F.col("q.part").alias("part")]
        best = met.groupBy(*key).agg(F.max_by(F.struct("r.block", "r.part"), F.struct(_bound("q", "r"), F.col("r.block"), F.col("r.part"))).alias("best"))
        first = tables.write(best.select("dim", "block", "part", F.col("best.block").alias("r_block"), F.col("best.part").alias("r_part")), "topk-first")
        seeds = tables.write(_searched(first, queries.withColumn("start", F.lit(None).cast("binary")), refs, k, True), "topk-seeds")
        held = seeds.where("start IS NOT NULL").select("dim", "block", "part", "start", "worst")
        q = queries.select(roots).join(F.broadcast(held.select("dim", "block", "part", "worst")), ["dim", "block", "part"]).alias("q")
        more = r.join(F.broadcast(q), (F.col("q.dim") == F.col("r.dim")) & (_bound("q", "r") >= F.col("q.worst")))
        more = more.select(*key, F.col("r.block").alias("r_block"), F.col("r.part").alias("r_part")).join(F.broadcast(first), ["dim", "block", "part", "r_block", "r_part"], "left_anti")
        pairs = tables.write(more, "topk-pairs")
        started = queries.join(held.drop("worst"), ["dim", "block", "part"])
        found = seeds.where("start IS NULL").drop("start", "worst").unionAll(_searched(pairs, started, refs, k, False).drop("start", "worst"))
        rank = F.row_number().over(Window.partitionBy("dim", "block", "part", "row").orderBy(F.col("score").desc(), "vec_id"))
        out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return tables.write(out, "topk-found", keep=True)


def _searched(pairs: DataFrame, queries: DataFrame, refs: DataFrame, k: int, first: bool) -> DataFrame:
    """Results of the pairs of blocks; of the first search also one row a query block to start others from
    (``start``, and the worst k-th score)."""

    def search(batches):
        for batch in batches:
            for dim, block, part, q_data, start, r_data in zip(*(batch.column(i).to_pylist() for i in range(3)), *batch.columns[3:], strict=True):
                q_ids, q, q_tree = pickle.loads(q_data.as_py())
                r_ids, r, r_tree = pickle.loads(r_data.as_py())
                s = Search(q.astype(np.int64), q_ids, q_tree, r.astype(np.int64), r_ids, r_tree, k, pickle.loads(start.as_py()) if start.is_valid else None)
                row, col = np.nonzero(s.fresh)
                n = len(row) + first
                none = [None] if first else []
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([x] * n, t) for x, t in ((dim, pa.int32()), (block, pa.int64()), (part, pa.int64()))),
                        *(pa.array([*x.tolist(), *none], pa.int64()) for x in (q_tree.order[row], s.q_ids[row], s.found[row, col], s.score[row, col])),
                        pa.array([None] * len(row) + ([pickle.dumps((s.score, s.found, s.some))] if first else []), pa.binary()),
                        pa.array([None] * len(row) + ([float(s.score[:, -1].min())] if first else []), pa.float64()),
                    ],
                    names=["dim", "block", "part", "row", "query_id", "vec_id", "score", "start", "worst"],
                )

    key = ["dim", "block", "part"]
    right = refs.select("dim", F.col("block").alias("r_block"), F.col("part").alias("r_part"), F.col("data").alias("r_data"))
    with_refs = right.join(F.broadcast(pairs) if first else pairs, ["dim", "r_block", "r_part"])
    both = with_refs.join(queries.select(*key, "data", "start"), key).select(*key, "data", "start", "r_data", "r_block", "r_part")
    dealt = both.repartition(*key, "r_block", "r_part").select(*key, "data", "start", "r_data")
    return dealt.mapInArrow(search, "dim int, block long, part long, row long, query_id long, vec_id long, score long, start binary, worst double")
