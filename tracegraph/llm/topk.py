"""Exact top-k search by inner product with two cover trees.

Components become ``floor(64 x)``; the score of a query and a candidate is the integer
inner product. Queries are cut into blocks by hash, candidates too; every pair of blocks
is one task group. Inside it both blocks are indexed by a cover tree (centre, covering
radius, children that cover ever smaller balls), and pairs of nodes are visited best
bound first: no query q in a ball (q0, a) and candidate p in a ball (p0, b) score above
<q0, p0> + b |q0| + a |p0| + a b, so a pair of nodes is pruned when that is below the
worst k-th score of the queries under the query node. What is not pruned meets as leaves,
in one matrix product. The k best per block pair are merged by query.

Exactness: integers are multiplied as doubles only while every sum stays below 2**53, else
as Python integers, held to the range of a long; bounds are widened by their rounding.

Defined cases: vectors that are null or empty-handed (null or non-finite components), and
rows without an id, take no part; a vector shorter than others counts as ended by zeros;
rows repeating id and vector of a query are one query; repeated candidates are rows of
their own; candidates with the query's id are never its results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows per block of queries and candidates, points per leaf, children per node
QUERY_BLOCK, BLOCK, LEAF, FAN = 4096, 16384, 512, 12


class Node:
    __slots__ = ("center", "norm", "radius", "children", "rows")

    def __init__(self, center, radius, children, rows):
        self.center, self.norm, self.radius = center, float(np.sqrt(center @ center)), radius
        self.children, self.rows = children, rows


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Children are centred on points chosen farthest first until they cover the node at half
    its radius, or are ``FAN``; every point goes to the nearest centre."""
    rows = np.arange(len(points)) if rows is None else rows
    mine = points[rows]
    far = np.sqrt(((mine - mine[0]) ** 2).sum(axis=1))
    radius = float(far.max())
    if len(rows) <= LEAF or radius == 0.0:
        return Node(mine[0], radius, [], rows)
    near, nearest, k = far, np.zeros(len(rows), dtype=np.int64), 0
    while near.max() > radius / 2 and k + 1 < FAN:
        k += 1
        d = np.sqrt(((mine - mine[int(near.argmax())]) ** 2).sum(axis=1))
        closer = d < near
        near, nearest = np.where(closer, d, near), np.where(closer, k, nearest)
    groups = [rows[nearest == c] for c in range(k + 1)]
    return Node(mine[0], radius, [cover_tree(points, g) for g in groups if len(g)], rows)


class Search:
    """Best k candidates of each query, held as rows sorted by score, then id."""

    def __init__(self, queries, query_ids, points, ids, k: int):
        self.queries, self.query_ids, self.points, self.ids, self.k = queries, query_ids, points, ids, k
        self.best = np.full((len(queries), k), -np.inf)
        self.who = np.full((len(queries), k), -1, dtype=np.int64)

    def bound(self, q: Node, p: Node) -> float:
        top = q.center @ p.center + p.radius * q.norm + q.radius * p.norm + q.radius * p.radius
        return top + 1e-9 * (q.norm + q.radius) * (p.norm + p.radius) + 1e-6

    def visit(self, q: Node, p: Node, bound: float) -> None:
        stack = [(q, p, bound)]
        while stack:
            q, p, bound = stack.pop()
            if bound < self.best[q.rows, -1].min():
                continue
            if not q.children and not p.children:
                self.meet(q.rows, p.rows)
                continue
            qs = q.children if q.children and (not p.children or q.radius > p.radius) else [q]
            ps = [p] if qs[0] is not q else p.children
            pairs = [(a, b, self.bound(a, b)) for a in qs for b in ps]
            stack += sorted(pairs, key=lambda x: x[2])  # the best is taken next

    def meet(self, q: np.ndarray, p: np.ndarray) -> None:
        scores = self.queries[q] @ self.points[p].T
        hit = (scores >= self.best[q, -1][:, None]) & (self.query_ids[q][:, None] != self.ids[p][None, :])
        row, col = np.nonzero(hit)
        if not len(row):
            return
        changed = np.unique(row)
        row = np.concatenate([np.repeat(changed, self.k), row])
        score = np.concatenate([self.best[q[changed]].ravel(), scores[hit]])
        who = np.concatenate([self.who[q[changed]].ravel(), self.ids[p[col]]])
        order = np.lexsort((who, -score, row))
        row, score, who = row[order], score[order], who[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.best[q[row[kept]], place[kept]] = score[kept]
        self.who[q[row[kept]], place[kept]] = who[kept]


def _matrix(column) -> np.ndarray:
    """Vectors of long as a matrix, shorter ones ended by zeros; Python integers if large."""
    vectors = [np.asarray(v, dtype=np.float64) for v in column]
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _widen(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def best_in_block(queries: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    columns = ["query_id", "vec_id", "score"]
    if not len(queries) or not len(points):
        return pd.DataFrame({c: pd.Series(dtype=np.int64) for c in columns})
    q, p = _matrix(queries["v"]), _matrix(points["v"])
    width = max(q.shape[1], p.shape[1])
    q, p = _widen(q, width), _widen(p, width)
    q_ids, p_ids = queries["vec_id"].to_numpy(), points["vec_id"].to_numpy()
    if np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * width >= 2**53:
        return _slow(q, q_ids, p, p_ids, k)
    found = Search(q, q_ids, p, p_ids, k)
    a, b = cover_tree(q), cover_tree(p)
    found.visit(a, b, np.inf)
    ok = np.isfinite(found.best)
    rows = np.nonzero(ok)[0]
    return pd.DataFrame({"query_id": q_ids[rows], "vec_id": found.who[ok], "score": found.best[ok].astype(np.int64)})


def _slow(q, q_ids, p, p_ids, k) -> pd.DataFrame:
    """All pairs in exact integers, for components beyond doubles; scores are held to a long."""
    out, ps = [], [[int(x) for x in v] for v in p]
    for vec, i in zip(q, q_ids.tolist(), strict=True):
        own = [int(x) for x in vec]
        scores = [(max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, own, x)))), j) for x, j in zip(ps, p_ids.tolist(), strict=True) if j != i]
        out += [(i, j, s) for s, j in sorted(scores, key=lambda t: (-t[0], t[1]))[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(np.int64)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part, as whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    wide = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    d = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), wide.alias("v"))
    d = d.where(F.forall("v", finite))
    # floor() would give a long, which large components overflow; rint() stays a double
    down = lambda y: F.when(F.rint(y) > y, F.rint(y) - 1).otherwise(F.rint(y))
    return d.select("vec_id", F.transform("v", lambda x: down(x * 64)).alias("v"))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` its
    ``k`` best among the other rows."""
    points = usable(vectors, id_col, vec_col)
    queries = points.where(F.col("vec_id") % every == 0).distinct()
    n = points.count()
    n_blocks, n_query_blocks = max(1, -(-n // block)), max(1, -(-n // (every * query_block)))
    place = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = queries.select("*", place(n_query_blocks).alias("qb"), all_of(n_blocks).alias("pb"))
    p = points.select("*", place(n_blocks).alias("pb"), all_of(n_query_blocks).alias("qb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_in_block(left, right, k)

    found = q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
  FROM v q JOIN v p ON p.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
