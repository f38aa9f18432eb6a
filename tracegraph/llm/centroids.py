"""Centroid clustering whose nearest-centroid search is the threshold algorithm.

Vectors of exactly ``dim`` finite components become whole numbers ``floor(64 x)``. The first
centroids are the vectors with the smallest SHA-256 of ``1:<vec_id>``; each round assigns
every vector to its nearest centroid (squared Euclidean distance, ties to the smaller number)
and moves every centroid that has vectors to the floor of their mean.

Search (Fagin's threshold algorithm): per dimension the centroids are a list sorted by their
value there. From a vector's value each list is walked outward, the nearer neighbour first;
a centroid met for the first time gets its exact distance. The distances at the frontiers of
all lists, squared and summed, are a lower bound for every centroid not met yet, so the walk
ends when it strictly exceeds the best exact distance (at equality a smaller number may
still come). A batch of vectors is walked together in numpy.

Scale: vectors are read once per round in Arrow batches and never shuffled. A task sends the
sums of its vectors per centroid and dimension, cut into numbers of 48 bits, which the engine
adds up as decimals; the driver sees these sums only (``k * dim`` numbers, however many
vectors there are), and the centroids go back with the task.

Exactness: whole numbers throughout; 64-bit where no sum can overflow, else Python's own. A
distance or inertia beyond a long is held to the largest long.

Defined cases: vectors that are null, of another length, or with a null or non-finite component
(also after the multiplication by 64) take no part; a vector without an id is clustered but
starts no centroid; repeated rows are vectors of their own; with fewer vectors than ``k``
there are fewer centroids; without any the result is empty; an empty cluster keeps its centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

DIM, K, ROUNDS, SEED = 64, 16, 3, 1
#: vectors walked together; bits per number of a sum; largest long
TOGETHER, LIMB, LONG = 2048, 48, 2**63 - 1


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``(vec_id, v array<double>)`` of the vectors that take part, as whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    down = lambda y: F.when(F.rint(y) > y, F.rint(y) - 1).otherwise(F.rint(y))
    scaled = F.transform(F.col(vec_col), lambda x: x.cast("double") * 64)
    d = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), scaled.alias("v"))
    d = d.where(F.col("v").isNotNull() & (F.size("v") == dim)).where(F.forall("v", finite))
    return d.select("vec_id", F.transform("v", down).alias("v"))


def small(dim: int) -> int:
    """Components below this keep the sum of ``dim`` squared differences in 64 bits."""
    return 1 << ((62 - dim.bit_length()) // 2 - 1)


def whole(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows of whole numbers: 64-bit if small, else Python's."""
    if np.abs(flat).max(initial=0.0) < small(dim):
        return flat.astype(np.int64).reshape(-1, dim)
    return np.array([int(x) for x in flat.tolist()], dtype=object).reshape(-1, dim)


class SortedLists:
    """Per dimension, the centroids in order of their value there."""

    def __init__(self, centroids: list[list[int]]):
        large = any(abs(x) >= small(len(c)) for c in centroids for x in c)
        self.points = np.array(centroids, dtype=object if large else np.int64)
        self.order = np.argsort(self.points, axis=0, kind="stable")
        self.values = np.take_along_axis(self.points, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of ``x``."""
        k, dim = self.points.shape
        if self.points.dtype == object or x.dtype == object:
            x = x.astype(object)
        known = np.full((len(x), k), float("inf") if x.dtype == object else np.iinfo(np.int64).max, dtype=x.dtype)
        seen = np.zeros(known.shape, dtype=bool)
        columns = np.arange(dim)
        right = np.stack([np.searchsorted(self.values[:, d], x[:, d], side="right") for d in range(dim)], axis=1)
        left = right - 1
        live = np.arange(len(x))
        for _ in range(k):
            mine, lo, hi = x[live], left[live], right[live]
            down, up = np.maximum(lo, 0), np.minimum(hi, k - 1)
            below, above = mine - self.values[down, columns], self.values[up, columns] - mine
            go_left = (lo >= 0) & ((hi >= k) | (below <= above))
            met = np.zeros((len(live), k), dtype=bool)
            met[np.arange(len(live))[:, None], np.where(go_left, self.order[down, columns], self.order[up, columns])] = True
            row, number = np.nonzero(met & ~seen[live])
            seen[live] |= met
            gap = mine[row] - self.points[number]
            known[live[row], number] = (gap * gap).sum(axis=1)
            left[live], right[live] = lo - go_left, hi + ~go_left
            frontier = np.where(go_left, below, above)
            live = live[(frontier * frontier).sum(axis=1) <= known[live].min(axis=1)]
            if not len(live):
                break
        best = known.argmin(axis=1)
        return best, known[np.arange(len(x)), best]


def limbs(number: int) -> list[int]:
    """``number`` as sum of ``limb << (LIMB * i)``; all limbs fit 49 bits with their sign."""
    out = []
    while not -(1 << LIMB) <= number < 1 << LIMB:
        out.append(number & ((1 << LIMB) - 1))
        number >>= LIMB
    return [*out, number]


def _matrices(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(batch), TOGETHER):
        some = batch.column(batch.schema.get_field_index("v")).slice(at, TOGETHER)
        yield at, whole(some.flatten().to_numpy(zero_copy_only=False), dim)


def moved(points: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """One round: the centroids after assigning all points."""
    lists = SortedLists(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dim + 1) for _ in centroids]
        for batch in batches:
            for _, x in _matrices(batch, dim):
                number, _ = lists.nearest(x)
                for c in np.unique(number).tolist():
                    own = x[number == c]
                    for d, s in enumerate([*own.sum(axis=0).tolist(), len(own)]):
                        total[c][d] += int(s)
        rows = [(c, d, i, part) for c, row in enumerate(total) if row[dim] for d, s in enumerate(row) for i, part in enumerate(limbs(s))]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["c", "d", "i", "part"])

    found = points.select("v").mapInArrow(sums, "c int, d int, i int, part bigint")
    total: dict[tuple[int, int], int] = {}
    # at most k * (dim + 1) sums of a few limbs each
    for r in found.groupBy("c", "d", "i").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("s")).collect():
        total[r.c, r.d] = total.get((r.c, r.d), 0) + (int(r.s) << (LIMB * r.i))
    count = lambda c: total.get((c, dim), 0)
    return [[total[c, d] // count(c) for d in range(dim)] if count(c) else own for c, own in enumerate(centroids)]


def assigned(points: DataFrame, centroids: list[list[int]], dim: int) -> DataFrame:
    """``(vec_id, cluster, distance)``."""
    lists = SortedLists(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, dim):
                number, gap = lists.nearest(x)
                held = pa.array([min(g, LONG) for g in gap.tolist()], type=pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(number, type=pa.int32()), held], names=["vec_id", "cluster", "distance"])

    return points.select("vec_id", "v").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def first_centroids(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.where(F.col("vec_id").isNotNull()).select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()
    return [[int(x) for x in r.v] for r in rows]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row per
    vector that takes part."""
    points = staged(usable(vectors, id_col, vec_col, dim), "centroid-points")
    centroids = first_centroids(points, k, seed)
    if not centroids:
        # no vector, or none with an id: nothing to start from
        nothing = "cast(null as int) cluster, 0L distance, 0L cluster_inertia, 0L inertia, '' centroid_sha256"
        return points.limit(0).selectExpr("vec_id", *nothing.split(", "))
    for _ in range(rounds):
        centroids = moved(points, centroids, dim)
    done = staged(assigned(points, centroids, dim), "centroid-assigned")
    sums = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    everything = min(LONG, sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(c, min(LONG, sums.get(c, 0)), everything, digest(own)) for c, own in enumerate(centroids)]
    of = done.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row per centroid: a proven bound
    return done.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [
        f"""p AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (
    SELECT v, sha256('{SEED}:' || vec_id) AS h FROM p WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {K}))"""
    ]
    near = "list_sum(list_transform(range(1, {n}), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))".format(n=DIM + 1)
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m FROM (
    SELECT p.row, p.vec_id, p.v, c.c, CAST({near} AS BIGINT) AS d FROM (SELECT *, row_number() OVER () AS row FROM p) p, c{r} c) GROUP BY row)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (
  SELECT m.c AS c, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY m.c, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(any_value(x.v), any_value(c.v)) AS v FROM c{r} c LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c) x ON x.c = c.c GROUP BY c.c)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} f ON f.c = m.c
"""


ORACLE = _sql()
