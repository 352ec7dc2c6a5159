"""Centroid clustering with n-simplex projection: bounds from cached pivot distances before exact comparison.

Vectors are integers (256 times each component, rounded down). Some of the first centroids that are
far from each other serve as pivots; pivots and their mutual distances form a simplex. A vector's
distances to the pivots, measured once and cached, place it as the apex above that simplex: one
coordinate per pivot. For two vectors, the Euclidean distance of their apexes is a lower bound of
their true distance, and the distance of one apex to the other's mirror image an upper bound. A
round keeps for each vector only the centroids whose lower bound does not exceed the least upper
bound, and compares those exactly, in integers. Bounds are widened by far more than their rounding
error, so no centroid is lost.

A round is one pass over the cached table; tasks hand on sums and counts per centroid, which are
all that reaches the driver (``CENTROIDS`` times the number of components).

Defined cases: vectors that are null, of another length, hold null or non-finite components, or
components of 2^19 and more in size (their squared distances would not fit 64 bits) are left
out; a null vec_id is hashed as an empty one; equal ids are ordered by their components; fewer
vectors than centroids give fewer centroids; repeated rows count each; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.store import drop, save

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Most pivots, and the least height of one above the simplex of those before, as a part of its distance.
PIVOTS, LEAST_HEIGHT = 16, 0.05
#: Largest size of a component.
LARGEST = 1 << 19
#: What bounds are widened by: parts of a vector's distance, for the root that gives the last coordinate,
#: and of its square over the least height of a pivot, for the others. Rounding errors are some 10^4 times smaller.
SLACK_ROOT, SLACK_HEIGHT = 1e-6, 1e-9


class Simplex:
    """Pivots in a coordinate system of their own, each the apex above those before it."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        """Chooses pivots among ``points`` (integers): always the one highest above those chosen so far."""
        self.pivots = points[:1]
        self.base = np.zeros((1, 0))  # row i: coordinates of pivot i, zero from column i on
        while len(self.pivots) < most:
            apex = self.apexes(points)
            far = np.sqrt((apex**2).sum(axis=1).max(initial=0.0))
            top = int(apex[:, -1].argmax())
            if apex[top, -1] <= max(LEAST_HEIGHT * far, 1.0):
                break
            self.base = np.vstack([np.pad(self.base, ((0, 0), (0, 1))), apex[top]])
            self.pivots = np.vstack([self.pivots, points[top]])

    def apexes(self, points: np.ndarray) -> np.ndarray:
        """Apex coordinates of integer points, from nothing but their distances to the pivots."""
        d2 = squared(points, self.pivots).astype(float)
        n = len(self.pivots)
        out = np.zeros((len(points), n))
        # y * v_i = (d_0^2 + |v_i|^2 - d_i^2) / 2 for pivots v_i, v_0 being the origin
        for i in range(1, n):
            v = self.base[i]
            right = (d2[:, 0] + (v**2).sum() - d2[:, i]) / 2
            out[:, i - 1] = (right - out[:, : i - 1] @ v[: i - 1]) / v[i - 1]
        out[:, n - 1] = np.sqrt(np.maximum(d2[:, 0] - (out[:, : n - 1] ** 2).sum(axis=1), 0.0))
        return out

    def slack(self, apex: np.ndarray, others: np.ndarray) -> np.ndarray:
        """What the bounds between each of ``apex`` and any of ``others`` are widened by."""
        far2 = (apex**2).sum(axis=1) + max((others**2).sum(axis=1).max(initial=0.0), (self.base**2).sum(axis=1).max(initial=0.0))
        height = min((self.base[i, i - 1] for i in range(1, len(self.base))), default=1.0)
        return SLACK_ROOT * (1 + np.sqrt(far2)) + SLACK_HEIGHT * far2 / height


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of ``b`` (a few)."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def bounds(apex: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between two sets of vectors."""
    flat = ((apex[:, None, :-1] - others[None, :, :-1]) ** 2).sum(axis=2)
    up, down = apex[:, None, -1], others[None, :, -1]
    return np.sqrt(flat + (up - down) ** 2), np.sqrt(flat + (up + down) ** 2)


def nearest(points: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one on ties) and its squared distance, both exact."""
    low, high = bounds(apex, tops)
    row, c = np.nonzero(low <= (high.min(axis=1) + slack)[:, None])
    d = np.empty(len(row), dtype=np.int64)
    for k in range(0, len(row), 65_536):
        part = slice(k, k + 65_536)
        d[part] = ((points[row[part]] - centroids[c[part]]) ** 2).sum(axis=1)
    order = np.lexsort((c, d, row))
    first = order[np.searchsorted(row, np.arange(len(points)))]  # rows ascend, each has a candidate
    return c[first], d[first]


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _cached(simplex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apex = simplex.value.apexes(_matrix(batch["ints"], np.int64))
            listed = pa.FixedSizeListArray.from_arrays(pa.array(apex.ravel()), apex.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["ints"], listed], ["row", "ints", "apex"])

    return run


def _summed(state) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per centroid, the number and the sum of the vectors nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simplex, centroids, tops = state.value
        count = np.zeros(len(centroids), dtype=np.int64)
        total = np.zeros_like(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            points, apex = _matrix(batch["ints"], np.int64), _matrix(batch["apex"], float)
            c, _ = nearest(points, apex, centroids, tops, simplex.slack(apex, tops))
            count += np.bincount(c, minlength=len(centroids))
            order = np.argsort(c, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(c[order]) > 0])
            total[c[order][starts]] += np.add.reduceat(points[order], starts, axis=0)
        at = np.flatnonzero(count)
        if len(at):
            sums = pa.FixedSizeListArray.from_arrays(pa.array(total[at].ravel()), centroids.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), sums], ["cluster", "count", "sums"])

    return run


def _assigned(state) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simplex, centroids, tops = state.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points, apex = _matrix(batch["ints"], np.int64), _matrix(batch["apex"], float)
            c, d = nearest(points, apex, centroids, tops, simplex.slack(apex, tops))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(c.astype(np.int32)), pa.array(d)], ["row", "cluster", "distance"])

    return run


def cluster(rows: DataFrame, carry: list[str], vector: str = "embedding", id_: str = "vec_id", centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """The carried columns of every usable vector as ``row`` with cluster, distance, cluster_inertia,
    inertia and the components of its final centroid as ``centroid``."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    good = (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LARGEST))
    kept = rows.where(F.coalesce(good, F.lit(False))).select(
        F.struct(*carry).alias("row"),
        F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col(id_).cast("string"), F.lit(""))), 256).alias("draw"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("ints"),
    )
    start = np.array([r.ints for r in kept.orderBy("draw", "ints").limit(centroids).select("ints").collect()], dtype=np.int64).reshape(-1, size)
    if not len(start):
        none = kept.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"))
        return none.select("*", F.lit(0).cast("long").alias("inertia"), F.col("row").isNull().alias("_"), F.array().cast("array<long>").alias("centroid")).drop("_").limit(0)
    simplex = Simplex(start)
    row = kept.schema["row"].dataType.simpleString()
    cached = save(kept.select("row", "ints").mapInArrow(_cached(sc.broadcast(simplex)), f"row {row}, ints array<long>, apex array<double>"), "apexes")

    def state(points: np.ndarray):
        return sc.broadcast((simplex, points, simplex.apexes(points)))

    points = start
    for _ in range(rounds):
        sums = cached.select("ints", "apex").mapInArrow(_summed(state(points)), "cluster int, count long, sums array<long>")
        wide = sums.groupBy("cluster").agg(F.sum("count").alias("count"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size)])
        points = points.copy()
        for r in wide.collect():  # at most a row per centroid
            points[r.cluster] = np.array(r[2:], dtype=np.int64) // r["count"]
    final = save(cached.mapInArrow(_assigned(state(points)), f"row {row}, cluster int, distance long"), "assigned")
    drop(cached)
    inertia = {r.cluster: r.d for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row per centroid
    table = [(c, d, sum(inertia.values()), points[c].tolist()) for c, d in inertia.items()]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return final.join(F.broadcast(named), "cluster").select("row", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: str = "centroid"):
    """sha256 of a centroid's components."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ","), 256)


def sql(rounds: int = ROUNDS) -> str:
    """The same by comparing all centroids, in DuckDB's SQL over the view ``embeddings``."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(CAST(x AS DOUBLE)) >= {LARGEST})) = 0
), flat AS MATERIALIZED (
  SELECT rid, unnest(ints) AS x, generate_subscripts(ints, 1) AS pos FROM kept
), c0 AS MATERIALIZED (
  SELECT cluster, unnest(ints) AS x, generate_subscripts(ints, 1) AS pos
  FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), ints) - 1 AS INT) AS cluster, ints FROM kept)
  WHERE cluster < {CENTROIDS}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT rid, cluster, distance FROM (
    SELECT rid, cluster, distance, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS place
    FROM (SELECT f.rid, c.cluster, CAST(sum((f.x - c.x) * (f.x - c.x)) AS BIGINT) AS distance FROM flat f JOIN c{k} c ON f.pos = c.pos GROUP BY f.rid, c.cluster)
  ) WHERE place = 1
)""")
        if k < rounds:
            steps.append(f"""m{k} AS MATERIALIZED (
  SELECT a.cluster, f.pos, CAST(sum(f.x) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN flat f ON a.rid = f.rid GROUP BY a.cluster, f.pos
), c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce((m.s - (((m.s % m.n) + m.n) % m.n)) // m.n, c.x) AS x, c.pos
  FROM c{k} c LEFT JOIN m{k} m ON c.cluster = m.cluster AND c.pos = m.pos
)""")
    return (
        "WITH "
        + ",\n".join(steps)
        + f""", named AS (
  SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster
)
SELECT k.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, n.centroid_sha256
FROM a{rounds} a JOIN kept k ON a.rid = k.rid JOIN named n ON a.cluster = n.cluster"""
    )
