"""k-means in whole numbers with Elkan's bounds.

Each vector keeps an upper bound of its distance to its own centroid and a lower bound
of its distance to every centroid. When centroids move, bounds move by the triangle
inequality; together with the distances between centroids they show most distances to
be larger than the own one, so those aren't computed. Bounds are rounded away from the
truth and prune only where they are strictly apart, so ties are always computed; what is
compared are squared distances, which are whole numbers.

Vectors stay in the partition that they were read in: a round is one pass that assigns,
and one that adds up the components of each cluster. Its rows are written to the shared
folder, so a lost executor's tasks are run again from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, saved, shared_path, table, with_id

WIDTH, CLUSTERS, ROUNDS, SCALE, SALT = 64, 16, 3, 64, "1"
#: Whole numbers beyond this are held to it, so that a squared distance over 64 components fits a long.
MOST = 1 << 27
_LOOSE = 1 + 2.0**-50  # above the error of a few roundings of doubles


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``id, v``: rows with exactly ``width`` finite components, each turned into floor(scale * x)."""
    x = F.col("x")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("x"))
    rows = rows.where((F.size(x) == width) & ~F.exists(x, bad))
    held = lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * scale))).cast("int")
    return rows.select("id", F.transform(x, held).alias("v"))


def seeds(rows: DataFrame, k: int, salt: str = SALT) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests; rows without an id come last, ties by components."""
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers, row by row (or to the one row ``y``)."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * _LOOSE


def below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) / _LOOSE


def _stored(x: np.ndarray, up: bool) -> np.ndarray:
    """Rounded to 32 bits, in the direction that keeps the bound."""
    y = x.astype(np.float32)
    wrong = y < x if up else y > x
    return np.where(wrong, np.nextafter(y, np.float32(np.inf if up else -np.inf)), y)


class State:
    """Vectors with their clusters and bounds, and how many distances were computed."""

    def __init__(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.x, self.own, self.upper, self.lower, self.computed = x, own, upper, lower, 0


def first_state(x: np.ndarray, centroids: np.ndarray) -> State:
    """Every distance computed; the nearest centroid, of equal ones the smallest number."""
    d = np.stack([squared(x, c) for c in centroids], 1) if len(x) else np.zeros((0, len(centroids)), np.int64)
    own = d.argmin(axis=1)
    state = State(x, own, above(d[np.arange(len(x)), own]), below(d))
    state.computed = d.size
    return state


def next_state(state: State, before: np.ndarray, now: np.ndarray) -> State:
    """The assignment after centroids have moved from ``before`` to ``now``."""
    moved = squared(before, now)
    own, rows = state.own.copy(), np.arange(len(state.x))
    upper = (state.upper.astype(np.float64) + above(moved)[own]) * _LOOSE
    lower = np.maximum(0.0, state.lower.astype(np.float64) - above(moved)[None]) / _LOOSE
    half = np.stack([below(squared(now, c)) for c in now]) / 2
    nearest = np.where(np.eye(len(now), dtype=bool), np.inf, half).min(axis=1)
    exact = np.full(len(rows), -1, np.int64)  # squared distance to the own centroid, where it has been computed
    out = State(state.x, own, upper, lower)
    for j in range(len(now)):
        open_ = (own != j) & (upper >= lower[:, j]) & (upper >= half[own, j]) & (upper >= nearest[own])
        loose = rows[open_ & (exact < 0)]
        if len(loose):  # the own distance first: it may settle the matter
            exact[loose] = squared(state.x[loose], now[own[loose]])
            upper[loose], lower[loose, own[loose]] = above(exact[loose]), below(exact[loose])
            out.computed += len(loose)
            open_ &= (upper >= lower[:, j]) & (upper >= half[own, j]) & (upper >= nearest[own])
        at = rows[open_]
        if not len(at):
            continue
        d = squared(state.x[at], now[j])
        out.computed += len(at)
        lower[at, j] = below(d)
        closer = (d < exact[at]) | ((d == exact[at]) & (j < own[at]))
        at, d = at[closer], d[closer]
        own[at], exact[at], upper[at] = j, d, above(d)
    return out


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


_STATE = "v array<int>, own int, upper float, lower array<float>, computed long"


def _assign_rows(before: np.ndarray | None, now: np.ndarray):
    k, width = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), np.int64, width)
            if before is None:
                s = first_state(x, now)
            else:
                s = next_state(State(x, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).to_numpy(zero_copy_only=False), _matrix(b.column(4), np.float32, k)), before, now)
            computed = np.zeros(len(x), np.int64)
            computed[:1] = s.computed  # on a batch's first row
            columns = [b.column(0), b.column(1), pa.array(s.own.astype(np.int32)), pa.array(_stored(s.upper, True)), _lists(_stored(s.lower, False), pa.float32()), pa.array(computed)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "own", "upper", "lower", "computed"])

    return run


def _sum_rows(k: int, width: int):
    """A task's sums: a row for each cluster that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            own, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), np.int64, width)
            for j in np.unique(own):
                sums[j] += x[own == j].sum(axis=0)
            n += np.bincount(own, minlength=k)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), _lists(sums[at], pa.int64())], ["own", "n", "sums"])

    return run


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each cluster's componentwise floor(sum / count); clusters without a vector stay where they are.

    The driver gets ``clusters * width`` sums, however many tasks there are.
    """
    k, width = centroids.shape
    parts = state.select("own", "v").mapInArrow(_sum_rows(k, width), "own int, n long, sums array<long>")
    at = parts.select("own", "n", F.posexplode("sums").alias("k", "x")).groupBy("own", "k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in at.collect():
        out[r["own"], r["k"]] = int(r["x"]) // r["n"]
    return out


def _distance_rows(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = _matrix(b.column(1), np.int64, centroids.shape[1]), b.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(squared(x, centroids[own]))], ["id", "cluster", "distance"])

    return run


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def rounds(rows: DataFrame, centroids: np.ndarray, n: int) -> Iterator[tuple[DataFrame, np.ndarray]]:
    """The state after the first assignment and after each of ``n`` rounds, with the centroids it belongs to.

    A state's table is deleted when the one after it has been written.
    """
    spark, before, path = rows.sparkSession, None, None
    for k in range(n + 1):
        kind = with_id(rows, "id", _STATE)
        df = rows.mapInArrow(_assign_rows(before, centroids), kind)
        written = shared_path(spark, "clusters")
        df.write.parquet(written)
        rows = spark.read.schema(kind).parquet(written)
        if path:
            remove(spark, path)
        path = written
        yield rows, centroids
        if k < n:
            before, centroids = centroids, means(rows, centroids)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", width: int = WIDTH, k: int = CLUSTERS, n_rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that is kept.

    Vectors that are null, have another number of components, or a component that is null
    or not finite are left out. Components are floor(scale * x), held to 2^27 either way.
    Centroids start as the ``k`` rows whose ids have the smallest digests (of equal ids
    the smallest vector; rows without an id last); fewer rows make fewer clusters. Ties
    go to the smaller number. Each of ``n_rounds`` assigns every vector and moves the
    centroids to floored means, then vectors are assigned once more; an empty cluster
    stays. Ids may be null or repeat, each row counts. A sum of distances that doesn't
    fit a long is null. Other columns aren't read; no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector, width, scale)
    start = seeds(rows, k, salt)
    names = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    if not len(start):
        return rows.limit(0).select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in names.items()])
    for state, centroids in rounds(rows, start, n_rounds):
        pass
    found = saved(state.select("id", "v", "own").mapInArrow(_distance_rows(centroids), with_id(rows, "id", "cluster int, distance long")), "distances")
    remove(spark, state.inputFiles()[0].rpartition("/")[0])
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each cluster
    fits = lambda x: x if x < 1 << 63 else None
    of = F.array(*[F.struct(F.lit(fits(sums.get(j, 0))).cast("long").alias("s"), F.lit(digest(c)).alias("sha")) for j, c in enumerate(centroids)])
    own = F.get(of, F.col("cluster"))
    return found.select(F.col("id").alias(id_col), "cluster", "distance", own["s"].alias("cluster_inertia"), F.lit(fits(sum(sums.values()))).cast("long").alias("inertia"), own["sha"].alias("centroid_sha256"))


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every distance computed, round by round."""
    out = [
        """WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INT AS cluster, v FROM kept QUALIFY cluster < 16
)"""
    ]
    for k in range(ROUNDS + 1):
        out.append(
            f""", a{k} AS MATERIALIZED (
  SELECT row, min(struct_pack(d := list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(x.v, c.v)])::BIGINT, c := c.cluster)) AS best FROM kept x, c{k} c GROUP BY row
)"""
        )
        if k < ROUNDS:
            out.append(
                f""", s{k} AS (
  SELECT cluster, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best.c AS cluster, unnest(v) AS x, unnest(range(1, 65)) AS p FROM a{k} JOIN kept USING (row)) GROUP BY 1, 2
), m{k} AS (
  SELECT cluster, list((s - (((s % n) + n) % n)) // n ORDER BY p) AS v FROM s{k} GROUP BY 1
), c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (cluster)
)"""
            )
    out.append(
        f"""
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (row) JOIN c{ROUNDS} c ON c.cluster = best.c"""
    )
    return "".join(out)


SQL = _sql()
