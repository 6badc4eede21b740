"""Centroid clustering on integer vectors with an incrementally kept table of exact dot products.

*State.* Every vector carries its integer components, its squared length and its dot product with every centroid.
The state is a Parquet table in the shared folder, one generation a round. A round moves centroids by integer steps,
and the new dot product is the old one plus ``x[j] * step[j]`` over those components ``j`` that moved; components and
centroids that stayed cost nothing. Distances follow exactly as ``|x|^2 - 2 x.c + |c|^2``, and the argmin is taken
again for every vector (ties: the smaller number). Nothing is rounded, so no drift builds up over the rounds.

*Update.* Tasks add up counts and component sums per cluster before the shuffle; a centroid becomes the exact
``floor(sum / count)`` of its vectors, an empty one stays. Only the ``k`` centroids (``k`` times the dimension
numbers, both parameters) pass through the driver; no vector is shuffled at any time, so a vector that occurs very
often costs nothing more.

*Recovery.* A generation is read from files, never from a lineage of rounds; the one before is removed once its
successor is written.

Defined results: rows whose vector is null, has another number of components, or a null or non-finite one are left
out; repeated rows and ids are clustered as often as they come; a null id is clustered but never seeds a
centroid; equal seed hashes are ordered by the vector; with fewer vectors than ``k`` there are as many centroids as
rows with an id, and without any, an empty result. A component beyond 2**27 after scaling raises an error, as its
distances need not fit a long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import drop_stage, pick, prepare, stage, stage_at

#: scaled components beyond this raise an error: 64 squared differences then still fit a long
LARGEST = 1 << 27
#: vectors per Arrow batch (a batch's state is this many rows of dimension + k numbers)
BATCH_ROWS = 8192


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """``id`` and ``x`` (array of long) of the rows that hold ``dim`` finite components."""
    raw = pick(df, id=id_col, v=vector_col)
    raw = raw.where(F.size("v") == dim).select("id", F.transform("v", lambda c: c.cast("double")).alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    scaled = F.transform("v", lambda c: c * float(scale))
    fits = F.forall(scaled, lambda c: F.abs(c) <= float(LARGEST))
    x = F.when(fits, F.transform(scaled, lambda c: F.floor(c).cast("long"))).otherwise(
        F.raise_error(F.lit(f"a vector component exceeds {LARGEST} after scaling")))
    return raw.where(finite).select("id", x.alias("x"))


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in that order."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where("id is not null").select(told.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    bounds = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(rows.reshape(-1)))


def moved(x: np.ndarray, dots: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The dot products after the centroids moved by ``steps``: only components that moved are touched."""
    dots = dots.copy()
    for c, step in enumerate(steps):
        at = np.flatnonzero(step)
        if len(at):
            dots[:, c] += x[:, at] @ step[at]
    return dots


def _advanced(steps: np.ndarray, centroids: np.ndarray, first: bool):
    lengths = (centroids * centroids).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            old = np.zeros((len(x), len(steps)), np.int64) if first else _matrix(batch.column("dots"))
            dots = moved(x, old, steps)
            away = (x * x).sum(axis=1)[:, None] - 2 * dots + lengths
            nearest = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("x"), _lists(dots), pa.array(nearest.astype(np.int32)),
                 pa.array(away[np.arange(len(x)), nearest])], ["id", "x", "dots", "cluster", "distance"])

    return run


def _partial_sums(k: int, dim: int):
    """Per task: count and component sums of every cluster with vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster, x = batch.column("cluster").to_numpy(), _matrix(batch.column("x"))
                counts += np.bincount(cluster, minlength=k)
                order = np.argsort(cluster, kind="stable")
                some, starts = np.unique(cluster[order], return_index=True)
                sums[some] += np.add.reduceat(x[order], starts, axis=0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), _lists(sums[some])],
                                         ["cluster", "n", "sums"])

    return run


def _updated(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    k, dim = centroids.shape
    parts = state.select("cluster", "x").mapInArrow(_partial_sums(k, dim), "cluster int, n long, sums array<long>")
    # sums of many tasks may leave 64 bits: they are added as decimals
    totals = (parts.select("cluster", "n", F.posexplode("sums"))
              .groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect())
    out = centroids.copy()
    for r in totals:  # k * dim rows
        out[r["cluster"], r["pos"]] = int(r["s"]) // r["n"]
    return out


def cluster(df: DataFrame, k: int, rounds: int, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64,
            scale: int = 256, seed: int = 2) -> DataFrame:
    """Per kept row: the id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` (array of long)."""
    spark = df.sparkSession
    prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(BATCH_ROWS, int(spark.conf.get(key)))))
    state = integer_vectors(df, id_col, vector_col, dim, scale)
    kind = state.schema["id"].dataType.simpleString()
    schema = f"id {kind}, x array<long>, dots array<long>, cluster int, distance long"
    centroids = seeds(state, k, seed)
    if not len(centroids):
        return (state.where("false").select(
            F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.col("x").alias("centroid")))
    steps, before = centroids, None
    for _ in range(rounds):
        state, folder = stage_at(state.mapInArrow(_advanced(steps, centroids, before is None), schema), "dots")
        after = _updated(state, centroids)
        if before:
            drop_stage(spark, before)
        steps, centroids, before = after - centroids, after, folder
    last = state.mapInArrow(_advanced(steps, centroids, before is None), schema).select("id", "cluster", "distance")
    last = stage(last, "clusters")
    if before:
        drop_stage(spark, before)
    inertia = {r["cluster"]: int(r["s"]) for r in  # at most k rows
               last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = spark.createDataFrame([(c, s, sum(inertia.values()), centroids[c].tolist()) for c, s in inertia.items()],
                                 "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return (last.join(F.broadcast(told), "cluster")  # k rows
            .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid"))


def digests(out: DataFrame) -> DataFrame:
    """The centroid's components, joined by commas, as lowercase hex SHA-256 instead."""
    return out.withColumn("centroid", F.sha2(F.concat_ws(",", F.transform("centroid", lambda c: c.cast("string"))), 256)) \
        .withColumnRenamed("centroid", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """DuckDB SQL of the same clustering with full distances in every round."""
    sql = [f"""rows AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e::DOUBLE))) = 0),
    parts AS MATERIALIZED (
      SELECT r, j, floor({scale} * embedding[j]::DOUBLE)::BIGINT AS x FROM rows, range(1, {dim + 1}) t(j)),
    seeds AS MATERIALIZED (
      SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) - 1 AS c FROM rows WHERE vec_id IS NOT NULL
      QUALIFY c < {k}),
    c0 AS MATERIALIZED (SELECT c, j, x FROM seeds JOIN parts USING (r))"""]
    for n in range(rounds + 1):
        sql.append(f"""a{n} AS MATERIALIZED (
      SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT r, c, sum((p.x - q.x) * (p.x - q.x))::BIGINT AS d FROM parts p JOIN c{n} q USING (j) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            sql.append(f"""c{n + 1} AS MATERIALIZED (
      SELECT c, j, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN (
        SELECT c, j, (CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((-sum(x) + count(*) - 1) // count(*)) END)::BIGINT AS x
        FROM a{n} JOIN parts USING (r) GROUP BY c, j) m USING (c, j))""")
    return f"""WITH {", ".join(sql)}, told AS (
      SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)
    SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
      (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
    FROM a{rounds} JOIN rows USING (r) JOIN told USING (c)"""
