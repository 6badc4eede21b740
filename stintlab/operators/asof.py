"""As-of *nearest* join (JN01) as an equi-join — no session-wide window over the big side.

Each right row (e.g. a weather reading) owns the half-open interval of left times for
which it is the nearest reading: ``(t_prev + t)/2 < x <= (t + t_next)/2`` (ties go to the
earlier reading, i.e. backward). Comparisons use ``2x`` against the sums, which is exact
in floating point. Intervals are exploded into fixed-width time buckets over the
readings' own range; left times are bucketed and clamped into that range, then join on
(group keys, bucket) plus the exact interval test. Only the right side is windowed, over
spans of buckets within a group; the big left side is never sorted per group. Both
sides hash-partition on (group, bucket), spreading a hot group over many tasks, unless
AQE finds one small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: time buckets in one window of the right side
SPAN = 64


def _neighbours(right: DataFrame, by: list, on: str, width: float) -> DataFrame:
    """The times ``_prev`` and ``_next`` of each reading's neighbours in its group.

    Windows span ``SPAN`` buckets of a group; the first and last reading of such a span
    take their neighbour from a table of span edges, so no window holds a whole group of
    readings (the edge table has one row per span).
    """
    t = F.col(on).cast("double")
    spans = right.withColumn("_t", t).withColumn("_span", F.floor(t / F.lit(float(width) * SPAN)))
    inner = Window.partitionBy(*by, "_span").orderBy("_t")
    order = Window.partitionBy(*by).orderBy("_span")
    edges = spans.groupBy(*by, "_span").agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"))
    edges = edges.select(*by, "_span", F.lag("_z").over(order).alias("_before"), F.lead("_a").over(order).alias("_after"))
    known = spans.withColumns({"_prev": F.lag("_t").over(inner), "_next": F.lead("_t").over(inner)})
    return known.join(edges, [*by, "_span"]).withColumns({
        "_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")}).drop("_before", "_after", "_span")


def asof_nearest(left: DataFrame, right: DataFrame, by: list, on: str, value_cols: list,
                 bucket_width: float = 60.0) -> DataFrame:
    """Left join ``right[value_cols]`` of the row nearest in ``on`` within ``by`` groups.

    Left rows with a NULL ``on`` (or a group without right rows) get NULLs.
    """
    t = F.col(on).cast("double")
    b = F.lit(float(bucket_width))
    right = right.filter(F.col(on).isNotNull())
    intervals = _neighbours(right, by, on, bucket_width).select(
        *by, *value_cols, "_t", (F.col("_prev") + F.col("_t")).alias("_lo2"), (F.col("_t") + F.col("_next")).alias("_hi2"))
    # Each group's reading range, in buckets (one row per group; right side only).
    bounds = right.groupBy(*by).agg(F.floor(F.min(t) / b).alias("_bmin"), F.floor(F.max(t) / b).alias("_bmax"))
    # First/last readings own everything before/after them; their buckets stop at the
    # range ends and left rows outside the range are clamped onto those end buckets.
    b0 = F.when(F.col("_lo2").isNull(), F.floor(F.col("_t") / b)).otherwise(F.floor(F.col("_lo2") / 2.0 / b))
    b1 = F.when(F.col("_hi2").isNull(), F.floor(F.col("_t") / b)).otherwise(F.floor(F.col("_hi2") / 2.0 / b))
    buckets = intervals.withColumn("_bucket", F.explode(F.sequence(b0, F.greatest(b0, b1)))).drop("_t")
    # No hints: AQE broadcasts either side where it turns out small, else both shuffle on
    # (group, bucket), which spreads a hot group over its buckets.
    r = buckets.alias("_r")
    lft = left.join(F.broadcast(bounds), on=by, how="left") \
        .withColumn("_bucket", F.least(F.greatest(F.floor(F.col(on).cast("double") / b), F.col("_bmin")),
                                       F.col("_bmax"))) \
        .drop("_bmin", "_bmax").alias("_l")
    x2 = F.col(f"_l.{on}").cast("double") * 2.0
    cond = [F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in by]
    cond.append(F.col("_l._bucket") == F.col("_r._bucket"))
    cond.append(F.col("_r._lo2").isNull() | (x2 > F.col("_r._lo2")))
    cond.append(F.col("_r._hi2").isNull() | (x2 <= F.col("_r._hi2")))
    joined = lft.join(r, on=cond, how="left")
    return joined.select("_l.*", *[F.col(f"_r.{c}") for c in value_cols]).drop("_bucket")
