"""Scalable running totals over an ordered key (used by threshold search, AP/AUC and
rank statistics).

A single ``Window.orderBy`` without partitioning sends every row to one task. Here the
order key is cut into value buckets (boundaries from ``percentile_approx`` — one small
row to the driver); running sums are computed inside (group, bucket) partitions and
shifted by the totals of all earlier buckets (a table of #groups x #buckets rows).
Equal keys always share a bucket, so ties are handled exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: distinct keys that one bucket of running totals is meant to hold
KEYS_PER_BUCKET = 50_000


def bucket_boundaries(df: DataFrame, key: str, n_buckets: int | None = None) -> list:
    """Ordered bucket bounds for ``key``. Unless given, the number of buckets follows the
    number of distinct keys, so the tasks of a running total grow with the data."""
    k = F.col(key).cast("double")
    if n_buckets is None:
        n_buckets = 1 + (df.agg(F.approx_count_distinct(k).alias("n")).first()["n"] or 0) // KEYS_PER_BUCKET
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(F.percentile_approx(k, probs, max(10_000, 10 * n_buckets)).alias("b")).first()
    vals = row["b"] if row is not None and row["b"] is not None else []
    return sorted(set(float(v) for v in vals if v is not None))


def bucket_boundaries_by(df: DataFrame, key: str, by: str) -> dict:
    """``bucket_boundaries`` for every value of ``by`` (few of them, such as feature names), in two passes."""
    k = F.col(key).cast("double")
    sizes = {r[by]: 1 + r["n"] // KEYS_PER_BUCKET for r in df.groupBy(by).agg(F.approx_count_distinct(k).alias("n")).collect()}
    wanted = max(sizes.values(), default=1)
    if wanted <= 1:
        return {g: [] for g in sizes}
    probs = [i / wanted for i in range(1, wanted)]
    rows = df.groupBy(by).agg(F.percentile_approx(k, probs, max(10_000, 10 * wanted)).alias("b")).collect()
    return {r[by]: sorted({float(v) for v in r["b"] or ()}) if sizes[r[by]] > 1 else [] for r in rows}


def bucket_number(key: Column, bounds: list) -> Column:
    """Number of bounds below the key. Two levels: every ``step``-th bound first, then the
    bounds within that step, so the work per row grows with the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every, coarse = (F.array(*[F.lit(b) for b in part]) for part in (bounds, bounds[::step]))
    below = F.size(F.filter(coarse, lambda b: b < key))
    inner = F.size(F.filter(F.slice(every, F.greatest((below - 1) * step + 1, F.lit(1)), step), lambda b: b < key))
    return F.when(below == 0, 0).otherwise((below - 1) * step + inner)


def running_totals(df: DataFrame, key: str, value_cols: list, by: list | None = None, descending: bool = True,
                   n_buckets: int | None = None, inclusive: bool = True, prefix: str = "cum_",
                   bounds: list | dict | None = None) -> DataFrame:
    """Add ``cum_<v>`` = sum of ``v`` over rows of the same ``by`` group whose key comes
    before (and, if ``inclusive``, equal to) this row's key in the given direction.
    Rows should have distinct keys per group (aggregate first) when ``inclusive``
    ties must be included; with equal keys, RANGE frames include all peers."""
    by = list(by or [])
    if bounds is None:
        bounds = bucket_boundaries(df, key, n_buckets)
    if isinstance(bounds, dict):  # bounds for each value of the first ``by`` column
        below = F.lit(0)
        for group, own in bounds.items():
            below = F.when(F.col(by[0]) == group, bucket_number(F.col(key).cast("double"), own)).otherwise(below)
        most = max(map(len, bounds.values()), default=0)
    else:
        below, most = bucket_number(F.col(key).cast("double"), bounds), len(bounds)
    bucket = F.lit(most) - below if descending else below
    out = df.withColumn("_bkt", bucket.cast("int"))
    order = F.col(key).desc() if descending else F.col(key).asc()
    frame_end = Window.currentRow if inclusive else -1
    w_in = Window.partitionBy(*(by + ["_bkt"])).orderBy(order)
    w_in = w_in.rangeBetween(Window.unboundedPreceding, Window.currentRow) if inclusive else \
        w_in.rowsBetween(Window.unboundedPreceding, frame_end)
    for v in value_cols:
        out = out.withColumn(f"_in_{v}", F.coalesce(F.sum(v).over(w_in), F.lit(0)))
    totals = out.groupBy(*(by + ["_bkt"])).agg(*[F.sum(v).alias(f"_bt_{v}") for v in value_cols])
    w_b = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bkt", *[F.coalesce(F.sum(f"_bt_{v}").over(w_b), F.lit(0)).alias(f"_off_{v}")
                                           for v in value_cols])
    out = out.join(offsets, on=by + ["_bkt"], how="left")
    for v in value_cols:
        out = out.withColumn(f"{prefix}{v}", F.col(f"_in_{v}") + F.col(f"_off_{v}")).drop(f"_in_{v}", f"_off_{v}")
    return out.drop("_bkt")


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Append the columns of a single-row aggregate (global totals) to every row of
    ``df``: a broadcast equi-join on a constant key — the one-row side is bounded."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(scalars.withColumn("_one", F.lit(1))), "_one") \
        .drop("_one")


def exact_quantiles(df: DataFrame, value: str, probs: list, by: list | None = None, weight: str | None = None,
                    n_buckets: int | None = None, prefix: str = "q", bounds: list | None = None) -> DataFrame:
    """Exact (linearly interpolated) quantiles per group without holding a group in one
    task. Values are reduced to a (group, value) -> count histogram, cumulative counts
    come from ``running_totals`` (spread over value buckets), and the value at rank
    ``k`` is the smallest value whose cumulative count exceeds ``k`` — a partial
    aggregate. Interpolation matches Spark's ``percentile``: with position
    ``p * (n - 1)``, ``(hi - pos) * v_lo + (pos - lo) * v_hi``.

    Returns one row per group: ``by..., n, q0, q1, ...`` (NULL for empty groups).
    """
    by = list(by or [])
    src = df.filter(F.col(value).isNotNull())
    w = F.col(weight) if weight else F.lit(1)
    hist = src.groupBy(*by, value).agg(F.sum(w).cast("long").alias("_cnt"))
    if bounds is None:
        # bucket boundaries from one scan of the raw values (no shuffle); shared bounds
        # can be passed in when several quantile tables read the same column
        bounds = bucket_boundaries(src, value, n_buckets)
    return histogram_quantiles(hist, value, probs, by, bounds, prefix)


def histogram_quantiles(hist: DataFrame, value: str, probs: list, by: list, bounds: list | dict, prefix: str = "q") -> DataFrame:
    """``exact_quantiles`` of a histogram: one row per (by.., value) with its count ``_cnt``."""
    cum = running_totals(hist, value, ["_cnt"], by=by, descending=False, prefix="_cum", bounds=bounds)
    sizes = hist.groupBy(*by).agg(F.sum("_cnt").alias("_n"))
    cum = cum.join(sizes, on=by, how="inner") if by else attach_scalars(cum, sizes)
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs.append(F.min(F.when(F.col("_cum_cnt") > lo, F.col(value))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("_cum_cnt") > hi, F.col(value))).alias(f"_hi{i}"))
    per = cum.groupBy(*by).agg(F.first("_n").alias("n"), *aggs)
    return per.select(*by, "n", *[_between(p, F.col(f"_lo{i}"), F.col(f"_hi{i}")).alias(f"{prefix}{i}") for i, p in enumerate(probs)])


def _between(p: float, v_lo: Column, v_hi: Column) -> Column:
    """The quantile at position ``p * (n - 1)`` from the values at the ranks below and above."""
    pos = F.lit(float(p)) * (F.col("n") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    v_lo, v_hi = v_lo.cast("double"), v_hi.cast("double")
    return F.when((lo == hi) | (v_lo == v_hi), v_lo).otherwise((hi - pos) * v_lo + (pos - lo) * v_hi)


#: ranks that share a key when values are looked up by rank
RANKS_PER_KEY = 4096


def leave_one_out_quantiles(hist: DataFrame, groups: DataFrame, value: str, probs: list, by: str, bounds: list | None = None) -> DataFrame:
    """Exact quantiles of the values of all *other* groups, for every row of ``groups`` (column ``by``).

    ``hist`` has one row per (by, value) with its count ``_cnt``. With F the running count of all groups and F_g that of
    group g, others have F - F_g values up to a value. At g's own values both are known, and between two of
    them F_g stays what it was; so the k-th value of the others is the (k + a)-th of all, where a is the
    largest F_g at an own value with F - F_g <= k. Rows of ``hist`` are never copied per group: one running count of all,
    one per group, and one lookup of a few ranks each.
    """
    if bounds is None:
        bounds = bucket_boundaries(hist, value)
    all_ = running_totals(hist, value, ["_cnt"], descending=False, prefix="_all", bounds=bounds)
    both = running_totals(all_, value, ["_cnt"], by=[by], descending=False, prefix="_own", bounds=bounds)
    own_n = hist.groupBy(by).agg(F.sum("_cnt").alias("_own_n"))
    total = hist.agg(F.coalesce(F.sum("_cnt"), F.lit(0)).alias("_total"))
    wanted = attach_scalars(groups.select(by).distinct().join(own_n, by, "left"), total)
    wanted = wanted.select(by, (F.col("_total") - F.coalesce("_own_n", F.lit(0))).alias("n"))
    ranks = [(i, side, f(F.lit(float(p)) * (F.col("n") - 1)).cast("long")) for i, p in enumerate(probs) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    asked = wanted.select(by, "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), k.alias("k"))
                                                       for i, side, k in ranks])).alias("_r")).select(by, "n", "_r.*").where("n > 0")
    # a: own values that lie before the k-th of the others (groups and ranks are few: one row each)
    before = both.join(F.broadcast(asked), by).where((F.col("_all_cnt") - F.col("_own_cnt")) <= F.col("k")) \
        .groupBy(by, "i", "side").agg(F.max("_own_cnt").alias("_a"))
    asked = asked.join(before, [by, "i", "side"], "left").select(
        F.col(by).alias("_group"), "i", "side", (F.col("k") + F.coalesce("_a", F.lit(0))).alias("_rank"))
    asked = asked.withColumn("_key", F.floor(F.col("_rank") / RANKS_PER_KEY))
    # each value holds the ranks from _from to its running count; it stands under every key these touch
    at = all_.groupBy(value).agg(F.max("_all_cnt").alias("_upto"), F.sum("_cnt").alias("_here"))
    at = at.withColumn("_from", F.col("_upto") - F.col("_here"))
    at = at.withColumn("_key", F.explode(F.sequence(F.floor(F.col("_from") / RANKS_PER_KEY), F.floor((F.col("_upto") - 1) / RANKS_PER_KEY))))
    found = at.join(F.broadcast(asked), "_key").where((F.col("_from") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    values = found.groupBy("_group").agg(*[F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col(value))).alias(f"_{side}{i}")
                                           for i in range(len(probs)) for side in ("lo", "hi")])
    out = wanted.join(values.withColumnRenamed("_group", by), by, "left")
    return out.select(by, "n", *[_between(p, F.col(f"_lo{i}"), F.col(f"_hi{i}")).alias(f"q{i}") for i, p in enumerate(probs)])


def with_ordinals(df: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """SO4: ``df`` with the place (from 1) of every row in the order of some columns, rows with equal keys in any order.

    Rows are dealt to tasks by ranges of the keys, whose bounds are drawn once; places within a range are then shifted by the rows
    of earlier ranges, so no task sorts more than its range. Rows with equal keys share a range.
    """
    key = F.struct(*order)
    # drawn anew a plan's ranges could differ from those of its sizes: their least keys are fixed values, one row per task of the range exchange
    drawn = df.select(*order).repartitionByRange(*order).groupBy(F.spark_partition_id().alias("_range")).agg(F.min(key).alias("_least"))
    types = df.select(key.alias("_least")).schema["_least"].dataType
    least = [r["_least"] for r in drawn.orderBy("_least").collect()]
    bounds = [F.struct(*[F.lit(b[f.name]).cast(f.dataType).alias(f.name) for f in types]) for b in least[1:]]
    ranged = df.withColumn("_range", bucket_number(key, bounds))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", earlier.alias("_off"))  # one row per range
    return ranged.withColumn("_place", place).join(F.broadcast(offsets), "_range") \
        .withColumn(name, F.col("_place") + F.col("_off")).drop("_range", "_place", "_off")
