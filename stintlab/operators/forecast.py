"""Degradation forecast table and its evaluation (ML13, ML14, AG13, AG14, WN17, WN18).

The forecaster is re-aimed as train-only empirical quantiles of the lap-time delta by
(circuit, compound, tyre age), backing off to (compound, tyre age) and then (tyre
age) where a key has no training laps. Every level is a partial aggregate (one row per
key); predictions are equi-joins. The output keeps the prediction-table interface
``(driver_stint_id, event_name, LapNumber, p10, p50, p90)`` any forecaster can fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import stage_once
from .ranking import bucket_boundaries_by, histogram_quantiles, with_ordinals

LEVELS = [["event_name", "Compound", "tire_age_laps"], ["Compound", "tire_age_laps"], ["tire_age_laps"]]


def quantile_levels(train: DataFrame, cfg: C.Config, target: str = "lap_time_delta_s") -> DataFrame:
    """Exact quantiles of every back-off level in one table: ``level``, the keys (NULL where a level has none), ``_q0``...

    GROUPING SETS roll the laps up to the histograms of all levels in one scan and one exchange; the quantiles
    of all levels come from one running total whose groups carry the level.
    """
    keys = LEVELS[0]
    laps = train.filter(F.col(target).isNotNull()).select(*keys, F.col(target).cast("double").alias(target))
    hist = laps.groupingSets([[*map(F.col, level), F.col(target)] for level in LEVELS], *map(F.col, keys), F.col(target)) \
        .agg(F.grouping_id(*keys, target).alias("_gid"), F.count(F.lit(1)).alias("_cnt"))
    # the grouping id has a bit for every key that a level leaves out
    level_of = F.lit(None).cast("int")
    for level, names in enumerate(LEVELS):
        gid = sum(2 ** (len(keys) - i) for i, k in enumerate(keys) if k not in names)
        level_of = F.when(F.col("_gid") == gid, F.lit(level)).otherwise(level_of)
    hist = hist.withColumn("level", level_of).drop("_gid")
    for i, k in enumerate(keys):  # a missing key matches no lap; the keys a level leaves out get one filler
        used = [level for level, names in enumerate(LEVELS) if k in names]
        hist = hist.where(F.col(k).isNotNull() | ~F.col("level").isin(*used))
    filler = {k: F.coalesce(F.col(k), F.lit("" if dict(laps.dtypes)[k] == "string" else 0).cast(dict(laps.dtypes)[k])) for k in keys}
    hist = stage_once(hist.withColumns(filler), "quantile-levels")
    qs = [float(q) for q in cfg.quantiles]
    out = histogram_quantiles(hist, target, qs, ["level", *keys], bucket_boundaries_by(hist, target, "level"), prefix="_q")
    return out.select("level", *keys, *[f"_q{i}" for i in range(len(qs))])


def predict_quantiles(train: DataFrame, test: DataFrame, cfg: C.Config, target: str = "lap_time_delta_s") -> DataFrame:
    """ML13 + JN08 + AG13: prediction table for every test lap with a prediction."""
    out = test.select("driver_stint_id", "event_name", "LapNumber", "Compound", "tire_age_laps")
    names = ["p10", "p50", "p90"]
    levels = quantile_levels(train, cfg, target)
    for level, keys in enumerate(LEVELS):
        table = levels.where(F.col("level") == level).select(*keys, *[F.col(f"_q{i}").alias(f"_l{level}_{i}") for i in range(len(names))])
        out = out.join(F.broadcast(table), on=keys, how="left")  # circuits x compounds x tyre ages at most
    preds = out.select(
        "driver_stint_id", "event_name", "LapNumber",
        *[F.coalesce(*[F.col(f"_l{lv}_{i}") for lv in range(len(LEVELS))]).alias(n) for i, n in enumerate(names)])
    preds = preds.filter(F.col("p50").isNotNull())
    # AG13: overlapping predictions for the same (stint, event, lap) are averaged.
    return preds.groupBy("driver_stint_id", "event_name", "LapNumber").agg(*[F.avg(n).alias(n) for n in names])


def with_actuals(pred: DataFrame, actual: DataFrame, target: str = "lap_time_delta_s") -> DataFrame:
    """JN09: actual laps left-joined with their predictions on (stint, lap)."""
    act = actual.select("driver_stint_id", "LapNumber", "Compound", "sc_or_vsc_flag", F.col(target).alias("y"))
    return act.join(pred, on=["driver_stint_id", "LapNumber"], how="left")


def cliff_lead_time(joined: DataFrame, cfg: C.Config) -> DataFrame:
    """WN17: per stint with an actual cliff (y > threshold): first cliff lap minus first
    lap whose p90 exceeds the threshold (clipped at 0; no warning -> 0); mean and
    population std over those stints (0, 0 when none)."""
    thr = float(cfg.cliff_threshold_s)
    per = joined.groupBy("driver_stint_id").agg(
        F.min(F.when(F.col("y") > thr, F.col("LapNumber"))).alias("_cliff"),
        F.min(F.when(F.col("p90") > thr, F.col("LapNumber"))).alias("_warn"))
    lead = per.filter(F.col("_cliff").isNotNull()).select(
        F.greatest(F.col("_cliff") - F.coalesce(F.col("_warn"), F.col("_cliff")), F.lit(0)).cast("double").alias("lead"))
    return lead.agg(F.coalesce(F.avg("lead"), F.lit(0.0)).alias("cliff_lead_time_mean"),
                    F.coalesce(F.stddev_pop("lead"), F.lit(0.0)).alias("cliff_lead_time_std"))


def mean_curve(pred: DataFrame) -> DataFrame:
    """AG14: mean quantile curve per (circuit, lap)."""
    return pred.groupBy("event_name", "LapNumber").agg(F.avg("p10").alias("p10"), F.avg("p50").alias("p50"),
                                                        F.avg("p90").alias("p90"))


def first_cliff_lap(curve: DataFrame, cfg: C.Config) -> DataFrame:
    """WN18: first lap of the mean curve whose p90 exceeds the cliff threshold."""
    return curve.groupBy("event_name").agg(
        F.min(F.when(F.col("p90") > float(cfg.cliff_threshold_s), F.col("LapNumber"))).alias("cliff_lap"))


def cubic_trend(curve: DataFrame, x: str = "LapNumber", y: str = "p50", by: str = "event_name") -> DataFrame:
    """ML14: cubic least-squares trend of the mean p50 curve per circuit (>= 4 distinct laps).

    One aggregate of power sums per circuit gives the normal equations. Laps are centred
    and scaled per circuit first, which keeps the 4x4 system well conditioned; it is
    solved by elimination over columns and the coefficients are moved back.
    """
    rows = curve.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    size = rows.groupBy(by).agg(F.avg("_x").alias("_m"), F.greatest(F.stddev_pop("_x"), F.lit(1e-9)).alias("_s"), F.count_distinct("_x").alias("_n"))
    z = rows.join(F.broadcast(size), by).filter("_n >= 4").withColumn("_z", (F.col("_x") - F.col("_m")) / F.col("_s"))
    sums = z.groupBy(by, "_m", "_s").agg(*[F.sum(F.pow("_z", F.lit(k))).alias(f"_p{k}") for k in range(7)],
                                         *[F.sum(F.pow("_z", F.lit(k)) * F.col("_y")).alias(f"_b{k}") for k in range(4)])
    out = sums.withColumns({f"_a{i}{j}": F.col(f"_p{i + j}") for i in range(4) for j in range(4)})
    for k in range(4):  # Gauss-Jordan; the matrix is positive definite, so pivots are not zero
        out = out.withColumns({**{f"_a{k}{j}": F.col(f"_a{k}{j}") / F.col(f"_a{k}{k}") for j in range(4)},
                               f"_b{k}": F.col(f"_b{k}") / F.col(f"_a{k}{k}")})
        for i in [i for i in range(4) if i != k]:
            out = out.withColumns({**{f"_a{i}{j}": F.col(f"_a{i}{j}") - F.col(f"_a{i}{k}") * F.col(f"_a{k}{j}") for j in range(4)},
                                   f"_b{i}": F.col(f"_b{i}") - F.col(f"_a{i}{k}") * F.col(f"_b{k}")})
    d0, d1, d2, d3 = (F.col(f"_b{k}") / F.pow("_s", F.lit(k)) for k in range(4))
    m = F.col("_m")
    return out.select(by, d3.alias("c3"), (d2 - 3 * d3 * m).alias("c2"), (d1 - 2 * d2 * m + 3 * d3 * m * m).alias("c1"),
                      (d0 - d1 * m + d2 * m * m - d3 * m * m * m).alias("c0"))


def trend_points(curve: DataFrame, trend: DataFrame, x: str = "LapNumber", by: str = "event_name") -> DataFrame:
    """ML14 applied: the trend's value at every lap of the curve."""
    v = F.col(x).cast("double")
    value = ((F.col("c3") * v + F.col("c2")) * v + F.col("c1")) * v + F.col("c0")
    return curve.join(F.broadcast(trend), by).select(by, x, value.alias("trend"))


def ordered_predictions(pred: DataFrame) -> DataFrame:
    """SO4: the prediction table with each row's place (``ordinal``) in (stint, lap) order."""
    return with_ordinals(pred, ["driver_stint_id", "LapNumber", "event_name"])
