"""Circuit fingerprints (CP5: AG02-AG09), distances (AG10, JN12) and
leave-one-circuit-out validation (AG17-AG18).

Every fingerprint dimension is a partial aggregate per circuit (map-side combined), so
the lap table is never brought to one task; the fingerprint table has one row per
circuit. Nearest fingerprints come from an equi-join on shared dimension values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from ..sources.io import exists
from .encode import assert_seasons_subset
from ..session import stage_once
from .ranking import attach_scalars, leave_one_out_quantiles

COMPOUNDS = ["SOFT", "MEDIUM", "HARD"]


def compute_circuit_fingerprints(train: DataFrame, cfg: C.Config, check_seasons: bool = True) -> DataFrame:
    """CP5: six-dimensional fingerprint per ``circuit_id`` from training laps only."""
    if check_seasons:
        assert_seasons_subset(train, cfg.train_seasons, "circuit fingerprints")
    t = train.filter(F.col("circuit_id").isNotNull())
    # AG04: mean AirTemp per event / max of those means (the max over a small table).
    air = train.groupBy("event_name").agg(F.avg("AirTemp").alias("_air")) \
        .withColumn("_air_max", F.max("_air").over(Window.partitionBy())) \
        .select("event_name", (F.col("_air") / F.col("_air_max")).alias("track_temp_percentile"))
    # AG02/AG03: per (circuit, compound): row count, OLS slope, mean delta.
    per_compound = t.filter(F.col("Compound").isin(*COMPOUNDS)).groupBy("circuit_id", "Compound").agg(
        F.count(F.lit(1)).alias("_n"),
        F.regr_slope("lap_time_delta_s", "tire_age_laps").alias("_slope"),
        F.avg("lap_time_delta_s").alias("_mean"))
    deg = per_compound.groupBy("circuit_id").agg(
        F.avg(F.when(F.col("_n") > 5, F.col("_slope"))).alias("avg_deg_rate"),
        F.stddev_samp("_mean").alias("compound_variance"))
    # AG07: mean over races of the max caution flag.
    races = t.groupBy("circuit_id", "season", "event_name").agg(F.max("sc_or_vsc_flag").alias("_had"))
    sc = races.groupBy("circuit_id").agg(F.avg("_had").alias("sc_vsc_frequency"))
    # AG06 + AG08: median SOFT tyre life; event label = mode (ties -> smallest).
    base = t.groupBy("circuit_id").agg(
        F.mode("event_name", deterministic=True).alias("event_name"),
        F.percentile(F.when(F.col("Compound") == "SOFT", F.col("TyreLife").cast("double")), 0.5)
        .alias("hist_soft_stint_len"))
    fp = base.join(deg, "circuit_id", "left").join(sc, "circuit_id", "left").join(air, "event_name", "left")
    return fp.select(
        F.col("circuit_id").cast("int").alias("circuit_id"), "event_name",
        F.coalesce(F.col("avg_deg_rate"), F.lit(0.0)).alias("avg_deg_rate"),
        F.coalesce(S.nan_to_null(F.col("compound_variance")), F.lit(0.0)).alias("compound_variance"),
        F.coalesce(F.col("track_temp_percentile"), F.lit(0.0)).alias("track_temp_percentile"),
        F.coalesce(S.literal_map(cfg.high_speed_fraction)[F.col("event_name")],
                   F.lit(C.DEFAULT_HIGH_SPEED_FRACTION)).alias("high_speed_fraction"),
        F.coalesce(F.col("hist_soft_stint_len"), F.lit(0.0)).alias("hist_soft_stint_len"),
        F.col("sc_vsc_frequency").cast("double").alias("sc_vsc_frequency"),
    )


def feature_ranges(fp: DataFrame) -> DataFrame:
    """AG09: max - min per fingerprint column, 0 replaced by 1."""
    return fp.agg(*[F.coalesce(F.nullif(F.max(c) - F.min(c), F.lit(0.0)), F.lit(1.0)).alias(c)
                    for c in C.FINGERPRINT_COLS])


def fp_vector(prefix: str = "") -> Column:
    return F.array(*[F.col(f"{prefix}{c}").cast("double") for c in C.FINGERPRINT_COLS])


def fingerprint_distance(a: Column, b: Column, ranges: Column | None = None) -> Column:
    """AG10: normalised Euclidean distance between two fingerprint arrays.

    Default (as specified): each dimension is normalised by the range over the *two*
    vectors, so every differing dimension contributes exactly 1 (Q1). With ``ranges``
    (an array, e.g. from ``feature_ranges``) dimensions are scaled by that instead.
    """
    if ranges is None:
        terms = F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(0.0)).otherwise(F.lit(1.0)))
    else:
        diffs = F.zip_with(a, b, lambda x, y: x - y)
        terms = F.zip_with(diffs, ranges, lambda d, r: F.pow(d / r, 2))
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))


def nearest_fingerprint(fp: DataFrame, cfg: C.Config, include_self: bool = True) -> DataFrame:
    """JN12: per circuit, the distance to the nearest fingerprint (itself included by
    default, as specified — then always 0).

    With the default metric a distance is the root of the number of differing
    dimensions, so the nearest fingerprint is the one that shares most of them: one
    equi-join on (dimension, value) over the circuit table, no pairs without a match.
    """
    n = len(C.FINGERPRINT_COLS)
    dims = fp.select("circuit_id", "event_name", F.posexplode(fp_vector()).alias("dim", "v"))
    other = dims.select(F.col("circuit_id").alias("_o"), F.col("event_name").alias("_e"), "dim", "v")
    different = F.lit(True) if include_self else ~F.col("event_name").eqNullSafe(F.col("_e"))
    best = (dims.join(other, ["dim", "v"]).filter(different).groupBy("circuit_id", "event_name", "_o", "_e")
            .agg(F.count(F.lit(1)).alias("_same")).groupBy("circuit_id", "event_name").agg(F.max("_same").alias("_same")))
    # a circuit that shares nothing with any other has the full distance, if there is another
    events = fp.agg(F.count_distinct(F.coalesce("event_name", F.lit(""))).alias("_n"))
    out = attach_scalars(fp.select("circuit_id", "event_name").join(best, ["circuit_id", "event_name"], "left"), events)
    alone = (F.col("_n") < 2) & F.lit(not include_self)
    return out.select("circuit_id", "event_name",
                      F.when(~alone, F.sqrt(F.lit(float(n)) - F.coalesce("_same", F.lit(0)))).alias("fingerprint_distance"))


def run_loco_cv(full: DataFrame, fp: DataFrame, cfg: C.Config, include_self: bool = True) -> DataFrame:
    """AG17: leave-one-circuit-out on the test season.

    For each test circuit with a fingerprint: baseline = median of train-season deltas
    of all *other* circuits; MAE of the held-out deltas against it; nearest fingerprint
    distance; street/permanent. The medians come from one histogram of (circuit, delta) by
    rank selection on running counts of all circuits minus the circuit's own.
    """
    test = full.filter(F.col("season") == cfg.test_season)
    train = full.filter(F.col("season").isin(*cfg.train_seasons))
    near = nearest_fingerprint(fp, cfg, include_self).select(
        F.col("event_name").alias("circuit"), "fingerprint_distance")
    held = test.select(F.col("event_name").alias("circuit")).distinct().join(near, "circuit", "inner")
    hist = stage_once(train.filter(F.col("lap_time_delta_s").isNotNull()).groupBy(F.col("event_name").alias("circuit"), "lap_time_delta_s")
                      .agg(F.count(F.lit(1)).alias("_cnt")), "delta-histogram")
    baseline = leave_one_out_quantiles(hist, held, "lap_time_delta_s", [0.5], "circuit").select("circuit", F.col("q0").alias("_baseline"))
    held_laps = test.select(F.col("event_name").alias("circuit"), "lap_time_delta_s")
    mae = held_laps.join(F.broadcast(baseline), "circuit", "left").groupBy("circuit").agg(
        F.avg(F.abs(F.col("lap_time_delta_s") - F.col("_baseline"))).alias("mae_p50"))
    return held.join(mae, "circuit", "left").select(
        "circuit", "mae_p50", "fingerprint_distance",
        F.when(F.col("circuit").isin(*cfg.street_circuits), "street").otherwise("permanent").alias("circuit_type"))


def loco_pearson(loco: DataFrame) -> DataFrame:
    """AG18: Pearson r of MAE vs distance; 0.0 with fewer than two rows; NULL when a
    column is constant (ANSI-safe, no division error)."""
    return loco.agg(F.when(F.count(F.lit(1)) < 2, F.lit(0.0))
                    .otherwise(S.pearson(F.col("mae_p50"), F.col("fingerprint_distance"))).alias("pearson_r"))


def save_fingerprints(fp: DataFrame, path: str) -> None:
    """SRC4: a small parquet table."""
    fp.write.mode("overwrite").parquet(path)


def load_fingerprints(spark, path: str) -> DataFrame:
    """SRC4."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)
