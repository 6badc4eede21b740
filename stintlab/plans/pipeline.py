"""Composite operators: the feature pipeline (CP1), train-fit/apply (CP2), splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from ..operators import features as FE
from ..operators.encode import FeatureState
from ..session import remove, stage_folder, write_observed


def season_split(df: DataFrame, cfg: C.Config) -> DataFrame:
    """SRC10: tag every row with its split (train / val / test / NULL)."""
    return df.withColumn(
        "split",
        F.when(F.col("season").isin(*cfg.train_seasons), "train")
        .when(F.col("season") == cfg.val_season, "val")
        .when(F.col("season") == cfg.test_season, "test"))


def split_frames(df: DataFrame, cfg: C.Config):
    """SRC10: (train, val, test) frames; filters on ``season`` prune parquet partitions."""
    return (df.filter(F.col("season").isin(*cfg.train_seasons)),
            df.filter(F.col("season") == cfg.val_season),
            df.filter(F.col("season") == cfg.test_season))


def base_features(df: DataFrame, cfg: C.Config, lap_norm: bool = True, tasks: int | None = None) -> DataFrame:
    """CP1 without the fitted steps: every deterministic row/window feature.

    Exchange plan: recent stops (one hash partitioning on season, event, Driver) -> runs -> steps within a
    lap, on the raw columns -> all stint windows (season, event, Driver again). Tables of a row per lap or session
    are broadcast. ``tasks`` is the number of tasks by driver (``FE.driver_tasks``).
    """
    raw = df if "LapTime_s" in df.columns else df.withColumn("LapTime_s", S.to_seconds_col(df, "LapTime"))
    out = FE.add_lap_level_features(FE.to_driver_partitioning(raw, tasks), cfg, evolution=False)
    out = FE.to_driver_partitioning(FE.add_stint_id(out), tasks)
    out = FE.add_fuel_load(out, cfg)
    out = FE.add_lap_time_delta(out, cfg)
    out = FE.add_degradation_derivatives(out)
    out = FE.add_tire_age_features(out)
    out = FE.add_sc_flags(out, cfg)
    out = FE.add_gap_trend(out)
    out = FE.add_lap_level_features(out, cfg, gap=False, undercut=False, source=raw)
    out = FE.add_track_evolution(out, cfg, source=raw)
    return FE.add_lap_norm(out, source=raw) if lap_norm else out


def run_full_feature_pipeline(df: DataFrame, cfg: C.Config, state: FeatureState | None = None,
                              reference: DataFrame | None = None, check_seasons: bool = True,
                              null_limit: float | None = 0.05):
    """CP1. Returns (features, state). Without ``state`` the encoders and SC
    probabilities are fitted on ``df`` itself (or on ``reference`` for the latter).

    The features are computed once: written as a stage table, from which the fits and the result read. While they
    are written the NULLs of the key columns are counted (AG16); if a column has more than ``null_limit`` of them the
    table is removed and the rows of the result fail at action time (None switches the gate off)."""
    spark = df.sparkSession
    base = base_features(df, cfg)
    path = f"{stage_folder(spark)}/features-{uuid.uuid4().hex[:12]}"
    gated = [c for c in FE.GATED if c in base.columns] if null_limit is not None else []
    over = FE.nulls_over_limit(write_observed(base, path, FE.null_counts(gated) if gated else {}) or {"rows": 0}, null_limit or 0.0)
    if over:
        remove(spark, path)
        refusal = F.raise_error(F.lit(f"too many nulls in {over}"))
        refused = spark.range(1).select(*[refusal.cast(f.dataType).alias(f.name) for f in base.schema])
        return refused, state
    out = spark.read.schema(base.schema).parquet(path)
    if state is None:
        state = FeatureState.fit(out, cfg, reference=reference, check_seasons=check_seasons)
    out = state.encode(out)
    out = FE.add_circuit_softness(out, cfg)
    out = state.add_historical_sc_prob(out)
    return out, state


def split_base_features(laps: DataFrame, cfg: C.Config) -> DataFrame:
    """Every season's base features, tagged by split. ``lap_count_norm`` is normalised
    within each split frame, as when splits are run apart."""
    return FE.add_lap_norm(season_split(base_features(laps, cfg, lap_norm=False), cfg), within=["split"],
                           source=season_split(laps, cfg))


def apply_train_state(feats: DataFrame, cfg: C.Config, reference: DataFrame | None = None) -> DataFrame:
    """CP2: encoders and SC probabilities fitted on the train split (the latter on
    ``reference`` where given) and applied to all splits of ``split_base_features``."""
    state = FeatureState.fit(feats.filter(F.col("split") == "train"), cfg, reference=reference)
    return state.add_historical_sc_prob(FE.add_circuit_softness(state.encode(feats), cfg))
