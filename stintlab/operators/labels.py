"""Pit labels, cleaning masks and constructor filters (WN11-WN13, PR13, PR16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from ..sources.laps import STINT_KEYS
from .features import to_driver_partitioning


def _driver_keys(df: DataFrame) -> list:
    keys = [k for k in ("season", "event_name", "session_type", "Driver") if k in df.columns]
    return keys or ["Driver"]


def pit_lap_flag(df: DataFrame):
    """WN11: explicit PitInTime laps if the driver has any, else laps whose next lap
    (by LapNumber) has a different, non-null Stint."""
    keys = _driver_keys(df)
    w_all = Window.partitionBy(*keys)
    explicit = F.col("PitInTime").isNotNull() if "PitInTime" in df.columns else F.lit(False)
    has_explicit = F.max(explicit.cast("int")).over(w_all) > 0
    if "Stint" in df.columns:
        nxt = F.lead("Stint", 1).over(Window.partitionBy(*keys).orderBy("LapNumber"))
        transition = nxt.isNotNull() & ~nxt.eqNullSafe(F.col("Stint"))
    else:
        transition = F.lit(False)
    return F.when(has_explicit, explicit).otherwise(transition)


def encode_pit_labels(df: DataFrame) -> DataFrame:
    """WN12: 2 on a pit lap; 1 if a pit lap is 1-3 lap *numbers* ahead; else 0.
    ``loss_weight`` is 0 under caution (sc_or_vsc_flag = 1), else 1."""
    keys = _driver_keys(df)
    out = df.withColumn("_pit", pit_lap_flag(df).cast("int"))
    ahead = Window.partitionBy(*keys).orderBy(F.col("LapNumber").cast("long")).rangeBetween(1, 3)
    out = out.withColumn("pit_label", F.when(F.col("_pit") == 1, 2)
                         .when(F.coalesce(F.max("_pit").over(ahead), F.lit(0)) == 1, 1)
                         .otherwise(0).cast("int"))
    weight = F.when(F.col("sc_or_vsc_flag") == 1, 0.0).otherwise(1.0) if "sc_or_vsc_flag" in df.columns \
        else F.lit(1.0)
    return out.withColumn("loss_weight", weight).drop("_pit")


def apply_cleaning_masks(df: DataFrame, cfg: C.Config) -> DataFrame:
    """PR16 + WN13, in order: flag pit-out laps; (1) LapNumber > 1; (2) drop wet
    compounds (NULL compound kept); (3) LapTime_s <= threshold * stint median over the
    survivors, or a pit-out lap; (5) LapTime_s not NULL and > 0."""
    pit_out = F.col("PitOutTime").isNotNull() if "PitOutTime" in df.columns else F.lit(False)
    out = df.withColumn("is_pit_out_lap", pit_out.cast("int"))
    out = out.filter(F.col("LapNumber") > 1)
    out = out.filter(~S.is_wet_compound(F.col("Compound"), cfg))
    keys = STINT_KEYS if all(c in out.columns for c in STINT_KEYS) else ["driver_stint_id"]
    out = out.withColumn("_stint_median", F.percentile(F.col("LapTime_s"), 0.5).over(Window.partitionBy(*keys)))
    keep = F.coalesce(F.col("LapTime_s") <= F.col("_stint_median") * F.lit(cfg.outlier_threshold), F.lit(False)) | \
        (F.col("is_pit_out_lap") == 1)
    out = out.filter(keep).drop("_stint_median")
    return out.filter(F.col("LapTime_s").isNotNull() & (F.col("LapTime_s") > 0))


def filter_top_constructors(df: DataFrame, cfg: C.Config, apply_filter: bool | None = None) -> DataFrame:
    """PR13: adds ``is_top4``; filters to the selected constructors when enabled."""
    out = df.withColumn("is_top4", S.team_matches_any(F.col("Team"), cfg.selected_constructors))
    enabled = cfg.top4_filter if apply_filter is None else apply_filter
    return out.filter(F.col("is_top4")) if enabled else out


def clean_then_label(df: DataFrame, cfg: C.Config, tasks: int | None = None) -> DataFrame:
    """CP3: cleaning masks, then labels (the evaluation path). One exchange, of ``tasks`` parts if given, serves the windows of both."""
    return encode_pit_labels(apply_cleaning_masks(to_driver_partitioning(df, tasks), cfg))


def label_then_clean(df: DataFrame, cfg: C.Config) -> DataFrame:
    """CP4: labels, cleaning, constructor filter (the training path)."""
    return filter_top_constructors(apply_cleaning_masks(encode_pit_labels(to_driver_partitioning(df)), cfg), cfg)
