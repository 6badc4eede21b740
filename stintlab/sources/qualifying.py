"""Qualifying source (CP6: AG11, JN05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def fastest_q2_compound(quali: DataFrame) -> DataFrame:
    """AG11: per (season, event, Driver) the compound of the fastest Q2 lap among laps
    with a known compound (NULL times sort last; ties -> lowest lap number)."""
    part = "SessionPart" if "SessionPart" in quali.columns else "SessionName"
    q2 = quali.filter(F.col(part) == "Q2").withColumn("LapTime_s", S.to_seconds_col(quali, "LapTime"))
    order = F.struct(F.col("LapTime_s").isNull(), F.col("LapTime_s"), F.col("LapNumber"))
    return q2.filter(F.col("Compound").isNotNull()).groupBy("season", "event_name", "Driver") \
        .agg(F.min_by("Compound", order).alias("q2_compound"))


def load_qualifying_sessions(quali: DataFrame, seasons=None) -> DataFrame:
    """CP6: keep Q2/Q3 laps (by SessionPart, else SessionName) and annotate each with
    the driver's fastest-Q2-lap compound (``q2_compound``; all NULL without parts)."""
    if seasons is not None:
        quali = quali.filter(F.col("season").isin(*seasons))
    part = "SessionPart" if "SessionPart" in quali.columns else (
        "SessionName" if "SessionName" in quali.columns else None)
    if part is None:
        return quali.withColumn("q2_compound", F.lit(None).cast("string"))
    kept = quali.filter(F.col(part).isin("Q2", "Q3"))
    return kept.join(fastest_q2_compound(quali), on=["season", "event_name", "Driver"], how="left")
