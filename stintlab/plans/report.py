"""Plot tables (CP7, ST2): the numbers behind every chart, as
DataFrames; rendering is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def pit_annotations(race_laps: DataFrame, pred: str = "pred_label") -> DataFrame:
    """ST2: UNION DISTINCT of actual pit laps and model pit calls per driver."""
    actual = race_laps.filter(F.col("pit_label") == 2).select("event_name", "Driver", "LapNumber",
                                                              F.lit("Actual pit").alias("annotation_text"))
    model = race_laps.filter(F.col(pred) == 2).select("event_name", "Driver", "LapNumber",
                                                      F.lit("Model pit").alias("annotation_text"))
    return actual.unionByName(model).dropDuplicates()


def degradation_points(actual: DataFrame, pred: DataFrame, cfg: C.Config) -> DataFrame:
    """CP7: the points of the degradation charts, long form: ``event_name, panel, series, LapNumber, value``.

    Panels are the dry compounds and ``combined``. Series: every actual lap (``actual``), pit laps
    (``pit``, without value), the mean forecast quantiles and their cubic trend, and the first lap over
    the cliff threshold (``cliff``). A panel shows the forecast of its circuit.
    """
    from ..operators import forecast as FC
    panels = F.explode(F.array(F.col("Compound"), F.lit("combined"))).alias("panel")
    laps = actual.select("event_name", panels, "LapNumber", "lap_time_delta_s", "pit_label") \
        .filter(F.col("panel").isin("SOFT", "MEDIUM", "HARD", "combined"))
    empty = F.lit(None).cast("double")
    points = laps.select("event_name", "panel", F.lit("actual").alias("series"), "LapNumber", F.col("lap_time_delta_s").alias("value"))
    pits = laps.filter(F.col("pit_label") == 2).select("event_name", "panel", F.lit("pit").alias("series"), "LapNumber", empty.alias("value")).distinct()
    curve = FC.mean_curve(pred)
    trend = FC.trend_points(curve, FC.cubic_trend(curve)).withColumnRenamed("trend", "value")
    lines = curve.select("event_name", "LapNumber", F.explode(F.array(*[
        F.struct(F.lit(q).alias("series"), F.col(q).alias("value")) for q in ("p10", "p50", "p90")])).alias("x")).select("event_name", "x.series", "LapNumber", "x.value")
    cliff = FC.first_cliff_lap(curve, cfg).filter("cliff_lap is not null").select(
        "event_name", F.lit("cliff").alias("series"), F.col("cliff_lap").alias("LapNumber"), empty.alias("value"))
    model = lines.unionByName(trend.select("event_name", F.lit("trend").alias("series"), "LapNumber", "value")).unionByName(cliff)
    shown = laps.select("event_name", "panel").distinct()  # circuits x panels
    return points.unionByName(pits).unionByName(model.join(F.broadcast(shown), "event_name").select("event_name", "panel", "series", "LapNumber", "value"))


def attribution_ranking(phi: DataFrame, class_code: int = 2) -> DataFrame:
    """CP7: per circuit, features ranked by mean absolute attribution to one compound class (SOFT by
    default). ``phi`` is the long attribution table."""
    means = phi.filter(F.col("class") == class_code).groupBy("event_name", "feature") \
        .agg(F.avg(F.abs("phi")).alias("mean_abs_phi"), F.avg("phi").alias("mean_phi"))
    order = Window.partitionBy("event_name").orderBy(F.col("mean_abs_phi").desc(), "feature")  # one row per feature
    return means.withColumn("place", F.row_number().over(order))
