"""Lap-model sources.

The engine's data model is a lap table (one row per session x driver x lap), a weather
table (irregular time series per session) and a qualifying table. On the driver test
data these are *derived* from the ``events`` table with a deterministic recipe, so every
query's work grows with the input. The same recipe is written in DuckDB SQL in
``stintlab.plans.oracle`` for the correctness oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import literal_map

SESSION_KEYS = ["season", "event_name", "session_type"]
DRIVER_KEYS = SESSION_KEYS + ["Driver"]
# Stint windows: same keys as the stint id (season_event_Driver_Stint). Hash
# partitioning on ``STINT_SHUFFLE_KEYS`` satisfies every stint and driver window, so
# the whole per-driver feature chain runs after a single exchange.
STINT_KEYS = ["season", "event_name", "Driver", "Stint"]
STINT_SHUFFLE_KEYS = ["season", "event_name", "Driver"]

LAP_SCHEMA = T.StructType([
    T.StructField("season", T.IntegerType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("session_type", T.StringType()),
    T.StructField("Driver", T.StringType()),
    T.StructField("Team", T.StringType()),
    T.StructField("LapNumber", T.IntegerType()),
    T.StructField("Stint", T.DoubleType()),
    T.StructField("PitInTime", T.TimestampNTZType()),
    T.StructField("PitOutTime", T.TimestampNTZType()),
    T.StructField("LapTime", T.DoubleType()),
    T.StructField("Time", T.DoubleType()),
    T.StructField("Position", T.DoubleType()),
    T.StructField("TyreLife", T.DoubleType()),
    T.StructField("Compound", T.StringType()),
    T.StructField("TrackStatus", T.StringType()),
    T.StructField("IsAccurate", T.BooleanType()),
])

# Fixed values of the derivation recipe (shared with the DuckDB oracle).
CIRCUITS = ["Bahrain", "Monaco", "Spain", "Britain", "Singapore", "Qatar"]
TEAMS = ["Red Bull Racing", "Mercedes", "Ferrari", "McLaren", "Aston Martin",
         "Alpine", "Williams", "AlphaTauri", "Alfa Romeo", "Haas F1 Team"]
COMPOUND_CYCLE = ["SOFT", "MEDIUM", "HARD", "SOFT", "MEDIUM", "INTERMEDIATE", None]
EPOCH = "2024-01-01 00:00:00"
SEASON_SPAN_S = 432000  # five days of events per season
FIRST_SEASON = 2018
N_SEASONS = 6
WEATHER_STEP_S = 60.0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _event_base(events: DataFrame) -> DataFrame:
    secs = F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'{EPOCH}', ts)")
    return events.select(
        (F.lit(FIRST_SEASON) + F.least(F.lit(N_SEASONS - 1), F.floor(secs / SEASON_SPAN_S))).cast("int").alias("season"),
        literal_map(dict(enumerate(CIRCUITS)))[(F.col("user_id") % len(CIRCUITS)).cast("int")].alias("event_name"),
        F.col("user_id"),
        F.col("ts"),
        F.col("event_id"),
        F.col("event_type"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def laps_from_events(events: DataFrame) -> DataFrame:
    """Derive the lap table: one lap per event of a user within a (season, circuit)."""
    base = _event_base(events).withColumns({
        "session_type": F.lit("R"),
        "Driver": F.col("user_id").cast("string"),
        "Team": literal_map(dict(enumerate(TEAMS)))[(F.col("user_id") % len(TEAMS)).cast("int")],
    })
    w_drv = Window.partitionBy(*STINT_SHUFFLE_KEYS).orderBy("ts", "event_id")
    is_pit = (F.col("event_type") == "purchase")
    lap_time = (F.when(F.col("k") == 0, F.lit(None).cast("double"))
                .when(F.col("k") == 99, F.lit(160.0) + F.least(F.col("value"), F.lit(200.0)) / 10.0)
                .otherwise(F.lit(80.0) + F.least(F.col("value"), F.lit(200.0)) / 10.0))
    drv = base.select(
        "season", "event_name", "session_type", "Driver", "Team", "user_id", "k", "ts",
        F.row_number().over(w_drv).cast("int").alias("LapNumber"),
        (F.lit(1.0) + F.coalesce(F.sum(is_pit.cast("int")).over(w_drv.rowsBetween(Window.unboundedPreceding, -1)),
                                 F.lit(0))).cast("double").alias("Stint"),
        F.when(is_pit, F.col("ts")).alias("PitInTime"),
        F.when(F.lag("event_type").over(w_drv) == "purchase", F.col("ts")).alias("PitOutTime"),
        F.round(lap_time, 3).alias("LapTime"),
        F.round(F.sum(F.coalesce(lap_time, F.lit(0.0))).over(w_drv.rowsBetween(Window.unboundedPreceding, 0)), 3)
        .alias("Time"),
        (F.col("event_type") != "error").alias("IsAccurate"),
    )
    w_stint = Window.partitionBy(*STINT_KEYS).orderBy("LapNumber")
    w_lap = Window.partitionBy("season", "event_name", "session_type", "LapNumber").orderBy("Time", "Driver")
    status = (F.when(F.col("k") < 3, "4").when(F.col("k") == 3, "14").when(F.col("k") == 4, "16")
              .when(F.col("k") <= 7, "2").when(F.col("k") == 8, "6").otherwise("1"))
    # stint window first: it reuses the driver partitioning; the lap window then
    # needs the one (session, lap) exchange.
    drv = drv.withColumn("TyreLife", F.row_number().over(w_stint).cast("double"))
    out = drv.select(
        "season", "event_name", "session_type", "Driver", "Team", "LapNumber", "Stint",
        "PitInTime", "PitOutTime", "LapTime", "Time",
        F.row_number().over(w_lap).cast("double").alias("Position"),
        "TyreLife",
        literal_map({i: c for i, c in enumerate(COMPOUND_CYCLE) if c is not None})[
            ((F.col("user_id") + F.col("Stint").cast("long")) % len(COMPOUND_CYCLE)).cast("int")].alias("Compound"),
        status.alias("TrackStatus"),
        "IsAccurate",
    )
    return out


def weather_from_events(events: DataFrame) -> DataFrame:
    """Derive the weather table: one reading per ``view`` event, 60 s apart per session."""
    base = _event_base(events).filter(F.col("event_type") == "view")
    w = Window.partitionBy("season", "event_name").orderBy("ts", "event_id")
    air = (F.lit(18.0) + (F.col("k") % 20)).cast("double")
    return base.select(
        "season", "event_name", F.lit("R").alias("session_type"),
        (F.row_number().over(w) * F.lit(WEATHER_STEP_S)).cast("double").alias("Time"),
        air.alias("AirTemp"),
        F.round(air + F.lit(8.0) + F.col("value") / 25.0, 2).alias("TrackTemp"),
        (F.lit(30.0) + F.col("k") / 2.0).alias("Humidity"),
    )


def qualifying_from_events(events: DataFrame) -> DataFrame:
    """Derive a qualifying lap table from ``click`` events: Q1/Q2/Q3 parts, compounds,
    weather columns, tyre age and freshness."""
    base = _event_base(events).filter(F.col("event_type") == "click")
    w = Window.partitionBy("season", "event_name", "user_id").orderBy("ts", "event_id")
    compounds = {0: "SOFT", 1: "MEDIUM", 2: "HARD", 3: "SUPERSOFT", 4: "SOFT", 5: "MEDIUM"}
    air = (F.lit(18.0) + (F.col("k") % 20)).cast("double")
    return base.select(
        "season", "event_name", F.lit("Q").alias("session_type"),
        F.col("user_id").cast("string").alias("Driver"),
        literal_map(dict(enumerate(TEAMS)))[(F.col("user_id") % len(TEAMS)).cast("int")].alias("Team"),
        F.row_number().over(w).cast("int").alias("LapNumber"),
        F.concat(F.lit("Q"), (F.lit(1) + F.col("k") % 3).cast("string")).alias("SessionPart"),
        F.round(F.lit(70.0) + F.least(F.col("value"), F.lit(200.0)) / 20.0, 3).alias("LapTime"),
        literal_map(compounds)[(F.col("k") % 7).cast("int")].alias("Compound"),
        air.alias("AirTemp"),
        F.round(air + F.lit(8.0) + F.col("value") / 25.0, 2).alias("TrackTemp"),
        (F.lit(30.0) + F.col("k") / 2.0).alias("Humidity"),
        ((F.col("k") % 2) == 0).alias("FreshTyre"),
        (F.lit(1.0) + (F.col("k") % 4)).alias("TyreLife"),
    )


def load_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laps_from_events(read_table(spark, sf_dir, "events"))


WEATHER_COLS = ["AirTemp", "TrackTemp", "Humidity"]


def merge_weather(laps: DataFrame, weather: DataFrame) -> DataFrame:
    """JN01: each lap gets the session's weather reading nearest in ``Time``."""
    from ..operators.asof import asof_nearest
    return asof_nearest(laps, weather, SESSION_KEYS, "Time", WEATHER_COLS)


def load_race_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7/SRC8/JN01: race laps with weather merged (the feature pipeline's input)."""
    events = read_table(spark, sf_dir, "events")
    return merge_weather(laps_from_events(events), weather_from_events(events))


def load_qualifying_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualifying_from_events(read_table(spark, sf_dir, "events"))
