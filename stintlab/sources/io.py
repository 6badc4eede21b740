"""Table sources and sinks (SRC1-SRC6, SRC9-SRC13).

Stage tables live in a shared folder (derived from the cluster's
``spark.checkpoint.dir`` by default) so they survive executor loss.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC2: parquet by default; CSV (header, explicit schema if given) by suffix."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)


def write_any(df: DataFrame, path: str, partition_by: list | None = None) -> None:
    """SRC3: overwrite as parquet (partitioned, e.g. by season) or CSV by suffix."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    """A folder counts as a table once its write has committed."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def load_splits(spark: SparkSession, folder: str, names=("train", "val", "test"), suffix: str = "_raw", schema=None):
    """SRC1: all-or-nothing load of the split tables (with the declared schema if given);
    None when any is missing or unfinished."""
    paths = [f"{folder.rstrip('/')}/{n}{suffix}.parquet" for n in names]
    if not all(_finished(spark, p) for p in paths):
        return None
    return tuple(read_any(spark, p, schema) for p in paths)


def stage(spark: SparkSession, path: str, compute, partition_by: list | None = None) -> DataFrame:
    """SRC5: reuse the stage table at ``path`` if its write has finished, else compute, write
    and read it back (the read-back plan starts from the written files: lineage is cut).
    What an unfinished write left behind is overwritten."""
    if not _finished(spark, path):
        write_any(compute(), path, partition_by)
    return read_any(spark, path)


def fresh_stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a stage table next to the cluster's checkpoint folder."""
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{os.path.dirname(base)}/stintlab-stages/{name}-{uuid.uuid4().hex[:12]}"


def select_circuits(df: DataFrame, selected: list | None) -> DataFrame:
    """SRC6: keep circuits whose canonical name is selected (empty selection = all).
    On a season/circuit-partitioned table this prunes partitions."""
    if not selected:
        return df
    return df.filter(S.canonical_event_name(F.col("event_name")).isin(*selected))


def accurate_laps(df: DataFrame) -> DataFrame:
    """SRC7."""
    return df.filter(F.col("IsAccurate"))


def tag_session(df: DataFrame, season: int, event_name: str, session_type: str) -> DataFrame:
    """SRC8."""
    return df.withColumns({"season": F.lit(int(season)), "event_name": F.lit(event_name),
                           "session_type": F.lit(session_type)})


def union_sessions(frames: list) -> DataFrame:
    """SRC9 / ST1: UNION ALL by name, absent columns as NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def season_event_codes(df: DataFrame) -> DataFrame:
    """SRC12: per season, sorted distinct event names -> 0..n-1 as ``circuit_id``.
    The ranking runs over the distinct (season, event) table only."""
    events = df.select("season", "event_name").filter(F.col("event_name").isNotNull()).distinct()
    codes = events.withColumn("circuit_id", (F.dense_rank().over(
        Window.partitionBy("season").orderBy("event_name")) - 1).cast("int"))
    return df.join(F.broadcast(codes), ["season", "event_name"], "left")  # one row per race of the calendar


def load_complete(laps: DataFrame, expected_sessions: DataFrame, what: str = "split") -> DataFrame:
    """SRC11 in the load path: ``laps``, after every expected session has been found."""
    assert_loaded(load_status(laps, expected_sessions), what)
    return laps


def load_status(laps: DataFrame, expected_sessions: DataFrame) -> DataFrame:
    """SRC11: per season, loaded and failed session counts (expected sessions without
    laps, by left-anti join) and the completeness flag."""
    keys = ["season", "event_name", "session_type"]
    actual = laps.select(*keys).distinct()
    failed = expected_sessions.select(*keys).distinct().join(actual, keys, "left_anti") \
        .groupBy("season").agg(F.count(F.lit(1)).alias("failed_sessions"))
    loaded = actual.groupBy("season").agg(F.count(F.lit(1)).alias("loaded_sessions"))
    seasons = expected_sessions.select("season").union(actual.select("season")).distinct()
    out = seasons.join(loaded, "season", "left").join(failed, "season", "left").fillna(0, ["loaded_sessions",
                                                                                          "failed_sessions"])
    return out.withColumn("complete", (F.col("failed_sessions") == 0) & (F.col("loaded_sessions") > 0))


def assert_loaded(status: DataFrame, what: str = "split") -> None:
    """SRC11: raise if any season is empty or partially loaded."""
    bad = status.filter(~F.col("complete")).orderBy("season").collect()  # one row per season
    if bad:
        raise RuntimeError(f"{what} incomplete: " + ", ".join(
            f"{r['season']}: loaded={r['loaded_sessions']} failed={r['failed_sessions']}" for r in bad))


def write_results_json(df: DataFrame, path: str) -> None:
    """SRC13: rows (nested columns allowed) as JSON lines, one file per partition of ``df``."""
    df.write.mode("overwrite").json(path)
