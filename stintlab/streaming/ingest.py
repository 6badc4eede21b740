"""Incremental session ingestion with Structured Streaming.

Sessions arrive as parquet files of whole sessions (the unit the source loads one at
a time). A file-source stream picks them up; ``foreachBatch`` runs the batch feature
pipeline on each micro-batch and writes it to a folder keyed by the batch id with
``overwrite``: a replayed batch (after a failure) replaces its own output instead of
duplicating it. Progress lives in the query checkpoint, which must be in a shared folder
on a cluster.

All features but ``lap_count_norm`` are computed within a session; that one divides by the
longest session, so a stream needs the fitted maximum (``fitted_max_laps``) and then equals
the batch in every column. A session must arrive in one file: a batch in which a session comes
from several files fails, and so does one with a session that an earlier batch had (their keys are kept in a
small table beside the sink), instead of giving wrong stints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import features as FE
from ..plans import pipeline as P
from ..sources.io import exists
from ..sources.laps import SESSION_KEYS


def assert_whole_sessions(batch: DataFrame) -> None:
    """Fail when a session of the batch comes from more than one file."""
    parts = batch.select(*SESSION_KEYS, F.input_file_name().alias("_f")).groupBy(*SESSION_KEYS) \
        .agg(F.min("_f").alias("_a"), F.max("_f").alias("_b")).filter("_a <> _b")
    cut = parts.select(F.concat_ws("/", *SESSION_KEYS).alias("s")).limit(1).collect()
    if cut:
        raise ValueError(f"session {cut[0]['s']} is spread over several files")


def _sessions_folder(sink: str) -> str:
    return f"{sink.rstrip('/')}-sessions"


def assert_new_sessions(batch: DataFrame, sink: str, batch_id: int) -> None:
    """Fail when a session of the batch was in another batch; then note the batch's sessions (a replay replaces its own)."""
    spark, folder = batch.sparkSession, _sessions_folder(sink)
    here = batch.select(*SESSION_KEYS).distinct()
    if exists(spark, folder):
        earlier = spark.read.parquet(folder).filter(F.col("batch") != batch_id)
        again = here.join(earlier, SESSION_KEYS, "left_semi").select(F.concat_ws("/", *SESSION_KEYS).alias("s")).limit(1).collect()
        if again:
            raise ValueError(f"session {again[0]['s']} came in an earlier batch already")
    here.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def session_feature_writer(sink: str, cfg: C.Config, fitted_max_laps: float, partition_by=("season",)):
    def write(batch: DataFrame, batch_id: int) -> None:
        assert_whole_sessions(batch)
        assert_new_sessions(batch, sink, batch_id)
        feats = FE.add_lap_norm(P.base_features(batch, cfg, lap_norm=False), fitted_max_laps=fitted_max_laps, source=batch)
        feats.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{sink.rstrip('/')}/batch={batch_id}")
    return write


def start_session_ingest(spark: SparkSession, source_dir: str, schema, sink: str, checkpoint: str,
                         fitted_max_laps: float, cfg: C.Config | None = None, files_per_trigger: int = 64, available_now: bool = True):
    """Start the stream: new session files in ``source_dir`` -> features in ``sink``."""
    cfg = cfg or C.default_config()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    writer = stream.writeStream.foreachBatch(session_feature_writer(sink, cfg, fitted_max_laps)) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_ingested(spark: SparkSession, sink: str) -> DataFrame:
    """All batches written so far, as one table."""
    return spark.read.option("basePath", sink).parquet(f"{sink.rstrip('/')}/batch=*")
