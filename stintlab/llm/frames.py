"""Frame helpers shared by the operators: input selection, shared staging, batch sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: rows per Arrow batch handed to Python; keeps a worker's memory near rows x text size
ARROW_ROWS = 512


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new_name=source_column`` pairs; extra (even clashing) columns are dropped.

    Columns are resolved by exact name in backquotes, so names with dots or spaces work.
    """
    return df.select(*[F.col("`" + src.replace("`", "``") + "`").alias(new) for new, src in columns.items()])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "stintlab.zip")  # on the driver; Spark hands it out
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def prepare(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Make the session ready for Python tasks over texts.

    Ships the package and lowers the session's Arrow batch length to ``rows`` if it is larger,
    because a batch of 10,000 long texts would not fit a worker.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage with files every executor can read again after a loss. The folder is
    ``spark.checkpoint.dir`` (a scratch folder only where that is unset, as in tests).
    """
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str = "stage", **options: str) -> tuple[DataFrame, str]:
    """As ``stage``, with options for the Parquet writer; the frame and its folder, for ``drop_stage``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stage(spark: SparkSession, path: str) -> None:
    """Remove a staged table that a later one has replaced, so that rounds do not pile up on disk."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
