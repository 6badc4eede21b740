"""Spark session helpers: session defaults, shared checkpoint folder, stage tables."""

from __future__ import annotations

import functools
import hashlib
import pathlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Session settings the engine relies on. AQE re-plans joins at runtime (turning a
# sort-merge join into a broadcast join only when the materialised side is small),
# coalesces small shuffle partitions and splits skewed join partitions.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once the checkpointed frames are garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "stintlab",
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults. For tests and local runs."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is. Only
    where it is unset on a local master (tests) do we create a scratch folder; elsewhere
    a machine-local folder would be lost to the other machines, so that is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="stintlab-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def stage_folder(spark: SparkSession) -> str:
    """Folder of stage tables: below the configured shared folder, so that later applications find them."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/stintlab-stages"


def source_digest(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the files below some paths by name, length and time of change, as one aggregate over their listing.

    No file is opened and no list of files comes to the driver program; a rewritten, added or removed file changes it.
    """
    parts = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        mark = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
        row = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"),
                        F.coalesce(F.bit_xor(mark), F.lit(0)).alias("mark")).first()
        parts.append(f"{path}:{row['n']}:{row['size']}:{row['mark']}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:20]


@functools.cache
def code_digest() -> str:
    """Digest of this package's modules: stage tables of other code are not reused."""
    told = hashlib.sha256()
    for path in sorted(pathlib.Path(__file__).parent.rglob("*.py")):
        if "llm" not in path.parts:
            told.update(path.name.encode() + path.read_bytes())
    return told.hexdigest()[:12]


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column], partition_by: tuple = ()) -> dict:
    """Write ``df`` as Parquet and return aggregates over its rows that Spark collects while it writes them."""
    seen = Observation()
    watched = df.observe(seen, *[c.alias(n) for n, c in metrics.items()]) if metrics else df
    (watched.write.partitionBy(*partition_by) if partition_by else watched.write).parquet(path)
    return seen.get if metrics else {}


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _finished_table(spark: SparkSession, stem: str) -> str | None:
    """A committed table whose name starts with ``stem``; of several (made at the same time) the first by name."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{stem}-*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return min((str(f.getPath().getParent()) for f in found or ()), default=None)


def staged_table(spark: SparkSession, name: str, sources: list[str], build, partition_by: tuple = ("season",),
                 metrics: dict[str, Column] | None = None, accept=None) -> DataFrame:
    """A stage table as Parquet in the shared folder, partitioned for pruning.

    Its name carries a digest of the source files and of the code, so a finished table (``_SUCCESS``) is
    read by every later query and application, and a rewritten source gives a new one. ``metrics`` are aggregates
    observed while the table is written; ``accept(values)`` may refuse it by raising, and then it is removed.
    """
    stem = f"{stage_folder(spark)}/{name}-{code_digest()}-{source_digest(spark, sources)}"
    path = _finished_table(spark, stem)
    if path is None:
        path = f"{stem}-{uuid.uuid4().hex[:12]}"
        values = write_observed(build(), path, metrics or {}, partition_by)
        if accept is not None:
            try:
                accept(values)
            except Exception:
                remove(spark, path)
                raise
    return spark.read.parquet(path)


def stage_once(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to a folder of its own and read it back: one run of its plan for many readers."""
    path = f"{stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
