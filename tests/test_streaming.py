"""Structured Streaming session ingestion: equals the batch features, restarts without
duplicates from its checkpoint."""

import pytest
from pyspark.sql import functions as F

from stintlab.plans import pipeline as P
from stintlab.sources import laps as L
from stintlab.streaming import ingest as ST

SF = "/root/testdata/sf0.001"


KEY = ["season", "event_name", "Driver", "LapNumber"]


def _rows(df):
    """Every feature column of every lap."""
    cols = sorted(c for c in df.columns if c not in ("batch",))
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*KEY, *cols).collect()), key=str)


def test_stream_equals_batch_and_restarts_cleanly(spark, cfg, tmp_path):
    src, sink, ckpt = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ckpt")
    laps = L.load_race_laps(spark, SF)
    laps.repartition(8, *L.SESSION_KEYS).write.partitionBy("season", "event_name").parquet(src)
    table = spark.read.parquet(src)
    longest = float(table.agg(F.max("LapNumber")).first()[0])
    go = lambda: ST.start_session_ingest(spark, src, table.schema, sink, ckpt, longest, cfg, files_per_trigger=4).awaitTermination()
    go()
    first = _rows(ST.read_ingested(spark, sink))
    assert first == _rows(P.base_features(table, cfg))
    # a restart from the same checkpoint finds no new files and writes nothing more
    go()
    assert _rows(ST.read_ingested(spark, sink)) == first


def test_a_session_in_two_files_is_an_error(spark, cfg, tmp_path):
    src = str(tmp_path / "src")
    L.load_race_laps(spark, SF).repartition(3).write.partitionBy("season", "event_name").parquet(src)
    with pytest.raises(Exception, match="several files"):
        ST.start_session_ingest(spark, src, spark.read.parquet(src).schema, str(tmp_path / "sink"), str(tmp_path / "ckpt"), 10.0,
                                cfg).awaitTermination()


def test_a_session_in_two_batches_is_an_error(spark, cfg, tmp_path):
    src, sink, ckpt = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ckpt")
    laps = L.load_race_laps(spark, SF).filter("season = 2018 and event_name = 'Monaco'").coalesce(1)
    half = laps.agg(F.max("LapNumber")).first()[0] // 2
    laps.filter(F.col("LapNumber") <= half).write.parquet(src)
    go = lambda: ST.start_session_ingest(spark, src, laps.schema, sink, ckpt, 10.0, cfg).awaitTermination()
    go()
    before = _rows(ST.read_ingested(spark, sink))
    laps.filter(F.col("LapNumber") > half).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="earlier batch"):
        go()
    assert _rows(ST.read_ingested(spark, sink)) == before


def test_the_stream_and_its_longest_session_share_one_derivation_of_the_laps(spark, monkeypatch):
    from stintlab.plans import catalog
    catalog._laps(spark, SF)
    made = []
    real = L.load_race_laps
    monkeypatch.setattr(L, "load_race_laps", lambda *args: made.append(1) or real(*args))
    out = catalog.QUERIES["stream_session_ingest"](spark, SF)
    assert out.agg(F.sum("n_laps")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert not made
