"""Plan-shape checks: exchange budget of the feature pipeline, pruning on stage tables."""

import re

from pyspark.sql import functions as F

from stintlab.operators import features as FE
from stintlab.operators import labels as LB
from stintlab.plans import pipeline as P
from stintlab.sources import io as IO
from stintlab.sources import laps as L

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_pipeline_splits_laps_and_sessions(spark, cfg, tmp_path):
    # laps as a stored table (the production input), then the full base feature plan
    path = str(tmp_path / "laps")
    L.load_race_laps(spark, SF).write.parquet(path)
    laps = spark.read.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(P.base_features(laps, cfg))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # no window of a whole lap or session: those with an order have a run, step or driver among their keys
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)
    assert windows
    for keys in windows:
        names = set(re.findall(r"([A-Za-z_]\w*)#", keys))
        assert names & {"Driver", "_run", "_step", "_bkt", "driver_stint_id"} or "_run#" in plan and names <= {
            "season", "event_name", "session_type", "LapNumber"}, keys
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_stage_table_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "stage")
    IO.write_any(L.load_laps(spark, SF), path, partition_by=["season"])
    q = IO.read_any(spark, path).filter((F.col("season") == 2023) & (F.col("LapNumber") > 3)) \
        .select("Driver", "LapTime")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "(season" in plan
    assert "PushedFilters: [IsNotNull(LapNumber), GreaterThan(LapNumber,3)]" in plan
    assert re.search(r"ReadSchema: struct<Driver:string,LapNumber:int,LapTime:double>", plan)


def test_registered_queries_read_pruned_stage_tables(spark):
    from stintlab.plans import catalog
    for name, column in (("wn21_stint_spans", "Driver"), ("ml13_quantile_forecast", "lap_time_delta_s")):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Scan ExistingRDD" not in plan, name
        assert column in plan and "FileScan parquet" in plan
        schemas = re.findall(r"ReadSchema: struct<([^>\n]*)", plan)
        assert schemas and all(len(x.split(",")) < 22 for x in schemas), (name, schemas)
    assert re.search(r"PartitionFilters: \[[^\]]*split", plan)


def test_threshold_join_is_broadcast(spark):
    from stintlab.plans import catalog
    plan = catalog.QUERIES["pr21_predict_labels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[event_name", plan)


def test_gate_counts_equal_the_fractions(spark, tmp_path):
    from stintlab.operators import features as FE
    from stintlab.session import write_observed
    df = spark.range(0, 1000, 1, 7).selectExpr("if(id % 8 = 0, null, id) AS a", "id AS b")
    seen = write_observed(df, str(tmp_path / "t"), FE.null_counts(["a", "b"]))
    assert seen == {"rows": 1000, "a": 125, "b": 0}
    assert FE.nulls_over_limit(seen, 0.05) == "a: 0.125" and FE.nulls_over_limit(seen, 0.125) == ""
    assert FE.nulls_over_limit({"rows": 0, "a": 0}) == ""


def test_stage_table_is_reused_until_its_source_changes(spark, tmp_path):
    """Reuse goes by the listing of the source: the same files give the same table (also to a later application, as
    nothing is remembered in the process); a rewritten one of the same name and length gives a new table."""
    import os

    from stintlab.session import source_digest, stage_folder, staged_table
    source = str(tmp_path / "source")
    spark.range(10).coalesce(1).write.parquet(source)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(source)

    stage = lambda: staged_table(spark, "numbers", [source], build, partition_by=())
    assert stage().count() == stage().count() == 10 and len(calls) == 1
    file = next(tmp_path.joinpath("source").glob("*.parquet"))
    before = source_digest(spark, [source])
    os.utime(file, (1, 1))
    assert source_digest(spark, [source]) != before
    assert stage().count() == 10 and len(calls) == 2
    spark.range(3).write.mode("append").parquet(source)
    assert stage().count() == 13 and len(calls) == 3
    # an unfinished table is not taken for a finished one
    for folder in os.listdir(stage_folder(spark).removeprefix("file:")):
        if folder.startswith("numbers-"):
            os.remove(f"{stage_folder(spark).removeprefix('file:')}/{folder}/_SUCCESS")
    assert stage().count() == 13 and len(calls) == 4


def test_refused_stage_leaves_no_table(spark, tmp_path):
    import pytest

    from stintlab.operators import features as FE
    from stintlab.session import staged_table
    source = str(tmp_path / "source")
    spark.range(10).write.parquet(source)
    build = lambda: spark.read.parquet(source).selectExpr("if(id < 5, null, id) AS a")
    for _ in range(2):  # nothing is left behind that a second call could take
        with pytest.raises(AssertionError, match="too many nulls in a: 0.500"):
            staged_table(spark, "refused", [source], build, (), FE.null_counts(["a"]), FE.refuse_nulls(0.2))
    assert staged_table(spark, "refused", [source], build, (), FE.null_counts(["a"]), FE.refuse_nulls(0.5)).count() == 10


def test_laps_are_dealt_anew_only_for_drivers_runs_and_steps(spark, cfg, tmp_path):
    """Laps were shuffled for every table of a row per lap or session, and twice for each window with a join on its keys."""
    L.load_race_laps(spark, SF).write.parquet(str(tmp_path / "laps"))
    laps = spark.read.parquet(str(tmp_path / "laps"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(P.base_features(laps, cfg, lap_norm=False))
        labelled = _plan(LB.clean_then_label(laps.withColumns({"LapTime_s": F.col("LapTime"), "sc_or_vsc_flag": F.lit(0)}), cfg))
        normed = _plan(FE.add_lap_norm(laps))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "hashpartitioning(_lap" in plan and "hashpartitioning(coalesce" not in plan
    assert len(re.findall(r"\bExchange\b", labelled)) == 1  # the stint's median and the driver's labels
    assert "SortMergeJoin" not in normed


def test_laps_of_a_task_do_not_grow_with_the_table(spark, cfg, tmp_path, monkeypatch):
    """The windows by driver sorted what the session's number of partitions left them, however many laps there were."""
    from stintlab.plans import catalog
    laps = spark.createDataFrame([(2018, "Monaco", "R", f"d{k}", "Ferrari", lap, 1.0, None, None, 80.0 + lap, 80.0 * lap, 1.0, float(lap), "SOFT", "1", True)
                                  for k in range(40) for lap in range(1, 6)], L.LAP_SCHEMA)
    monkeypatch.setattr(FE, "LAPS_PER_TASK", 20)
    tasks = FE.driver_tasks(laps, laps.count())
    assert tasks == 10 and FE.driver_tasks(laps, 0) == spark.sparkContext.defaultParallelism
    weather = laps.withColumns({"AirTemp": F.lit(20.0), "TrackTemp": F.lit(30.0), "Humidity": F.lit(40.0)})
    number = lambda df: df.rdd.getNumPartitions()
    features = P.base_features(weather, cfg, lap_norm=False, tasks=tasks)
    labelled = LB.clean_then_label(features, cfg, tasks)
    assert number(features) == number(labelled) == tasks
    rows = lambda df: sorted(map(str, df.collect()))
    plain = P.base_features(weather, cfg, lap_norm=False)
    assert rows(features) == rows(plain) and rows(labelled) == rows(LB.clean_then_label(plain, cfg))
    given = []
    monkeypatch.setattr(catalog, "staged_table", lambda spark, name, sources, build, *args, **more: build() if name != "race-laps" else weather)
    for module, name in ((catalog.P, "base_features"), (catalog.LB, "clean_then_label")):
        plan = lambda df, *args, real=getattr(module, name), tasks=None, **more: given.append(tasks or args[-1]) or real(df, *args, **more)
        monkeypatch.setattr(module, name, plan)
    catalog._labeled(spark, SF)
    assert set(given) == {tasks}
