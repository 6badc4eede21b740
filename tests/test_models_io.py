"""MLlib pit model train / calibrate / save / reload, results sink, streaming ingestion."""

import pytest
from pyspark.sql import functions as F

from stintlab.operators import classify as CL
from stintlab.sources import io as IO


def _pit_frame(spark, circuits, n):
    rows = []
    for c in circuits:
        for i in range(n):
            label = 2 if i >= n - 3 else (1 if i >= n - 6 else 0)
            rows.append((c, label, 1.0, float(i + 1), float((i + 1) ** 2), float(i % 3), 0.0, 0.0,
                         110.0 - 2.3 * i, (i + 1) / n, 0.0, 0.0, 0, 0, 0.1 * i, 0.01, 0.0))
    return spark.createDataFrame(rows, "event_name string, pit_label int, loss_weight double, tire_age_laps double, "
                                       "tire_age_sq double, compound_enc double, circuit_id_enc double, "
                                       "team_id_enc double, fuel_load_kg double, lap_norm double, gap_ahead_s double, "
                                       "gap_ahead_trend double, undercut_threat int, sc_or_vsc_flag int, "
                                       "lap_time_delta_s double, deg_velocity double, deg_acceleration double")


def test_pit_window_dataset(spark, cfg):
    ds = CL.build_pit_window_dataset(_pit_frame(spark, ["Bahrain"], 12), cfg)
    assert ds.count() == 12 and ds.agg(F.sum("y")).first()[0] == 6


def test_train_save_reload(spark, cfg, tmp_path):
    train = _pit_frame(spark, ["Bahrain", "Monaco"], 30)
    val = _pit_frame(spark, ["Bahrain", "Monaco"], 24)
    model = CL.train_pit_model(train, val, cfg, max_iter=5, extra_circuits=[])
    assert {r["event_name"] for r in model.thresholds.collect()} == {"Bahrain", "Monaco"}
    path = str(tmp_path / "pit_model")
    model.save(path)
    again = CL.PitModel.load(spark, path)
    a = model.predict_proba(val).select("p").collect()
    b = again.predict_proba(val).select("p").collect()
    assert [r[0] for r in a] == pytest.approx([r[0] for r in b])
    m = CL.binary_metrics(again.predict_labels(CL.build_pit_window_dataset(val, cfg, again.features))).first()
    assert 0.25 - 1e-9 <= m["average_precision"] <= 1.0  # never below the positive prevalence (12 of 48)
    IO.write_results_json(spark.createDataFrame([m.asDict()]), str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).count() == 1


def test_class_weights_come_from_train_only(spark, cfg):
    train = spark.createDataFrame([(1,)] * 2 + [(0,)] * 6, "y int")
    both = train.unionByName(spark.createDataFrame([(1,)] * 50, "y int"))
    weights = {r["y"]: r["w"] for r in CL.class_weights(both, fitted_on=train).distinct().collect()}
    assert weights == {1: 2.0, 0: pytest.approx(8 / 12)}


def test_broken_model_part_is_an_error(spark, cfg, tmp_path):
    train, val = _pit_frame(spark, ["Bahrain", "Monaco"], 30), _pit_frame(spark, ["Bahrain", "Monaco"], 24)
    model = CL.train_pit_model(train, val, cfg, max_iter=2, extra_circuits=[])
    path = tmp_path / "model"
    model.save(str(path))
    (path / "calibrator").rename(tmp_path / "elsewhere")
    with pytest.raises(Exception):
        CL.PitModel.load(spark, str(path))
    model.calibrator, model.thresholds = None, None
    model.save(str(tmp_path / "plain"))
    again = CL.PitModel.load(spark, str(tmp_path / "plain"))
    assert again.calibrator is None and again.thresholds is None


def test_unfinished_stage_is_written_again(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def compute():
        calls.append(1)
        return spark.range(5)

    assert IO.stage(spark, path, compute).count() == IO.stage(spark, path, compute).count() == 5 and len(calls) == 1
    (tmp_path / "stage" / "_SUCCESS").unlink()
    assert IO.load_splits(spark, str(tmp_path), names=("stage",), suffix="") is None
    assert IO.stage(spark, path, compute).count() == 5 and len(calls) == 2


def test_load_gate_names_every_bad_season(spark):
    keys = "season int, event_name string, session_type string"
    expected = spark.createDataFrame([(s, e, "R") for s in range(2010, 2020) for e in ("North", "South")], keys)
    laps = expected.filter("season >= 2018 or event_name = 'North'")
    with pytest.raises(RuntimeError) as told:
        IO.load_complete(laps, expected)
    assert all(str(s) in str(told.value) for s in range(2010, 2018)) and "2018" not in str(told.value)
    assert IO.load_complete(expected, expected).count() == 20


def test_metric_report_keeps_text(spark, cfg):
    from stintlab.operators.metrics import metric_report
    got = {r["metric"]: (r["value"], r["text"], r["target"]) for r in
           metric_report(spark.createDataFrame([(0.5, "3/4", 2)], "mcc double, heuristics string, n int"), cfg, "s").collect()}
    assert got == {"mcc": (0.5, None, cfg.metric_targets["mcc"]), "heuristics": (None, "3/4", None), "n": (2.0, None, None)}


def test_best_prefix_by_patience():
    assert CL.best_prefix([5.0, 4.0, 3.0, 3.5, 3.2, 2.0], 2) == (3, True)  # the later minimum lies beyond the patience
    assert CL.best_prefix([5.0, 4.0, 3.0, 3.5], 2) == (3, False)
    assert CL.best_prefix([1.0, 1.0, 1.0], 2) == (1, True) and CL.best_prefix([1.0], 5) == (1, False)


def test_model_is_the_prefix_and_contributions_sum_to_margins(spark, cfg):
    from pyspark.ml.functions import vector_to_array

    from stintlab.operators import attribution as AT
    train, val = _pit_frame(spark, ["Bahrain", "Monaco"], 40), _pit_frame(spark, ["Bahrain", "Spain"], 24)
    model = CL.train_pit_model(train, val, cfg, max_iter=6, extra_circuits=[])
    assembler, boosted = model.pipeline.stages
    assert len(model.validation_losses) == 6
    assert boosted.getNumTrees == CL.best_prefix(model.validation_losses, cfg.pit_gbt["patience"])[0]
    rows = assembler.transform(CL.build_pit_window_dataset(val, cfg, model.features)).withColumn("row", F.monotonically_increasing_id()).cache()
    for m in (boosted, CL.prefix_model(boosted, 1)):
        phi = AT.tree_attributions(m, rows.select("row", "features"), model.features, ["row"])
        sums = phi.groupBy("row").agg(F.sum("phi").alias("s"))
        margins = m.transform(rows).select("row", vector_to_array("rawPrediction")[1].alias("margin"))
        both = margins.join(sums, "row").collect()
        assert len(both) == 48 and all(abs(r["s"] - r["margin"]) < 1e-9 for r in both)
        assert {r["feature"] for r in phi.select("feature").distinct().collect()} <= {AT.BASE, *model.features}


def test_isotonic_in_ranges_equals_pooling_at_once(spark):
    import random

    from stintlab.operators import isotonic as IS
    r = random.Random(3)
    data = [(round(r.random(), 2), int(r.random() < 0.2 + 0.5 * r.random())) for _ in range(600)] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(data, "p double, y int")
    seen = {}
    for p, y in data:
        if p is not None and y is not None:
            seen.setdefault(p, []).append(y)
    scores = sorted(seen)
    # by definition: the largest of the least means of the runs around a score
    mean = lambda a, b: sum(sum(seen[s]) for s in scores[a:b + 1]) / sum(len(seen[s]) for s in scores[a:b + 1])
    n = len(scores)
    expected = {scores[i]: max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(0, n, 3)}
    for bounds in ([], [k / 40 for k in range(1, 40)]):
        model = IS.Isotonic.fit(df, bounds=bounds)
        got = {x["p"]: x["c"] for x in df.select("p", model.apply(F.col("p")).alias("c")).distinct().collect()}
        assert got[None] is None
        assert all(got[s] == pytest.approx(v) for s, v in expected.items())
    assert model.value == sorted(model.value) and len(set(model.value)) == len(model.value)
    edges = spark.createDataFrame([(-1.0,), (2.0,), ((model.hi[0] + model.lo[1]) / 2,)], "p double").select(model.apply(F.col("p"))).collect()
    assert [x[0] for x in edges] == pytest.approx([model.value[0], model.value[-1], (model.value[0] + model.value[1]) / 2])
    assert spark.range(1).select(IS.Isotonic.fit(df.where("p > 5")).apply(F.lit(0.3))).first()[0] is None


def test_boosted_fit_is_not_thrown_away_for_a_common_prefix(spark):
    """A best prefix of 37 trees with a patience of 50 took two fits: 64 trees, then 128."""
    fits = []

    class Model:
        def __init__(self, n):
            self.getNumTrees = n

        def evaluateEachIteration(self, val):  # noqa: N802
            return [abs(k - 36) + 1.0 for k in range(self.getNumTrees)]

    class Estimator:
        maxIter = "maxIter"  # noqa: N815

        def copy(self, params):
            self.n = params["maxIter"]
            return self

        def fit(self, train):
            fits.append(self.n)
            return Model(self.n)

    cut = CL.prefix_model
    CL.prefix_model = lambda model, n: n
    try:
        assert CL.fit_boosted(Estimator(), None, None, 500, 50)[0] == 37
        assert len(fits) == 1
        fits.clear()
        assert CL.fit_boosted(Estimator(), None, None, 60, 50)[0] == 37 and fits == [60]
    finally:
        CL.prefix_model = cut


def test_thresholds_do_not_score_the_validation_rows_again(spark, cfg):
    train, val = _pit_frame(spark, ["Bahrain", "Monaco"], 30), _pit_frame(spark, ["Bahrain", "Monaco"], 24)
    model = CL.train_pit_model(train, val, cfg, max_iter=2, extra_circuits=[])
    plan = model.thresholds._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Exchange" not in plan


def test_ablations_run_beside_each_other_in_their_order(spark, cfg, monkeypatch):
    import threading

    from stintlab.operators import models as MD
    together, asked = threading.Barrier(2, timeout=60), []

    class Model:
        def __init__(self, features):
            self.features = features

        def predict_labels(self, df):
            return df.select("y", F.lit(len(self.features) / 100).alias("p"), F.lit(2).alias("pred_label"))

    def fit(train, val, cfg, features, max_iter=None):
        together.wait()  # six models in pairs: one after the other they would wait in vain
        asked.append(features)
        return Model(features)

    monkeypatch.setattr(MD.CL, "train_pit_model", fit)
    monkeypatch.setattr(MD, "ABLATION_THREADS", 2)
    frame = _pit_frame(spark, ["Bahrain"], 12).withColumn("Team", F.lit("Ferrari"))
    rows = MD.run_ablations(frame, frame, frame, cfg).collect()
    assert [r["ablation_name"] for r in rows] == [a[0] for a in MD.ABLATIONS] and len(asked) == 6


def test_boosted_fit_has_no_more_tasks_than_its_rows_need(spark, cfg, tmp_path, monkeypatch):
    """The stages of a fit had a task for every file read: 12 files of a few rows were 12 tasks a stage."""
    path = str(tmp_path / "rows")
    train, val = _pit_frame(spark, ["Bahrain", "Monaco"], 30), _pit_frame(spark, ["Bahrain", "Monaco"], 24)
    train.repartition(12).write.parquet(path)
    monkeypatch.setattr(CL, "LEAST_FIT_TASKS", 1)
    rows = spark.read.parquet(path)
    for per_task, parts in ((60, 1), (30, 2), (59, 2), (1000, 1)):
        monkeypatch.setattr(CL, "ROWS_PER_FIT_TASK", per_task)
        cut = CL.fit_rows(rows)
        assert cut.rdd.getNumPartitions() == min(parts, rows.rdd.getNumPartitions())
        assert sorted(cut.collect()) == sorted(rows.collect())
    assert CL.fit_rows(rows.where("false")).count() == 0
    monkeypatch.setattr(CL, "ROWS_PER_FIT_TASK", 1000)
    seen, fit = [], CL.fit_boosted

    def watched(estimator, train, val, max_iter, patience):
        seen.append(train.rdd.getNumPartitions())
        return fit(estimator, train, val, max_iter, patience)

    monkeypatch.setattr(CL, "fit_boosted", watched)
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 * 1024 * 1024))  # a task for every file read
    try:
        CL.train_pit_model(rows, val, cfg, max_iter=1, extra_circuits=[])
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert seen == [1]
