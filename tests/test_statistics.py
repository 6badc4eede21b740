"""One-pass statistics against their definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintlab.operators import explore as X
from stintlab.operators import forecast as FC
from stintlab.operators import ranking as R


def _scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")


def test_leave_one_out_quantiles(spark):
    r = random.Random(4)
    rows = [(r.choice("abcde"), float(r.choice([r.randint(-5, 5), r.gauss(0, 3)]))) for _ in range(700)]
    rows += [("lone", 1e6)] + [("a", 2.0)] * 300 + [(None, 7.0)] * 5
    hist = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("_cnt"))
    groups = spark.createDataFrame([(g,) for g in ["a", "b", "c", "d", "e", "lone", "absent"]], "g string")
    for bounds in ([], [-1.0, 0.0, 2.0, 2.5]):
        got = {x["g"]: x for x in R.leave_one_out_quantiles(hist, groups, "v", [0.0, 0.3, 0.5, 1.0], "g", bounds).collect()}
        assert len(got) == 7
        for g, row in got.items():
            others = [v for h, v in rows if h != g]
            assert row["n"] == len(others)
            assert [row[f"q{i}"] for i in range(4)] == pytest.approx(np.quantile(others, [0.0, 0.3, 0.5, 1.0]).tolist(), abs=1e-12)


def test_leave_one_out_of_a_single_group(spark):
    hist = spark.createDataFrame([("a", 1.0, 3)], "g string, v double, _cnt long")
    groups = spark.createDataFrame([("a",), ("b",)], "g string")
    got = {x["g"]: (x["n"], x["q0"]) for x in R.leave_one_out_quantiles(hist, groups, "v", [0.5], "g").collect()}
    assert got == {"a": (0, None), "b": (3, 1.0)}


def test_ranks_spread_over_several_keys(spark, monkeypatch):
    monkeypatch.setattr(R, "RANKS_PER_KEY", 3)
    rows = [("a", 1.0, 10), ("a", 2.0, 1), ("b", 1.0, 4), ("b", 5.0, 9)]
    hist = spark.createDataFrame(rows, "g string, v double, _cnt long")
    got = {x["g"]: x["q0"] for x in R.leave_one_out_quantiles(hist, hist.select("g"), "v", [0.5], "g").collect()}
    assert got == {"a": 5.0, "b": 1.0}


def test_quantiles_of_all_levels_from_one_scan(spark, cfg, tmp_path):
    r = random.Random(9)
    rows = [(r.choice(["N", "S", None]), r.choice(["SOFT", "HARD", None]), r.choice([1.0, 2.0, None]), r.choice([None, r.gauss(0, 1), 0.5]))
            for _ in range(400)]
    spark.createDataFrame(rows, "event_name string, Compound string, tire_age_laps double, lap_time_delta_s double").write.parquet(str(tmp_path / "t"))
    out = FC.quantile_levels(spark.read.parquet(str(tmp_path / "t")), cfg)
    got = {(x["level"], x["event_name"], x["Compound"], x["tire_age_laps"]): [x["_q0"], x["_q1"], x["_q2"]] for x in out.collect()}
    expected = {}
    for e, c, a, v in rows:
        if v is not None and a is not None:
            expected.setdefault((2, "", "", a), []).append(v)
            if c is not None:
                expected.setdefault((1, "", c, a), []).append(v)
                if e is not None:
                    expected.setdefault((0, e, c, a), []).append(v)
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        assert got[key] == pytest.approx(np.quantile(values, cfg.quantiles).tolist(), abs=1e-12)


def test_anova_and_kruskal_against_their_definitions(spark):
    r = random.Random(2)
    rows = [(k % 3, float(r.randint(0, 6)) + (k % 3), r.gauss(k % 3, 2)) for k in range(200)] + [(7, 1.0, None)] * 3 + [(None, 1.0, 1.0), (1, None, float(5))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {t["feature"]: t for t in X.anova_kruskal(df, ["x", "y"], "g").collect()}
    for name, at in (("x", 1), ("y", 2)):
        groups = {}
        for row in rows:
            if row[0] is not None and row[at] is not None:
                groups.setdefault(row[0], []).append(row[at])
        groups = [np.array(v) for v in groups.values() if len(v) > 3]
        every = np.concatenate(groups)
        n, k = len(every), len(groups)
        between = sum(len(v) * (v.mean() - every.mean()) ** 2 for v in groups)
        within = sum(((v - v.mean()) ** 2).sum() for v in groups)
        f = between / (k - 1) / (within / (n - k))
        values, counts = np.unique(every, return_counts=True)
        rank = dict(zip(values, np.cumsum(counts) - (counts - 1) / 2))
        h = 12 / (n * (n + 1)) * sum(sum(rank[x] for x in v) ** 2 / len(v) for v in groups) - 3 * (n + 1)
        h /= 1 - sum(c ** 3 - c for c in counts) / (n ** 3 - n)
        assert (got[name]["groups"], got[name]["anova_f"], got[name]["kruskal_h"]) == (k, pytest.approx(f), pytest.approx(h))
    places = {t["feature"]: t["place"] for t in X.ordered_tests(X.anova_kruskal(df, ["x", "y"], "g")).collect()}
    first = min(got, key=lambda f: got[f]["anova_p"])
    assert places[first] == 1 and sorted(places.values()) == [1, 2]


def test_ordinals_over_several_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice("abcdefgh") * r.randint(1, 3), r.randint(0, 40)) for _ in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = R.with_ordinals(spark.createDataFrame(rows, "a string, b int").repartition(5), ["a", "b"])
        got = [(x["ordinal"], x["a"], x["b"]) for x in out.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [x[1:] for x in sorted(got)] == sorted(rows) and sorted(x[0] for x in got) == list(range(1, 901))


def test_one_compound_table_is_broadcast(spark):
    df = spark.createDataFrame([("SOFT", "s1", 3.0), ("HARD", "s2", 9.0)], "Compound string, driver_stint_id string, tire_age_laps double")
    plan = X.stint_length_histogram(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
