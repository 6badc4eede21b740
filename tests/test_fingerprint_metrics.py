"""Fingerprints, thresholds, metrics, qualifying, as-of join and running totals."""

import math
import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintlab.functions import scalars as S
from stintlab.operators import classify as CL
from stintlab.operators import fingerprint as FP
from stintlab.operators.asof import asof_nearest
from stintlab.operators.ranking import running_totals
from stintlab.sources.qualifying import load_qualifying_sessions


#: circuit -> (pace lost per lap of tyre age, air temperature, a caution in how many of its two races)
CIRCUITS = {"North": (0.04, 18.0, 2), "South": (0.11, 24.0, 1), "East": (0.07, 36.0, 0), "West": (0.22, 30.0, 1)}


@pytest.fixture(scope="module")
def fp_frame(spark):
    rows = [(season, name, cid, comp, float(age), slope * age + 0.3 * k, air, age + (0 if comp == "SOFT" else 5), int(n <= cautions))
            for cid, (name, (slope, air, cautions)) in enumerate(CIRCUITS.items()) for n, season in enumerate((2020, 2021), 1)
            for k, comp in enumerate(("SOFT", "MEDIUM", "HARD")) for age in range(1, 12)]
    return spark.createDataFrame(rows, "season int, event_name string, circuit_id int, Compound string, "
                                       "tire_age_laps double, lap_time_delta_s double, AirTemp double, TyreLife int, "
                                       "sc_or_vsc_flag int")


def test_fingerprints(spark, cfg, fp_frame):
    fp = {r["event_name"]: r for r in FP.compute_circuit_fingerprints(fp_frame, cfg).collect()}
    assert set(fp) == set(CIRCUITS)
    for name, (slope, air, cautions) in CIRCUITS.items():
        assert fp[name]["avg_deg_rate"] == pytest.approx(slope)
        assert fp[name]["track_temp_percentile"] == pytest.approx(air / 36.0)
        assert fp[name]["sc_vsc_frequency"] == cautions / 2
        assert fp[name]["hist_soft_stint_len"] == 6.0  # median of 1..11
        assert fp[name]["compound_variance"] == pytest.approx(0.3)  # deviation of means 0.3 apart


@pytest.mark.parametrize("include_self", [True, False])
def test_nearest_fingerprint_equals_all_distances(spark, cfg, fp_frame, include_self):
    fp = FP.compute_circuit_fingerprints(fp_frame, cfg)
    rows = fp.collect()
    got = {r["event_name"]: r["fingerprint_distance"] for r in FP.nearest_fingerprint(fp, cfg, include_self).collect()}
    for a in rows:
        want = min(math.sqrt(sum(a[c] != b[c] for c in FP.C.FINGERPRINT_COLS)) for b in rows if include_self or a != b)
        assert got[a["event_name"]] == pytest.approx(want)


def test_distance_with_table_ranges(spark, cfg, fp_frame):
    """AG10 with AG09's ranges: dimensions scaled by the spread of the whole table."""
    fp = FP.compute_circuit_fingerprints(fp_frame, cfg)
    ranges = FP.feature_ranges(fp).first()
    rows = fp.collect()
    a, b = rows[0], rows[1]
    want = math.sqrt(sum(((a[c] - b[c]) / ranges[c]) ** 2 for c in FP.C.FINGERPRINT_COLS))
    vec = lambda r: F.array(*[F.lit(float(r[c])) for c in FP.C.FINGERPRINT_COLS])
    assert spark.range(1).select(FP.fingerprint_distance(vec(a), vec(b), vec(ranges)).alias("d")).first()["d"] == pytest.approx(want)


def test_fingerprint_distance(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 5.0, 4.0])], "a array<double>, b array<double>")
    r = df.select(FP.fingerprint_distance(F.col("a"), F.col("a")).alias("d0"),
                  FP.fingerprint_distance(F.col("a"), F.col("b")).alias("d1"),
                  FP.fingerprint_distance(F.col("b"), F.col("a")).alias("d2")).first()
    assert r["d0"] == 0.0 and r["d1"] == pytest.approx(math.sqrt(2)) and r["d1"] == r["d2"]


def test_fingerprint_roundtrip(spark, cfg, fp_frame, tmp_path):
    fp = FP.compute_circuit_fingerprints(fp_frame, cfg)
    FP.save_fingerprints(fp, str(tmp_path / "fp"))
    assert FP.load_fingerprints(spark, str(tmp_path / "fp")).count() == len(CIRCUITS)
    with pytest.raises(FileNotFoundError):
        FP.load_fingerprints(spark, str(tmp_path / "none"))


def test_threshold_of_a_separable_score(spark):
    df = spark.createDataFrame([(int(k >= 6), k / 10) for k in range(10)], "y int, p double")
    assert CL.find_threshold_max_f1(df).first()["threshold"] == 0.6


def _brute_threshold(y, p):
    best = None
    for s in sorted(set(p)):
        tp = sum(1 for a, b in zip(y, p) if b >= s and a == 1)
        fp = sum(1 for a, b in zip(y, p) if b >= s and a == 0)
        P = sum(y)
        prec = tp / (tp + fp)
        rec = tp / P if P else 1.0
        f1 = round(2 * prec * rec / (prec + rec + 1e-9), 12)
        if best is None or f1 > best[0]:
            best = (f1, s)
    return best[1]


def test_threshold_and_auc_vs_brute_force(spark):
    rng = random.Random(7)
    y = [rng.randint(0, 1) for _ in range(300)]
    p = [round(rng.random(), 2) for _ in range(300)]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double").withColumn("pred_label", F.lit(0))
    assert CL.find_threshold_max_f1(df).first()["threshold"] == _brute_threshold(y, p)
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    m = CL.binary_metrics(df).first()
    assert m["auc"] == pytest.approx(auc, abs=1e-12)
    assert m["brier"] == pytest.approx(sum((b - a) ** 2 for a, b in zip(y, p)) / 300)


def test_running_totals_vs_cumsum(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(rng.randint(0, 50)), rng.randint(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, k double, v int")
    out = running_totals(df, "k", ["v"], by=["g"], descending=True, n_buckets=8).collect()
    pdf = pd.DataFrame(rows, columns=["g", "k", "v"])
    for r in out:
        expect = pdf[(pdf.g == r["g"]) & (pdf.k >= r["k"])].v.sum()
        assert r["cum_v"] == expect


def test_asof_nearest_vs_brute_force(spark):
    rng = random.Random(11)
    left = [("s", round(rng.uniform(0, 1000), 3)) for _ in range(300)]
    right = [("s", float(t), float(i)) for i, t in enumerate(sorted(rng.sample(range(0, 1000, 7), 60)))]
    ldf = spark.createDataFrame(left, "sess string, Time double")
    rdf = spark.createDataFrame(right, "sess string, Time double, val double")
    got = {r["Time"]: r["val"] for r in asof_nearest(ldf, rdf, ["sess"], "Time", ["val"], bucket_width=25.0).collect()}
    for _, t in left:
        best = min(right, key=lambda w: (abs(w[1] - t), w[1]))  # ties -> earlier reading
        assert got[t] == best[2]


def test_canonical_event_name(spark):
    df = spark.createDataFrame([("British Grand Prix",), (" Monza ",), ("Qatar Grand Prix",)], "n string")
    got = [r[0] for r in df.select(S.canonical_event_name(F.col("n"))).collect()]
    assert got == ["Britain", "Italy", "Qatar Grand Prix"]


def test_qualifying_without_parts(spark):
    q = spark.createDataFrame([(2023, "Bahrain", "VER", "SOFT")], "season int, event_name string, Driver string, "
                                                                  "Compound string")
    out = load_qualifying_sessions(q)
    assert "q2_compound" in out.columns and out.filter(F.col("q2_compound").isNotNull()).count() == 0


def test_qualifying_fastest_q2(spark):
    rows = [(2023, "Bahrain", "VER", "Q2", 1, 91.0, "SOFT"), (2023, "Bahrain", "VER", "Q2", 2, 90.0, None),
            (2023, "Bahrain", "VER", "Q2", 3, 90.5, "MEDIUM"), (2023, "Bahrain", "VER", "Q1", 4, 89.0, "HARD"),
            (2023, "Bahrain", "VER", "Q3", 5, 89.5, "SOFT")]
    q = spark.createDataFrame(rows, "season int, event_name string, Driver string, SessionPart string, "
                                    "LapNumber int, LapTime double, Compound string")
    out = load_qualifying_sessions(q).collect()
    assert len(out) == 4 and {r["q2_compound"] for r in out} == {"MEDIUM"}


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_exact_quantiles_vs_numpy(spark):
    import numpy as np
    from stintlab.operators.ranking import exact_quantiles
    rng = random.Random(5)
    rows = [(rng.choice("abc"), round(rng.gauss(0, 1), 2)) for _ in range(2000)] + [("d", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, "v", [0.1, 0.5, 0.9], by=["g"], n_buckets=16).collect()}
    for g in "abcd":
        vals = np.array([v for k, v in rows if k == g])
        for i, p in enumerate([0.1, 0.5, 0.9]):
            assert got[g][f"q{i}"] == pytest.approx(float(np.quantile(vals, p)), abs=1e-9)
    spark_pct = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert all(got[g]["q1"] == pytest.approx(spark_pct[g], abs=1e-12) for g in "abcd")
