"""Labels, cleaning, counterfactual scoring on inputs of our own."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stintlab.operators import counterfactual as CF
from stintlab.operators import labels as LB

T0 = datetime(2022, 7, 10, 14, 5, 0)


N_LAPS = 24


def _driver_laps(spark, stops, caution=(), driver="K1"):
    rows = [(driver, lap, T0 if lap in stops else None, 1 if lap in caution else 0) for lap in range(1, N_LAPS + 1)]
    return spark.createDataFrame(rows, "Driver string, LapNumber int, PitInTime timestamp, sc_or_vsc_flag int")


def _labels(df):
    return {r["LapNumber"]: (r["pit_label"], r["loss_weight"]) for r in LB.encode_pit_labels(df).collect()}


@pytest.mark.parametrize("stops, caution", [({6, 19}, ()), ({12, 13}, {10, 20}), ({2, 24}, {1, 23}), (set(), {4})])
def test_labels_follow_their_definition(spark, stops, caution):
    """2 on a stop, 1 on the three laps before one, else 0; no weight on caution laps."""
    for lap, (label, weight) in _labels(_driver_laps(spark, stops, caution)).items():
        assert label == (2 if lap in stops else 1 if any(lap < s <= lap + 3 for s in stops) else 0)
        assert weight == (0.0 if lap in caution else 1.0)


def test_label_shares_of_a_field(spark):
    field = _driver_laps(spark, {8, 17}, driver="K0")
    for k in range(1, 5):
        field = field.unionByName(_driver_laps(spark, {7 + k, 16 + k}, driver=f"K{k}"))
    share = {r["pit_label"]: r["count"] / (5 * N_LAPS) for r in LB.encode_pit_labels(field).groupBy("pit_label").count().collect()}
    assert share == {0: pytest.approx(16 / 24), 1: pytest.approx(6 / 24), 2: pytest.approx(2 / 24)}


def test_stint_transition_rule(spark):
    rows = [("A", lap, None, 1.0 if lap <= 5 else 2.0) for lap in range(1, 9)]
    df = spark.createDataFrame(rows, "Driver string, LapNumber int, PitInTime timestamp, Stint double")
    lab = {r["LapNumber"]: r["pit_label"] for r in LB.encode_pit_labels(df).collect()}
    assert lab[5] == 2 and [lab[i] for i in (2, 3, 4)] == [1, 1, 1] and lab[1] == 0


def test_cleaning_keeps_pit_out(spark, cfg):
    rows = [(2, "SOFT", "s1", 91.0, None), (3, "SOFT", "s1", 140.0, T0), (4, "SOFT", "s1", 91.2, None)]
    df = spark.createDataFrame(rows, "LapNumber int, Compound string, driver_stint_id string, LapTime_s double, "
                                     "PitOutTime timestamp")
    out = LB.apply_cleaning_masks(df, cfg.replace(outlier_threshold=1.2)).orderBy("LapNumber").collect()
    assert len(out) == 3
    assert [r["is_pit_out_lap"] for r in out] == [0, 1, 0]


def test_cleaning_rules_order(spark, cfg):
    rows = [(1, "SOFT", "s1", 90.0), (2, "WET", "s1", 90.0), (3, None, "s1", 90.0), (4, "SOFT", "s1", 200.0),
            (5, "SOFT", "s1", None), (6, "SOFT", "s1", 91.0)]
    df = spark.createDataFrame(rows, "LapNumber int, Compound string, driver_stint_id string, LapTime_s double")
    kept = sorted(r["LapNumber"] for r in LB.apply_cleaning_masks(df, cfg).collect())
    assert kept == [3, 6]


PACE = (0.4, 0.0, 0.9, 2.1, 0.6)  # the car stops on lap 4


def _cf_frame(spark, calls, curve=None, cautions=(), pace=PACE):
    rows = [("Race", "K1", "stint", lap, 2 if lap == 4 else 0, d, int(lap in cautions), 2 if lap in calls else 0, curve[lap - 1] if curve else None)
            for lap, d in enumerate(pace, 1)]
    return spark.createDataFrame(rows, "event_name string, Driver string, driver_stint_id string, LapNumber int, "
                                       "pit_label int, lap_time_delta_s double, sc_or_vsc_flag int, "
                                       "pred_label int, p50 double").withColumns(
        {"Compound": F.lit("MEDIUM"), "Team": F.lit("Team K")})


def _race_delta(df, cfg):
    return CF.per_race_deltas(df, cfg).first()["delta_pos"]


def test_counterfactual_cases(spark, cfg):
    cons = cfg.replace(strategy_policy="conservative_advisor", allow_late_divergence=False)
    aggr = cfg.replace(strategy_policy="aggressive", allow_late_divergence=True)
    loss = float(cfg.pit_stop_time_loss_s)
    curve = [0.2, 0.35, 0.5, 0.85, 0.3]
    assert _race_delta(_cf_frame(spark, {4}), cons) == 0.0  # agrees with the stop
    assert _race_delta(_cf_frame(spark, {3, 4}, curve), cons) == pytest.approx((2.1 - 0.5) / loss)  # an earlier call, by the curve
    assert _race_delta(_cf_frame(spark, {2, 3}), cons) == pytest.approx((2.1 - 0.0) / loss)  # the first call, by its own pace
    assert _race_delta(_cf_frame(spark, (), curve), cons) == 0.0  # never called: only the aggressive policy pays
    assert _race_delta(_cf_frame(spark, (), curve), aggr) == pytest.approx(-(2.1 - 0.85) / loss)
    assert _race_delta(_cf_frame(spark, {2}, curve, cautions={2}), cons) == 0.0  # a call under caution decides nothing
    huge = _cf_frame(spark, {1}, pace=(0.0, 0.0, 0.0, 40 * loss, 0.0))
    assert _race_delta(huge, cons) == CF.C.COUNTERFACTUAL_CAP


def test_entity_aggregate_counts(spark):
    recs = spark.createDataFrame([("North_K1", 0.6, False, False), ("North_K2", -0.7, False, False),
                                  ("North_K3", 0.4, False, False), ("South_K1", -0.02, True, True)],
                                 "driver_id string, delta_pos double, is_wet boolean, is_street boolean")
    s = CF.aggregate_by_entity(recs, "driver", include_map=True).first()
    assert (s["drivers_positive"], s["drivers_negative"], s["drivers_neutral"]) == (2, 1, 1)
    assert s["per_driver_deltas"]["North_K3"] == 0.4
    assert s["wet_driver_mean"] == pytest.approx(-0.02) and s["dry_driver_mean"] == pytest.approx(0.1)
