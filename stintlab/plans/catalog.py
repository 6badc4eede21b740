"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the driver tables (or frames Spark derives from them) in full.
Doubles are rounded to 6 dp on both sides so value hashes are comparable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import features as FE
from ..session import stage_once, staged_table
from ..sources import laps as L
from . import oracle as O
from . import pipeline as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle_sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLE[name] = oracle_sql
        return fn
    return deco


def r6(c, name: str | None = None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or (c if isinstance(c, str) else None))


CFG = C.default_config()


def _laps(spark, sf):
    """Race laps derived from ``events`` (bridge + as-of weather): a stage table by season."""
    return staged_table(spark, "race-laps", [f"{sf}/events.parquet"], lambda: L.load_race_laps(spark, sf))


def _tasks(spark, sf) -> int:
    """Tasks for all laps by driver; their number is told by the footers of the stage table."""
    laps = _laps(spark, sf)
    return FE.driver_tasks(laps, laps.count())


def _base(spark, sf):
    """The window features of all laps, without the frame-dependent lap norms: a stage table, refused (AG16) if
    the NULLs counted while it is written are too many."""
    return staged_table(spark, "base-features", [f"{sf}/events.parquet"],
                        lambda: P.base_features(_laps(spark, sf), CFG, lap_norm=False, tasks=_tasks(spark, sf)),
                        metrics=FE.null_counts(), accept=FE.refuse_nulls())


def _feats(spark, sf):
    return FE.add_lap_norm(_base(spark, sf), source=_laps(spark, sf))


# ------------------------------------------------------------------ sources / bridge

@register("src_laps_bridge", O.with_fragments(["laps"], """
SELECT season, event_name, session_type, Driver, Team, LapNumber, Stint, PitInTime, PitOutTime,
       LapTime, Time, Position, TyreLife, Compound, TrackStatus, IsAccurate FROM laps"""))
def q_laps(spark, sf):
    return L.load_laps(spark, sf)


@register("jn01_asof_weather", O.with_fragments(["laps_w"], """
SELECT season, event_name, Driver, LapNumber, Time, AirTemp, TrackTemp, Humidity FROM laps_w"""))
def q_jn01(spark, sf):
    return _laps(spark, sf).select("season", "event_name", "Driver", "LapNumber", "Time", "AirTemp", "TrackTemp",
                                   "Humidity")


# ------------------------------------------------------------------ minimum slice

@register("wn03_lap_time_delta", O.with_fragments(["f4"], """
SELECT driver_stint_id, LapNumber, round(LapTime_s, 6) AS LapTime_s, round(fuel_load_kg, 6) AS fuel_load_kg,
       round(lap_time_delta_s, 6) AS lap_time_delta_s, round(deg_velocity, 6) AS deg_velocity,
       round(deg_acceleration, 6) AS deg_acceleration FROM f4"""))
def q_wn03(spark, sf):
    laps = _laps(spark, sf)
    out = FE.add_degradation_derivatives(FE.add_lap_time_delta(FE.add_fuel_load(FE.add_stint_id(laps), CFG), CFG))
    return out.select("driver_stint_id", "LapNumber", r6("LapTime_s"), r6("fuel_load_kg"), r6("lap_time_delta_s"),
                      r6("deg_velocity"), r6("deg_acceleration"))


@register("cp1_degradation_curve", O.with_fragments(["feat"], """
SELECT event_name, Compound, tire_age_laps, count(*) AS n_laps,
       round(avg(lap_time_delta_s), 6) AS mean_delta_s
FROM feat GROUP BY event_name, Compound, tire_age_laps"""))
def q_curve(spark, sf):
    f = _feats(spark, sf)
    return f.groupBy("event_name", "Compound", "tire_age_laps").agg(
        F.count(F.lit(1)).alias("n_laps"), r6(F.avg("lap_time_delta_s"), "mean_delta_s"))


@register("cp1_feature_pipeline", O.with_fragments(["feat"], """
SELECT driver_stint_id, LapNumber, session_type, round(fuel_load_kg, 6) AS fuel_load_kg,
       round(lap_time_delta_s, 6) AS lap_time_delta_s, round(deg_velocity, 6) AS deg_velocity,
       round(deg_acceleration, 6) AS deg_acceleration, round(tire_age_laps, 6) AS tire_age_laps,
       round(tire_age_sq, 6) AS tire_age_sq, round(gap_ahead_s, 6) AS gap_ahead_s,
       round(gap_ahead_trend, 6) AS gap_ahead_trend, safety_car_flag, vsc_flag, sc_or_vsc_flag, TrackStatus,
       round(track_evolution_delta, 6) AS track_evolution_delta, undercut_threat,
       round(lap_norm, 6) AS lap_norm, round(lap_count_norm, 6) AS lap_count_norm FROM feat"""))
def q_cp1(spark, sf):
    f = _feats(spark, sf)  # gated by AG16 when its stage was written
    return f.select("driver_stint_id", "LapNumber", "session_type", r6("fuel_load_kg"), r6("lap_time_delta_s"),
                    r6("deg_velocity"), r6("deg_acceleration"), r6("tire_age_laps"), r6("tire_age_sq"),
                    r6("gap_ahead_s"), r6("gap_ahead_trend"), "safety_car_flag", "vsc_flag", "sc_or_vsc_flag",
                    "TrackStatus", r6("track_evolution_delta"), "undercut_threat", r6("lap_norm"),
                    r6("lap_count_norm"))


# ------------------------------------------------------------------ CP2: split features with train-fitted state

def _fs(spark, sf):
    tagged = P.season_split(_base(spark, sf), CFG)
    return P.apply_train_state(FE.add_lap_norm(tagged, within=["split"], source=P.season_split(_laps(spark, sf), CFG)), CFG)


@register("cp2_split_features", O.with_fragments(["fs"], """
SELECT driver_stint_id, LapNumber, split, circuit_id_enc, circuit_id, compound_type, compound_enc, team_id_enc,
       team_id, track_temp_category, round(starting_position_norm, 6) AS starting_position_norm,
       round(circuit_softness, 6) AS circuit_softness, round(historical_sc_prob, 6) AS historical_sc_prob,
       round(lap_norm, 6) AS lap_norm, round(lap_count_norm, 6) AS lap_count_norm,
       round(AirTemp, 6) AS AirTemp, round(TrackTemp, 6) AS TrackTemp FROM fs"""))
def q_cp2(spark, sf):
    f = _fs(spark, sf)
    return f.select("driver_stint_id", "LapNumber", "split", "circuit_id_enc", "circuit_id", "compound_type",
                    "compound_enc", "team_id_enc", "team_id", "track_temp_category", r6("starting_position_norm"),
                    r6("circuit_softness"), r6("historical_sc_prob"), r6("lap_norm"), r6("lap_count_norm"),
                    r6("AirTemp"), r6("TrackTemp"))


@register("ml01_encoders", O.with_fragments(["enc_circuit", "enc_team"], """
SELECT 'circuit_id' AS encoder, label, code FROM enc_circuit
UNION ALL SELECT 'team_id' AS encoder, label, code FROM enc_team"""))
def q_ml01(spark, sf):
    from ..operators.encode import fit_label_encoder
    train = P.split_frames(_laps(spark, sf), CFG)[0]
    return fit_label_encoder(train, "event_name").select(F.lit("circuit_id").alias("encoder"), "label", "code") \
        .unionByName(fit_label_encoder(train, "Team").select(F.lit("team_id").alias("encoder"), "label", "code"))


@register("ag01_historical_sc_prob", O.with_fragments(["sc_prob"], """
SELECT event_name, round(historical_sc_prob, 6) AS historical_sc_prob FROM sc_prob"""))
def q_ag01(spark, sf):
    from ..operators.encode import historical_sc_table
    train = P.split_frames(_base(spark, sf), CFG)[0]
    return historical_sc_table(train, CFG).select("event_name", r6("historical_sc_prob"))


# ------------------------------------------------------------------ labels and cleaning

from ..operators import labels as LB  # noqa: E402


@register("wn12_pit_labels", O.with_fragments(["lab_all"], """
SELECT driver_stint_id, LapNumber, split, pit_label, loss_weight FROM lab_all"""))
def q_wn12(spark, sf):
    return LB.encode_pit_labels(_fs(spark, sf)).select("driver_stint_id", "LapNumber", "split", "pit_label",
                                                       "loss_weight")


@register("ag23_label_distribution", O.with_fragments(["lab_all"], """
SELECT split, pit_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
FROM lab_all GROUP BY split, pit_label"""))
def q_ag23(spark, sf):
    from ..operators import explore as X
    return X.label_distribution(LB.encode_pit_labels(_fs(spark, sf)), ["split"])


@register("cp3_clean_then_label", O.with_fragments(["ev_lab"], """
SELECT driver_stint_id, LapNumber, split, is_pit_out_lap, pit_label, loss_weight,
       round(LapTime_s, 6) AS LapTime_s FROM ev_lab"""))
def q_cp3(spark, sf):
    return LB.clean_then_label(_fs(spark, sf), CFG).select("driver_stint_id", "LapNumber", "split",
                                                           "is_pit_out_lap", "pit_label", "loss_weight",
                                                           r6("LapTime_s"))


@register("cp4_label_clean_filter", O.with_fragments(["cl_lab"], f"""
SELECT driver_stint_id, LapNumber, split, pit_label, is_pit_out_lap, {O.TOP4} AS is_top4 FROM cl_lab"""))
def q_cp4(spark, sf):
    return LB.label_then_clean(_fs(spark, sf), CFG).select("driver_stint_id", "LapNumber", "split", "pit_label",
                                                           "is_pit_out_lap", "is_top4")


@register("pr13_top4_constructors", O.with_fragments(["laps"], f"""
SELECT Team, {O.TOP4} AS is_top4, count(*) AS n_laps FROM laps GROUP BY ALL"""))
def q_pr13(spark, sf):
    laps = LB.filter_top_constructors(L.load_laps(spark, sf), CFG)
    return laps.groupBy("Team", "is_top4").agg(F.count(F.lit(1)).alias("n_laps"))


#: the stage tables that queries share, in the order they are written: name -> (spark, sf_dir) -> DataFrame
STAGES = {"race_laps": _laps, "base_features": _base, "labelled_laps": lambda spark, sf: _labeled(spark, sf),
          "fingerprints": lambda spark, sf: _fingerprints(spark, sf)}


# ------------------------------------------------------------------ fingerprints, LOCO

from ..operators import fingerprint as FP  # noqa: E402


def _labeled(spark, sf):
    """Evaluation path over all splits: clean -> label (CP3), a stage table by split and season."""
    return staged_table(spark, "labelled-laps", [f"{sf}/events.parquet"], lambda: LB.clean_then_label(_fs(spark, sf), CFG, _tasks(spark, sf)),
                        partition_by=("split", "season"))


def _fingerprints(spark, sf):
    """One row per circuit, from the labelled training laps."""
    train = _labeled(spark, sf).filter(F.col("split") == "train")
    return staged_table(spark, "fingerprints", [f"{sf}/events.parquet"],
                        lambda: FP.compute_circuit_fingerprints(train, CFG), partition_by=())


FP_COLS = ["avg_deg_rate", "compound_variance", "track_temp_percentile", "high_speed_fraction",
           "hist_soft_stint_len", "sc_vsc_frequency"]


@register("cp5_circuit_fingerprints", O.with_fragments(["fp"], "SELECT circuit_id, event_name, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in FP_COLS) + " FROM fp"))
def q_cp5(spark, sf):
    return _fingerprints(spark, sf).select("circuit_id", "event_name", *[r6(c) for c in FP_COLS])


@register("jn12_nearest_fingerprint", O.with_fragments(["fp"], f"""
SELECT a.circuit_id, a.event_name, round(min(sqrt({O.FP_DIFF})), 6) AS fingerprint_distance
FROM fp a JOIN fp b ON a.event_name <> b.event_name GROUP BY a.circuit_id, a.event_name"""))
def q_jn12(spark, sf):
    near = FP.nearest_fingerprint(_fingerprints(spark, sf), CFG, include_self=False)
    return near.select("circuit_id", "event_name", r6("fingerprint_distance"))


@register("ag17_loco_cv", O.with_fragments(["loco"], """
SELECT circuit, round(mae_p50, 6) AS mae_p50, round(fingerprint_distance, 6) AS fingerprint_distance,
       circuit_type FROM loco"""))
def q_ag17(spark, sf):
    loco = FP.run_loco_cv(_fs(spark, sf), _fingerprints(spark, sf), CFG, include_self=False)
    return loco.select("circuit", r6("mae_p50"), r6("fingerprint_distance"), "circuit_type")


@register("ag18_loco_pearson", O.with_fragments(["loco"], """
SELECT CASE WHEN count(*) < 2 THEN 0.0
            ELSE round(covar_pop(mae_p50, fingerprint_distance)
                       / nullif(sqrt(var_pop(mae_p50) * var_pop(fingerprint_distance)), 0), 6) END AS pearson_r
FROM loco"""))
def q_ag18(spark, sf):
    loco = FP.run_loco_cv(_fs(spark, sf), _fingerprints(spark, sf), CFG, include_self=False)
    return FP.loco_pearson(loco).select(r6("pearson_r"))


# ------------------------------------------------------------------ qualifying, compound dataset

from ..operators import compound as CO  # noqa: E402
from ..sources import qualifying as Q  # noqa: E402


@register("cp6_qualifying_q2_compound", O.with_fragments(["quali"], """
SELECT season, event_name, Driver, LapNumber, SessionPart, Compound, q2_compound FROM quali"""))
def q_cp6(spark, sf):
    q = Q.load_qualifying_sessions(L.load_qualifying_raw(spark, sf))
    return q.select("season", "event_name", "Driver", "LapNumber", "SessionPart", "Compound", "q2_compound")


XGB_COLS = FP_COLS + ["AirTemp", "Humidity", "TrackTemp", "FreshTyre", "TyreLife", "qualifying_pace_delta_s"]


def _xgb(spark, sf):
    quali = Q.load_qualifying_sessions(L.load_qualifying_raw(spark, sf))
    return CO.build_compound_dataset(quali, _fingerprints(spark, sf))


@register("ml08_compound_dataset", O.with_fragments(["xgb"], "SELECT season, event_name, Driver, label, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in XGB_COLS) + " FROM xgb WHERE label IS NOT NULL"))
def q_ml08(spark, sf):
    return _xgb(spark, sf).select("season", "event_name", "Driver", "label", *[r6(c) for c in XGB_COLS])


# ------------------------------------------------------------------ thresholds, predictions, metrics

from ..operators import classify as CL  # noqa: E402
from ..operators import metrics as MT  # noqa: E402


def _scored_splits(spark, sf):
    """Labelled laps (clean -> label) with the baseline score; thresholds tuned on the
    validation pit-window dataset; labels predicted for every split."""
    labeled = CL.baseline_pit_score(_labeled(spark, sf))
    val = CL.build_pit_window_dataset(labeled.filter(F.col("split") == "val"), CFG)
    thresholds, global_thr = CL.tune_circuit_thresholds(val, CFG)
    return labeled, val, thresholds, global_thr


@register("ml05_global_threshold", O.with_fragments(["thr_best"], """
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM thr_best WHERE g = '*'"""))
def q_ml05(spark, sf):
    labeled = CL.baseline_pit_score(_labeled(spark, sf))
    val = CL.build_pit_window_dataset(labeled.filter(F.col("split") == "val"), CFG)
    return CL.find_threshold_max_f1(val).select(r6("threshold"), r6("f1"))


@register("ml06_circuit_thresholds", O.with_fragments(["thr_circuit"], """
SELECT event_name, round(threshold, 6) AS threshold FROM thr_circuit"""))
def q_ml06(spark, sf):
    _, _, thresholds, _ = _scored_splits(spark, sf)
    return thresholds.select("event_name", r6("threshold"))


@register("pr21_predict_labels", O.with_fragments(["test_pred"], """
SELECT driver_stint_id, LapNumber, round(p, 6) AS p, pred_label FROM test_pred"""))
def q_pr21(spark, sf):
    labeled, _, thresholds, global_thr = _scored_splits(spark, sf)
    pred = CL.predict_labels(labeled.filter(F.col("split") == "test"), thresholds, global_thr)
    return pred.select("driver_stint_id", "LapNumber", r6("p"), "pred_label")


@register("ms04_binary_metrics", O.with_fragments(["pw_val_pred"], """
WITH d AS (SELECT p, sum(y) AS tp, sum(1 - y) AS fp FROM pw_val_pred GROUP BY p),
     c AS (SELECT d.p, d.tp, d.fp, (SELECT sum(tp) FROM d d2 WHERE d2.p >= d.p) AS ctp,
                  (SELECT sum(fp) FROM d d2 WHERE d2.p >= d.p) AS cfp FROM d),
     pairs AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS w
               FROM pw_val_pred a JOIN pw_val_pred b ON a.y = 1 AND b.y = 0),
     tot AS (SELECT sum(y) AS P, sum(1 - y) AS N, sum(CASE WHEN pred_label = 2 AND y = 1 THEN 1 ELSE 0 END) AS tp,
                    sum(CASE WHEN pred_label = 2 AND y = 0 THEN 1 ELSE 0 END) AS fp,
                    sum(CASE WHEN pred_label <> 2 AND y = 1 THEN 1 ELSE 0 END) AS fn,
                    avg(pow(p - y, 2)) AS brier FROM pw_val_pred)
SELECT round(CASE WHEN tot.P > 0 THEN (SELECT sum(tp::DOUBLE / tot.P * ctp / (ctp + cfp)) FROM c) ELSE 0.0 END, 6)
         AS average_precision,
       round(CASE WHEN tot.P > 0 AND tot.N > 0 THEN (SELECT w FROM pairs) / (tot.P * tot.N) ELSE 0.5 END, 6) AS auc,
       round(coalesce(2.0 * tot.tp / nullif(2 * tot.tp + tot.fp + tot.fn, 0), 0.0), 6) AS f1,
       round(coalesce(tot.tp / nullif(tot.tp + tot.fp, 0), 0.0), 6) AS precision,
       round(coalesce(tot.tp / nullif(tot.tp + tot.fn, 0), 0.0), 6) AS recall,
       round(coalesce(tot.brier, 0.0), 6) AS brier
FROM tot"""))
def q_ms04(spark, sf):
    labeled, val, thresholds, global_thr = _scored_splits(spark, sf)
    pred = CL.predict_labels(val, thresholds, global_thr)
    m = CL.binary_metrics(pred)
    return m.select(*[r6(c) for c in m.columns])


@register("ms01_confusion_matrix", O.with_fragments(["test_pred"], """
SELECT t.true_label, t.pred_label, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT a AS true_label, b AS pred_label FROM unnest([0, 1, 2]) x(a), unnest([0, 1, 2]) y(b)) t
LEFT JOIN (SELECT pit_label AS true_label, pred_label, count(*) AS n FROM test_pred GROUP BY ALL) c
  ON c.true_label = t.true_label AND c.pred_label = t.pred_label"""))
def q_ms01(spark, sf):
    labeled, _, thresholds, global_thr = _scored_splits(spark, sf)
    pred = CL.predict_labels(labeled.filter(F.col("split") == "test"), thresholds, global_thr)
    return MT.confusion_matrix(pred)


@register("ms02_classification_report", O.with_fragments(["rep2"], """
SELECT CAST(label AS INTEGER) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep2"""))
def q_ms02(spark, sf):
    labeled, _, thresholds, global_thr = _scored_splits(spark, sf)
    pred = CL.predict_labels(labeled.filter(F.col("split") == "test"), thresholds, global_thr)
    rep = MT.per_class_report(pred)
    return rep.select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@register("ms03_multiclass_summary", O.with_fragments(["rep2", "mcc_parts"], """
SELECT round((SELECT avg(f1) FROM rep2), 6) AS macro_f1,
       round(CASE WHEN n_true <= 1 THEN 0.0
                  ELSE coalesce((c * s - tp_sum) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0.0), 0.0) END, 6) AS mcc,
       round(coalesce((SELECT max(recall) FROM rep2 WHERE label = 2), 0.0), 6) AS pit_now_recall,
       round(coalesce((SELECT max(precision) FROM rep2 WHERE label = 2), 0.0), 6) AS pit_now_precision,
       round(coalesce((SELECT max(recall) FROM rep2 WHERE label = 1), 0.0), 6) AS pit_soon_recall,
       round(coalesce((SELECT max(precision) FROM rep2 WHERE label = 0), 0.0), 6) AS stay_out_precision
FROM mcc_parts"""))
def q_ms03(spark, sf):
    labeled, _, thresholds, global_thr = _scored_splits(spark, sf)
    pred = CL.predict_labels(labeled.filter(F.col("split") == "test"), thresholds, global_thr)
    m = MT.multiclass_summary(pred)
    return m.select(*[r6(c) for c in m.columns])


# ------------------------------------------------------------------ forecast table, counterfactual

from . import report as R  # noqa: E402
from ..operators import counterfactual as CF  # noqa: E402
from ..operators import forecast as FC  # noqa: E402


def _forecast(spark, sf, labeled=None):
    labeled = labeled if labeled is not None else _labeled(spark, sf)
    return FC.predict_quantiles(labeled.filter(F.col("split") == "train"), labeled.filter(F.col("split") == "test"),
                                CFG)


@register("ml13_quantile_forecast", O.with_fragments(["fc"], """
SELECT driver_stint_id, event_name, LapNumber, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90
FROM fc"""))
def q_ml13(spark, sf):
    table = FC.ordered_predictions(_forecast(spark, sf))  # SO4
    return table.select("driver_stint_id", "event_name", "LapNumber", r6("p10"), r6("p50"), r6("p90"))


@register("so4_ordered_predictions", O.with_fragments(["fc"], """
SELECT driver_stint_id, event_name, LapNumber, row_number() OVER (ORDER BY driver_stint_id, LapNumber, event_name) AS ordinal FROM fc"""))
def q_so4(spark, sf):
    return FC.ordered_predictions(_forecast(spark, sf)).select("driver_stint_id", "event_name", "LapNumber", F.col("ordinal").cast("long").alias("ordinal"))


def _fc_joined(spark, sf):
    labeled = _labeled(spark, sf)
    return FC.with_actuals(_forecast(spark, sf, labeled), labeled.filter(F.col("split") == "test"))


@register("wn17_cliff_lead_time", O.with_fragments(["fc_act"], """
SELECT round(coalesce(avg(lead), 0.0), 6) AS cliff_lead_time_mean,
       round(coalesce(stddev_pop(lead), 0.0), 6) AS cliff_lead_time_std
FROM (SELECT CAST(greatest(cl - coalesce(wa, cl), 0) AS DOUBLE) AS lead
      FROM (SELECT driver_stint_id, min(CASE WHEN y > 1.0 THEN LapNumber END) AS cl,
                   min(CASE WHEN p90 > 1.0 THEN LapNumber END) AS wa FROM fc_act GROUP BY 1) s
      WHERE cl IS NOT NULL) x"""))
def q_wn17(spark, sf):
    m = FC.cliff_lead_time(_fc_joined(spark, sf), CFG)
    return m.select(*[r6(c) for c in m.columns])


@register("ms05_quantile_metrics", O.with_fragments(["fc_act"], """
SELECT round(avg(abs(y - p50)), 6) AS p50_mae_overall, round(avg(CAST(y <= p90 AS DOUBLE)), 6) AS p90_coverage,
       round(avg(CAST(y >= p10 AS DOUBLE)), 6) AS p10_coverage,
       round((avg(greatest(0.1 * (y - p10), (0.1 - 1.0) * (y - p10))) + avg(greatest(0.5 * (y - p50), (0.5 - 1.0) * (y - p50)))
              + avg(greatest(0.9 * (y - p90), (0.9 - 1.0) * (y - p90)))) / 3.0, 6) AS pinball_loss
FROM fc_act WHERE p50 IS NOT NULL"""))
def q_ms05(spark, sf):
    m = MT.quantile_metrics(_fc_joined(spark, sf).filter(F.col("p50").isNotNull()))
    return m.select(*[r6(c) for c in m.columns])


@register("ms06_mae_by_compound", O.with_fragments(["fc_act"], """
SELECT Compound, round(avg(abs(y - p50)), 6) AS mae, count(*) AS n FROM fc_act
WHERE p50 IS NOT NULL AND Compound IN ('HARD', 'MEDIUM', 'SOFT') GROUP BY Compound"""))
def q_ms06(spark, sf):
    j = _fc_joined(spark, sf).filter(F.col("p50").isNotNull() & F.col("Compound").isin("HARD", "MEDIUM", "SOFT"))
    return MT.mae_by_group(j).select("Compound", r6("mae"), "n")


def _cf_laps(spark, sf):
    labeled, _, thresholds, global_thr = _scored_splits(spark, sf)
    test = CL.predict_labels(labeled.filter(F.col("split") == "test"), thresholds, global_thr)
    curve = _forecast(spark, sf, labeled).select("driver_stint_id", "LapNumber", "p50")
    return test.join(curve, ["driver_stint_id", "LapNumber"], "left")


@register("cf3_per_race_deltas", O.with_fragments(["cf_race"], """
SELECT race_id, round(delta_pos, 6) AS delta_pos, is_wet, is_street FROM cf_race"""))
def q_cf3(spark, sf):
    return CF.per_race_deltas(_cf_laps(spark, sf), CFG).select("race_id", r6("delta_pos"), "is_wet", "is_street")


@register("cf4_per_driver_deltas", O.with_fragments(["cf_driver"], """
SELECT driver_id, race_id, driver, team, round(delta_pos, 6) AS delta_pos, is_wet, is_street FROM cf_driver"""))
def q_cf4(spark, sf):
    d = CF.per_driver_deltas(_cf_laps(spark, sf), CFG)
    return d.select("driver_id", "race_id", "driver", "team", r6("delta_pos"), "is_wet", "is_street")


@register("cf4_wet_before_cleaning", O.with_fragments(["cf_driver", "fs"], f"""
SELECT d.driver_id, round(d.delta_pos, 6) AS delta_pos, coalesce(w.wet, false) AS is_wet FROM cf_driver d
LEFT JOIN (SELECT event_name, Driver, bool_or(coalesce(Compound IN ({", ".join(f"'{c}'" for c in CFG.wet_compounds)}), false)) AS wet
           FROM fs WHERE split = 'test' GROUP BY ALL) w ON w.event_name = d.race_id AND w.Driver = d.driver"""))
def q_cf4_wet(spark, sf):
    """CF4 with PR15's flag from the laps before cleaning."""
    before = _fs(spark, sf).filter(F.col("split") == "test")
    return CF.per_driver_deltas(_cf_laps(spark, sf), CFG, wet_source=before).select("driver_id", r6("delta_pos"), "is_wet")


@register("cf5_per_team_deltas", O.with_fragments(["cf_team"], """
SELECT team_id, race_id, team, round(delta_pos, 6) AS delta_pos, is_wet, is_street FROM cf_team"""))
def q_cf5(spark, sf):
    t = CF.per_team_deltas(CF.per_driver_deltas(_cf_laps(spark, sf), CFG))
    return t.select("team_id", "race_id", "team", r6("delta_pos"), "is_wet", "is_street")


@register("ag21_race_summary", O.with_fragments(["cf_race"], O.entity_summary_sql("cf_race", "race",
                                                                                  "street_circuit_mean")))
def q_ag21(spark, sf):
    s = CF.aggregate_races(CF.per_race_deltas(_cf_laps(spark, sf), CFG))
    return s.select(*[r6(c) if t == "double" else c for c, t in s.dtypes])


@register("ag20_driver_summary", O.with_fragments(["cf_driver"], O.entity_summary_sql("cf_driver", "driver")))
def q_ag20(spark, sf):
    s = CF.aggregate_by_entity(CF.per_driver_deltas(_cf_laps(spark, sf), CFG), "driver")
    return s.select(*[r6(c) if t == "double" else c for c, t in s.dtypes])


@register("pr14_focus_team_summary", O.with_fragments(["cf_team"], O.entity_summary_sql(
    "(SELECT * FROM cf_team WHERE length(trim(lower(team))) > 0 AND (contains('red bull racing', trim(lower(team)))"
    " OR contains(trim(lower(team)), 'red bull racing')))", "team")))
def q_pr14(spark, sf):
    teams = CF.focus_team_filter(CF.per_team_deltas(CF.per_driver_deltas(_cf_laps(spark, sf), CFG)), CFG.focus_team)
    s = CF.aggregate_by_entity(teams, "team")
    return s.select(*[r6(c) if t == "double" else c for c, t in s.dtypes])


# ------------------------------------------------------------------ exploratory analysis (CP8) and plot tables (CP7)

from ..operators import explore as X  # noqa: E402


def _eda(spark, sf):
    """The exploratory frame: cleaned, labelled laps of all seasons."""
    return _labeled(spark, sf)


@register("ag22_stints_by_dimension", O.with_fragments(["ev_lab"], """
SELECT 'compound' AS dimension, c.value, CAST(coalesce(n, 0) AS BIGINT) AS n_stints
FROM (SELECT unnest(['SOFT', 'MEDIUM', 'HARD']) AS value) c
LEFT JOIN (SELECT Compound AS value, count(DISTINCT driver_stint_id) AS n FROM ev_lab WHERE Compound IS NOT NULL
           GROUP BY 1) x ON x.value = c.value
UNION ALL SELECT 'circuit', event_name, count(DISTINCT driver_stint_id) FROM ev_lab WHERE event_name IS NOT NULL GROUP BY 2
UNION ALL SELECT 'constructor', Team, count(DISTINCT driver_stint_id) FROM ev_lab WHERE Team IS NOT NULL GROUP BY 2
UNION ALL SELECT 'season', CAST(season AS VARCHAR), count(DISTINCT driver_stint_id) FROM ev_lab GROUP BY 2"""))
def q_ag22(spark, sf):
    return X.stints_by_dimension(_eda(spark, sf))


@register("ag24_stint_length_histogram", O.with_fragments(["ev_lab"], """
WITH l AS (SELECT Compound, driver_stint_id, max(tire_age_laps) AS length FROM ev_lab
           WHERE Compound IN ('SOFT', 'MEDIUM', 'HARD') GROUP BY ALL HAVING max(tire_age_laps) IS NOT NULL),
     r AS (SELECT Compound, CASE WHEN max(length) > min(length) THEN min(length) ELSE min(length) - 0.5 END AS a,
                  CASE WHEN max(length) > min(length) THEN max(length) ELSE max(length) + 0.5 END AS b
           FROM l GROUP BY Compound)
SELECT l.Compound, CAST(least(floor((l.length - r.a) * (20.0 / (r.b - r.a))), 19) AS INTEGER) AS bin, count(*) AS n
FROM l JOIN r ON r.Compound = l.Compound GROUP BY ALL"""))
def q_ag24(spark, sf):
    return X.stint_length_histogram(_eda(spark, sf))


def _box_sql(f):
    return f"""
SELECT Compound, '{f}' AS feature, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round((SELECT min({f}) FROM ev_lab e WHERE e.Compound = q.Compound AND e.{f} >= q.q1 - 1.5 * (q.q3 - q.q1)), 6) AS whislo,
       round((SELECT max({f}) FROM ev_lab e WHERE e.Compound = q.Compound AND e.{f} <= q.q3 + 1.5 * (q.q3 - q.q1)), 6) AS whishi
FROM (SELECT Compound, quantile_cont({f}, 0.25) AS q1, quantile_cont({f}, 0.5) AS med, quantile_cont({f}, 0.75) AS q3
      FROM ev_lab WHERE {f} IS NOT NULL AND Compound IS NOT NULL GROUP BY Compound) q"""


@register("ag25_box_stats", O.with_fragments(["ev_lab"], _box_sql("deg_velocity") + "\nUNION ALL" +
                                             _box_sql("deg_acceleration")))
def q_ag25(spark, sf):
    b = X.box_stats(_eda(spark, sf))
    return b.select("Compound", "feature", *[r6(c) for c in ["q1", "median", "q3", "whislo", "whishi"]])


@register("ag26_pit_now_rate_by_threat", O.with_fragments(["ev_lab"], """
SELECT undercut_threat, round(avg(CAST(pit_label = 2 AS DOUBLE)), 6) AS pit_now_rate FROM ev_lab GROUP BY 1"""))
def q_ag26(spark, sf):
    return X.pit_now_rate_by(_eda(spark, sf)).select("undercut_threat", r6("pit_now_rate"))


@register("ag27_dataset_summary", O.with_fragments(["ev_lab"], """
SELECT count(*) AS lap_rows, count(DISTINCT driver_stint_id) AS stints,
       array_to_string(list_sort(list_distinct(list(event_name))), ', ') AS circuits,
       array_to_string(list_sort(list_distinct(list(Team))), ', ') AS constructors,
       round(avg(CAST(pit_label = 2 AS DOUBLE)), 6) AS pit_now_prevalence,
       round(avg(CAST(pit_label = 1 AS DOUBLE)), 6) AS pit_soon_prevalence,
       round(avg(CAST(pit_label = 0 AS DOUBLE)), 6) AS stay_out_prevalence FROM ev_lab"""))
def q_ag27(spark, sf):
    s = X.dataset_summary(_eda(spark, sf))
    return s.select("lap_rows", "stints", "circuits", "constructors",
                    *[r6(c) for c in ["pit_now_prevalence", "pit_soon_prevalence", "stay_out_prevalence"]])


@register("ag28_delta_distribution", O.with_fragments(["cf_race"], """
SELECT s.subset, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(mean, 0.0), 6) AS mean,
       round(coalesce(std, 0.0), 6) AS std, round(coalesce(q1, 0.0), 6) AS q1, round(coalesce(med, 0.0), 6) AS median,
       round(coalesce(q3, 0.0), 6) AS q3
FROM (SELECT unnest(['all', 'dry', 'street']) AS subset) s LEFT JOIN (
  SELECT subset, count(*) AS n, avg(delta_pos) AS mean, stddev_pop(delta_pos) AS std,
         quantile_cont(delta_pos, 0.25) AS q1, quantile_cont(delta_pos, 0.5) AS med, quantile_cont(delta_pos, 0.75) AS q3
  FROM (SELECT 'all' AS subset, delta_pos FROM cf_race
        UNION ALL SELECT 'dry', delta_pos FROM cf_race WHERE is_wet = false
        UNION ALL SELECT 'street', delta_pos FROM cf_race WHERE is_street = true) u GROUP BY subset) d
  ON d.subset = s.subset"""))
def q_ag28(spark, sf):
    d = X.delta_distribution(CF.per_race_deltas(_cf_laps(spark, sf), CFG))
    return d.select("subset", "n", *[r6(c) for c in ["mean", "std", "q1", "median", "q3"]])


@register("so3_longest_stints", O.with_fragments(["ev_lab"], """
SELECT event_name, Compound, driver_stint_id, max_age FROM (
  SELECT *, row_number() OVER (PARTITION BY event_name, Compound ORDER BY max_age DESC, driver_stint_id) AS rn
  FROM (SELECT event_name, Compound, driver_stint_id, max(tire_age_laps) AS max_age FROM ev_lab
        WHERE Compound IN ('SOFT', 'MEDIUM', 'HARD') GROUP BY ALL HAVING max(tire_age_laps) IS NOT NULL) a) b
WHERE rn = 1"""))
def q_so3(spark, sf):
    return X.longest_stints(_eda(spark, sf)).select("event_name", "Compound", "driver_stint_id", "max_age")


@register("wn21_stint_spans", O.with_fragments(["ev_lab"], """
SELECT season, event_name, Driver, Stint, min(LapNumber) AS start_lap, max(LapNumber) - min(LapNumber) + 1 AS length,
       arg_min(Compound, LapNumber) AS compound FROM ev_lab WHERE split = 'test' GROUP BY ALL"""))
def q_wn21(spark, sf):
    return X.stint_spans(_eda(spark, sf).filter(F.col("split") == "test"))


@register("wn20_fixed_reference_baseline", O.with_fragments(["ev_lab"], """
SELECT driver_stint_id, LapNumber, round(_c - quantile_cont(CASE WHEN _len < 4 OR _n BETWEEN 2 AND 5 THEN _c END, 0.5)
                                         OVER (PARTITION BY driver_stint_id), 6) AS eda_lap_time_delta_s
FROM (SELECT *, LapTime_s - _n * 0.1495::DOUBLE AS _c FROM (
        SELECT *, row_number() OVER (PARTITION BY driver_stint_id ORDER BY LapNumber) AS _n,
               count(*) OVER (PARTITION BY driver_stint_id) AS _len FROM ev_lab) a) b"""))
def q_wn20(spark, sf):
    return X.fixed_reference_baseline(_eda(spark, sf), CFG).select("driver_stint_id", "LapNumber",
                                                                     r6("eda_lap_time_delta_s"))


@register("wn19_autocorrelation", O.with_fragments(["ev_lab"], """
WITH s AS (SELECT driver_stint_id, lap_time_delta_s AS x,
                  row_number() OVER (PARTITION BY driver_stint_id ORDER BY LapNumber) AS i,
                  count(*) OVER (PARTITION BY driver_stint_id) AS len
           FROM ev_lab WHERE lap_time_delta_s IS NOT NULL),
     lags AS (SELECT CAST(unnest(range(1, 16)) AS INTEGER) AS lag),
     pr AS (SELECT a.driver_stint_id, l.lag, a.x, b.x AS y FROM s a JOIN lags l ON a.len > l.lag + 2
            JOIN s b ON b.driver_stint_id = a.driver_stint_id AND b.i = a.i + l.lag),
     per AS (SELECT driver_stint_id, lag, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS r
             FROM pr GROUP BY ALL)
SELECT l.lag, round(avg(per.r), 6) AS mean_autocorr FROM lags l LEFT JOIN per ON per.lag = l.lag GROUP BY l.lag"""))
def q_wn19(spark, sf):
    return X.autocorrelation(_eda(spark, sf)).select("lag", r6("mean_autocorr"))


@register("ag30_eda_fingerprints", O.with_fragments(["ev_lab"], """
SELECT b.event_name, round(coalesce(s.avg_deg_rate, 0.0), 6) AS avg_deg_rate, round(m.cv, 6) AS compound_variance,
       round(b.track_temp_mean, 6) AS track_temp_mean, round(b.gap_mean, 6) AS gap_mean,
       round(so.soft, 6) AS hist_soft_stint_len, round(sc.f, 6) AS sc_vsc_frequency
FROM (SELECT event_name, avg(AirTemp) AS track_temp_mean, avg(gap_ahead_s) AS gap_mean FROM ev_lab GROUP BY 1) b
LEFT JOIN (SELECT event_name, avg(CASE WHEN n > 5 THEN sl END) AS avg_deg_rate FROM (
             SELECT event_name, Compound, count(*) AS n, regr_slope(lap_time_delta_s, tire_age_laps) AS sl FROM ev_lab
             WHERE Compound IN ('SOFT', 'MEDIUM', 'HARD') AND tire_age_laps IS NOT NULL AND lap_time_delta_s IS NOT NULL
             GROUP BY ALL) x GROUP BY 1) s ON s.event_name = b.event_name
LEFT JOIN (SELECT event_name, stddev_samp(mm) AS cv FROM (SELECT event_name, Compound, avg(lap_time_delta_s) AS mm
           FROM ev_lab WHERE Compound IS NOT NULL GROUP BY ALL) y GROUP BY 1) m ON m.event_name = b.event_name
LEFT JOIN (SELECT event_name, quantile_cont(a, 0.5) AS soft FROM (SELECT event_name, driver_stint_id,
           max(tire_age_laps) AS a FROM ev_lab WHERE Compound = 'SOFT' GROUP BY ALL) z GROUP BY 1) so
  ON so.event_name = b.event_name
LEFT JOIN (SELECT event_name, avg(h) AS f FROM (SELECT season, event_name, max(sc_or_vsc_flag) AS h FROM ev_lab
           GROUP BY ALL) w GROUP BY 1) sc ON sc.event_name = b.event_name"""))
def q_ag30(spark, sf):
    return X.eda_fingerprints(_eda(spark, sf)).select("event_name", *[r6(c) for c in X.EDA_FP_COLS])


@register("ml15_fingerprint_pca")
def q_ml15(spark, sf):
    return X.fingerprint_pca(X.eda_fingerprints(_eda(spark, sf))).select("event_name", r6("pc1"), r6("pc2"))


def _rank_expr(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) AS r_{c}"


def _spearman_sql() -> str:
    cols = X.CORR_COLS
    cc = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    ranks = ", ".join(_rank_expr(c) for c in cols)
    pairs = "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN '{a}' = '{b}' THEN 1.0 ELSE corr(r_{a}, r_{b}) END, 6) AS rho"
        f" FROM rk" for a in cols for b in cols)
    return f"WITH rk AS (SELECT {ranks} FROM (SELECT * FROM ev_lab WHERE {cc}) cc)\n{pairs}"


@register("ms09_spearman_matrix", O.with_fragments(["ev_lab"], _spearman_sql()))
def q_ms09(spark, sf):
    return X.spearman_matrix(_eda(spark, sf)).select("a", "b", r6("rho"))


def _anova_sql() -> str:
    parts = []
    for f in X.TEST_FEATURES:
        parts.append(f"""
SELECT '{f}' AS feature, CAST(k AS INTEGER) AS groups, round(fs, 6) AS anova_f,
       round(CASE WHEN k = 3 THEN pow(1.0 + 2.0 * fs / (n - k), -(n - k) / 2.0) END, 6) AS anova_p,
       round(h, 6) AS kruskal_h, round(CASE WHEN k = 3 THEN exp(-h / 2.0) END, 6) AS kruskal_p
FROM (SELECT k, n, (ssb / (k - 1)) / nullif(ssw / (n - k), 0.0) AS fs,
             (12.0 / (n * (n + 1.0)) * sr - 3 * (n + 1.0)) / nullif(1.0 - tt / (n * n * n - n), 0.0) AS h
      FROM (SELECT count(DISTINCT g) AS k, count(*)::DOUBLE AS n,
                   (SELECT sum(ng * pow(mg - mall, 2)) FROM (SELECT g, count(*) AS ng, avg(v) AS mg FROM s_{f} GROUP BY g) a,
                           (SELECT avg(v) AS mall FROM s_{f}) b) AS ssb,
                   (SELECT sum(pow(v - mg, 2)) FROM s_{f} JOIN (SELECT g AS gg, avg(v) AS mg FROM s_{f} GROUP BY g) c
                      ON c.gg = s_{f}.g) AS ssw,
                   (SELECT sum(pow(rs, 2) / ng) FROM (SELECT g, sum(r) AS rs, count(*) AS ng FROM
                      (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM s_{f}) q
                      GROUP BY g) t) AS sr,
                   (SELECT sum(pow(t, 3) - t) FROM (SELECT count(*)::DOUBLE AS t FROM s_{f} GROUP BY v) u) AS tt
            FROM s_{f}) m) z WHERE k >= 2""")
    srcs = ",\n".join(
        f"s_{f} AS (SELECT pit_label AS g, {f} AS v FROM ev_lab WHERE {f} IS NOT NULL AND pit_label IS NOT NULL "
        f"AND pit_label IN (SELECT pit_label FROM ev_lab WHERE {f} IS NOT NULL GROUP BY pit_label HAVING count(*) > 3))"
        for f in X.TEST_FEATURES)
    return f"WITH {srcs}\n" + "\nUNION ALL".join(parts)


@register("ms10_anova_kruskal", O.with_fragments(["ev_lab"], _anova_sql()))
def q_ms10(spark, sf):
    t = X.anova_kruskal(_eda(spark, sf))
    return t.select("feature", "groups", *[r6(c) for c in ["anova_f", "anova_p", "kruskal_h", "kruskal_p"]])


@register("so4_tests_by_p_value", O.with_fragments(["ev_lab"], f"""
SELECT feature, row_number() OVER (ORDER BY anova_p, feature) AS place, anova_p FROM ({_anova_sql()}) t"""))
def q_so4_tests(spark, sf):
    tests = X.ordered_tests(X.anova_kruskal(_eda(spark, sf)).withColumn("anova_p", F.round("anova_p", 6)))
    return tests.select("feature", F.col("place").cast("long").alias("place"), "anova_p")


@register("ag14_mean_quantile_curve", O.with_fragments(["fc"], """
SELECT event_name, LapNumber, round(avg(p10), 6) AS p10, round(avg(p50), 6) AS p50, round(avg(p90), 6) AS p90
FROM fc GROUP BY event_name, LapNumber"""))
def q_ag14(spark, sf):
    return FC.mean_curve(_forecast(spark, sf)).select("event_name", "LapNumber", r6("p10"), r6("p50"), r6("p90"))


@register("wn18_first_cliff_lap", O.with_fragments(["fc"], """
SELECT event_name, min(CASE WHEN p90 > 1.0 THEN LapNumber END) AS cliff_lap
FROM (SELECT event_name, LapNumber, avg(p90) AS p90 FROM fc GROUP BY ALL) c GROUP BY event_name"""))
def q_wn18(spark, sf):
    return FC.first_cliff_lap(FC.mean_curve(_forecast(spark, sf)), CFG)


def _trend_sql(points: str) -> str:
    """Least-squares cubic by orthogonal polynomials, step by step (the Spark side solves normal equations)."""
    return f"""WITH c AS ({points}),
ok AS (SELECT event_name FROM c GROUP BY event_name HAVING count(DISTINCT x) >= 4),
p AS (SELECT event_name, x, y, x - avg(x) OVER e AS q1, x * x AS x2, x * x * x AS x3 FROM c SEMI JOIN ok USING (event_name)
      WINDOW e AS (PARTITION BY event_name)),
p2 AS (SELECT *, x2 - avg(x2) OVER e - sum(x2 * q1) OVER e / sum(q1 * q1) OVER e * q1 AS q2 FROM p WINDOW e AS (PARTITION BY event_name)),
p3 AS (SELECT *, x3 - avg(x3) OVER e - sum(x3 * q1) OVER e / sum(q1 * q1) OVER e * q1
              - sum(x3 * q2) OVER e / sum(q2 * q2) OVER e * q2 AS q3 FROM p2 WINDOW e AS (PARTITION BY event_name))
SELECT event_name, CAST(x AS INTEGER) AS LapNumber,
       round(avg(y) OVER e + sum(y * q1) OVER e / sum(q1 * q1) OVER e * q1 + sum(y * q2) OVER e / sum(q2 * q2) OVER e * q2
             + sum(y * q3) OVER e / sum(q3 * q3) OVER e * q3, 5) AS trend FROM p3 WINDOW e AS (PARTITION BY event_name)"""


@register("ml14_cubic_trend", O.with_fragments(["fc"], _trend_sql(
    "SELECT event_name, CAST(LapNumber AS DOUBLE) AS x, avg(p50) AS y FROM fc GROUP BY event_name, LapNumber")))
def q_ml14(spark, sf):
    curve = FC.mean_curve(_forecast(spark, sf))
    return FC.trend_points(curve, FC.cubic_trend(curve)).select("event_name", "LapNumber", F.round("trend", 5).alias("trend"))


@register("st2_pit_annotations", O.with_fragments(["test_pred"], """
SELECT DISTINCT event_name, Driver, LapNumber, 'Actual pit' AS annotation_text FROM test_pred WHERE pit_label = 2
UNION SELECT DISTINCT event_name, Driver, LapNumber, 'Model pit' FROM test_pred WHERE pred_label = 2"""))
def q_st2(spark, sf):
    labeled, _, thresholds, global_thr = _scored_splits(spark, sf)
    test = CL.predict_labels(labeled.filter(F.col("split") == "test"), thresholds, global_thr)
    return R.pit_annotations(test)


@register("cp7_degradation_points", O.with_fragments(["ev_lab", "fc"], "WITH tr AS (" + _trend_sql(
    "SELECT event_name, CAST(LapNumber AS DOUBLE) AS x, avg(p50) AS y FROM fc GROUP BY event_name, LapNumber") + """),
a AS (SELECT event_name, unnest(['combined', Compound]) AS panel, LapNumber, lap_time_delta_s AS v, pit_label FROM ev_lab WHERE split = 'test'),
l AS (SELECT * FROM a WHERE panel IN ('SOFT', 'MEDIUM', 'HARD', 'combined')),
cu AS (SELECT event_name, LapNumber, avg(p10) AS p10, avg(p50) AS p50, avg(p90) AS p90 FROM fc GROUP BY ALL),
m AS (SELECT event_name, 'p10' AS series, LapNumber, p10 AS v FROM cu UNION ALL SELECT event_name, 'p50', LapNumber, p50 FROM cu
      UNION ALL SELECT event_name, 'p90', LapNumber, p90 FROM cu UNION ALL SELECT event_name, 'trend', LapNumber, trend FROM tr
      UNION ALL SELECT event_name, 'cliff', min(LapNumber), NULL FROM cu WHERE p90 > 1.0 GROUP BY event_name),
u AS (SELECT event_name, panel, 'actual' AS series, LapNumber, v FROM l
      UNION ALL SELECT DISTINCT event_name, panel, 'pit', LapNumber, CAST(NULL AS DOUBLE) FROM l WHERE pit_label = 2
      UNION ALL SELECT m.event_name, p.panel, series, LapNumber, v FROM m JOIN (SELECT DISTINCT event_name, panel FROM l) p USING (event_name))
SELECT event_name, panel, series, count(*) AS n, round(sum(v), 3) AS total, min(LapNumber) AS first_lap FROM u GROUP BY ALL"""))
def q_cp7_points(spark, sf):
    labeled = _labeled(spark, sf)
    points = R.degradation_points(labeled.filter(F.col("split") == "test"), _forecast(spark, sf, labeled), CFG)
    return points.groupBy("event_name", "panel", "series").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"), F.min("LapNumber").alias("first_lap"))


# ------------------------------------------------------------------ model panels

from ..operators import panels as PN  # noqa: E402


@register("wn14_global_lap_index", O.with_fragments(["ev_lab"], """
SELECT l.driver_stint_id, l.LapNumber, CAST(l.LapNumber + 1000 * s.o AS BIGINT) AS lap_number_global
FROM ev_lab l JOIN (SELECT season, event_name, session_type,
                           dense_rank() OVER (ORDER BY season, event_name, session_type) - 1 AS o
                    FROM (SELECT DISTINCT season, event_name, session_type FROM ev_lab) d) s
  ON s.season = l.season AND s.event_name = l.event_name AND s.session_type = l.session_type"""))
def q_wn14(spark, sf):
    return PN.add_global_lap_index(_labeled(spark, sf)).select("driver_stint_id", "LapNumber",
                                                                    "lap_number_global")


def _windows(spark, sf):
    return PN.build_lstm_windows(_labeled(spark, sf), CFG)


def _in_order(column):
    """Sum of the values times their place (from 1): another order gives another sum."""
    placed = F.transform(F.col(column), lambda v, i: v * (i + 1))
    return F.aggregate(placed, F.lit(0.0), lambda a, v: a + v)


def _steps_in_order(column):
    """The same over the steps of a sequence and the features of a step."""
    step = lambda s: F.aggregate(F.transform(s, lambda v, j: v * (j + 1)), F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.transform(F.col(column), lambda s, i: step(s) * (i + 1)), F.lit(0.0), lambda a, v: a + v)


@register("wn15_lstm_windows", O.with_fragments(["lstm_win"], """
SELECT driver_stint_id, LapNumber, y, w, CAST(n_steps AS INTEGER) AS n_steps, round(seq_sum, 6) AS seq_sum,
       round(seq_order, 5) AS seq_order, round(static_sum, 6) AS static_sum FROM lstm_win"""))
def q_wn15(spark, sf):
    w = _windows(spark, sf)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)
    return w.select("driver_stint_id", "LapNumber", "y", "w", F.size("seq").alias("n_steps"),
                    r6(total(F.flatten("seq")), "seq_sum"),
                    F.round(_steps_in_order("seq"), 5).alias("seq_order"), r6(total(F.col("static")), "static_sum"))


def _scaler_sql() -> str:
    seq = "\nUNION ALL ".join(
        f"SELECT 'seq' AS part, {i} AS idx, round(avg(r.{c}), 6) AS mean, "
        f"round(coalesce(nullif(stddev_pop(r.{c}), 0.0), 1.0), 6) AS scale FROM steps r"
        for i, c in enumerate(O.LSTM_SEQ))
    st = "\nUNION ALL ".join(
        f"SELECT 'static' AS part, {i} AS idx, round(avg(a.{c}), 6) AS mean, "
        f"round(coalesce(nullif(stddev_pop(a.{c}), 0.0), 1.0), 6) AS scale FROM anchors a"
        for i, c in enumerate(O.LSTM_STATIC))
    return f"""WITH anchors AS (SELECT i.* FROM imp i JOIN lstm_win w ON w.driver_stint_id = i.driver_stint_id
                          AND w.LapNumber = i.LapNumber WHERE w.split = 'train'),
     steps AS (SELECT i.* FROM (SELECT *, row_number() OVER (PARTITION BY driver_stint_id ORDER BY LapNumber) AS rn
                                FROM imp) i
               JOIN (SELECT * FROM lstm_win WHERE split = 'train') w ON w.driver_stint_id = i.driver_stint_id
                AND i.rn BETWEEN w.rn - 10 AND w.rn - 1)
{seq}
UNION ALL {st}"""


@register("ml11_window_scaler", O.with_fragments(["lstm_win", "imp"], _scaler_sql()))
def q_ml11(spark, sf):
    labeled = _labeled(spark, sf)
    train = PN.build_lstm_windows(labeled.filter(F.col("split") == "train"), CFG)
    return PN.fit_window_scaler(train).select("part", "idx", r6("mean"), r6("scale"))


# The configured maximum lengths; only the minimum lengths are lowered to the short stints of the data.
PANEL_CFG = CFG.replace(min_encoder_length=5, min_prediction_length=2)


@register("wn16_panel_windows")
def q_wn16(spark, sf):
    labeled = _labeled(spark, sf)
    cats = PN.panel_categories(labeled.filter(F.col("split") == "train"), PANEL_CFG)
    p = PN.build_panel(labeled, PANEL_CFG, cats)
    return p.select("driver_stint_id", "time_idx", F.size("encoder_target").alias("enc_len"),
                    F.size("decoder_target").alias("dec_len"), r6("target_center"), r6("target_scale"),
                    r6(_in_order("encoder_target"), "enc_order"), r6(_in_order("decoder_target"), "dec_order"),
                    "circuit_id_code", "compound_type_code", "team_id_code")


def _panel_sql() -> str:
    cats = [("circuit_id", "event_name"), ("compound_type", "Compound"), ("team_id", "Team")]
    codes = ",\n".join(
        f"c_{t} AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS code FROM "
        f"(SELECT DISTINCT coalesce({s}, 'unknown') AS label FROM ev_lab WHERE split = 'train') d)" for t, s in cats)
    joins = "\n".join(f"LEFT JOIN c_{t} ON c_{t}.label = f.{t}" for t, _ in cats)
    code_cols = ", ".join(f"coalesce(c_{t}.code, 0) AS {t}_code" for t, _ in cats)
    return f"""WITH {codes},
sess AS (SELECT season, event_name, session_type, dense_rank() OVER (ORDER BY season, event_name, session_type) - 1 AS o
         FROM (SELECT DISTINCT season, event_name, session_type FROM ev_lab) d),
pf AS (SELECT l.driver_stint_id, CAST(l.LapNumber + 1000 * s.o AS BIGINT) AS t, coalesce(l.lap_time_delta_s, 0.0) AS y,
              coalesce(l.event_name, 'unknown') AS circuit_id, coalesce(l.Compound, 'unknown') AS compound_type,
              coalesce(l.Team, 'unknown') AS team_id
       FROM ev_lab l JOIN sess s ON s.season = l.season AND s.event_name = l.event_name AND s.session_type = l.session_type),
grid AS (SELECT driver_stint_id, unnest(generate_series(min(t), max(t))) AS t FROM pf GROUP BY driver_stint_id),
ff AS (SELECT g.driver_stint_id, g.t,
              last_value(p.y IGNORE NULLS) OVER wf AS y, last_value(p.circuit_id IGNORE NULLS) OVER wf AS circuit_id,
              last_value(p.compound_type IGNORE NULLS) OVER wf AS compound_type,
              last_value(p.team_id IGNORE NULLS) OVER wf AS team_id
       FROM grid g LEFT JOIN pf p ON p.driver_stint_id = g.driver_stint_id AND p.t = g.t
       WINDOW wf AS (PARTITION BY g.driver_stint_id ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, count(y) OVER we AS enc_len, count(y) OVER wd AS dec_len, avg(y) OVER we AS center,
             list(y) OVER we AS enc, list(y) OVER wd AS dec,
             coalesce(nullif(stddev_pop(y) OVER we, 0.0), 1.0) AS scale
      FROM ff WINDOW we AS (PARTITION BY driver_stint_id ORDER BY t ROWS BETWEEN {CFG.encoder_length} PRECEDING AND 1 PRECEDING),
                     wd AS (PARTITION BY driver_stint_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {CFG.prediction_length - 1} FOLLOWING))
SELECT f.driver_stint_id, f.t AS time_idx, CAST(f.enc_len AS INTEGER) AS enc_len, CAST(f.dec_len AS INTEGER) AS dec_len,
       round(f.center, 6) AS target_center, round(f.scale, 6) AS target_scale,
       round(list_sum(list_transform(f.enc, lambda v, i: v * i)), 6) AS enc_order,
       round(list_sum(list_transform(f.dec, lambda v, i: v * i)), 6) AS dec_order, {code_cols}
FROM f {joins}
WHERE f.enc_len >= 5 AND f.dec_len >= 2"""


ORACLE["wn16_panel_windows"] = O.with_fragments(["ev_lab"], _panel_sql())


# ------------------------------------------------------------------ MLlib models (rows-only checks)

from ..operators import models as MD  # noqa: E402

@register("ml02_pit_model_validation_metrics")
def q_ml02(spark, sf):
    labeled = _labeled(spark, sf)
    model = CL.train_pit_model(labeled.filter(F.col("split") == "train"), labeled.filter(F.col("split") == "val"),
                               CFG)
    val = CL.build_pit_window_dataset(labeled.filter(F.col("split") == "val"), CFG, model.features)
    m = CL.binary_metrics(stage_once(model.predict_labels(val).select("y", "p", "pred_label"), "scored-val"))
    return m.select(*[r6(c) for c in m.columns])


@register("ml02_best_prefix", O.with_fragments(["ev_lab"], """
SELECT count(*) AS n_val, 0 AS n_off, true AS stopped_at_best FROM ev_lab
WHERE split = 'val' AND pit_label IN (0, 1, 2) AND loss_weight > 0"""))
def q_ml02_prefix(spark, sf):
    """ML02: the model is the prefix of least validation loss, and the contributions along its trees' paths sum to
    its margins (``n_off`` counts validation rows that differ)."""
    from pyspark.ml.functions import vector_to_array

    from ..operators import attribution as AT
    labeled = _labeled(spark, sf)
    split = {k: labeled.filter(F.col("split") == k) for k in ("train", "val")}
    model = CL.train_pit_model(split["train"], split["val"], CFG)
    assembler, boosted = model.pipeline.stages
    best, _ = CL.best_prefix(model.validation_losses, CFG.pit_gbt["patience"])
    key = ["season", "event_name", "Driver", "LapNumber"]
    rows = assembler.transform(CL.build_pit_window_dataset(split["val"], CFG, model.features)).select(*key, "features")
    phi = AT.tree_attributions(boosted, rows, model.features, key).groupBy(*key).agg(F.sum("phi").alias("sum"))
    margins = boosted.transform(rows).select(*key, vector_to_array("rawPrediction")[1].alias("margin"))
    off = F.count_if(F.coalesce(F.abs(F.col("sum") - F.col("margin")) > 1e-9, F.lit(True)))
    return margins.join(phi, key, "left").agg(F.count(F.lit(1)).alias("n_val"), off.cast("int").alias("n_off"),
                                              F.lit(boosted.getNumTrees == best).alias("stopped_at_best"))


@register("ml03_isotonic_calibration", O.with_fragments(["pw_val_pred"], """
WITH d AS (SELECT p, count(*) AS n, sum(y) AS s FROM pw_val_pred GROUP BY p),
     c AS (SELECT p, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER w - n AS n0, sum(s) OVER w - s AS s0 FROM d WINDOW w AS (ORDER BY p)),
     means AS (SELECT i.p, a.p AS a, min((b.s - a.s0)::DOUBLE / (b.n - a.n0)) AS low
               FROM c i JOIN c a ON a.p <= i.p JOIN c b ON b.p >= i.p GROUP BY i.p, a.p)
SELECT round(p, 6) AS p, round(max(low), 6) AS calibrated FROM means GROUP BY p"""))
def q_ml03(spark, sf):
    """ML03 on the baseline score: the calibrated value of every distinct validation score (in SQL: the largest of
    the least means of the runs around it)."""
    from ..operators.isotonic import Isotonic
    val = CL.baseline_pit_score(CL.build_pit_window_dataset(_labeled(spark, sf).filter(F.col("split") == "val"), CFG))
    return val.select("p").distinct().select(r6("p"), r6(Isotonic.fit(val).apply(F.col("p")), "calibrated"))


@register("ml07_compound_accuracy")
def q_ml07(spark, sf):
    data = _xgb(spark, sf)
    model = MD.train_compound_model(data, CFG)
    return MD.compound_accuracy(model, data, CFG).select(r6("accuracy"), "n_test")


@register("ml09_linear_attributions")
def q_ml09(spark, sf):
    phi = MD.linear_attributions(_xgb(spark, sf), CFG)
    return phi.groupBy("event_name", "feature", "class").agg(r6(F.avg("phi"), "mean_phi"),
                                                             F.count(F.lit(1)).alias("n"))


@register("ml09_tree_attribution_sums", O.with_fragments(["xgb"], f"""
SELECT 3 * count(*) AS n, 0 AS n_off FROM xgb WHERE label IS NOT NULL AND season = {CFG.test_season}"""))
def q_ml09_sums(spark, sf):
    """ML09 of the boosted recommender itself: for every test row and class the contributions sum to the margin."""
    data = _xgb(spark, sf)
    phi, margins = MD.boosted_attributions(MD.train_compound_model(data, CFG), data, CFG)
    key = ["_row", "class"]
    both = margins.join(phi.groupBy(*key).agg(F.sum("phi").alias("sum")), key, "left")
    off = F.count_if(F.coalesce(F.abs(F.col("sum") - F.col("margin")) > 1e-9, F.lit(True)))
    return both.agg(F.count(F.lit(1)).alias("n"), off.cast("int").alias("n_off"))


@register("ml10_boosted_recovery")
def q_ml10_boosted(spark, sf):
    """ML10 on the contributions of the boosted recommender."""
    data = _xgb(spark, sf)
    phi, _ = MD.boosted_attributions(MD.train_compound_model(data, CFG), data, CFG)
    return MD.heuristic_recovery(phi, CFG).select("heuristic", "passed")


@register("ml10_heuristic_recovery")
def q_ml10(spark, sf):
    phi = MD.linear_attributions(_xgb(spark, sf), CFG)
    return MD.heuristic_recovery(phi, CFG).select("heuristic", "passed")


@register("ml12_feature_ablations")
def q_ml12(spark, sf):
    labeled = _labeled(spark, sf)
    return MD.run_ablations(labeled.filter(F.col("split") == "train"), labeled.filter(F.col("split") == "val"),
                            labeled.filter(F.col("split") == "test"), CFG) \
        .select("ablation_name", r6("average_precision"), r6("f1"), r6("delta_average_precision"), r6("delta_f1"))


@register("ml10_recovery_summary")
def q_ml10_summary(spark, sf):
    return MD.recovery_summary(MD.heuristic_recovery(MD.linear_attributions(_xgb(spark, sf), CFG), CFG))


@register("cp7_attribution_ranking")
def q_cp7_ranking(spark, sf):
    rank = R.attribution_ranking(MD.linear_attributions(_xgb(spark, sf), CFG))
    return rank.select("event_name", "feature", r6("mean_abs_phi"), r6("mean_phi"), "place")


@register("cf3_trained_model_deltas")
def q_cf3_trained(spark, sf):
    """The evaluation path with the fitted classifier: its calibrated labels through CF3."""
    labeled = _labeled(spark, sf)
    split = {k: labeled.filter(F.col("split") == k) for k in ("train", "val", "test")}
    model = CL.train_pit_model(split["train"], split["val"], CFG)
    curve = _forecast(spark, sf, labeled).select("driver_stint_id", "LapNumber", "p50")
    test = model.predict_labels(split["test"]).join(curve, ["driver_stint_id", "LapNumber"], "left")
    return CF.per_race_deltas(test, CFG).select("race_id", r6("delta_pos"), "is_wet", "is_street")


# ------------------------------------------------------------------ sources and sinks

from ..sources import io as IO  # noqa: E402


@register("src12_season_event_codes", O.with_fragments(["laps"], """
SELECT season, event_name, CAST(dense_rank() OVER (PARTITION BY season ORDER BY event_name) - 1 AS INTEGER) AS circuit_id,
       n_laps FROM (SELECT season, event_name, count(*) AS n_laps FROM laps GROUP BY ALL) x"""))
def q_src12(spark, sf):
    coded = IO.season_event_codes(L.load_laps(spark, sf))
    return coded.groupBy("season", "event_name", "circuit_id").agg(F.count(F.lit(1)).alias("n_laps"))


@register("src11_load_status", O.with_fragments(["laps"], f"""
SELECT CAST(e.season AS INTEGER) AS season, CAST(coalesce(l.n, 0) AS BIGINT) AS loaded_sessions, CAST(coalesce(f.n, 0) AS BIGINT) AS failed_sessions,
       coalesce(f.n, 0) = 0 AND coalesce(l.n, 0) > 0 AS complete
FROM (SELECT DISTINCT season FROM (SELECT unnest(range(2018, 2024)) AS season UNION SELECT season FROM laps) s) e
LEFT JOIN (SELECT season, count(*) AS n FROM (SELECT DISTINCT season, event_name, session_type FROM laps) a GROUP BY 1) l
  ON l.season = e.season
LEFT JOIN (SELECT x.season, count(*) AS n FROM
             (SELECT s.season, c.event_name FROM (SELECT unnest(range(2018, 2024)) AS season) s,
                     (SELECT unnest({list(L.CIRCUITS)}) AS event_name) c) x
           WHERE NOT EXISTS (SELECT 1 FROM laps WHERE laps.season = x.season AND laps.event_name = x.event_name)
           GROUP BY 1) f ON f.season = e.season"""))
def q_src11(spark, sf):
    laps = L.load_laps(spark, sf)
    expected = spark.createDataFrame([(s, c, "R") for s in range(L.FIRST_SEASON, L.FIRST_SEASON + L.N_SEASONS)
                                      for c in L.CIRCUITS], "season int, event_name string, session_type string")
    return IO.load_status(laps, expected).select("season", "loaded_sessions", "failed_sessions", "complete")


@register("src6_selected_accurate_laps", O.with_fragments(["laps"], """
SELECT event_name, count(*) AS n_laps FROM laps
WHERE IsAccurate AND event_name IN ('Britain', 'Monaco', 'Singapore') GROUP BY 1"""))
def q_src6(spark, sf):
    laps = IO.accurate_laps(IO.select_circuits(L.load_laps(spark, sf), ["Britain", "Monaco", "Singapore"]))
    return laps.groupBy("event_name").agg(F.count(F.lit(1)).alias("n_laps"))


@register("src5_stage_roundtrip", O.with_fragments(["feat"], """
SELECT season, count(*) AS n_laps, round(sum(lap_time_delta_s), 6) AS sum_delta FROM feat GROUP BY season"""))
def q_src5(spark, sf):
    path = IO.fresh_stage_path(spark, "features")
    staged = IO.stage(spark, path, lambda: _feats(spark, sf), partition_by=["season"])
    return staged.groupBy("season").agg(F.count(F.lit(1)).alias("n_laps"), r6(F.sum("lap_time_delta_s"), "sum_delta"))


# ------------------------------------------------------------------ streaming ingestion (= batch result)

STREAMED = ["lap_time_delta_s", "deg_velocity", "deg_acceleration", "gap_ahead_s", "gap_ahead_trend", "track_evolution_delta",
            "undercut_threat", "lap_norm", "lap_count_norm", "sc_or_vsc_flag", "fuel_load_kg", "tire_age_sq"]


def _longest(spark, sf) -> float:
    """The fitted longest session, which a stream cannot know from its own batches."""
    return float(_laps(spark, sf).agg(F.max("LapNumber").alias("n")).first()["n"] or 1)


@register("stream_session_ingest", O.with_fragments(["feat"], "SELECT season, count(*) AS n_laps, " + ", ".join(
    f"round(sum({c}), 6) AS sum_{c}" for c in STREAMED) + " FROM feat GROUP BY season"))
def q_stream(spark, sf):
    from ..streaming import ingest as ST
    src = IO.fresh_stage_path(spark, "session-files")
    # one file per session (season, circuit), the unit the source ingests, from the stage table that also tells the longest session
    _laps(spark, sf).repartition("season", "event_name").write.partitionBy("season", "event_name").parquet(src)
    laps_schema = spark.read.parquet(src).schema
    sink = IO.fresh_stage_path(spark, "session-features")
    q = ST.start_session_ingest(spark, src, laps_schema, sink, IO.fresh_stage_path(spark, "stream-ckpt"), 
                                _longest(spark, sf), CFG, files_per_trigger=8)
    q.awaitTermination()
    out = ST.read_ingested(spark, sink)
    return out.groupBy("season").agg(F.count(F.lit(1)).alias("n_laps"), *[r6(F.sum(F.col(c).cast("double")), f"sum_{c}") for c in STREAMED])


# ------------------------------------------------------------------ metric report (MS08)

_MS08 = ["average_precision", "auc", "f1", "precision", "recall", "brier"]
ORACLE["ms08_metric_report"] = "WITH m AS (" + ORACLE["ms04_binary_metrics"] + ")\n" + "\nUNION ALL ".join(
    f"SELECT 'pit_window' AS section, '{c}' AS metric, {c} AS value, CAST(NULL AS VARCHAR) AS text, "
    f"CAST({CFG.metric_targets.get(c, 'NULL')} AS DOUBLE) AS target FROM m" for c in _MS08) + (
    "\nUNION ALL SELECT 'pit_window', 'policy', CAST(NULL AS DOUBLE), 'max-F1', CAST(NULL AS DOUBLE)")


@register("ms08_metric_report")
def q_ms08(spark, sf):
    labeled, val, thresholds, global_thr = _scored_splits(spark, sf)
    m = CL.binary_metrics(CL.predict_labels(val, thresholds, global_thr)).withColumn("policy", F.lit("max-F1"))
    rep = MT.metric_report(m, CFG, "pit_window")
    return rep.select("section", "metric", r6("value"), "text", "target")


@register("src1_split_tables", O.with_fragments(["laps"], """
SELECT season, count(*) AS n_laps, round(sum(LapTime), 6) AS sum_lap_time, count(PitInTime) AS n_pit_in,
       count(PitOutTime) AS n_pit_out FROM laps GROUP BY season"""))
def q_src1(spark, sf):
    """SRC1-SRC3, SRC9, SRC10: split tables written as stage parquet (test as CSV too),
    loaded all-or-nothing, CSV read back with the lap schema, unioned by name."""
    laps = L.load_laps(spark, sf)
    folder = IO.fresh_stage_path(spark, "splits")
    train, val, test = P.split_frames(laps, CFG)
    for name, frame in (("train", train), ("val", val), ("test", test)):
        IO.write_any(frame, f"{folder}/{name}_raw.parquet", partition_by=["season"])
    IO.write_any(test, f"{folder}/test_raw.csv")
    loaded = IO.load_splits(spark, folder, schema=L.LAP_SCHEMA)
    test_csv = IO.read_any(spark, f"{folder}/test_raw.csv", L.LAP_SCHEMA)
    both = IO.union_sessions([loaded[0], loaded[1], test_csv])
    return both.groupBy("season").agg(F.count(F.lit(1)).alias("n_laps"), r6(F.sum("LapTime"), "sum_lap_time"),
                                      F.count("PitInTime").alias("n_pit_in"), F.count("PitOutTime").alias("n_pit_out"))


@register("jn13_representative_stint_laps", O.with_fragments(["ev_lab"], """
SELECT driver_stint_id, LapNumber, round(tire_age_laps, 6) AS tire_age_laps, round(lap_time_delta_s, 6) AS lap_time_delta_s
FROM ev_lab WHERE driver_stint_id IN (
  SELECT driver_stint_id FROM (
    SELECT *, row_number() OVER (PARTITION BY event_name, Compound ORDER BY max_age DESC, driver_stint_id) AS rn
    FROM (SELECT event_name, Compound, driver_stint_id, max(tire_age_laps) AS max_age FROM ev_lab
          WHERE Compound IN ('SOFT', 'MEDIUM', 'HARD') GROUP BY ALL HAVING max(tire_age_laps) IS NOT NULL) a) b
  WHERE rn = 1)"""))
def q_jn13(spark, sf):
    laps = X.representative_stint_laps(_eda(spark, sf))
    return laps.select("driver_stint_id", "LapNumber", r6("tire_age_laps"), r6("lap_time_delta_s"))


# ------------------------------------------------------------------ null profile and gate (AG15, AG16)

#: every column of the feature table
PROFILED = [
    "season", "event_name", "session_type", "Driver", "Team", "LapNumber", "Stint", "PitInTime", "PitOutTime", "LapTime", "Time",
    "Position", "TyreLife", "Compound", "TrackStatus", "IsAccurate", "AirTemp", "TrackTemp", "Humidity", "LapTime_s", "driver_stint_id",
    "fuel_load_kg", "lap_time_delta_s", "deg_velocity", "deg_acceleration", "tire_age_laps", "tire_age_sq", "safety_car_flag",
    "vsc_flag", "sc_or_vsc_flag", "gap_ahead_s", "gap_ahead_trend", "undercut_threat", "track_evolution_delta", "lap_norm", "lap_count_norm"]


@register("ag15_null_profile", O.with_fragments(["feat"], "\nUNION ALL ".join(
    [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM feat" for c in PROFILED]
    + ["SELECT 'rows' AS column_name, count(*) AS null_count FROM feat"])))
def q_ag15(spark, sf):
    from ..operators.panels import null_profile
    feats = _feats(spark, sf).select(*PROFILED)
    prof = null_profile(feats)
    return prof.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("long").alias("null_count"))
                                           for c in ["rows"] + PROFILED])).alias("x")).select("x.*")


@register("ag16_null_fraction_gate", O.with_fragments(["feat"], """
SELECT round(avg(CAST(lap_time_delta_s IS NULL AS DOUBLE)), 6) AS lap_time_delta_s,
       round(avg(CAST(deg_acceleration IS NULL AS DOUBLE)), 6) AS deg_acceleration,
       round(avg(CAST(tire_age_laps IS NULL AS DOUBLE)), 6) AS tire_age_laps,
       round(avg(CAST(undercut_threat IS NULL AS DOUBLE)), 6) AS undercut_threat FROM feat"""))
def q_ag16(spark, sf):
    g = FE.null_fractions(_feats(spark, sf))
    return g.select(*[r6(c) for c in g.columns])


@register("ag09_fingerprint_ranges", O.with_fragments(["fp"], "SELECT " + ", ".join(
    f"round(coalesce(nullif(max({c}) - min({c}), 0.0), 1.0), 6) AS {c}" for c in FP_COLS) + " FROM fp"))
def q_ag09(spark, sf):
    r = FP.feature_ranges(_fingerprints(spark, sf))
    return r.select(*[r6(c) for c in FP_COLS])


# ------------------------------------------------------------------ single operators on the lap table

RAW_NAMES = {"Bahrain": " BAHRAIN Grand Prix", "Monaco": "Grand Prix de Monaco ", "Spain": "Spanish Grand Prix", "Britain": "Silverstone 70th",
             "Singapore": "Marina Bay, Singapore", "Qatar": "Qatar GP"}
_RAW_SQL = "CASE event_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RAW_NAMES.items()) + " END"


@register("pr06_canonical_names", O.with_fragments(["laps"], f"""
SELECT raw_name, {"CASE " + " ".join(f"WHEN contains(lower(trim(raw_name)), '{a}') THEN '{c}'" for a, c in C.EVENT_ALIASES) + " ELSE raw_name END"}
         AS event_name, n_laps FROM (SELECT {_RAW_SQL} AS raw_name, count(*) AS n_laps FROM laps GROUP BY 1) x"""))
def q_pr06(spark, sf):
    """PR06 + PR07: raw names as the feed spells them, taken from the first name column that has one."""
    from ..functions import scalars as S
    raw = S.literal_map(RAW_NAMES)[F.col("event_name")]
    feed = L.load_laps(spark, sf).select(F.lit(None).cast("string").alias("EventName"), raw.alias("OfficialEventName"), F.lit("?").alias("Country"))
    named = feed.select(S.event_name_from_columns(feed.columns).alias("raw_name"))
    return named.groupBy("raw_name").agg(F.count(F.lit(1)).alias("n_laps")) \
        .select("raw_name", S.canonical_event_name(F.col("raw_name")).alias("event_name"), "n_laps")


@register("pr01_seconds", O.with_fragments(["laps"], """
SELECT season, Driver, LapNumber, event_name, round(LapTime, 3) AS from_interval, round(LapTime, 3) AS from_text FROM laps"""))
def q_pr01(spark, sf):
    """PR01 on day-time intervals and on numbers spelled as text."""
    from ..functions import scalars as S
    laps = L.load_laps(spark, sf)
    t = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("LapTime").cast("decimal(18,6)"))
    raw = laps.select("season", "Driver", "LapNumber", "event_name", F.when(F.col("LapTime").isNotNull(), t).alias("i"),
                      F.coalesce(F.col("LapTime").cast("string"), F.lit("NaN")).alias("s"))
    return raw.select("season", "Driver", "LapNumber", "event_name", F.round(S.to_seconds_col(raw, "i"), 3).alias("from_interval"),
                      F.round(S.to_seconds_col(raw, "s"), 3).alias("from_text"))


@register("src4_fingerprint_roundtrip", ORACLE["cp5_circuit_fingerprints"])
def q_src4(spark, sf):
    path = IO.fresh_stage_path(spark, "fingerprints")
    FP.save_fingerprints(_fingerprints(spark, sf), path)
    return FP.load_fingerprints(spark, path).select("circuit_id", "event_name", *[r6(c) for c in FP_COLS])


@register("src8_tagged_sessions", O.with_fragments(["laps"], """
SELECT season, event_name, session_type, count(*) AS n_laps, round(sum(LapTime), 3) AS total FROM laps
WHERE event_name IN ('Bahrain', 'Monaco') AND season IN (2018, 2019) GROUP BY ALL"""))
def q_src8(spark, sf):
    """SRC8 + SRC9: laps of single sessions without keys, tagged and put together."""
    laps = L.load_laps(spark, sf)
    parts = [IO.tag_session(laps.filter((F.col("season") == s) & (F.col("event_name") == e)).drop("season", "event_name", "session_type"), s, e, "R")
             for s in (2018, 2019) for e in ("Bahrain", "Monaco")]
    return IO.union_sessions(parts).groupBy("season", "event_name", "session_type").agg(
        F.count(F.lit(1)).alias("n_laps"), F.round(F.sum("LapTime"), 3).alias("total"))


@register("src13_json_results", O.with_fragments(["laps"], """
SELECT Team, count(*) AS n_laps, round(avg(LapTime), 6) AS mean FROM laps GROUP BY Team"""))
def q_src13(spark, sf):
    path = IO.fresh_stage_path(spark, "results")
    result = L.load_laps(spark, sf).groupBy("Team").agg(F.count(F.lit(1)).alias("n_laps"), r6(F.avg("LapTime"), "mean"))
    IO.write_results_json(result.select(F.struct("*").alias("section")), path)
    return spark.read.schema("section struct<Team: string, n_laps: long, mean: double>").json(path).select("section.*")


@register("src11_complete_laps", O.with_fragments(["laps"], "SELECT season, count(*) AS n_laps FROM laps GROUP BY season"))
def q_src11_gate(spark, sf):
    """SRC11 in the load path: the sessions the calendar of the table names must all be there."""
    laps = L.load_laps(spark, sf)
    calendar = L.load_laps(spark, sf).select("season", "event_name", "session_type").distinct()
    return IO.load_complete(laps, calendar, "laps").groupBy("season").agg(F.count(F.lit(1)).alias("n_laps"))


@register("src11_missing_session", O.with_fragments(["laps"], f"""
WITH have AS (SELECT DISTINCT season, event_name FROM laps WHERE session_type = 'R'),
     want AS (SELECT s.season, e.event_name FROM (SELECT unnest(range({L.FIRST_SEASON}, {L.FIRST_SEASON + L.N_SEASONS})) AS season) s,
                     (SELECT unnest([{", ".join(f"'{c}'" for c in [*L.CIRCUITS, "Elsewhere"])}]) AS event_name) e)
SELECT CAST(season AS INTEGER) AS season, CAST(count(h.event_name) AS BIGINT) AS loaded_sessions,
       CAST(count(*) - count(h.event_name) AS BIGINT) AS failed_sessions, false AS complete
FROM want LEFT JOIN have h USING (season, event_name) GROUP BY season"""))
def q_src11_missing(spark, sf):
    """SRC11 against a calendar of its own that names one session more than was driven: every season reports it."""
    calendar = spark.createDataFrame([(s, c, "R") for s in range(L.FIRST_SEASON, L.FIRST_SEASON + L.N_SEASONS) for c in [*L.CIRCUITS, "Elsewhere"]],
                                     "season int, event_name string, session_type string")
    laps = L.load_laps(spark, sf).filter(F.col("session_type") == "R")
    return IO.load_status(laps, calendar).select("season", F.col("loaded_sessions").cast("long").alias("loaded_sessions"),
                                                 F.col("failed_sessions").cast("long").alias("failed_sessions"), "complete")


@register("jn04_undercut_of_one_session", O.with_fragments(["feat"], """
SELECT Driver, LapNumber, undercut_threat FROM feat WHERE season = 2019 AND event_name = 'Monaco' AND session_type = 'R'"""))
def q_jn04(spark, sf):
    """JN04: the undercut of a lap table without session columns (one session)."""
    one = _laps(spark, sf).filter((F.col("season") == 2019) & (F.col("event_name") == "Monaco") & (F.col("session_type") == "R"))
    return FE.add_undercut_threat(one.drop("season", "event_name", "session_type"), CFG).select("Driver", "LapNumber", "undercut_threat")


@register("pr17_model_frame", O.with_fragments(["ev_lab"], """
SELECT split, count(*) AS n, round(sum(coalesce(tire_age_laps, 0)), 6) AS tire_age_laps, round(sum(coalesce(deg_velocity, 0)), 6) AS deg_velocity,
       round(sum(coalesce(gap_ahead_s, 0)), 6) AS gap_ahead_s, 0.0 AS not_there FROM ev_lab GROUP BY split"""))
def q_pr17(spark, sf):
    """PR17: features as doubles without NULLs; one that the table lacks is 0."""
    names = ["tire_age_laps", "deg_velocity", "gap_ahead_s", "not_there"]
    frame = CL.model_frame(_labeled(spark, sf), names)
    return frame.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[r6(F.sum(c), c) for c in names])


@register("ml11_scaled_windows", O.with_fragments(["lstm_win", "imp"], "WITH raw AS (" + _scaler_sql() + """)
SELECT part, idx, 0.0 AS mean, CASE WHEN spread THEN 1.0 ELSE 0.0 END AS scale FROM (
  SELECT part, idx, scale <> 1.0 AS spread FROM raw) x"""))
def q_ml11_scaled(spark, sf):
    """ML11 applied: scaled training windows have mean 0 and deviation 1 in every feature that varies."""
    train = PN.build_lstm_windows(_labeled(spark, sf).filter(F.col("split") == "train"), CFG)
    scaled = PN.transform_windows(train, PN.fit_window_scaler(train))
    again = PN.fit_window_scaler(scaled)
    raw = PN.fit_window_scaler(train).select("part", "idx", (F.round("scale", 6) != 1.0).alias("varies"))
    return again.join(raw, ["part", "idx"]).select("part", "idx", (F.round("mean", 5) + 0.0).alias("mean"),
                                                   F.when(F.col("varies"), F.round("scale", 5)).otherwise(F.lit(0.0)).alias("scale"))


@register("src14_saved_model")
def q_src14(spark, sf):
    """SRC14: a saved and loaded pit model scores like the one that was saved."""
    labeled = _labeled(spark, sf)
    val = labeled.filter(F.col("split") == "val")
    model = CL.train_pit_model(labeled.filter(F.col("split") == "train"), val, CFG)
    path = IO.fresh_stage_path(spark, "model")
    model.save(path)
    again = CL.PitModel.load(spark, path)
    key = ["driver_stint_id", "LapNumber"]
    a = model.predict_labels(val).select(*key, F.col("p").alias("p1"), F.col("pred_label").alias("l1"))
    b = again.predict_labels(val).select(*key, F.col("p").alias("p2"), F.col("pred_label").alias("l2"))
    return a.join(b, key).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("p1") != F.col("p2")) | (F.col("l1") != F.col("l2"))).alias("n_differ"))
