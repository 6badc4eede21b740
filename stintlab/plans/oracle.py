"""DuckDB SQL for the correctness oracle.

Each query is ``WITH <named fragments> <final select>``; fragments are plain SQL over
the pre-registered driver tables. They are written independently of the Spark code
(joins and EXISTS where Spark uses windows), so the oracle checks the Spark plans.
Doubles are rounded to 6 dp in both engines before hashing.
"""

from __future__ import annotations

from ..sources.laps import CIRCUITS, COMPOUND_CYCLE, TEAMS

SK = "season, event_name, session_type"          # session keys
STK = "season, event_name, Driver, Stint"         # stint keys
DK = "season, event_name, session_type, Driver"   # driver keys
LK = "season, event_name, session_type, LapNumber"  # lap keys


def _case(expr: str, values) -> str:
    parts = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} {parts} ELSE NULL END"


FRAGMENTS: dict[str, str] = {}
DEPENDS: dict[str, list] = {}


def frag(name: str, deps: list, sql: str) -> None:
    FRAGMENTS[name] = sql
    DEPENDS[name] = deps


# ---------------------------------------------------------------- bridge: events -> laps
frag("ev", [], f"""
SELECT CAST(2018 + least(5, floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 432000)) AS INTEGER) AS season,
       {_case("CAST(user_id % 6 AS INTEGER)", CIRCUITS)} AS event_name,
       user_id, ts, event_id, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events""")

frag("laps_drv", ["ev"], f"""
SELECT season, event_name, 'R' AS session_type, CAST(user_id AS VARCHAR) AS Driver,
       {_case("CAST(user_id % 10 AS INTEGER)", TEAMS)} AS Team, user_id, k, ts,
       CAST(row_number() OVER wd AS INTEGER) AS LapNumber,
       CAST(1 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
            OVER (wd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS Stint,
       CASE WHEN event_type = 'purchase' THEN ts END AS PitInTime,
       CASE WHEN lag(event_type) OVER wd = 'purchase' THEN ts END AS PitOutTime,
       round(lt, 3) AS LapTime,
       round(sum(coalesce(lt, 0.0)) OVER (wd ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS Time,
       event_type <> 'error' AS IsAccurate
FROM (SELECT *, CASE WHEN k = 0 THEN NULL
                     WHEN k = 99 THEN 160.0::DOUBLE + least(value, 200.0::DOUBLE) / 10.0::DOUBLE
                     ELSE 80.0::DOUBLE + least(value, 200.0::DOUBLE) / 10.0::DOUBLE END AS lt FROM ev) e
WINDOW wd AS (PARTITION BY season, event_name, CAST(user_id AS VARCHAR) ORDER BY ts, event_id)""")

frag("laps", ["laps_drv"], f"""
SELECT season, event_name, session_type, Driver, Team, LapNumber, Stint, PitInTime, PitOutTime, LapTime, Time,
       CAST(row_number() OVER (PARTITION BY {LK} ORDER BY Time, Driver) AS DOUBLE) AS Position,
       CAST(row_number() OVER (PARTITION BY {STK} ORDER BY LapNumber) AS DOUBLE) AS TyreLife,
       {_case("CAST((user_id + CAST(Stint AS BIGINT)) % 7 AS INTEGER)", COMPOUND_CYCLE)} AS Compound,
       CASE WHEN k < 3 THEN '4' WHEN k = 3 THEN '14' WHEN k = 4 THEN '16' WHEN k <= 7 THEN '2'
            WHEN k = 8 THEN '6' ELSE '1' END AS TrackStatus,
       IsAccurate
FROM laps_drv""")

frag("weather", ["ev"], """
SELECT season, event_name, 'R' AS session_type,
       CAST(row_number() OVER (PARTITION BY season, event_name ORDER BY ts, event_id) * 60.0 AS DOUBLE) AS Time,
       CAST(18.0 + (k % 20) AS DOUBLE) AS AirTemp,
       round(CAST(18.0 + (k % 20) AS DOUBLE) + 8.0::DOUBLE + value / 25.0::DOUBLE, 2) AS TrackTemp,
       30.0::DOUBLE + k / 2.0::DOUBLE AS Humidity
FROM ev WHERE event_type = 'view'""")

frag("quali_raw", ["ev"], f"""
SELECT season, event_name, 'Q' AS session_type, CAST(user_id AS VARCHAR) AS Driver,
       {_case("CAST(user_id % 10 AS INTEGER)", TEAMS)} AS Team,
       CAST(row_number() OVER (PARTITION BY season, event_name, user_id ORDER BY ts, event_id) AS INTEGER) AS LapNumber,
       'Q' || CAST(1 + k % 3 AS VARCHAR) AS SessionPart,
       round(70.0::DOUBLE + least(value, 200.0::DOUBLE) / 20.0::DOUBLE, 3) AS LapTime,
       {_case("CAST(k % 7 AS INTEGER)", ["SOFT", "MEDIUM", "HARD", "SUPERSOFT", "SOFT", "MEDIUM"])} AS Compound,
       CAST(18.0 + (k % 20) AS DOUBLE) AS AirTemp,
       round(CAST(18.0 + (k % 20) AS DOUBLE) + 8.0::DOUBLE + value / 25.0::DOUBLE, 2) AS TrackTemp,
       30.0::DOUBLE + k / 2.0::DOUBLE AS Humidity,
       (k % 2) = 0 AS FreshTyre,
       CAST(1 + k % 4 AS DOUBLE) AS TyreLife
FROM ev WHERE event_type = 'click'""")

frag("laps_w", ["laps", "weather"], """
SELECT l.*,
       CASE WHEN f.Time IS NULL OR (b.Time IS NOT NULL AND l.Time - b.Time <= f.Time - l.Time) THEN b.AirTemp ELSE f.AirTemp END AS AirTemp,
       CASE WHEN f.Time IS NULL OR (b.Time IS NOT NULL AND l.Time - b.Time <= f.Time - l.Time) THEN b.TrackTemp ELSE f.TrackTemp END AS TrackTemp,
       CASE WHEN f.Time IS NULL OR (b.Time IS NOT NULL AND l.Time - b.Time <= f.Time - l.Time) THEN b.Humidity ELSE f.Humidity END AS Humidity
FROM laps l
ASOF LEFT JOIN weather b ON l.season = b.season AND l.event_name = b.event_name AND l.session_type = b.session_type
     AND l.Time >= b.Time
ASOF LEFT JOIN weather f ON l.season = f.season AND l.event_name = f.event_name AND l.session_type = f.session_type
     AND l.Time <= f.Time""")

# ---------------------------------------------------------------- features (CP1)
frag("f0", ["laps_w"], f"""
SELECT *, coalesce(CAST(season AS VARCHAR), 'nan') || '_' || coalesce(event_name, 'nan') || '_' ||
          coalesce(Driver, 'nan') || '_' || coalesce(CAST(Stint AS VARCHAR), 'nan') AS driver_stint_id,
       CASE WHEN LapNumber IS NULL THEN NULL
            ELSE greatest(0.0::DOUBLE, 110.0::DOUBLE - CAST(LapNumber AS DOUBLE) * 2.3::DOUBLE) END AS fuel_load_kg,
       CAST(LapTime AS DOUBLE) AS LapTime_s,
       row_number() OVER (PARTITION BY {STK} ORDER BY LapNumber) AS _n
FROM laps_w""")

frag("f1", ["f0"], f"""
SELECT *, quantile_cont(_ref, 0.5) OVER (PARTITION BY {STK}) AS _m
FROM (SELECT *, LapTime_s - _n * 0.1495::DOUBLE AS _c,
             CASE WHEN _n >= 2 THEN LapTime_s - _n * 0.1495::DOUBLE END AS _ref FROM f0) x""")

frag("f2", ["f1"], f"""
SELECT *, CASE WHEN _ref IS NULL THEN NULL
               ELSE least(greatest(_ref, _m - greatest(3.0::DOUBLE * _mad, 0.25::DOUBLE)),
                          _m + greatest(3.0::DOUBLE * _mad, 0.25::DOUBLE)) END AS _r
FROM (SELECT *, quantile_cont(abs(_ref - _m), 0.5) OVER (PARTITION BY {STK}) AS _mad FROM f1) x""")

frag("f3", ["f2"], f"""
SELECT *, first_value(_base IGNORE NULLS) OVER (PARTITION BY {STK} ORDER BY LapNumber
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _bf
FROM (SELECT *, quantile_cont(_r, 0.5) OVER (PARTITION BY {STK} ORDER BY LapNumber
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _base FROM f2) x""")

frag("f4", ["f3"], f"""
SELECT *, coalesce(deg_velocity - lag(deg_velocity) OVER (PARTITION BY {STK} ORDER BY LapNumber), 0.0) AS deg_acceleration
FROM (SELECT *, coalesce(lap_time_delta_s - lag(lap_time_delta_s) OVER (PARTITION BY {STK} ORDER BY LapNumber), 0.0)
                AS deg_velocity
      FROM (SELECT * EXCLUDE (_n, _c, _ref, _m, _mad, _r, _base, _bf),
                   _c - coalesce(_bf, _c) AS lap_time_delta_s FROM f3) a) b""")

frag("f5", ["f4"], f"""
SELECT * REPLACE (coalesce(TrackStatus, '') AS TrackStatus),
       CAST(TyreLife AS DOUBLE) AS tire_age_laps, pow(CAST(TyreLife AS DOUBLE), 2) AS tire_age_sq,
       CAST(regexp_matches(coalesce(TrackStatus, ''), '[45]') AS INTEGER) AS safety_car_flag,
       CAST(regexp_matches(coalesce(TrackStatus, ''), '[67]') AS INTEGER) AS vsc_flag,
       CAST(regexp_matches(coalesce(TrackStatus, ''), '[24567]') AS INTEGER) AS sc_or_vsc_flag,
       CASE WHEN Time IS NULL THEN NULL ELSE greatest(Time - min(Time) OVER (PARTITION BY {LK}), 0.0) END AS _gap
FROM f4""")

# Undercut as the pair semantics: exists a recent pit of another driver and that
# driver's gap on the current lap is within (0, 3.0).
frag("f_threat", ["f5"], f"""
SELECT DISTINCT c.season, c.event_name, c.session_type, c.LapNumber, c.Driver
FROM f5 c
JOIN f5 p ON p.season = c.season AND p.event_name = c.event_name AND p.session_type = c.session_type
         AND p.PitInTime IS NOT NULL AND p.LapNumber < c.LapNumber AND c.LapNumber - p.LapNumber <= 2
         AND p.Driver <> c.Driver
JOIN f5 r ON r.season = c.season AND r.event_name = c.event_name AND r.session_type = c.session_type
         AND r.LapNumber = c.LapNumber AND r.Driver = p.Driver
WHERE r._gap IS NOT NULL AND c._gap IS NOT NULL AND r._gap < c._gap AND c._gap - r._gap < 3.0::DOUBLE""")

frag("f6", ["f5", "f_threat"], f"""
SELECT f.*,
       CASE WHEN row_number() OVER wp = 1 THEN 0.0 WHEN f._gap IS NULL THEN 0.0
            ELSE coalesce(greatest(f._gap - lag(f._gap) OVER wp, 0.0), 0.0) END AS gap_ahead_s,
       CASE WHEN t.Driver IS NOT NULL THEN 1 ELSE 0 END AS undercut_threat,
       quantile_cont(f.LapTime_s + f.LapNumber * 0.1495::DOUBLE, 0.5) OVER (PARTITION BY f.season, f.event_name,
            f.session_type, f.LapNumber) AS _lap_median
FROM f5 f LEFT JOIN f_threat t ON t.season = f.season AND t.event_name = f.event_name
     AND t.session_type = f.session_type AND t.LapNumber = f.LapNumber AND t.Driver = f.Driver
WINDOW wp AS (PARTITION BY f.season, f.event_name, f.session_type, f.LapNumber
              ORDER BY f.Position ASC NULLS LAST, f.Driver ASC NULLS LAST)""")

frag("f7", ["f6"], f"""
SELECT f.* EXCLUDE (_gap, _lap_median),
       coalesce(f.gap_ahead_s - lag(f.gap_ahead_s, 3) OVER (PARTITION BY {', '.join('f.' + c.strip() for c in STK.split(','))}
                ORDER BY f.LapNumber), 0.0) AS gap_ahead_trend,
       l3.m3 - f._lap_median AS track_evolution_delta
FROM f6 f LEFT JOIN (SELECT {SK}, quantile_cont(LapTime_s + LapNumber * 0.1495::DOUBLE, 0.5) AS m3
                     FROM f6 WHERE LapNumber = 3 GROUP BY ALL) l3
     ON l3.season = f.season AND l3.event_name = f.event_name AND l3.session_type = f.session_type""")

# base features over the whole frame (lap_count_norm normalised over all seasons)
frag("feat", ["f7"], """
SELECT *, LapNumber / tl AS lap_norm, tl / max(tl) OVER () AS lap_count_norm
FROM (SELECT *, max(LapNumber) OVER (PARTITION BY season, event_name) AS tl FROM f7) x""")

# with split tag, per-split lap_count_norm, train-fitted encoders and SC probability
frag("feat_split0", ["f7"], """
SELECT * EXCLUDE (tl), LapNumber / tl AS lap_norm, tl / max(tl) OVER (PARTITION BY split) AS lap_count_norm
FROM (SELECT *, max(LapNumber) OVER (PARTITION BY season, event_name) AS tl,
             CASE WHEN season IN (2018, 2019, 2020, 2021) THEN 'train' WHEN season = 2022 THEN 'val'
                  WHEN season = 2023 THEN 'test' END AS split FROM f7) x""")

frag("enc_circuit", ["feat_split0"], """
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT coalesce(event_name, 'nan') AS label FROM feat_split0 WHERE split = 'train') x""")

frag("enc_team", ["feat_split0"], """
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT coalesce(Team, 'nan') AS label FROM feat_split0 WHERE split = 'train') x""")

frag("sc_prob", ["feat_split0"], """
SELECT event_name, avg(had_sc) AS historical_sc_prob
FROM (SELECT season, event_name, max(sc_or_vsc_flag) AS had_sc FROM feat_split0 WHERE split = 'train'
      GROUP BY season, event_name) r WHERE event_name IS NOT NULL GROUP BY event_name""")

frag("fs", ["feat_split0", "enc_circuit", "enc_team", "sc_prob"], """
SELECT f.*, coalesce(ec.code, -1) AS circuit_id_enc, coalesce(ec.code, -1) AS circuit_id,
       CAST(CASE f.Compound WHEN 'HARD' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'SOFT' THEN 2 ELSE -1 END AS INTEGER) AS compound_type,
       CAST(CASE f.Compound WHEN 'HARD' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'SOFT' THEN 2 ELSE -1 END AS INTEGER) AS compound_enc,
       coalesce(et.code, -1) AS team_id_enc, coalesce(et.code, -1) AS team_id,
       CAST(CASE WHEN f.TrackTemp < 30.0 THEN 0 WHEN f.TrackTemp <= 45.0 THEN 1 WHEN f.TrackTemp > 45.0 THEN 2
                 ELSE 1 END AS INTEGER) AS track_temp_category,
       coalesce(f.Position, 20.0) / 20.0 AS starting_position_norm,
       CASE f.event_name WHEN 'Bahrain' THEN 0.8 WHEN 'Monaco' THEN 0.2 WHEN 'Spain' THEN 0.8 WHEN 'Britain' THEN 0.6
            WHEN 'Singapore' THEN 0.6 WHEN 'Qatar' THEN 1.0 ELSE 0.5 END AS circuit_softness,
       coalesce(sp.historical_sc_prob, (SELECT avg(historical_sc_prob) FROM sc_prob)) AS historical_sc_prob
FROM feat_split0 f
LEFT JOIN enc_circuit ec ON ec.label = coalesce(f.event_name, 'nan')
LEFT JOIN enc_team et ON et.label = coalesce(f.Team, 'nan')
LEFT JOIN sc_prob sp ON sp.event_name = f.event_name""")


def with_fragments(needed: list, final_sql: str) -> str:
    """Build ``WITH`` clause of the transitive fragment closure, in dependency order."""
    order: list = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in DEPENDS[name]:
            visit(dep)
        order.append(name)

    for name in needed:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in order)
    body = final_sql.strip()
    if body.upper().startswith("WITH "):
        # the final query brings its own CTEs: append them to the fragment list
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{final_sql}"


# ---------------------------------------------------------------- labels / cleaning
def label_frags(prefix: str, src: str) -> str:
    """Register pit-label fragments over ``src``; returns the name of the labelled frame."""
    frag(f"{prefix}_src", [src], f"""
SELECT *, CASE WHEN max(CASE WHEN PitInTime IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {DK}) = 1
               THEN PitInTime IS NOT NULL
               ELSE coalesce(lead(Stint) OVER (PARTITION BY {DK} ORDER BY LapNumber) IS NOT NULL
                    AND lead(Stint) OVER (PARTITION BY {DK} ORDER BY LapNumber) IS DISTINCT FROM Stint, false)
          END AS _is_pit
FROM {src}""")
    frag(f"{prefix}_warn", [f"{prefix}_src"], f"""
SELECT DISTINCT a.season, a.event_name, a.session_type, a.Driver, a.LapNumber
FROM {prefix}_src a JOIN {prefix}_src p
  ON p.season = a.season AND p.event_name = a.event_name AND p.session_type = a.session_type AND p.Driver = a.Driver
 AND p._is_pit AND p.LapNumber BETWEEN a.LapNumber + 1 AND a.LapNumber + 3""")
    frag(prefix, [f"{prefix}_src", f"{prefix}_warn"], f"""
SELECT s.* EXCLUDE (_is_pit),
       CAST(CASE WHEN s._is_pit THEN 2 WHEN w.Driver IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS pit_label,
       CASE WHEN s.sc_or_vsc_flag = 1 THEN 0.0 ELSE 1.0 END AS loss_weight
FROM {prefix}_src s LEFT JOIN {prefix}_warn w
  ON w.season = s.season AND w.event_name = s.event_name AND w.session_type = s.session_type
 AND w.Driver = s.Driver AND w.LapNumber = s.LapNumber""")
    return prefix


def clean_frags(prefix: str, src: str) -> str:
    frag(prefix, [src], f"""
SELECT * EXCLUDE (_med) FROM (
  SELECT *, quantile_cont(LapTime_s, 0.5) OVER (PARTITION BY {STK}) AS _med
  FROM (SELECT *, CAST(PitOutTime IS NOT NULL AS INTEGER) AS is_pit_out_lap FROM {src}) a
  WHERE LapNumber > 1 AND NOT coalesce(Compound IN ('INTERMEDIATE', 'WET'), false)) b
WHERE (coalesce(LapTime_s <= _med * 1.35::DOUBLE, false) OR is_pit_out_lap = 1)
  AND LapTime_s IS NOT NULL AND LapTime_s > 0""")
    return prefix


TOP4 = "(contains('red bull', lower(coalesce(Team, ''))) OR contains(lower(coalesce(Team, '')), 'red bull') OR " \
       "contains('mercedes', lower(coalesce(Team, ''))) OR contains(lower(coalesce(Team, '')), 'mercedes') OR " \
       "contains('ferrari', lower(coalesce(Team, ''))) OR contains(lower(coalesce(Team, '')), 'ferrari') OR " \
       "contains('mclaren', lower(coalesce(Team, ''))) OR contains(lower(coalesce(Team, '')), 'mclaren'))"

label_frags("lab_all", "fs")                 # labels on all split features
clean_frags("cl_lab", "lab_all")             # CP4: label -> clean
clean_frags("cl_all", "fs")                  # CP3: clean -> label
label_frags("ev_lab", "cl_all")


# ---------------------------------------------------------------- fingerprints / LOCO
frag("fp_train", ["ev_lab"], "SELECT * FROM ev_lab WHERE split = 'train'")
frag("fp", ["fp_train"], """
SELECT CAST(b.circuit_id AS INTEGER) AS circuit_id, b.event_name,
       coalesce(d.avg_deg_rate, 0.0) AS avg_deg_rate, coalesce(d.compound_variance, 0.0) AS compound_variance,
       coalesce(a.tp, 0.0) AS track_temp_percentile,
       CASE b.event_name WHEN 'Bahrain' THEN 0.35 WHEN 'Monaco' THEN 0.05 WHEN 'Spain' THEN 0.35
            WHEN 'Britain' THEN 0.60 WHEN 'Singapore' THEN 0.08 WHEN 'Qatar' THEN 0.52 ELSE 0.35 END AS high_speed_fraction,
       coalesce(b.soft, 0.0) AS hist_soft_stint_len, CAST(s.freq AS DOUBLE) AS sc_vsc_frequency
FROM (SELECT circuit_id, min(event_name) AS event_name,
             quantile_cont(CASE WHEN Compound = 'SOFT' THEN CAST(TyreLife AS DOUBLE) END, 0.5) AS soft
      FROM fp_train WHERE circuit_id IS NOT NULL GROUP BY circuit_id) b
LEFT JOIN (SELECT circuit_id, avg(CASE WHEN n > 5 THEN slope END) AS avg_deg_rate, stddev_samp(m) AS compound_variance
           FROM (SELECT circuit_id, Compound, count(*) AS n, regr_slope(lap_time_delta_s, tire_age_laps) AS slope,
                        avg(lap_time_delta_s) AS m
                 FROM fp_train WHERE Compound IN ('SOFT', 'MEDIUM', 'HARD') AND circuit_id IS NOT NULL GROUP BY ALL) x
           GROUP BY circuit_id) d ON d.circuit_id = b.circuit_id
LEFT JOIN (SELECT circuit_id, avg(h) AS freq
           FROM (SELECT circuit_id, season, event_name, max(sc_or_vsc_flag) AS h FROM fp_train
                 WHERE circuit_id IS NOT NULL GROUP BY ALL) y GROUP BY circuit_id) s ON s.circuit_id = b.circuit_id
LEFT JOIN (SELECT event_name, a / max(a) OVER () AS tp
           FROM (SELECT event_name, avg(AirTemp) AS a FROM fp_train GROUP BY event_name) z) a ON a.event_name = b.event_name""")

FP_DIFF = " + ".join(f"CAST(a.{c} <> b.{c} AS INTEGER)" for c in
                     ["avg_deg_rate", "compound_variance", "track_temp_percentile", "high_speed_fraction",
                      "hist_soft_stint_len", "sc_vsc_frequency"])

frag("loco", ["fs", "fp"], f"""
SELECT h.circuit,
       (SELECT avg(abs(t.lap_time_delta_s - (SELECT quantile_cont(o.lap_time_delta_s, 0.5) FROM fs o
                                             WHERE o.split = 'train' AND o.event_name <> h.circuit)))
        FROM fs t WHERE t.split = 'test' AND t.event_name = h.circuit) AS mae_p50,
       (SELECT min(sqrt({FP_DIFF})) FROM fp a JOIN fp b ON a.event_name <> b.event_name WHERE a.event_name = h.circuit) AS fingerprint_distance,
       CASE WHEN h.circuit IN ('Monaco', 'Singapore') THEN 'street' ELSE 'permanent' END AS circuit_type
FROM (SELECT DISTINCT event_name AS circuit FROM fs WHERE split = 'test'
      AND event_name IN (SELECT event_name FROM fp)) h""")


# ---------------------------------------------------------------- qualifying / compound dataset
frag("q2c", ["quali_raw"], """
SELECT season, event_name, Driver, Compound AS q2_compound FROM (
  SELECT *, row_number() OVER (PARTITION BY season, event_name, Driver
                               ORDER BY LapTime IS NULL, LapTime, LapNumber) AS rn
  FROM quali_raw WHERE SessionPart = 'Q2' AND Compound IS NOT NULL) x WHERE rn = 1""")
frag("quali", ["quali_raw", "q2c"], """
SELECT q.*, c.q2_compound FROM quali_raw q
LEFT JOIN q2c c ON c.season = q.season AND c.event_name = q.event_name AND c.Driver = q.Driver
WHERE q.SessionPart IN ('Q2', 'Q3')""")
frag("xgb", ["quali", "fp"], """
SELECT q.season, q.event_name, q.Driver,
       coalesce(f.avg_deg_rate, 0.0) AS avg_deg_rate, coalesce(f.compound_variance, 0.0) AS compound_variance,
       coalesce(f.track_temp_percentile, 0.0) AS track_temp_percentile,
       coalesce(f.high_speed_fraction, 0.0) AS high_speed_fraction,
       coalesce(f.hist_soft_stint_len, 0.0) AS hist_soft_stint_len,
       coalesce(f.sc_vsc_frequency, 0.0) AS sc_vsc_frequency,
       coalesce(q.AirTemp, 0.0) AS AirTemp, coalesce(q.Humidity, 0.0) AS Humidity,
       coalesce(q.TrackTemp, 0.0) AS TrackTemp, coalesce(CAST(q.FreshTyre AS DOUBLE), 0.0) AS FreshTyre,
       coalesce(q.TyreLife, 0.0) AS TyreLife,
       coalesce(q.LapTime - min(q.LapTime) OVER (PARTITION BY q.season, q.event_name), 0.0) AS qualifying_pace_delta_s,
       CAST(CASE upper(coalesce(q.q2_compound, '')) WHEN 'HARD' THEN 0 WHEN 'SUPERHARD' THEN 0 WHEN 'MEDIUM' THEN 1
            WHEN 'SOFT' THEN 2 WHEN 'SUPERSOFT' THEN 2 WHEN 'ULTRASOFT' THEN 2 WHEN 'HYPERSOFT' THEN 2 END AS INTEGER) AS label
FROM quali q LEFT JOIN fp f ON f.event_name = q.event_name""")


# ---------------------------------------------------------------- pit-window dataset, thresholds, metrics
frag("pw", ["ev_lab"], """
SELECT *, CAST(pit_label IN (1, 2) AS INTEGER) AS y,
       round(coalesce(tire_age_laps, 0.0) / (coalesce(tire_age_laps, 0.0) + 5.0::DOUBLE), 6) AS p
FROM ev_lab WHERE pit_label IN (0, 1, 2) AND loss_weight > 0""")
frag("pw_val", ["pw"], "SELECT * FROM pw WHERE split = 'val'")

# brute force: every distinct score against every row of its group
frag("thr_cand", ["pw_val"], """
SELECT g, s, round(2.0 * prec * rec / (prec + rec + 1e-9), 12) AS f1, P FROM (
  SELECT d.g, d.s,
         sum(CASE WHEN v.p >= d.s AND v.y = 1 THEN 1 ELSE 0 END)::DOUBLE
           / sum(CASE WHEN v.p >= d.s THEN 1 ELSE 0 END) AS prec,
         CASE WHEN sum(v.y) = 0 THEN 1.0
              ELSE sum(CASE WHEN v.p >= d.s AND v.y = 1 THEN 1 ELSE 0 END)::DOUBLE / sum(v.y) END AS rec,
         sum(v.y) AS P
  FROM (SELECT DISTINCT '*' AS g, p AS s FROM pw_val
        UNION ALL SELECT DISTINCT CAST(event_name AS VARCHAR) AS g, p AS s FROM pw_val) d
  JOIN (SELECT '*' AS g, p, y FROM pw_val UNION ALL SELECT CAST(event_name AS VARCHAR) AS g, p, y FROM pw_val) v
    ON v.g = d.g
  GROUP BY d.g, d.s) x""")
frag("thr_best", ["thr_cand"], """
SELECT g, s AS threshold, f1, P AS positives FROM (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, s ASC) AS rn FROM thr_cand) x WHERE rn = 1""")
frag("thr_circuit", ["thr_best", "pw_val"], """
SELECT c.g AS event_name,
       CASE WHEN coalesce(b.positives, 0) > 0 THEN b.threshold
            ELSE (SELECT threshold FROM thr_best WHERE g = '*') END AS threshold
FROM (SELECT DISTINCT CAST(event_name AS VARCHAR) AS g FROM pw_val
      UNION SELECT unnest(['Bahrain', 'Britain', 'Spain', 'Italy', 'Monaco', 'Singapore'])) c
LEFT JOIN thr_best b ON b.g = c.g""")
frag("pred_all", ["ev_lab", "thr_circuit", "thr_best"], """
SELECT l.*, round(coalesce(l.tire_age_laps, 0.0) / (coalesce(l.tire_age_laps, 0.0) + 5.0::DOUBLE), 6) AS p,
       CAST(CASE WHEN round(coalesce(l.tire_age_laps, 0.0) / (coalesce(l.tire_age_laps, 0.0) + 5.0::DOUBLE), 6)
                      >= coalesce(t.threshold, (SELECT threshold FROM thr_best WHERE g = '*')) THEN 2 ELSE 0 END
            AS INTEGER) AS pred_label
FROM ev_lab l LEFT JOIN thr_circuit t ON t.event_name = CAST(l.event_name AS VARCHAR)""")
frag("pw_val_pred", ["pred_all"], """
SELECT *, CAST(pit_label IN (1, 2) AS INTEGER) AS y FROM pred_all
WHERE split = 'val' AND pit_label IN (0, 1, 2) AND loss_weight > 0""")
frag("test_pred", ["pred_all"], "SELECT * FROM pred_all WHERE split = 'test'")
frag("rep", ["test_pred"], """
SELECT coalesce(t.label, p.label) AS label, coalesce(t.support, 0) AS support,
       coalesce(p.predicted, 0) AS predicted, coalesce(c.tp, 0) AS tp
FROM (SELECT pit_label AS label, count(*) AS support FROM test_pred GROUP BY 1) t
FULL JOIN (SELECT pred_label AS label, count(*) AS predicted FROM test_pred GROUP BY 1) p ON p.label = t.label
LEFT JOIN (SELECT pit_label AS label, count(*) AS tp FROM test_pred WHERE pit_label = pred_label GROUP BY 1) c
  ON c.label = coalesce(t.label, p.label)""")
frag("rep2", ["rep"], """
SELECT label, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
       coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0) AS f1, support FROM rep""")
frag("mcc_parts", ["test_pred"], """
SELECT * FROM
 (SELECT sum(CASE WHEN pit_label = pred_label THEN 1 ELSE 0 END)::DOUBLE AS c, count(*)::DOUBLE AS s FROM test_pred) m,
 (SELECT sum(t_k::DOUBLE * p_k) AS tp_sum, sum(p_k::DOUBLE * p_k) AS pp, sum(t_k::DOUBLE * t_k) AS tt,
         sum(CASE WHEN t_k > 0 THEN 1 ELSE 0 END) AS n_true
  FROM (SELECT coalesce(t.k, p.k) AS k, coalesce(t_k, 0) AS t_k, coalesce(p_k, 0) AS p_k
        FROM (SELECT pit_label AS k, count(*) AS t_k FROM test_pred GROUP BY 1) t
        FULL JOIN (SELECT pred_label AS k, count(*) AS p_k FROM test_pred GROUP BY 1) p ON p.k = t.k) k) kk""")


# ---------------------------------------------------------------- forecast table and evaluation
def _fq(keys: str) -> str:
    return f"""
SELECT {keys}, quantile_cont(lap_time_delta_s, 0.1) AS q0, quantile_cont(lap_time_delta_s, 0.5) AS q1,
       quantile_cont(lap_time_delta_s, 0.9) AS q2
FROM ev_lab WHERE split = 'train' AND lap_time_delta_s IS NOT NULL GROUP BY {keys}"""


frag("fq1", ["ev_lab"], _fq("event_name, Compound, tire_age_laps"))
frag("fq2", ["ev_lab"], _fq("Compound, tire_age_laps"))
frag("fq3", ["ev_lab"], _fq("tire_age_laps"))
frag("fc", ["fq1", "fq2", "fq3", "ev_lab"], """
SELECT t.driver_stint_id, t.event_name, t.LapNumber, avg(coalesce(a.q0, b.q0, c.q0)) AS p10,
       avg(coalesce(a.q1, b.q1, c.q1)) AS p50, avg(coalesce(a.q2, b.q2, c.q2)) AS p90
FROM (SELECT * FROM ev_lab WHERE split = 'test') t
LEFT JOIN fq1 a ON a.event_name = t.event_name AND a.Compound = t.Compound AND a.tire_age_laps = t.tire_age_laps
LEFT JOIN fq2 b ON b.Compound = t.Compound AND b.tire_age_laps = t.tire_age_laps
LEFT JOIN fq3 c ON c.tire_age_laps = t.tire_age_laps
WHERE coalesce(a.q1, b.q1, c.q1) IS NOT NULL
GROUP BY t.driver_stint_id, t.event_name, t.LapNumber""")
frag("fc_act", ["fc", "ev_lab"], """
SELECT t.driver_stint_id, t.LapNumber, t.Compound, t.sc_or_vsc_flag, t.lap_time_delta_s AS y, f.p10, f.p50, f.p90
FROM (SELECT * FROM ev_lab WHERE split = 'test') t LEFT JOIN fc f
  ON f.driver_stint_id = t.driver_stint_id AND f.LapNumber = t.LapNumber""")

# ---------------------------------------------------------------- counterfactual
frag("cf_rows", ["test_pred", "fc"], """
SELECT l.*, f.p50 FROM test_pred l LEFT JOIN fc f ON f.driver_stint_id = l.driver_stint_id AND f.LapNumber = l.LapNumber""")
frag("cf_hist", ["cf_rows"], """
SELECT p.event_name, p.Driver, p.driver_stint_id, p.LapNumber, p.lap_time_delta_s AS d, p.p50 AS p50_here,
       p.pred_label AS pr, p.sc_or_vsc_flag AS sc,
       max(CASE WHEN h.sc_or_vsc_flag = 1 AND h.pred_label = 2 THEN 1 ELSE 0 END) AS sc_call,
       min(CASE WHEN h.pred_label = 2 AND h.sc_or_vsc_flag = 0 THEN h.LapNumber END) AS q_lap
FROM cf_rows p JOIN cf_rows h ON h.driver_stint_id = p.driver_stint_id AND h.LapNumber <= p.LapNumber
WHERE p.pit_label = 2
GROUP BY p.event_name, p.Driver, p.driver_stint_id, p.LapNumber, p.lap_time_delta_s, p.p50, p.pred_label, p.sc_or_vsc_flag""")
frag("cf_contrib", ["cf_hist", "cf_rows"], """
SELECT c.*,
  CASE WHEN c.sc_call = 1 THEN 0.0
       WHEN c.q_lap IS NOT NULL THEN
         CASE WHEN c.q_lap < c.LapNumber AND greatest(c.d - coalesce(q.p50, q.lap_time_delta_s), 0.0) >= 0.0
              THEN greatest(c.d - coalesce(q.p50, q.lap_time_delta_s), 0.0) / 22.0 ELSE 0.0 END
       WHEN c.pr = 0 AND c.sc = 0 THEN -greatest(c.d - coalesce(c.p50_here, c.d), 0.0) / 22.0
       ELSE 0.0 END AS contribution
FROM cf_hist c LEFT JOIN cf_rows q ON q.driver_stint_id = c.driver_stint_id AND q.LapNumber = c.q_lap""")
frag("cf_race", ["cf_contrib", "test_pred"], """
SELECT u.event_name AS race_id, least(greatest(coalesce(s.total, 0.0), -5.0), 5.0) AS delta_pos, u.is_wet,
       u.event_name IN ('Monaco', 'Singapore') AS is_street
FROM (SELECT event_name, bool_or(coalesce(Compound IN ('INTERMEDIATE', 'WET'), false)) AS is_wet
      FROM test_pred GROUP BY event_name) u
LEFT JOIN (SELECT event_name, sum(contribution) AS total FROM cf_contrib GROUP BY event_name) s
  ON s.event_name = u.event_name""")
frag("cf_driver", ["cf_contrib", "test_pred"], """
SELECT u.event_name || '_' || u.Driver AS driver_id, u.event_name AS race_id, u.Driver AS driver,
       coalesce(u.team, 'unknown') AS team,
       least(greatest(coalesce(s.total, 0.0), -5.0), 5.0) AS delta_pos, u.is_wet,
       u.event_name IN ('Monaco', 'Singapore') AS is_street
FROM (SELECT event_name, Driver, bool_or(coalesce(Compound IN ('INTERMEDIATE', 'WET'), false)) AS is_wet,
             arg_min(Team, LapNumber) FILTER (WHERE Team IS NOT NULL) AS team
      FROM test_pred GROUP BY event_name, Driver) u
LEFT JOIN (SELECT event_name, Driver, sum(contribution) AS total FROM cf_contrib GROUP BY event_name, Driver) s
  ON s.event_name = u.event_name AND s.Driver = u.Driver""")
frag("cf_team", ["cf_driver"], """
SELECT race_id || '_' || team AS team_id, race_id, team, sum(delta_pos) AS delta_pos,
       arg_min(is_wet, driver) AS is_wet, arg_min(is_street, driver) AS is_street
FROM cf_driver GROUP BY race_id, team""")


def entity_summary_sql(src: str, entity: str, street_name: str | None = None) -> str:
    street = street_name or f"street_{entity}_mean"
    return f"""
SELECT round(coalesce(avg(delta_pos), 0.0), 6) AS mean_delta_pos,
       round(coalesce(stddev_pop(delta_pos), 0.0), 6) AS std_delta_pos,
       round(coalesce(median(delta_pos), 0.0), 6) AS median_delta_pos,
       CAST(count(*) FILTER (WHERE delta_pos > 0.1) AS BIGINT) AS {entity}s_positive,
       CAST(count(*) FILTER (WHERE delta_pos < -0.1) AS BIGINT) AS {entity}s_negative,
       CAST(count(*) FILTER (WHERE abs(delta_pos) < 0.1) AS BIGINT) AS {entity}s_neutral,
       round(coalesce(avg(delta_pos) FILTER (WHERE is_wet = false), 0.0), 6) AS dry_{entity}_mean,
       round(coalesce(avg(delta_pos) FILTER (WHERE is_street = true), 0.0), 6) AS {street},
       round(coalesce(avg(delta_pos) FILTER (WHERE is_wet = true), 0.0), 6) AS wet_{entity}_mean
FROM {src}"""


# ---------------------------------------------------------------- panels
LSTM_SEQ = ["lap_time_delta_s", "deg_velocity", "deg_acceleration", "tire_age_laps", "tire_age_sq", "fuel_load_kg",
            "gap_ahead_s", "gap_ahead_trend", "undercut_threat", "sc_or_vsc_flag", "lap_norm", "Position"]
LSTM_STATIC = ["circuit_id_enc", "compound_enc", "starting_position_norm", "circuit_softness", "track_temp_category",
               "historical_sc_prob", "team_id_enc", "lap_count_norm"]

frag("imp", ["ev_lab"], "SELECT * REPLACE (" + ", ".join(
    [f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in LSTM_SEQ + LSTM_STATIC
     if c not in ("tire_age_laps", "tire_age_sq")] +
    ["coalesce(tire_age_laps, CAST(row_number() OVER (PARTITION BY driver_stint_id ORDER BY LapNumber) AS DOUBLE)) "
     "AS tire_age_laps",
     "coalesce(tire_age_sq, pow(coalesce(tire_age_laps, CAST(row_number() OVER (PARTITION BY driver_stint_id "
     "ORDER BY LapNumber) AS DOUBLE)), 2)) AS tire_age_sq"]) + ") FROM ev_lab")
frag("lstm_win", ["imp"], f"""
SELECT driver_stint_id, LapNumber, split, CAST(pit_label AS INTEGER) AS y, CAST(loss_weight AS DOUBLE) AS w,
       count(*) OVER wn AS n_steps,
       sum({' + '.join(LSTM_SEQ)}) OVER wn AS seq_sum,
       list_sum(list_transform(list({' + '.join(f'{k + 1} * {c}' for k, c in enumerate(LSTM_SEQ))}) OVER wn, lambda v, i: v * i)) AS seq_order,
       {' + '.join(LSTM_STATIC)} AS static_sum, rn
FROM (SELECT *, row_number() OVER (PARTITION BY driver_stint_id ORDER BY LapNumber) AS rn FROM imp) x
WINDOW wn AS (PARTITION BY driver_stint_id ORDER BY LapNumber ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
QUALIFY count(*) OVER wn = 10 AND LapNumber > 3""")
