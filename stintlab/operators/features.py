"""Stint-aware lap features (DataFrame -> DataFrame, usable with ``df.transform``).

Partitioning plan (see README): per-driver/stint windows share one hash partitioning on
(season, event_name, Driver). Values over a lap or a session (leader's time, medians,
session length, maxima) are partial aggregates joined back; what needs an order within a
lap is cut into runs of places or steps of the gap. No window spans a lap or a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from ..sources.laps import SESSION_KEYS, STINT_KEYS, STINT_SHUFFLE_KEYS
from .ranking import attach_scalars, exact_quantiles

LAP_KEYS = SESSION_KEYS + ["LapNumber"]


def stint_window(df: DataFrame | None = None, ordered: bool = True):
    """Window over a stint. With ``driver_stint_id`` only (no stint columns) we fall
    back to the id itself."""
    keys = STINT_KEYS if df is None or all(c in df.columns for c in STINT_KEYS) else ["driver_stint_id"]
    w = Window.partitionBy(*keys)
    return w.orderBy("LapNumber") if ordered else w


#: laps that a task of the driver partitioning is meant to hold: every window of its chain sorts them in memory of its own
LAPS_PER_TASK = 250_000


def driver_tasks(df: DataFrame, rows: int) -> int:
    """Tasks for ``rows`` laps: as many as there are cores, and more as laps grow, so that a task's memory does not grow with them."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LAPS_PER_TASK))


def to_driver_partitioning(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Hash-partition on (season, event_name, Driver): satisfies every stint and
    driver window (their keys are supersets), so one exchange serves them all. ``tasks`` is their number (see
    ``driver_tasks``), else the session's, of which small ones are put together."""
    if all(c in df.columns for c in STINT_SHUFFLE_KEYS):
        return df.repartition(tasks, *STINT_SHUFFLE_KEYS) if tasks else df.repartition(*STINT_SHUFFLE_KEYS)
    return df.repartition("driver_stint_id") if "driver_stint_id" in df.columns else df


def _session_keys(df: DataFrame) -> list:
    return [k for k in SESSION_KEYS if k in df.columns]


# --------------------------------------------------------------------------- PR02-PR04

def add_stint_id(df: DataFrame) -> DataFrame:
    """PR02."""
    return df.withColumn("driver_stint_id", S.stint_id())


def add_fuel_load(df: DataFrame, cfg: C.Config) -> DataFrame:
    """PR03."""
    return df.withColumn("fuel_load_kg", S.fuel_load(F.col("LapNumber"), cfg))


def add_tire_age_features(df: DataFrame) -> DataFrame:
    """PR04."""
    age = F.col("TyreLife").cast("double")
    return df.withColumns({"tire_age_laps": age, "tire_age_sq": F.pow(age, 2)})


# --------------------------------------------------------------------------- WN01-WN05

def add_lap_time_delta(df: DataFrame, cfg: C.Config) -> DataFrame:
    """WN01-WN03: fuel-corrected lap time minus a robust expanding stint baseline.

    n = lap index in stint; c = LapTime_s - n * effect; reference laps are n >= 2.
    The reference is clipped to median +- max(3 * MAD, 0.25) (whole-stint median/MAD),
    then the baseline is the expanding median of the clipped reference, back-filled,
    falling back to c. ``lap_time_delta_s = c - baseline``.
    """
    if "LapTime_s" not in df.columns:
        df = df.withColumn("LapTime_s", S.to_seconds_col(df, "LapTime"))
    w_ord = stint_window(df)
    w_all = stint_window(df, ordered=False)
    # Back-fill = last non-null of the reversed running frame (O(n), unlike a frame
    # reaching to UNBOUNDED FOLLOWING which is re-evaluated per row).
    w_rev = Window.partitionBy(*(STINT_KEYS if all(c in df.columns for c in STINT_KEYS) else ["driver_stint_id"])) \
        .orderBy(F.col("LapNumber").desc()).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(w_ord)
    out = df.withColumn("_n", n) \
        .withColumn("_c", F.col("LapTime_s") - F.col("_n") * F.lit(cfg.fuel_lap_time_effect)) \
        .withColumn("_ref", F.when(F.col("_n") >= 2, F.col("_c")))
    out = out.withColumn("_m", F.percentile(F.col("_ref"), 0.5).over(w_all))
    out = out.withColumn("_mad", F.percentile(F.abs(F.col("_ref") - F.col("_m")), 0.5).over(w_all))
    width = F.greatest(F.lit(3.0) * F.col("_mad"), F.lit(0.25))
    # Spark's greatest/least skip NULLs: guard so a NULL reference stays NULL.
    out = out.withColumn("_r", F.when(F.col("_ref").isNotNull(),
                                      F.least(F.greatest(F.col("_ref"), F.col("_m") - width), F.col("_m") + width)))
    out = out.withColumn("_base", F.percentile(F.col("_r"), 0.5).over(w_ord.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_bf", F.last(F.col("_base"), ignorenulls=True).over(w_rev))
    out = out.withColumn("lap_time_delta_s", F.col("_c") - F.coalesce(F.col("_bf"), F.col("_c")))
    return out.drop("_n", "_c", "_ref", "_m", "_mad", "_r", "_base", "_bf")


def add_degradation_derivatives(df: DataFrame) -> DataFrame:
    """WN04-WN05: first and second row differences of the delta within a stint."""
    w = stint_window(df)
    out = df.withColumn("deg_velocity",
                        F.coalesce(F.col("lap_time_delta_s") - F.lag("lap_time_delta_s", 1).over(w), F.lit(0.0)))
    return out.withColumn("deg_acceleration",
                          F.coalesce(F.col("deg_velocity") - F.lag("deg_velocity", 1).over(w), F.lit(0.0)))


# --------------------------------------------------------------------------- PR05

def add_sc_flags(df: DataFrame, cfg: C.Config) -> DataFrame:
    """PR05. TrackStatus NULL becomes the empty string, as in the source semantics."""
    flags = S.sc_flags(F.col("TrackStatus"), cfg)
    return df.withColumn("TrackStatus", F.coalesce(F.col("TrackStatus").cast("string"), F.lit(""))) \
        .withColumns(flags)


# --------------------------------------------------------------------------- WN06-WN09, JN02-JN03

#: positions in one window of a lap's running order
PLACES = 32


def add_gap_to_leader(df: DataFrame) -> DataFrame:
    """WN06: ``_gap`` = explicit GapToLeader, else Time - min(Time) per (session, lap), clipped >= 0.
    The leader's time is an aggregate joined back (a row per lap of a session, broadcast), so no window holds a whole lap."""
    if "GapToLeader" in df.columns:
        return df.withColumn("_gap", S.to_seconds_col(df, "GapToLeader"))
    if "Time" not in df.columns:
        return df.withColumn("_gap", F.lit(None).cast("double"))
    keys = _session_keys(df) + ["LapNumber"]
    t = S.to_seconds_col(df, "Time")
    lead = df.groupBy(*keys).agg(F.min(t).alias("_lead"))
    return _join_keys(df, F.broadcast(lead), keys).withColumn("_gap", F.when(t.isNotNull(), F.greatest(t - F.col("_lead"), F.lit(0.0)))).drop("_lead")


def _join_keys(df: DataFrame, table: DataFrame, keys: list) -> DataFrame:
    """Left join on keys of which some may be NULL (they match each other)."""
    t = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(t, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def _add_gap_ahead(df: DataFrame, keys: list) -> DataFrame:
    """WN07: gap to the car one place ahead. Windows hold ``PLACES`` positions of a lap; the first car of such
    a run takes its predecessor from a table with the last car of every run. ``keys`` are the fields of ``_lap``."""
    pos = S.nan_to_null(F.col("Position").cast("string").try_cast("double")) if "Position" in df.columns else F.lit(None).cast("double")
    out = df.withColumn("_pos", pos).withColumn("_run", F.coalesce(F.floor(F.col("_pos") / PLACES), F.lit(2**62)).cast("long"))
    place = F.struct(F.coalesce("_pos", F.lit(0.0)), F.col("Driver").isNull(), F.coalesce("Driver", F.lit("")))
    last = out.groupBy("_lap", "_run").agg(F.max_by(F.struct("_gap"), place).alias("_last")).select("_lap", "_run", "_last", "_lap.*")
    last = last.select("_lap", "_run", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_run")).alias("_before"))
    order = [F.col("_pos").asc_nulls_last(), F.col("Driver").asc_nulls_last()]
    inner = Window.partitionBy("_lap", "_run").orderBy(*order)
    out = out.withColumns({"_n": F.row_number().over(inner), "_ahead": F.lag("_gap").over(inner)}).join(last, ["_lap", "_run"], "left")
    first = (F.col("_n") == 1) & F.col("_before").isNull()
    ahead = F.when(F.col("_n") == 1, F.col("_before._gap")).otherwise(F.col("_ahead"))
    diff = F.greatest(F.col("_gap") - ahead, F.lit(0.0))
    # greatest() skips NULLs: an unknown gap on either side counts as none
    known = ~first & F.col("_gap").isNotNull() & ahead.isNotNull()
    return out.withColumn("gap_ahead_s", F.when(known, diff).otherwise(F.lit(0.0))).drop("_pos", "_run", "_n", "_ahead", "_before")


def _add_undercut(df: DataFrame, gap_s: float) -> DataFrame:
    """JN02-JN03 on ``_gap`` and ``_recent_pit``. Gaps are cut into steps a little wider than ``gap_s``: a rival
    less than ``gap_s`` ahead is in the same step or the one before. Within a step the nearest recent
    pitter below is a running maximum; of the step before only its largest pitter gap matters."""
    width = gap_s * (1 + 1e-9)  # rounding of the quotient must not skip a step
    pitter = F.when(F.col("_recent_pit") == 1, F.col("_gap"))
    out = df.withColumn("_step", F.floor(F.col("_gap") / F.lit(width)))
    # a car without a gap has no step and no rival, so plain equality of steps is enough
    prev = out.groupBy("_lap", "_step").agg(F.max(pitter).alias("_prev")).withColumn("_step", F.col("_step") + 1)
    steps = out.join(prev, ["_lap", "_step"], "left")
    inner = Window.partitionBy("_lap", "_step").orderBy("_gap", F.col("Driver").asc_nulls_first())
    steps = steps.withColumn("_below", F.max(pitter).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    # cars with equal gaps share the value of the first of them; a peer's own gap is no threat
    steps = steps.withColumn("_below", F.min("_below").over(Window.partitionBy("_lap", "_step", "_gap")))
    near = lambda c: (F.col(c) < F.col("_gap")) & ((F.col("_gap") - F.col(c)) < F.lit(gap_s))
    threat = F.coalesce(near("_below"), F.lit(False)) | F.coalesce(near("_prev"), F.lit(False))
    return steps.withColumn("undercut_threat", threat.cast("int")).drop("_step", "_prev", "_below")


def _recent_pit_flag(df: DataFrame, look_back: int) -> Column:
    """1 if this driver pitted on a lap in [lap - look_back, lap - 1] (lap numbers)."""
    keys = _session_keys(df) + ["Driver"]
    w = Window.partitionBy(*keys).orderBy(F.col("LapNumber").cast("long")).rangeBetween(-look_back, -1)
    return F.coalesce(F.max(F.col("PitInTime").isNotNull().cast("int")).over(w), F.lit(0))


def add_lap_level_features(df: DataFrame, cfg: C.Config, gap: bool = True, undercut: bool = True,
                           evolution: bool = True, source: DataFrame | None = None) -> DataFrame:
    """WN06-WN07, WN09 (per-lap part) and JN02-JN03. No window holds a whole (session, lap):
    the leader's time and the lap median are aggregates joined back, running orders are cut into
    runs of places and gaps into steps, so a lap with many cars spreads over many tasks.

    Undercut (JN02-JN03): driver d on lap l is threatened iff some other driver r, who
    pitted on a lap in [l - look_back, l - 1], has on lap l a gap-to-leader g_r with
    0 < g_d - g_r < gap_s. ``source`` may give raw laps with ``LapTime_s`` for the medians.
    """
    keys = _session_keys(df) + ["LapNumber"]
    out = df
    pits = undercut and "PitInTime" in df.columns
    if pits:
        out = out.withColumn("_recent_pit", _recent_pit_flag(out, cfg.undercut_threat_laps))
    if gap or pits:
        out = add_gap_to_leader(out)
    if gap or pits:
        # the lap as one value: NULLs in it are equal, so windows and joins of a step share one exchange
        rest = [c for c in out.columns if c not in keys]
        out = out.select(F.struct(*keys).alias("_lap"), *rest)
        if gap:
            out = _add_gap_ahead(out, keys)
        if pits:
            out = _add_undercut(out, float(cfg.undercut_threat_gap_s)).drop("_recent_pit")
        out = out.select(*[F.col(f"_lap.{c}").alias(c) if c in keys else F.col(c) for c in df.columns],
                         *[c for c in out.columns if c != "_lap" and c not in df.columns])
    if undercut and not pits:
        out = out.withColumn("undercut_threat", F.lit(0))
    if evolution:
        medians = corrected_medians(source if source is not None else out, cfg, keys)
        out = _join_keys(out, F.broadcast(medians.withColumnRenamed("_median", "_lap_median")), keys)  # a row per lap of a session
    return out.drop("_gap")


def corrected_medians(laps: DataFrame, cfg: C.Config, keys: list) -> DataFrame:
    """Exact median of LapTime_s + lap * effect per group, without holding a group in one task."""
    lt = F.col("LapTime_s") if "LapTime_s" in laps.columns else S.to_seconds_col(laps, "LapTime")
    values = laps.select(*keys, (lt + F.col("LapNumber") * F.lit(cfg.track_evolution_fuel_effect)).alias("_v"))
    return exact_quantiles(values, "_v", [0.5], by=keys).select(*keys, F.col("q0").alias("_median"))


def add_gap_trend(df: DataFrame) -> DataFrame:
    """WN08: gap_ahead_s minus its value 3 stint rows earlier; NULL -> 0."""
    w = stint_window(df)
    return df.withColumn("gap_ahead_trend",
                         F.coalesce(F.col("gap_ahead_s") - F.lag("gap_ahead_s", 3).over(w), F.lit(0.0)))


def add_gap_features(df: DataFrame) -> DataFrame:
    """WN06-WN08 as one step (``compute_gap_features``)."""
    out = add_lap_level_features(df, C.default_config(), gap=True, undercut=False, evolution=False)
    return add_gap_trend(out)


def add_undercut_threat(df: DataFrame, cfg: C.Config) -> DataFrame:
    """JN02-JN03 as one step (``compute_undercut_threat``)."""
    return add_lap_level_features(df, cfg, gap=False, undercut=True, evolution=False)


def lap3_medians(laps: DataFrame, cfg: C.Config) -> DataFrame:
    """Per session: median of LapTime_s + lap * effect over lap-3 rows (one row/session).
    Computed from the raw lap columns so it never re-runs the feature windows."""
    keys = _session_keys(laps)
    return corrected_medians(laps.filter(F.col("LapNumber") == 3), cfg, keys).withColumnRenamed("_median", "_lap3_median")


def add_track_evolution(df: DataFrame, cfg: C.Config, source: DataFrame | None = None) -> DataFrame:
    """WN09: lap-3 median (per session) minus the per-lap median of fuel-added time.

    Needs ``_lap_median`` from ``add_lap_level_features`` (added here if absent). The
    lap-3 median is a partial aggregate per session joined back (one row/session).
    """
    out = df if "_lap_median" in df.columns else add_lap_level_features(df, cfg, gap=False, undercut=False)
    skeys = _session_keys(out)
    lap3 = lap3_medians(source if source is not None else out, cfg)
    out = out.join(F.broadcast(lap3), on=skeys, how="left") if skeys else attach_scalars(out, lap3)
    return out.withColumn("track_evolution_delta", F.col("_lap3_median") - F.col("_lap_median")) \
        .drop("_lap3_median", "_lap_median")


# --------------------------------------------------------------------------- WN10, AG29

def add_lap_norm(df: DataFrame, fitted_max_laps: float | None = None, within: list | None = None,
                 source: DataFrame | None = None) -> DataFrame:
    """WN10 + AG29: lap / session length; session length / max session length of the
    frame (or of a fitted maximum). ``within`` names frame-defining columns (e.g. a
    split tag) so several frames can be normalised in one pass. Session lengths are one
    row per (season, event); the max is a window over that small table, never over laps."""
    within = list(within or [])
    keys = within + ["season", "event_name"]
    totals = (source if source is not None else df).groupBy(*keys).agg(F.max("LapNumber").alias("_total_laps"))
    if fitted_max_laps is None:
        totals = totals.withColumn("_max_total", F.max("_total_laps").over(Window.partitionBy(*within)))
    else:
        totals = totals.withColumn("_max_total", F.lit(float(fitted_max_laps)))
    out = df.join(F.broadcast(totals), on=keys, how="left")  # one row per race
    return out.withColumns({
        "lap_norm": F.col("LapNumber") / F.col("_total_laps"),
        "lap_count_norm": F.col("_total_laps") / F.col("_max_total"),
    }).drop("_total_laps", "_max_total")


# --------------------------------------------------------------------------- PR12

def add_circuit_softness(df: DataFrame, cfg: C.Config) -> DataFrame:
    """PR12."""
    return df.withColumn("circuit_softness", S.circuit_softness(F.col("event_name"), cfg))


# --------------------------------------------------------------------------- AG16

GATED = ("lap_time_delta_s", "deg_acceleration", "tire_age_laps", "undercut_threat")


def null_fractions(df: DataFrame, cols=GATED) -> DataFrame:
    """AG16: share of NULLs per key column (one aggregate, one row)."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols if c in df.columns])


def null_counts(cols=GATED) -> dict[str, Column]:
    """AG16 as aggregates that can be observed while a table is written: its rows and the NULLs of key columns."""
    return {"rows": F.count(F.lit(1)), **{c: F.count_if(F.col(c).isNull()) for c in cols}}


def nulls_over_limit(counts: dict, limit: float = 0.05) -> str:
    """The columns of ``null_counts`` with too many NULLs and their fractions; empty if there are none."""
    rows = counts["rows"]
    return ", ".join(f"{c}: {n / rows:.3f}" for c, n in counts.items() if c != "rows" and rows and n / rows > limit)


def refuse_nulls(limit: float = 0.05):
    """AG16 as the verdict on a stage table: raises on observed ``null_counts`` over the limit."""

    def accept(counts: dict) -> None:
        over = nulls_over_limit(counts, limit)
        if over:
            raise AssertionError(f"too many nulls in {over}")

    return accept


def check_null_fractions(df: DataFrame, cols=GATED, limit: float = 0.05) -> dict:
    """AG16, eager: the fractions, or an error that names the columns over the limit."""
    row = null_fractions(df, cols).first()
    found = {k: v for k, v in row.asDict().items() if v is not None}
    bad = [f"{k} {v:.3f}" for k, v in found.items() if v > limit]
    if bad:
        raise AssertionError(f"share of nulls over {limit:.0%}: {', '.join(bad)}")
    return found
