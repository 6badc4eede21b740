"""Model panels (WN14-WN16, ML11, PR18, PR19).

Windows are built with bounded sliding frames (``collect_list`` over ``ROWS -n..-1``)
inside stint partitions, so each output row carries at most ``n`` steps; nothing is
gathered per stint or per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .ranking import attach_scalars

SESSION = ["season", "event_name", "session_type"]


def add_global_lap_index(df: DataFrame) -> DataFrame:
    """WN14: ``LapNumber + 1000 * session ordinal``; ordinals are dense ranks of the
    sorted distinct sessions (a window over one row per session)."""
    sessions = df.select(*SESSION).distinct()
    sessions = sessions.withColumn("_ord", F.dense_rank().over(Window.orderBy(*SESSION)) - 1)
    out = df.join(sessions, on=SESSION, how="left")
    return out.withColumn("lap_number_global", (F.col("LapNumber") + F.col("_ord") * 1000).cast("long")).drop("_ord")


def impute_for_models(df: DataFrame, required: list) -> DataFrame:
    """PR19: tyre age <- row number in stint when missing; its square recomputed; every
    other required column NULL -> 0.0."""
    w = Window.partitionBy("driver_stint_id").orderBy("LapNumber")
    out = df
    if "tire_age_laps" in out.columns:
        out = out.withColumn("tire_age_laps", F.coalesce(F.col("tire_age_laps"), F.row_number().over(w).cast("double")))
    if "tire_age_sq" in out.columns:
        out = out.withColumn("tire_age_sq", F.coalesce(F.col("tire_age_sq"), F.pow(F.col("tire_age_laps"), 2)))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in required if c in out.columns})


def null_profile(df: DataFrame) -> DataFrame:
    """AG15: rows, columns and NULL count per column (one aggregate)."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


# --------------------------------------------------------------------------- WN15 + ML11

def build_lstm_windows(df: DataFrame, cfg: C.Config, features=C.LSTM_SEQ_FEATURES,
                       static=C.LSTM_STATIC_FEATURES) -> DataFrame:
    """WN15: for each anchor lap with ``seq_len`` earlier rows in its stint and
    LapNumber > 3: the previous ``seq_len`` rows of ``features`` (``seq``), the anchor's
    ``static`` features, label and weight. NULLs are imputed first (PR19), since
    ``collect_list`` would drop them."""
    n = int(cfg.seq_len)
    req = list(dict.fromkeys(list(features) + list(static)))
    src = impute_for_models(df, req)
    w = Window.partitionBy("driver_stint_id").orderBy("LapNumber").rowsBetween(-n, -1)
    step = F.array(*[F.col(c).cast("double") for c in features])
    out = src.select("driver_stint_id", "LapNumber", "pit_label", "loss_weight",
                     F.collect_list(step).over(w).alias("seq"),
                     F.array(*[F.col(c).cast("double") for c in static]).alias("static"))
    return out.filter((F.size("seq") == n) & (F.col("LapNumber") > 3)) \
        .select("driver_stint_id", "LapNumber", "seq", "static", F.col("pit_label").cast("int").alias("y"),
                F.col("loss_weight").cast("double").alias("w"))


def fit_window_scaler(windows: DataFrame, n_seq: int = len(C.LSTM_SEQ_FEATURES),
                      n_static: int = len(C.LSTM_STATIC_FEATURES)) -> DataFrame:
    """ML11: per feature mean and population std over every step of every training
    window (sequence part) and over anchors (static part); zero std -> 1."""
    steps = windows.select(F.explode("seq").alias("s"))
    seq_stats = steps.agg(*[F.avg(F.col("s")[i]).alias(f"m{i}") for i in range(n_seq)],
                          *[F.stddev_pop(F.col("s")[i]).alias(f"s{i}") for i in range(n_seq)])
    st_stats = windows.agg(*[F.avg(F.col("static")[i]).alias(f"m{i}") for i in range(n_static)],
                           *[F.stddev_pop(F.col("static")[i]).alias(f"s{i}") for i in range(n_static)])

    def long(stats: DataFrame, part: str, k: int) -> DataFrame:
        return stats.select(F.explode(F.array(*[
            F.struct(F.lit(part).alias("part"), F.lit(i).alias("idx"), F.col(f"m{i}").alias("mean"),
                     F.coalesce(F.nullif(F.col(f"s{i}"), F.lit(0.0)), F.lit(1.0)).alias("scale"))
            for i in range(k)])).alias("x")).select("x.*")
    return long(seq_stats, "seq", n_seq).unionByName(long(st_stats, "static", n_static))


def transform_windows(windows: DataFrame, scaler: DataFrame) -> DataFrame:
    """ML11: scale windows with a training-fitted scaler (a tiny table, attached as
    two arrays)."""
    arrays = scaler.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("idx", "mean", "scale"))).alias("p"))
    seq = arrays.filter(F.col("part") == "seq").select(F.col("p").alias("_sp"))
    st = arrays.filter(F.col("part") == "static").select(F.col("p").alias("_tp"))
    out = attach_scalars(attach_scalars(windows, seq), st)
    scale = lambda vec, params: F.zip_with(vec, params, lambda v, p: (v - p["mean"]) / p["scale"])
    return out.withColumn("seq", F.transform("seq", lambda s: scale(s, F.col("_sp")))) \
        .withColumn("static", scale(F.col("static"), F.col("_tp"))).drop("_sp", "_tp")


# --------------------------------------------------------------------------- WN16

def prepare_panel_frame(df: DataFrame, cfg: C.Config) -> DataFrame:
    """PR18 + PR19 + WN14: aliases, string categoricals with ``unknown``, imputation
    and the global time index."""
    out = add_global_lap_index(df)
    if "air_temp" not in out.columns and "AirTemp" in out.columns:
        out = out.withColumn("air_temp", F.col("AirTemp"))
    if "humidity" not in out.columns and "Humidity" in out.columns:
        out = out.withColumn("humidity", F.col("Humidity"))
    for target, source in (("circuit_id", "event_name"), ("compound_type", "Compound"), ("team_id", "Team")):
        if source in out.columns:
            out = out.withColumn(target, F.coalesce(F.col(source).cast("string"), F.lit("unknown")))
    reals = C.PANEL_STATIC_REALS + C.PANEL_KNOWN_REALS + C.PANEL_UNKNOWN_REALS + ["lap_time_delta_s"]
    return impute_for_models(out, list(dict.fromkeys(reals)))


def build_panel(df: DataFrame, cfg: C.Config, categories: DataFrame | None = None) -> DataFrame:
    """WN16: encoder/decoder windows per stint on the gap-filled global time index.

    Missing time steps are filled by exploding each stint's index range and
    forward-filling (``last`` ignoring NULLs). For every decoder start ``t``: encoder
    = up to ``encoder_length`` steps before ``t``, decoder = up to
    ``prediction_length`` steps from ``t``; windows shorter than the minimum lengths
    are dropped. The target is scaled by the encoder mean / std (std 0 -> 1).
    Categoricals are coded with train-fitted ``categories`` (unknown -> 0, as a
    NaN-aware encoder reserves code 0).
    """
    enc, dec = int(cfg.encoder_length), int(cfg.prediction_length)
    frame = prepare_panel_frame(df, cfg)
    cols = list(dict.fromkeys(C.PANEL_STATIC_CATEGORICALS + C.PANEL_STATIC_REALS + C.PANEL_KNOWN_REALS +
                              C.PANEL_UNKNOWN_REALS))
    cols = [c for c in cols if c in frame.columns]
    rng = frame.groupBy("driver_stint_id").agg(F.min("lap_number_global").alias("_a"),
                                               F.max("lap_number_global").alias("_b"))
    grid = rng.select("driver_stint_id", F.explode(F.sequence("_a", "_b")).alias("time_idx"))
    filled = grid.join(frame.select("driver_stint_id", F.col("lap_number_global").alias("time_idx"),
                                    "LapNumber", *cols), ["driver_stint_id", "time_idx"], "left")
    wf = Window.partitionBy("driver_stint_id").orderBy("time_idx").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.select("driver_stint_id", "time_idx",
                           *[F.last(c, ignorenulls=True).over(wf).alias(c) for c in ["LapNumber"] + cols])
    w = Window.partitionBy("driver_stint_id").orderBy("time_idx")
    y = "lap_time_delta_s"
    out = filled.select(
        "driver_stint_id", "time_idx", *[c for c in C.PANEL_STATIC_CATEGORICALS if c in cols],
        F.collect_list(y).over(w.rowsBetween(-enc, -1)).alias("encoder_target"),
        F.collect_list(y).over(w.rowsBetween(0, dec - 1)).alias("decoder_target"),
        F.collect_list(F.array(*[F.col(c).cast("double") for c in C.PANEL_KNOWN_REALS if c in cols]))
        .over(w.rowsBetween(0, dec - 1)).alias("decoder_known"))
    out = out.filter((F.size("encoder_target") >= int(cfg.min_encoder_length)) &
                     (F.size("decoder_target") >= int(cfg.min_prediction_length)))
    n = F.size("encoder_target").cast("double")
    mean = F.aggregate("encoder_target", F.lit(0.0), lambda a, v: a + v) / n
    out = out.withColumn("target_center", mean)
    var = F.aggregate("encoder_target", F.lit(0.0), lambda a, v: a + (v - F.col("target_center")) * (v - F.col("target_center"))) / n
    out = out.withColumn("target_scale", F.coalesce(F.nullif(F.sqrt(var), F.lit(0.0)), F.lit(1.0)))
    if categories is not None:
        for c in [c for c in C.PANEL_STATIC_CATEGORICALS if c in out.columns]:
            codes = categories.filter(F.col("category") == c).select(F.col("label").alias(c), F.col("code").alias(f"{c}_code"))
            out = out.join(F.broadcast(codes), c, "left")  # labels of one category: circuits, compounds, teams
            out = out.withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(0)))
    return out


def panel_categories(train: DataFrame, cfg: C.Config) -> DataFrame:
    """Train-fitted categorical vocabularies: (category, label, code), codes from 1 in
    label order."""
    frame = prepare_panel_frame(train, cfg)
    names = [c for c in C.PANEL_STATIC_CATEGORICALS if c in frame.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("label")) for c in names]))
    labels = frame.select(pairs.alias("x")).select("x.*").distinct()
    return labels.withColumn("code", F.row_number().over(Window.partitionBy("category").orderBy("label")))
