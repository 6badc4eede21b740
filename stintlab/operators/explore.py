"""Exploratory aggregates (AG22-AG30, MS09-MS11, WN19-WN21, SO3, ML15).

All are aggregations or bounded windows over the lap frame; ranks for the rank
statistics use the bucketed running totals (no single-task global sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from ..session import stage_once
from .ranking import attach_scalars, bucket_boundaries_by, exact_quantiles, histogram_quantiles, running_totals, with_ordinals

COMPOUNDS = ["SOFT", "MEDIUM", "HARD"]
TEST_FEATURES = ["deg_acceleration", "deg_velocity", "gap_ahead_s", "gap_ahead_trend", "fuel_load_kg",
                 "tire_age_laps"]
CORR_COLS = ["lap_time_delta_s", "deg_velocity", "deg_acceleration", "tire_age_laps", "tire_age_sq",
             "fuel_load_kg", "gap_ahead_s", "gap_ahead_trend", "undercut_threat", "safety_car_flag", "lap_norm",
             "pit_label"]


def label_distribution(df: DataFrame, by: list | None = None, label: str = "pit_label") -> DataFrame:
    """AG23: label counts and their share (within ``by`` groups)."""
    by = list(by or [])
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share", F.round(share, 6))


def stints_by_dimension(df: DataFrame) -> DataFrame:
    """AG22: distinct stints per compound (SOFT/MEDIUM/HARD, zero-filled), circuit,
    constructor and season, as one long table (dimension, value, n_stints)."""
    def per(dim: str, col: str) -> DataFrame:
        return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")) \
            .agg(F.count_distinct("driver_stint_id").alias("n_stints")).withColumn("dimension", F.lit(dim))
    comp = df.sparkSession.createDataFrame([(c,) for c in COMPOUNDS], "value string") \
        .join(per("compound", "Compound"), "value", "left") \
        .select(F.lit("compound").alias("dimension"), "value", F.coalesce("n_stints", F.lit(0)).alias("n_stints"))
    parts = [per("circuit", "event_name"), per("constructor", "Team"), per("season", "season")]
    out = comp
    for p in parts:
        out = out.unionByName(p.select("dimension", "value", "n_stints"))
    return out.withColumn("n_stints", F.col("n_stints").cast("long"))


def stint_lengths(df: DataFrame) -> DataFrame:
    """Max tyre age per stint and compound (SOFT/MEDIUM/HARD)."""
    return df.filter(F.col("Compound").isin(*COMPOUNDS)).groupBy("Compound", "driver_stint_id") \
        .agg(F.max("tire_age_laps").alias("length")).filter(F.col("length").isNotNull())


def stint_length_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """AG24: 20 equal-width bins per compound between that compound's min and max
    stint length (last bin closed; a constant range widens to +-0.5)."""
    lengths = stint_lengths(df)
    rng = lengths.groupBy("Compound").agg(F.min("length").alias("_lo"), F.max("length").alias("_hi"))
    lo = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    hi = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_hi") + 0.5)
    j = lengths.join(F.broadcast(rng), "Compound").withColumns({"_a": lo, "_b": hi})  # one row a compound
    idx = F.least(F.floor((F.col("length") - F.col("_a")) * (F.lit(float(bins)) / (F.col("_b") - F.col("_a")))),
                  F.lit(bins - 1)).cast("int")
    return j.groupBy("Compound", idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def value_histogram(df: DataFrame, features, group: str) -> DataFrame:
    """Counts per (feature, group, value), unpivoted: one scan and one exchange for all features, written as a stage
    table from which ranks, ties, moments, quartiles and whiskers are read."""
    wide = df.filter(F.col(group).isNotNull()).select(group, *[F.col(f).cast("double").alias(f) for f in features])
    long = wide.unpivot([group], list(features), "feature", "v").filter(F.col("v").isNotNull())
    return stage_once(long.groupBy("feature", group, "v").agg(F.count(F.lit(1)).alias("_cnt")), "value-histogram")


def box_stats(df: DataFrame, features=("deg_velocity", "deg_acceleration"), by: str = "Compound") -> DataFrame:
    """AG25: quartiles and 1.5 IQR whiskers per group for each feature, all from one histogram."""
    hist = value_histogram(df, features, by)
    q = histogram_quantiles(hist, "v", [0.25, 0.5, 0.75], ["feature", by], bucket_boundaries_by(hist, "v", "feature")).select(
        "feature", by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return hist.join(F.broadcast(q), ["feature", by]).groupBy(by, "q1", "median", "q3", "feature").agg(  # features x compounds
        F.min(F.when(F.col("v") >= F.col("q1") - 1.5 * iqr, F.col("v"))).alias("whislo"),
        F.max(F.when(F.col("v") <= F.col("q3") + 1.5 * iqr, F.col("v"))).alias("whishi")) \
        .select(by, "q1", "median", "q3", "whislo", "whishi", "feature")


def pit_now_rate_by(df: DataFrame, by: str = "undercut_threat") -> DataFrame:
    """AG26: share of pit-now labels per value of ``by``."""
    return df.groupBy(by).agg(F.avg((F.col("pit_label") == 2).cast("double")).alias("pit_now_rate"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """AG27: rows, stints, circuit and constructor lists (domain-bounded sets) and the
    label prevalences, in one aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("lap_rows"),
        F.count_distinct("driver_stint_id").alias("stints"),
        F.array_join(F.sort_array(F.collect_set("event_name")), ", ").alias("circuits"),
        F.array_join(F.sort_array(F.collect_set("Team")), ", ").alias("constructors"),
        F.avg((F.col("pit_label") == 2).cast("double")).alias("pit_now_prevalence"),
        F.avg((F.col("pit_label") == 1).cast("double")).alias("pit_soon_prevalence"),
        F.avg((F.col("pit_label") == 0).cast("double")).alias("stay_out_prevalence"))


def delta_distribution(deltas: DataFrame) -> DataFrame:
    """AG28: all / dry / street subsets of the per-race deltas: count, mean, population
    std and quartiles (an empty subset is the single value 0.0)."""
    subsets = [("all", F.lit(True)), ("dry", F.col("is_wet") == F.lit(False)),
               ("street", F.col("is_street") == F.lit(True))]
    rows = deltas.select(F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in subsets])).alias("subset"),
                         "delta_pos").filter(F.col("subset").isNotNull())
    stats = rows.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta_pos").alias("mean"), F.stddev_pop("delta_pos").alias("std"),
        F.percentile("delta_pos", [0.25, 0.5, 0.75]).alias("_q"))
    names = deltas.sparkSession.createDataFrame([(n,) for n, _ in subsets], "subset string")
    out = names.join(stats, "subset", "left")
    return out.select("subset", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                      F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"),
                      F.coalesce(F.col("_q")[0], F.lit(0.0)).alias("q1"),
                      F.coalesce(F.col("_q")[1], F.lit(0.0)).alias("median"),
                      F.coalesce(F.col("_q")[2], F.lit(0.0)).alias("q3"))


def longest_stints(df: DataFrame) -> DataFrame:
    """SO3: per (circuit, compound) the stint with the largest tyre age (ties -> lowest
    stint id), as a top-1 per group aggregate."""
    per = df.filter(F.col("Compound").isin(*COMPOUNDS)).groupBy("event_name", "Compound", "driver_stint_id") \
        .agg(F.max("tire_age_laps").alias("max_age")).filter(F.col("max_age").isNotNull())
    # top-1 per group as a partial aggregate: highest age, then smallest stint id
    best = per.groupBy("event_name", "Compound").agg(
        F.min(F.struct((-F.col("max_age")).alias("neg_age"), F.col("driver_stint_id").alias("id"))).alias("_b"))
    return best.select("event_name", "Compound", F.col("_b.id").alias("driver_stint_id"),
                       (-F.col("_b.neg_age")).alias("max_age"))


def stint_spans(df: DataFrame) -> DataFrame:
    """WN21: per (race, driver, stint): start lap, length = max - min + 1 and the
    compound of the first lap."""
    return df.groupBy("season", "event_name", "Driver", "Stint").agg(
        F.min("LapNumber").alias("start_lap"),
        (F.max("LapNumber") - F.min("LapNumber") + 1).alias("length"),
        F.min_by("Compound", "LapNumber").alias("compound"))


def fixed_reference_baseline(df: DataFrame, cfg: C.Config) -> DataFrame:
    """WN20: stint baseline = median of corrected times of stint rows 2-5 (all rows if
    the stint has fewer than 4); delta = corrected - baseline."""
    keys = ["driver_stint_id"]
    w = Window.partitionBy(*keys).orderBy("LapNumber")
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    out = out.withColumn("_c", F.col("LapTime_s") - F.col("_n") * F.lit(cfg.fuel_lap_time_effect))
    ref = F.when((F.col("_len") < 4) | F.col("_n").between(2, 5), F.col("_c"))
    out = out.withColumn("_base", F.percentile(ref, 0.5).over(Window.partitionBy(*keys)))
    return out.withColumn("eda_lap_time_delta_s", F.col("_c") - F.col("_base")).drop("_n", "_len", "_c", "_base")


def autocorrelation(df: DataFrame, max_lag: int = 15, value: str = "lap_time_delta_s") -> DataFrame:
    """WN19: mean over stints of the lag-k autocorrelation of the delta series (rows
    ordered by lap, NULLs dropped), for stints longer than k + 2; one window pass
    with ``max_lag`` leads, then a per-(stint, lag) ANSI-safe Pearson."""
    src = df.filter(F.col(value).isNotNull())
    w = Window.partitionBy("driver_stint_id").orderBy("LapNumber")
    leads = src.select("driver_stint_id", F.col(value).alias("x"),
                       F.count(F.lit(1)).over(Window.partitionBy("driver_stint_id")).alias("_len"),
                       *[F.lead(value, k).over(w).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    pairs = leads.select("driver_stint_id", "_len", "x", F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("y")) for k in range(1, max_lag + 1)])).alias("p")) \
        .select("driver_stint_id", "_len", "x", "p.lag", "p.y") \
        .filter(F.col("y").isNotNull() & (F.col("_len") > F.col("lag") + 2))
    per = pairs.groupBy("driver_stint_id", "lag").agg(S.pearson(F.col("x"), F.col("y")).alias("r"))
    lags = df.sparkSession.range(1, max_lag + 1).select(F.col("id").cast("int").alias("lag"))
    return lags.join(per.groupBy("lag").agg(F.avg("r").alias("mean_autocorr")), "lag", "left")


def eda_fingerprints(df: DataFrame) -> DataFrame:
    """AG30: the exploratory fingerprint per circuit: mean OLS slope over compounds
    with > 5 complete rows, sample std of compound means, mean AirTemp, mean gap,
    median of per-stint max SOFT tyre age, mean race caution frequency."""
    comp = df.filter(F.col("Compound").isin(*COMPOUNDS) & F.col("tire_age_laps").isNotNull()
                     & F.col("lap_time_delta_s").isNotNull()) \
        .groupBy("event_name", "Compound").agg(F.count(F.lit(1)).alias("_n"),
                                               F.regr_slope("lap_time_delta_s", "tire_age_laps").alias("_s"))
    slopes = comp.groupBy("event_name").agg(F.avg(F.when(F.col("_n") > 5, F.col("_s"))).alias("avg_deg_rate"))
    means = df.filter(F.col("Compound").isNotNull()).groupBy("event_name", "Compound") \
        .agg(F.avg("lap_time_delta_s").alias("_m")).groupBy("event_name") \
        .agg(F.stddev_samp("_m").alias("compound_variance"))
    base = df.groupBy("event_name").agg(F.avg("AirTemp").alias("track_temp_mean"),
                                        F.avg("gap_ahead_s").alias("gap_mean"))
    soft_lengths = df.filter(F.col("Compound") == "SOFT").groupBy("event_name", "driver_stint_id") \
        .agg(F.max("tire_age_laps").alias("_a"))
    soft = exact_quantiles(soft_lengths, "_a", [0.5], by=["event_name"]) \
        .select("event_name", F.col("q0").alias("hist_soft_stint_len"))
    sc = df.groupBy("season", "event_name").agg(F.max("sc_or_vsc_flag").alias("_h")).groupBy("event_name") \
        .agg(F.avg("_h").alias("sc_vsc_frequency"))
    out = base.join(slopes, "event_name", "left").join(means, "event_name", "left") \
        .join(soft, "event_name", "left").join(sc, "event_name", "left")
    return out.select("event_name", F.coalesce("avg_deg_rate", F.lit(0.0)).alias("avg_deg_rate"),
                      "compound_variance", "track_temp_mean", "gap_mean", "hist_soft_stint_len",
                      F.col("sc_vsc_frequency").cast("double").alias("sc_vsc_frequency"))


EDA_FP_COLS = ["avg_deg_rate", "compound_variance", "track_temp_mean", "gap_mean", "hist_soft_stint_len",
               "sc_vsc_frequency"]


def fingerprint_pca(fp: DataFrame, cols=EDA_FP_COLS, k: int = 2) -> DataFrame:
    """ML15: standardise (population std, zero std -> 1, NULL -> 0) then PCA(k) with
    MLlib; component signs are arbitrary."""
    from pyspark.ml.feature import PCA, VectorAssembler
    filled = fp.select("event_name", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    stats = filled.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                       *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in cols])
    z = attach_scalars(filled, stats).select(
        "event_name", *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in cols])
    vec = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(z)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(vec)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(vec).withColumn("_a", vector_to_array("_pc"))
    return out.select("event_name", *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)])


def anova_kruskal(df: DataFrame, features=TEST_FEATURES, group: str = "pit_label") -> DataFrame:
    """MS10 + MS11: one-way ANOVA F and tie-corrected Kruskal-Wallis H over the
    ``group`` classes with more than 3 values; p-values in closed form for three
    groups (F(2, d) and chi-square(2) tails), NULL otherwise.

    All features share one histogram of (feature, group, value). A running count over a feature's values gives
    the average rank and the ties of every value; moments and rank sums are aggregates of the histogram.
    """
    hist = value_histogram(df, features, group)
    sizes = hist.groupBy("feature", group).agg(F.sum("_cnt").alias("n"), (F.sum(F.col("v") * F.col("_cnt")) / F.sum("_cnt")).alias("m"))
    sizes = sizes.filter(F.col("n") > 3)
    hist = hist.join(F.broadcast(sizes), ["feature", group])  # features x classes
    ranked = running_totals(hist, "v", ["_cnt"], by=["feature"], descending=False, prefix="_upto",
                            bounds=bucket_boundaries_by(hist, "v", "feature"))
    tied = ranked.groupBy("feature", "v").agg(F.max("_upto_cnt").alias("_upto"), F.sum("_cnt").alias("_t"))
    tied = tied.withColumn("r", F.col("_upto") - (F.col("_t") - 1) / 2.0)
    t = F.col("_t").cast("double")
    ties = tied.groupBy("feature").agg(F.sum(t * t * t - t).alias("tt"))
    per = hist.join(tied.select("feature", "v", "r"), ["feature", "v"]).groupBy("feature", group).agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.sum(F.col("r") * F.col("_cnt")).alias("R"),
        F.sum(F.pow(F.col("v") - F.col("m"), 2) * F.col("_cnt")).alias("ss"))
    grand = per.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mall"))
    m = per.join(F.broadcast(grand), "feature").groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("_ntot"), F.sum("ss").alias("ssw"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_mall"), 2)).alias("ssb"), F.sum(F.pow(F.col("R"), 2) / F.col("n")).alias("sr"))
    m = m.join(F.broadcast(ties), "feature")  # one row a feature
    N = F.col("_ntot").cast("double")
    d1 = F.col("k") - 1
    d2 = F.col("_ntot") - F.col("k")
    fstat = (F.col("ssb") / F.nullif(d1, F.lit(0))) / F.nullif(F.col("ssw") / F.nullif(d2, F.lit(0)), F.lit(0.0))
    h = (F.lit(12.0) / (N * (N + 1)) * F.col("sr") - 3 * (N + 1)) / \
        F.nullif(F.lit(1.0) - F.col("tt") / F.nullif(N * N * N - N, F.lit(0.0)), F.lit(0.0))
    out = m.select(
        "feature", F.col("k").cast("int").alias("groups"), fstat.alias("anova_f"),
        F.when(F.col("k") == 3, F.pow(F.lit(1.0) + 2.0 * fstat / d2, -d2 / 2.0)).alias("anova_p"),
        h.alias("kruskal_h"), F.when(F.col("k") == 3, F.exp(-h / 2.0)).alias("kruskal_p"))
    return out.filter(F.col("groups") >= 2)


def ordered_tests(tests: DataFrame) -> DataFrame:
    """SO4: the tests in order of their p-value (then feature) with their place; NULL p-values last."""
    keyed = tests.withColumn("_p", F.coalesce("anova_p", F.lit(float("inf"))))
    return with_ordinals(keyed, ["_p", "feature"], "place").drop("_p")


def spearman_matrix(df: DataFrame, cols=CORR_COLS) -> DataFrame:
    """MS09: Spearman correlation matrix over complete cases, via MLlib
    ``Correlation.corr(method='spearman')`` (distributed ranks, ties averaged);
    returned long as (a, b, rho), NaN -> NULL."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    src = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    vec = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(src)
    mat = Correlation.corr(vec, "_v", "spearman").first()[0].toArray().tolist()
    rows = [(a, b, None if v != v else float(v)) for i, a in enumerate(cols) for j, (b, v) in
            enumerate(zip(cols, mat[i]))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, rho double")


def representative_stint_laps(df: DataFrame) -> DataFrame:
    """JN13: laps of the longest stint per (circuit, compound) — a left-semi join of
    the lap frame with the sampled stint ids."""
    return df.join(longest_stints(df).select("driver_stint_id"), "driver_stint_id", "left_semi")
