"""Metric operators (MS01-MS03, MS05-MS08) — each one aggregate over the scored frame,
so they run as partial aggregations; the driver only receives the metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .ranking import attach_scalars

CLASSES = [0, 1, 2]


def confusion_matrix(df: DataFrame, y_true: str = "pit_label", y_pred: str = "pred_label",
                     labels=CLASSES) -> DataFrame:
    """MS01: counts for every (true, predicted) pair of ``labels``; empty cells 0."""
    counts = df.groupBy(F.col(y_true).alias("true_label"), F.col(y_pred).alias("pred_label")) \
        .agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.createDataFrame([(t, p) for t in labels for p in labels], "true_label int, pred_label int")
    return cells.join(counts, ["true_label", "pred_label"], "left") \
        .select("true_label", "pred_label", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def per_class_report(df: DataFrame, y_true: str = "pit_label", y_pred: str = "pred_label") -> DataFrame:
    """MS02 (text report as a table): per class precision / recall / f1 / support with
    zero_division = 0, for every class present in truth or prediction."""
    t = df.groupBy(F.col(y_true).alias("label")).agg(F.count(F.lit(1)).alias("support"))
    p = df.groupBy(F.col(y_pred).alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    tp = df.filter(F.col(y_true) == F.col(y_pred)).groupBy(F.col(y_true).alias("label")) \
        .agg(F.count(F.lit(1)).alias("tp"))
    rep = t.join(p, "label", "full").join(tp, "label", "left").fillna(0, ["support", "predicted", "tp"])
    prec = F.coalesce(F.col("tp") / F.nullif(F.col("predicted"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0))
    return rep.select(F.col("label").cast("int").alias("label"), prec.alias("precision"), rec.alias("recall"),
                      f1.alias("f1"), F.col("support").cast("long").alias("support"))


def multiclass_summary(df: DataFrame, y_true: str = "pit_label", y_pred: str = "pred_label") -> DataFrame:
    """MS02-MS03: macro F1, MCC (0 with a single true class) and the named per-class
    precision / recall values of the report."""
    rep = per_class_report(df, y_true, y_pred)
    pick = lambda metric, label: F.max(F.when(F.col("label") == label, F.col(metric)))
    summary = rep.agg(
        F.avg("f1").alias("macro_f1"),
        F.coalesce(pick("recall", 2), F.lit(0.0)).alias("pit_now_recall"),
        F.coalesce(pick("precision", 2), F.lit(0.0)).alias("pit_now_precision"),
        F.coalesce(pick("recall", 1), F.lit(0.0)).alias("pit_soon_recall"),
        F.coalesce(pick("precision", 0), F.lit(0.0)).alias("stay_out_precision"))
    # MCC = (c*s - sum p_k t_k) / sqrt((s^2 - sum p_k^2)(s^2 - sum t_k^2)).
    t = df.groupBy(F.col(y_true).alias("k")).agg(F.count(F.lit(1)).alias("t_k"))
    p = df.groupBy(F.col(y_pred).alias("k")).agg(F.count(F.lit(1)).alias("p_k"))
    tp = df.agg(F.sum((F.col(y_true) == F.col(y_pred)).cast("long")).alias("c"), F.count(F.lit(1)).alias("s"))
    kk = t.join(p, "k", "full").fillna(0, ["t_k", "p_k"]).agg(
        F.sum(F.col("t_k").cast("double") * F.col("p_k")).alias("tp_sum"),
        F.sum(F.col("p_k").cast("double") * F.col("p_k")).alias("pp"),
        F.sum(F.col("t_k").cast("double") * F.col("t_k")).alias("tt"),
        F.sum((F.col("t_k") > 0).cast("int")).alias("n_true"))
    s = F.col("s").cast("double")
    num = F.col("c") * s - F.col("tp_sum")
    den = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.when(F.col("n_true") <= 1, F.lit(0.0)).otherwise(F.coalesce(num / F.nullif(den, F.lit(0.0)), F.lit(0.0)))
    return attach_scalars(attach_scalars(summary, tp), kk).select(
        "macro_f1", mcc.alias("mcc"), "pit_now_recall", "pit_now_precision", "pit_soon_recall", "stay_out_precision")


def quantile_metrics(df: DataFrame, y: str = "y", p10: str = "p10", p50: str = "p50", p90: str = "p90") -> DataFrame:
    """MS05: p50 MAE, p90 coverage (y <= p90), p10 coverage (y >= p10) and the mean
    pinball loss of the three quantiles."""
    def pinball(pred, q):
        d = F.col(y) - F.col(pred)
        return F.avg(F.greatest(F.lit(q) * d, F.lit(q - 1.0) * d))
    return df.agg(
        F.avg(F.abs(F.col(y) - F.col(p50))).alias("p50_mae_overall"),
        F.avg((F.col(y) <= F.col(p90)).cast("double")).alias("p90_coverage"),
        F.avg((F.col(y) >= F.col(p10)).cast("double")).alias("p10_coverage"),
        ((pinball(p10, 0.1) + pinball(p50, 0.5) + pinball(p90, 0.9)) / 3.0).alias("pinball_loss"))


def mae_by_group(df: DataFrame, by: str = "Compound", y: str = "y", pred: str = "p50",
                 caution_col: str | None = None) -> DataFrame:
    """MS06: MAE per group (e.g. compound), optionally excluding caution laps."""
    src = df.filter(F.coalesce(F.col(caution_col), F.lit(0)) == 0) if caution_col else df
    return src.groupBy(by).agg(F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae"),
                               F.count(F.lit(1)).alias("n"))


def metric_report(metrics: DataFrame, cfg: C.Config, section: str = "") -> DataFrame:
    """MS08: a one-row metric frame -> long (section, metric, value, text, target) table. Numbers go
    to ``value``, strings to ``text``; the target comes from the configured target table."""
    numeric = ("double", "float", "integer", "long", "short", "decimal")
    prefix = f"{section}_" if section.startswith("counterfactual") else ""
    entries = []
    for f in metrics.schema.fields:
        kind = f.dataType.typeName()
        if kind in numeric or kind == "string":
            entries.append(F.struct(
                F.lit(f"{prefix}{f.name}").alias("metric"),
                (F.col(f.name).cast("double") if kind in numeric else F.lit(None).cast("double")).alias("value"),
                (F.col(f.name) if kind == "string" else F.lit(None).cast("string")).alias("text")))
    stacked = metrics.select(F.explode(F.array(*entries)).alias("m")).select("m.*")
    targets = metrics.sparkSession.createDataFrame(list(cfg.metric_targets.items()), "metric string, target double")
    return stacked.join(F.broadcast(targets), "metric", "left").select(  # the configured targets: a few rows
        F.lit(section).alias("section"), "metric", "value", "text", "target")
