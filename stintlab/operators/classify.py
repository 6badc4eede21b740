"""Pit-window classification: dataset (PR17, PR20), threshold search (ML05-ML06),
labels (PR21, JN11), binary metrics (MS04) and the distributed MLlib model
(ML02-ML04: boosted trees + isotonic calibration)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import stage_once
from .ranking import attach_scalars, bucket_boundaries, running_totals

DEGRADATION_CIRCUITS = ["Bahrain", "Britain", "Spain", "Italy", "Monaco", "Singapore"]


def pit_feature_names(df: DataFrame, cfg: C.Config) -> list:
    """Configured features that exist in the frame."""
    return [f for f in cfg.pit_features if f in df.columns]


def model_frame(df: DataFrame, features: list) -> DataFrame:
    """PR17: the feature columns, absent ones as 0.0, NULLs -> 0.0 (as doubles)."""
    cols = set(df.columns)
    return df.withColumns({f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in cols else F.lit(0.0))
                           for f in features})


def build_pit_window_dataset(df: DataFrame, cfg: C.Config, features: list | None = None) -> DataFrame:
    """PR20: rows with label in {0,1,2} and positive loss weight; ``y`` = label in {1,2}."""
    features = features or pit_feature_names(df, cfg)
    if not features:
        raise ValueError("No pit features were found in the frame.")
    mask = F.col("pit_label").isin(0, 1, 2)
    if "loss_weight" in df.columns:
        mask = mask & (F.col("loss_weight") > 0)
    sub = df.filter(mask).withColumn("y", F.col("pit_label").isin(1, 2).cast("int"))
    return model_frame(sub, features)


def baseline_pit_score(df: DataFrame, out: str = "p") -> DataFrame:
    """A deterministic tyre-age hazard score in [0, 1): age / (age + 5). Used as the
    score when no trained model is supplied (keeps the metric operators exact)."""
    age = F.coalesce(F.col("tire_age_laps").cast("double"), F.lit(0.0))
    return df.withColumn(out, F.round(age / (age + F.lit(5.0)), 6))


def score_table(df: DataFrame, score: str = "p", label: str = "y", by: list | None = None,
                bounds: list | None = None) -> DataFrame:
    """Per distinct score: positives and negatives at that score, and running totals
    over scores >= it (descending), plus group totals. Bucket boundaries come from one
    scan of the raw scores (or are passed in to share them)."""
    by = list(by or [])
    g = df.groupBy(*by, score).agg(F.sum(F.col(label)).alias("tp"), F.sum(1 - F.col(label)).alias("fp"))
    if bounds is None:
        bounds = bucket_boundaries(df, score)
    cum = running_totals(g, score, ["tp", "fp"], by=by, descending=True, bounds=bounds)
    tot = g.groupBy(*by).agg(F.sum("tp").alias("n_pos"), F.sum("fp").alias("n_neg"))
    return cum.join(tot, on=by, how="inner") if by else attach_scalars(cum, tot)


def find_threshold_max_f1(df: DataFrame, score: str = "p", label: str = "y", by: list | None = None,
                          bounds: list | None = None) -> DataFrame:
    """ML05: the distinct score maximising F1 = 2PR/(P+R+1e-9) of ``score >= s``;
    ties -> lowest score (F1 rounded to 12 dp so ties agree across engines).
    Returns one row per ``by`` group: (by..., threshold, f1, positives)."""
    by = list(by or [])
    t = score_table(df, score, label, by, bounds)
    precision = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    recall = F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(F.col("cum_tp") / F.col("n_pos"))
    f1 = F.lit(2.0) * precision * recall / (precision + recall + F.lit(1e-9))
    t = t.withColumn("_f1", F.round(f1, 12))
    return t.groupBy(*by).agg(
        F.max_by(F.col(score), F.struct(F.col("_f1"), -F.col(score))).alias("threshold"),
        F.max("_f1").alias("f1"),
        F.first("n_pos").alias("positives"))


def tune_circuit_thresholds(val: DataFrame, cfg: C.Config, score: str = "p", label: str = "y",
                            circuit_col: str = "event_name", extra_circuits=None) -> tuple:
    """ML06: per-circuit thresholds over validation circuits plus configured ones;
    circuits without positives (or rows) get the global threshold.
    Returns (threshold frame (circuit, threshold), global threshold float)."""
    bounds = bucket_boundaries(val, score)  # shared by the global and per-circuit searches
    glob = find_threshold_max_f1(val, score, label, bounds=bounds).first()
    global_thr = float(glob["threshold"]) if glob is not None and glob["threshold"] is not None else 0.5
    per = find_threshold_max_f1(val.withColumn("_c", F.col(circuit_col).cast("string")), score, label, by=["_c"],
                                bounds=bounds)
    extra = list(DEGRADATION_CIRCUITS if extra_circuits is None else extra_circuits)
    spark = val.sparkSession
    circuits = val.select(F.col(circuit_col).cast("string").alias("_c")).distinct() \
        .unionByName(spark.createDataFrame([(c,) for c in extra], "_c string")).distinct()
    out = circuits.join(per, on="_c", how="left").select(
        F.col("_c").alias(circuit_col),
        F.when(F.coalesce(F.col("positives"), F.lit(0)) > 0, F.col("threshold"))
        .otherwise(F.lit(global_thr)).alias("threshold"))
    return out, global_thr


def predict_labels(df: DataFrame, thresholds: DataFrame, global_thr: float, score: str = "p",
                   circuit_col: str = "event_name") -> DataFrame:
    """PR21 + JN11: 2 if score >= the circuit's threshold (default: global), else 0.
    The threshold table has one row per circuit of the sport and is broadcast."""
    thr = thresholds.select(F.col(circuit_col).alias("_tc"), F.col("threshold").alias("_thr"))
    joined = df.join(F.broadcast(thr), F.col(circuit_col).cast("string") == F.col("_tc"), "left")
    limit = F.coalesce(F.col("_thr"), F.lit(float(global_thr)))
    return joined.withColumn("pred_label", F.when(F.col(score) >= limit, 2).otherwise(0).cast("int")) \
        .drop("_tc", "_thr")


def binary_metrics(df: DataFrame, score: str = "p", label: str = "y", pred: str | None = "pred_label") -> DataFrame:
    """MS04: average precision, ROC AUC (ties grouped), F1 / precision / recall of the
    predicted labels (2 = positive) and the Brier score. Degenerate defaults: AP 0
    without positives, AUC 0.5 without both classes."""
    t = score_table(df, score, label)
    curve = t.agg(
        F.sum(F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos") * F.col("cum_tp") /
                     (F.col("cum_tp") + F.col("cum_fp")))).alias("_ap"),
        F.sum(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                     F.col("fp") / F.col("n_neg") * (F.col("cum_tp") - F.col("tp") / 2.0) / F.col("n_pos"))).alias("_auc"),
        F.max("n_pos").alias("_P"), F.max("n_neg").alias("_N"))
    yhat = (F.col(pred) == 2).cast("int") if pred else F.lit(0)
    counts = df.agg(
        F.sum(yhat * F.col(label)).alias("_tp"), F.sum(yhat * (1 - F.col(label))).alias("_fp"),
        F.sum((1 - yhat) * F.col(label)).alias("_fn"),
        F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))
    m = attach_scalars(curve, counts)
    prec = F.coalesce(F.col("_tp") / F.nullif(F.col("_tp") + F.col("_fp"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(F.col("_tp") / F.nullif(F.col("_tp") + F.col("_fn"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2.0 * F.col("_tp") / F.nullif(2 * F.col("_tp") + F.col("_fp") + F.col("_fn"), F.lit(0)),
                    F.lit(0.0))
    return m.select(
        F.when(F.coalesce(F.col("_P"), F.lit(0)) > 0, F.col("_ap")).otherwise(F.lit(0.0)).alias("average_precision"),
        F.when((F.coalesce(F.col("_P"), F.lit(0)) > 0) & (F.coalesce(F.col("_N"), F.lit(0)) > 0), F.col("_auc"))
        .otherwise(F.lit(0.5)).alias("auc"),
        f1.alias("f1"), prec.alias("precision"), rec.alias("recall"),
        F.coalesce(F.col("brier"), F.lit(0.0)).alias("brier"))


# --------------------------------------------------------------------------- MLlib model (ML02-ML04)

@dataclass
class PitModel:
    """Fitted pit-window model: assembler + boosted trees + isotonic calibration, and
    per-circuit thresholds (ML02-ML06)."""

    pipeline: object
    calibrator: object | None
    features: list
    thresholds: DataFrame | None = None
    global_threshold: float = 0.5
    validation_losses: list | None = None  # of the prefixes of 1, 2, ... trees that were fitted

    def predict_proba(self, df: DataFrame, out: str = "p") -> DataFrame:
        """ML04: raw positive-class probability -> calibrated probability."""
        from pyspark.ml.functions import vector_to_array
        frame = model_frame(df, self.features)
        scored = self.pipeline.transform(frame)
        scored = scored.withColumn("_raw", vector_to_array(F.col("probability"))[1])
        if self.calibrator is not None:
            scored = self.calibrator.transform(scored.withColumn("_iso_in", F.col("_raw"))) \
                .withColumnRenamed("_iso_pred", out)
        else:
            scored = scored.withColumn(out, F.col("_raw"))
        return scored.drop("features", "rawPrediction", "probability", "prediction", "_raw", "_iso_in")

    def predict_labels(self, df: DataFrame, score: str = "p") -> DataFrame:
        scored = self.predict_proba(df, score)
        if self.thresholds is None:
            return scored.withColumn("pred_label", F.when(F.col(score) >= self.global_threshold, 2).otherwise(0))
        return predict_labels(scored, self.thresholds, self.global_threshold, score)

    def save(self, path: str) -> None:
        """SRC14: MLlib pipeline + calibrator + threshold table + metadata."""
        import json
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")
        from pyspark.sql import SparkSession
        spark = SparkSession.active()
        if self.thresholds is not None:
            self.thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
        meta = {"features": self.features, "global_threshold": self.global_threshold,
                "calibrated": self.calibrator is not None, "per_circuit": self.thresholds is not None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> "PitModel":
        import json
        from pyspark.ml import PipelineModel
        from pyspark.ml.regression import IsotonicRegressionModel
        # the metadata, written last, says which parts belong to the model: one that is
        # missing or broken is an error
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        pipeline = PipelineModel.load(f"{path}/pipeline")
        calibrator = IsotonicRegressionModel.load(f"{path}/calibrator") if meta["calibrated"] else None
        thresholds = spark.read.parquet(f"{path}/thresholds") if meta["per_circuit"] else None
        return cls(pipeline, calibrator, meta["features"], thresholds, float(meta["global_threshold"]))


def class_weights(df: DataFrame, fitted_on: DataFrame | None = None, label: str = "y") -> DataFrame:
    """Balanced class weights n / (2 * n_class) as a column ``w``, counted on ``fitted_on``
    (the training rows) and applied to ``df``. One row per class."""
    src = df if fitted_on is None else fitted_on
    counts = src.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = src.agg(F.count(F.lit(1)).alias("_n"))
    weights = attach_scalars(counts, total).select(label, (F.col("_n") / (2.0 * F.col("_nc"))).alias("w"))
    return df.join(F.broadcast(weights), on=label, how="left").withColumn("w", F.coalesce("w", F.lit(1.0)))


def best_prefix(losses: list, patience: int) -> tuple[int, bool]:
    """Length of the ensemble prefix with the least loss before ``patience`` trees in a row bring none, and whether
    the losses reach that far. Losses are those of the prefixes of 1, 2, ... trees."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        if k - best >= patience:
            return best + 1, True
    return best + 1, False


def prefix_model(model, n_trees: int):
    """The first ``n_trees`` trees of a fitted boosted model as a model of its own."""
    from pyspark.ml.classification import GBTClassificationModel
    if n_trees >= model.getNumTrees:
        return model
    java, jvm = model._java_obj, _jvm()
    trees = _array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, java.trees(), n_trees)
    weights = _array(jvm.double, java.treeWeights(), n_trees)
    cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights))
    cut._resetUid(model.uid)
    return model._copyValues(cut)


#: training rows that one task of a boosted fit is meant to hold, and the least number of tasks of a fit
ROWS_PER_FIT_TASK = 16_000
LEAST_FIT_TASKS = 4


def fit_rows(df: DataFrame) -> DataFrame:
    """A stage table in as many partitions as a boosted fit needs. The fit runs two stages for every level of every tree, and a
    task of few rows takes longer to start than to run. Partitions are put together where they are read, without a shuffle;
    they are never more than the files give. MLlib draws a tree's rows by partition, so the draws follow their number."""
    return df.coalesce(max(LEAST_FIT_TASKS, -(-df.count() // ROWS_PER_FIT_TASK)))  # the footers tell the rows


def fit_boosted(estimator, train: DataFrame, val: DataFrame, max_iter: int, patience: int):
    """ML02: boosted trees cut to the prefix that is best on validation rows, by patience.

    MLlib evaluates every prefix in one pass (``evaluateEachIteration``). The fit is repeated with twice the trees
    until ``patience`` trees without gain are among them or ``max_iter`` is reached; with one seed the trees of a longer
    fit begin with those of a shorter one. The first fit is long enough for a best prefix of ``patience`` trees and
    more: a shorter one would nearly always be thrown away. Returns the model and the validation loss of its prefixes.
    """
    n = min(max_iter, 2 * (patience + 14))
    while True:
        model = estimator.copy({estimator.maxIter: n}).fit(train)
        losses = list(model.evaluateEachIteration(val))
        best, certain = best_prefix(losses, patience)
        if certain or n >= max_iter:
            return prefix_model(model, best), losses
        n = min(max_iter, 2 * n)


def train_pit_model(train: DataFrame, val: DataFrame, cfg: C.Config, features: list | None = None,
                    max_iter: int | None = None, extra_circuits=None) -> PitModel:
    """ML02-ML03 + ML06: boosted trees with balanced weights and patience on the validation
    loss, isotonic calibration fitted on validation, thresholds tuned on
    calibrated validation scores."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression
    features = features or pit_feature_names(train, cfg)
    tr, va = (build_pit_window_dataset(df, cfg, features) for df in (train, val))
    p = cfg.pit_gbt
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    gbt = GBTClassifier(labelCol="y", featuresCol="features", weightCol="w", maxDepth=p["max_depth"], stepSize=p["step_size"],
                        minInstancesPerNode=p["min_instances_per_node"], subsamplingRate=p["subsampling_rate"],
                        featureSubsetStrategy=p["feature_subset"], seed=p["seed"])
    columns = ["y", "w", "features"]
    weighed = [assembler.transform(class_weights(df, fitted_on=tr)).select(*columns) for df in (tr, va)]
    tr_rows, va_rows = (stage_once(df, name) for df, name in zip(weighed, ("fit-train", "fit-val"), strict=True))
    boosted, losses = fit_boosted(gbt, fit_rows(tr_rows), va_rows, max_iter or p["max_iter"], p["patience"])
    model = PitModel(PipelineModel([assembler, boosted]), None, features)
    model.validation_losses = losses
    # the trees score the validation rows once; calibration and thresholds read the scores
    scored = stage_once(model.predict_proba(va, "_raw_p").select("event_name", "y", F.col("_raw_p").alias("_iso_in")), "scored-val")
    iso = IsotonicRegression(featuresCol="_iso_in", labelCol="y", predictionCol="_iso_pred")
    model.calibrator = iso.fit(scored)
    cal = stage_once(model.calibrator.transform(scored).select("event_name", "y", F.col("_iso_pred").alias("p")), "calibrated-val")
    thresholds, model.global_threshold = tune_circuit_thresholds(cal, cfg, extra_circuits=extra_circuits)
    model.thresholds = stage_once(thresholds, "thresholds")  # one row per circuit, read by every prediction
    return model


def _jvm():
    from pyspark.sql import SparkSession
    return SparkSession.active()._jvm


def _array(kind, values, n: int):
    from pyspark.sql import SparkSession
    out = SparkSession.active().sparkContext._gateway.new_array(kind, n)
    for k in range(n):
        out[k] = values[k]
    return out
