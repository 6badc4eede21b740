"""Train-fitted state: categorical encoders and historical SC probability.

Statistics are fitted on the training split only and applied to any split
(``FeatureState.fit`` / ``apply``). The fitted tables stay DataFrames with one row per
circuit or team, and are applied as broadcast left joins: their size is bounded by the
sport, not by the laps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from .ranking import attach_scalars


def _labels(c):
    """Encoder input: the value as a string, missing values spelled ``nan``."""
    return S.stringify(c)


def fit_label_encoder(df: DataFrame, column: str) -> DataFrame:
    """ML01: sorted distinct labels -> 0..n-1 (a small dimension frame)."""
    labels = df.select(_labels(F.col(column)).alias("label")).distinct()
    # The ordered window runs over distinct labels only (bounded by cardinality).
    return labels.withColumn("code", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))


def historical_sc_table(reference: DataFrame, cfg: C.Config) -> DataFrame:
    """AG01: max caution flag per (season, event) -> mean per event."""
    flag = "sc_or_vsc_flag" if "sc_or_vsc_flag" in reference.columns else "safety_car_flag"
    if flag not in reference.columns:
        raise KeyError("the SC reference needs a caution flag column")
    races = reference.groupBy("season", "event_name").agg(F.max(flag).alias("had_sc"))
    return races.filter(F.col("event_name").isNotNull()) \
        .groupBy("event_name").agg(F.avg("had_sc").alias("historical_sc_prob"))


def assert_seasons_subset(df: DataFrame, allowed, what: str) -> None:
    """ST4: the seasons of ``df`` must be a subset of ``allowed`` (left-anti must be empty)."""
    bad = df.select("season").distinct().filter(~F.col("season").isin(*[int(s) for s in allowed]))
    if bad.limit(1).count() > 0:
        raise AssertionError(f"{what}: rows from outside the training seasons")


@dataclass
class FeatureState:
    """Train-fitted tables: ``circuit_codes`` and ``team_codes`` (label, code), ``sc_prob``
    (event_name, historical_sc_prob) and its one-row mean ``sc_default``."""

    circuit_codes: DataFrame
    team_codes: DataFrame
    sc_prob: DataFrame
    sc_default: DataFrame

    @classmethod
    def fit(cls, train: DataFrame, cfg: C.Config, reference: DataFrame | None = None,
            check_seasons: bool = True) -> "FeatureState":
        """Fit on ``train``; SC probabilities on ``reference`` where one is given."""
        reference = train if reference is None else reference
        if check_seasons:
            assert_seasons_subset(reference, cfg.train_seasons, "historical_sc_prob")
        sc = historical_sc_table(reference, cfg)
        default = sc.agg(F.coalesce(F.avg("historical_sc_prob"), F.lit(0.0)).alias("_sc_default"))
        return cls(fit_label_encoder(train, "event_name"), fit_label_encoder(train, "Team"), sc, default)

    # -- application ---------------------------------------------------------
    @staticmethod
    def _encode(df: DataFrame, src: str, codes: DataFrame, out: str) -> DataFrame:
        # one row per circuit or team of the sport: bounded by construction
        dim = F.broadcast(codes.select(F.col("label").alias("_label"), F.col("code").alias("_code")))
        joined = df.withColumn("_label", _labels(F.col(src))).join(dim, "_label", "left")
        return joined.withColumn(out, F.coalesce("_code", F.lit(-1)).cast("int")).drop("_label", "_code")

    def encode(self, df: DataFrame) -> DataFrame:
        """ML01 / JN14 / PR08 / PR10 / PR11 as one step."""
        out = self._encode(df, "event_name", self.circuit_codes, "circuit_id_enc")
        out = out.withColumn("circuit_id", F.col("circuit_id_enc"))
        out = out.withColumn("compound_type", S.compound_code(F.col("Compound")))
        out = out.withColumn("compound_enc", F.col("compound_type"))
        out = self._encode(out, "Team", self.team_codes, "team_id_enc")
        out = out.withColumn("team_id", F.col("team_id_enc"))
        cols = out.columns
        out = out.withColumn("track_temp_category", S.track_temp_category(S.track_temp_source(cols)))
        return out.withColumn("starting_position_norm", S.starting_position_norm(cols))

    def add_historical_sc_prob(self, df: DataFrame) -> DataFrame:
        """JN06: per-event probability, default = mean over events."""
        out = df.join(F.broadcast(self.sc_prob), on="event_name", how="left")  # one row per circuit
        out = attach_scalars(out, self.sc_default)
        return out.withColumn("historical_sc_prob", F.coalesce("historical_sc_prob", "_sc_default")).drop("_sc_default")
