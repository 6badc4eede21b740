"""Engine configuration.

Every operator takes its parameters from a ``Config`` so callers can override any
value; ``default_config()`` returns the documented defaults.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from typing import Any

# ---------------------------------------------------------------------------
# Fixed values (must equal the documented defaults for identical results).
# ---------------------------------------------------------------------------

TRAIN_SEASONS = [2018, 2019, 2020, 2021]
VAL_SEASON = 2022
TEST_SEASON = 2023

FUEL_KG_START = 110.0
FUEL_CONSUMPTION_PER_LAP = 2.3
FUEL_LAP_TIME_EFFECT = 0.1495
TRACK_EVOLUTION_FUEL_EFFECT = 0.1495
UNDERCUT_THREAT_GAP_S = 3.0
UNDERCUT_THREAT_LAPS = 2
OUTLIER_THRESHOLD = 1.35
SC_TRACK_STATUSES = ["4", "5", "6", "7"]
WET_COMPOUNDS = ["INTERMEDIATE", "WET"]
SELECTED_CONSTRUCTORS = ["Red Bull", "Mercedes", "Ferrari", "McLaren"]

# Track-status digit codes: safety car, virtual safety car, extra caution code (yellow).
SAFETY_CAR_CODES = ["4", "5"]
VSC_CODES = ["6", "7"]
EXTRA_CAUTION_CODES = ["2"]

# Compound ordinal codes (anything else -> -1).
COMPOUND_CODES = {"HARD": 0, "MEDIUM": 1, "SOFT": 2}
# Extended compound target codes (legacy names folded; unknown -> dropped).
COMPOUND_TARGET_CODES = {
    "HARD": 0,
    "SUPERHARD": 0,
    "MEDIUM": 1,
    "SOFT": 2,
    "SUPERSOFT": 2,
    "ULTRASOFT": 2,
    "HYPERSOFT": 2,
}

# Circuit abrasion scores.
ABRASION = {
    "Bahrain": 4,
    "Saudi Arabia": 2,
    "Australia": 3,
    "Japan": 2,
    "China": 3,
    "Miami": 3,
    "Emilia Romagna": 2,
    "Monaco": 1,
    "Canada": 3,
    "Spain": 4,
    "Austria": 2,
    "Britain": 3,
    "Hungary": 3,
    "Belgium": 2,
    "Netherlands": 3,
    "Italy": 2,
    "Singapore": 3,
    "Qatar": 5,
    "United States": 3,
    "Mexico": 2,
    "Brazil": 3,
    "Las Vegas": 2,
    "Abu Dhabi": 2,
}
UNKNOWN_CIRCUIT_SOFTNESS = 0.5

# High-speed corner fraction per circuit (default for unknown circuits: 0.35).
HIGH_SPEED_FRACTION = {
    "Bahrain": 0.35,
    "Saudi Arabia": 0.55,
    "Australia": 0.30,
    "Japan": 0.45,
    "China": 0.38,
    "Miami": 0.42,
    "Emilia Romagna": 0.40,
    "Monaco": 0.05,
    "Canada": 0.25,
    "Spain": 0.35,
    "Austria": 0.50,
    "Britain": 0.60,
    "Hungary": 0.15,
    "Belgium": 0.65,
    "Netherlands": 0.38,
    "Italy": 0.70,
    "Singapore": 0.08,
    "Qatar": 0.52,
    "United States": 0.40,
    "Mexico": 0.45,
    "Brazil": 0.42,
    "Las Vegas": 0.55,
    "Abu Dhabi": 0.35,
}
DEFAULT_HIGH_SPEED_FRACTION = 0.35

# Event-name aliases, checked in this order; the first alias contained in the
# lower-cased, trimmed name wins.
EVENT_ALIASES = [
    ("silverstone", "Britain"),
    ("great britain", "Britain"),
    ("british", "Britain"),
    ("britain", "Britain"),
    ("barcelona", "Spain"),
    ("spanish", "Spain"),
    ("spain", "Spain"),
    ("monza", "Italy"),
    ("italian", "Italy"),
    ("italy", "Italy"),
    ("bahrain", "Bahrain"),
    ("monaco", "Monaco"),
    ("singapore", "Singapore"),
]

FINGERPRINT_COLS = [
    "avg_deg_rate",
    "compound_variance",
    "track_temp_percentile",
    "high_speed_fraction",
    "hist_soft_stint_len",
    "sc_vsc_frequency",
]

STREET_CIRCUITS = ["Monaco", "Singapore"]
FOCUS_TEAM = "Red Bull Racing"
PIT_STOP_TIME_LOSS_S = 22.0
STRATEGY_POLICY = "aggressive"
MIN_TIME_GAIN_S = 0.0
ALLOW_LATE_DIVERGENCE = True
COUNTERFACTUAL_CAP = 5.0
NEUTRAL_BAND = 0.1

CLIFF_THRESHOLD_S = 1.0
ENCODER_LENGTH = 20
PREDICTION_LENGTH = 12
QUANTILES = [0.1, 0.5, 0.9]
LSTM_SEQ_LEN = 10

# Heuristic attribution thresholds.
HEURISTIC_THRESHOLDS = {
    "barcelona_soft_deg_threshold": 0.15,
    "monaco_soft_positive_threshold": 0.10,
    "singapore_medium_threshold": 0.08,
    "qatar_soft_neg_threshold": 0.12,
}

# Metric targets.
METRIC_TARGETS = {
    "p50_mae_overall": 0.15,
    "p90_coverage": 0.90,
    "cliff_lead_time_mean": 2.0,
    "macro_f1": 0.72,
    "pit_now_recall": 0.68,
    "pit_now_precision": 0.55,
    "mcc": 0.55,
    "accuracy": 0.70,
    "loco_permanent_mae": 0.22,
    "loco_street_mae": 0.40,
}

PIT_FEATURES = [
    "tire_age_laps",
    "tire_age_sq",
    "compound_enc",
    "circuit_id_enc",
    "team_id_enc",
    "fuel_load_kg",
    "lap_norm",
    "lap_count_norm",
    "TrackTemp",
    "AirTemp",
    "Humidity",
    "track_temp_category",
    "gap_ahead_s",
    "gap_ahead_trend",
    "undercut_threat",
    "sc_or_vsc_flag",
    "Position",
    "starting_position_norm",
    "circuit_softness",
    "historical_sc_prob",
    "lap_time_delta_s",
    "deg_velocity",
    "deg_acceleration",
]

LSTM_SEQ_FEATURES = [
    "lap_time_delta_s",
    "deg_velocity",
    "deg_acceleration",
    "tire_age_laps",
    "tire_age_sq",
    "fuel_load_kg",
    "gap_ahead_s",
    "gap_ahead_trend",
    "undercut_threat",
    "sc_or_vsc_flag",
    "lap_norm",
    "Position",
]
LSTM_STATIC_FEATURES = [
    "circuit_id_enc",
    "compound_enc",
    "starting_position_norm",
    "circuit_softness",
    "track_temp_category",
    "historical_sc_prob",
    "team_id_enc",
    "lap_count_norm",
]

PANEL_STATIC_CATEGORICALS = ["circuit_id", "compound_type", "team_id"]
PANEL_STATIC_REALS = ["circuit_softness", "historical_sc_prob"]
PANEL_KNOWN_REALS = ["lap_norm", "fuel_load_kg", "track_evolution_delta", "air_temp", "humidity"]
PANEL_UNKNOWN_REALS = [
    "lap_time_delta_s",
    "deg_velocity",
    "deg_acceleration",
    "tire_age_laps",
    "tire_age_sq",
    "gap_ahead_s",
    "gap_ahead_trend",
    "undercut_threat",
]

# Boosted-tree settings for the pit-window classifier.
PIT_GBT = {"max_iter": 500, "max_depth": 5, "step_size": 0.03, "min_instances_per_node": 25,
           "subsampling_rate": 0.8, "feature_subset": "0.8", "seed": 42, "patience": 50}
COMPOUND_GBT = {"max_iter": 400, "max_depth": 5, "step_size": 0.05, "subsampling_rate": 0.8,
                "feature_subset": "0.7", "seed": 42, "min_instances_per_node": 3, "min_info_gain": 0.1}


@dataclass
class Config:
    """Typed view of the engine parameters; override any field per call."""

    train_seasons: list = field(default_factory=lambda: list(TRAIN_SEASONS))
    val_season: int = VAL_SEASON
    test_season: int = TEST_SEASON
    selected_circuits: list = field(default_factory=list)
    top4_filter: bool = False
    selected_constructors: list = field(default_factory=lambda: list(SELECTED_CONSTRUCTORS))
    fuel_kg_start: float = FUEL_KG_START
    fuel_consumption_per_lap: float = FUEL_CONSUMPTION_PER_LAP
    fuel_lap_time_effect: float = FUEL_LAP_TIME_EFFECT
    track_evolution_fuel_effect: float = TRACK_EVOLUTION_FUEL_EFFECT
    undercut_threat_gap_s: float = UNDERCUT_THREAT_GAP_S
    undercut_threat_laps: int = UNDERCUT_THREAT_LAPS
    outlier_threshold: float = OUTLIER_THRESHOLD
    sc_track_statuses: list = field(default_factory=lambda: list(SC_TRACK_STATUSES))
    wet_compounds: list = field(default_factory=lambda: list(WET_COMPOUNDS))
    abrasion: dict = field(default_factory=lambda: dict(ABRASION))
    high_speed_fraction: dict = field(default_factory=lambda: dict(HIGH_SPEED_FRACTION))
    street_circuits: list = field(default_factory=lambda: list(STREET_CIRCUITS))
    focus_team: str = FOCUS_TEAM
    pit_stop_time_loss_s: float = PIT_STOP_TIME_LOSS_S
    strategy_policy: str = STRATEGY_POLICY
    min_time_gain_s: float = MIN_TIME_GAIN_S
    allow_late_divergence: bool = ALLOW_LATE_DIVERGENCE
    cliff_threshold_s: float = CLIFF_THRESHOLD_S
    encoder_length: int = ENCODER_LENGTH
    prediction_length: int = PREDICTION_LENGTH
    min_encoder_length: int = ENCODER_LENGTH
    min_prediction_length: int = PREDICTION_LENGTH
    quantiles: list = field(default_factory=lambda: list(QUANTILES))
    seq_len: int = LSTM_SEQ_LEN
    pit_features: list = field(default_factory=lambda: list(PIT_FEATURES))
    heuristic_thresholds: dict = field(default_factory=lambda: dict(HEURISTIC_THRESHOLDS))
    metric_targets: dict = field(default_factory=lambda: dict(METRIC_TARGETS))
    pit_gbt: dict = field(default_factory=lambda: dict(PIT_GBT))
    compound_gbt: dict = field(default_factory=lambda: dict(COMPOUND_GBT))

    def replace(self, **kwargs: Any) -> "Config":
        out = copy.deepcopy(self)
        for key, value in kwargs.items():
            if not hasattr(out, key):
                raise KeyError(f"unknown config field {key!r}")
            setattr(out, key, value)
        return out


def default_config() -> Config:
    return Config()
