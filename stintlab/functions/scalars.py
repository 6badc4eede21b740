"""Column expressions (all JVM-side, no Python UDFs).

Each function returns a ``Column`` built from ``pyspark.sql.functions`` so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


def nan_to_null(c: Column) -> Column:
    """NaN is a value in Spark but missing in the semantics we follow: map it to NULL."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def to_seconds(c: Column, dtype: T.DataType | None = None) -> Column:
    """PR01: interval -> seconds; numbers and numeric strings -> double; bad -> NULL."""
    if isinstance(dtype, T.DayTimeIntervalType):
        return (F.unix_micros(F.timestamp_seconds(F.lit(0)) + c) / F.lit(1e6)).cast("double")
    if isinstance(dtype, T.StringType):
        return nan_to_null(c.try_cast("double"))
    return nan_to_null(c.cast("double"))


def to_seconds_col(df, name: str) -> Column:
    """PR01 for a column of ``df`` whatever its type; missing column -> NULL."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    return to_seconds(F.col(name), df.schema[name].dataType)


def stringify(c: Column) -> Column:
    """String form with missing values spelled ``nan`` (as the stint key expects)."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def stint_id(season="season", event="event_name", driver="Driver", stint="Stint") -> Column:
    """PR02: ``season_event_Driver_Stint``. Plain ``concat_ws`` would skip NULLs."""
    return F.concat_ws("_", *[stringify(F.col(c)) for c in (season, event, driver, stint)])


def fuel_load(lap: Column, cfg: C.Config) -> Column:
    """PR03: ``max(0, start - lap * burn)``; NULL lap stays NULL."""
    raw = F.lit(cfg.fuel_kg_start) - lap.cast("double") * F.lit(cfg.fuel_consumption_per_lap)
    return F.when(lap.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), raw))


def _digit_class(codes) -> str:
    return "[" + "".join(sorted(set(codes))) + "]"


def status_has_any(status: Column, codes) -> Column:
    """1 if any digit of the track-status string is in ``codes`` (NULL status -> 0)."""
    return F.coalesce(status, F.lit("")).rlike(_digit_class(codes)).cast("int")


def sc_flags(status: Column, cfg: C.Config) -> dict:
    """PR05: safety car, VSC and caution flags from track-status digit tokens."""
    caution = list(cfg.sc_track_statuses) + C.EXTRA_CAUTION_CODES
    return {
        "safety_car_flag": status_has_any(status, C.SAFETY_CAR_CODES),
        "vsc_flag": status_has_any(status, C.VSC_CODES),
        "sc_or_vsc_flag": status_has_any(status, caution),
    }


def canonical_event_name(name: Column, aliases=None) -> Column:
    """PR06: first alias (in order) contained in lower(trim(name)) wins, else name."""
    aliases = aliases or C.EVENT_ALIASES
    norm = F.lower(F.trim(name))
    out = None
    for alias, canonical in aliases:
        cond = norm.contains(alias)
        out = F.when(cond, F.lit(canonical)) if out is None else out.when(cond, F.lit(canonical))
    return out.otherwise(name) if out is not None else name


def event_name_from_columns(df_cols, candidates=("EventName", "OfficialEventName", "Country", "Location")) -> Column:
    """PR07: first non-null of the event-name-like columns; error if all are NULL."""
    present = [F.col(c).cast("string") for c in candidates if c in df_cols]
    if not present:
        raise KeyError("No event name-like column found")
    first = F.coalesce(*present) if len(present) > 1 else present[0]
    return F.when(first.isNull(), F.raise_error(F.lit("No event name-like value in row"))).otherwise(first)


def literal_map(mapping: dict) -> Column:
    """A ``map`` literal; lookups on it are codegen'd, no join needed."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def compound_code(compound: Column) -> Column:
    """PR08: HARD 0, MEDIUM 1, SOFT 2, anything else -1."""
    return F.coalesce(literal_map(C.COMPOUND_CODES)[compound], F.lit(-1)).cast("int")


def compound_target_code(compound: Column) -> Column:
    """PR09: upper-cased with legacy names folded; unknown -> NULL (caller drops)."""
    return literal_map(C.COMPOUND_TARGET_CODES)[F.upper(compound.cast("string"))].cast("int")


def track_temp_category(temp: Column) -> Column:
    """PR10: <30 -> 0, [30,45] -> 1, >45 -> 2, missing -> 1."""
    return (F.when(temp < 30.0, 0).when(temp <= 45.0, 1).when(temp > 45.0, 2).otherwise(1)).cast("int")


def track_temp_source(df_cols) -> Column:
    """PR10 input: TrackTemp if present, else AirTemp, else 25."""
    if "TrackTemp" in df_cols:
        return F.col("TrackTemp").cast("double")
    if "AirTemp" in df_cols:
        return F.col("AirTemp").cast("double")
    return F.lit(25.0)


def starting_position_norm(df_cols) -> Column:
    """PR11: GridPosition (else current Position) / 20; missing -> 1.0."""
    src = "GridPosition" if "GridPosition" in df_cols else ("Position" if "Position" in df_cols else None)
    pos = F.col(src).cast("string").try_cast("double") if src else F.lit(None).cast("double")
    return F.coalesce(nan_to_null(pos), F.lit(20.0)) / F.lit(20.0)


def circuit_softness(event: Column, cfg: C.Config) -> Column:
    """PR12: abrasion / max(abrasion); unknown circuit 0.5."""
    top = float(max(cfg.abrasion.values()))
    return F.coalesce(literal_map({k: v / top for k, v in cfg.abrasion.items()})[event],
                      F.lit(C.UNKNOWN_CIRCUIT_SOFTNESS))


def team_matches_any(team: Column, references) -> Column:
    """PR13: lower-case substring match in either direction against any reference.

    An empty team name is contained in every reference, so it matches.
    """
    t = F.lower(F.coalesce(team.cast("string"), F.lit("")))
    refs = F.array(*[F.lit(r.lower()) for r in references])
    return F.exists(refs, lambda r: F.contains(r, t) | F.contains(t, r))


def team_matches_focus(team: Column, focus: str) -> Column:
    """PR14: trimmed, lower-cased, bidirectional substring; empty names never match."""
    t = F.lower(F.trim(F.coalesce(team.cast("string"), F.lit(""))))
    f = focus.strip().lower()
    if not f:
        return F.lit(False)
    return (F.length(t) > 0) & (F.contains(F.lit(f), t) | F.contains(t, F.lit(f)))


def is_wet_compound(compound: Column, cfg: C.Config) -> Column:
    return F.coalesce(compound.isin(*cfg.wet_compounds), F.lit(False))


def safe_div(num: Column, den: Column) -> Column:
    """ANSI-safe division: NULL when the denominator is 0 or NULL."""
    return num / F.nullif(den, F.lit(0))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate Pearson r that never raises on constant input (NULL instead)."""
    return F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))
