"""Learned quality rules: a decision list by sequential covering, applied as Spark expressions.

*Statistics* of a text are array and string expressions over its words, with no Python and no shuffle.
*Learning* repeats: grow a conjunction of thresholds on two thirds of the labelled rows that no earlier
rule covers, each step adding the condition with the largest FOIL gain; prune trailing conditions on
the other third; keep the rule if its pruned precision holds. A step is one grouped count of
(feature, bin) over the binned labelled rows, of which the driver sees features x bins numbers. All
labelled rows are used. *Applying* the list is one ``CASE WHEN`` per document.

Defined results: a null text counts as empty (no words; it fails the base check); rows with null ids or
labels teach nothing; several labels of one id count as its lowest; with no labelled rows there are no
rules; repeated rows are returned as often as they come; an empty table gives an empty result; other
columns pass through ``with_statistics`` untouched (clashing names are replaced). Whole texts are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the separator between words
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: statistics that rules may test: whole numbers, shares in thousandths
FEATURES = ["n_words", "chars_per_100_words", "symbols_per_1000", "repeats_per_1000", "echoes_per_1000", "distinct_per_1000",
            "dup_lines_per_1000", "capitals_per_1000"]


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the base statistics (long), ``base_failed`` and the ``FEATURES`` (long)."""
    made = {*BASE, *FEATURES, "base_failed"}
    if text_col in made:
        raise ValueError(f"the text column must not be named {text_col}")
    own = [f"`{c}`" for c in df.columns if c not in made]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    step = df.select(*own, text.alias("_text"), F.array_remove(F.split(text, SPACES), "").alias("_words"),
                     F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE)).alias("_lines"))
    n = F.size("_words")
    runs = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
                                           lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("_runs", runs)
    # only texts with a repeated window sort their windows: (hash, position), neighbours are equal
    placed = F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_placed", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), placed))
    again = F.filter("_placed", lambda e, i: (e["h"] == F.get("_placed", i - 1)["h"]) | (e["h"] == F.get("_placed", i + 1)["h"]))
    at = F.array_sort(F.transform(again, lambda e: e["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, i: F.struct((acc["n"] + WINDOW - F.greatest(F.lit(0), acc["to"] - i)).alias("n"), (i + WINDOW).alias("to")))["n"]
    echoes = F.size(F.filter("_words", lambda w, i: (i > 0) & (w == F.get("_words", i - 1))))
    step = step.select(
        *own, "_words", "_lines", "_text",
        n.cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        echoes.cast("long").alias("_echoes"),
        F.size(F.array_distinct("_words")).cast("long").alias("_distinct"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("_capitals"))

    def share(a: Column, b: Column, times: int = 1000) -> Column:
        return F.when(b > 0, F.floor(a * times / b)).otherwise(0).cast("long")

    words = F.col("n_words")
    return step.select(
        *own, *BASE, ((words < 20) | (100 * F.col("n_repeat_words") > 30 * words)).alias("base_failed"),
        share(F.col("word_chars"), words, 100).alias("chars_per_100_words"),
        share(F.col("n_symbols"), words).alias("symbols_per_1000"),
        share(F.col("n_repeat_words"), words).alias("repeats_per_1000"),
        share(F.col("_echoes"), words).alias("echoes_per_1000"),
        share(F.col("_distinct"), words).alias("distinct_per_1000"),
        share(F.col("n_dup_lines"), F.size("_lines").cast("long")).alias("dup_lines_per_1000"),
        share(F.col("_capitals"), F.col("word_chars")).alias("capitals_per_1000"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: int

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    hits: int
    misses: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out &= c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" -> reject ({self.hits}:{self.misses})"


def rule_number(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, 0 if none does."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), 1)
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), k)
    return out.otherwise(0)


def learn(labelled: DataFrame, bad: Column, id_col: str, features: list[str] = FEATURES, bins: int = 64, max_rules: int = 8,
          max_conditions: int = 3, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Rules for rows where ``bad`` holds. ``labelled`` has one row per labelled document with ``features``."""
    quantiles = [k / bins for k in range(1, bins)]
    found = labelled.agg(*[F.percentile_approx(f, quantiles, 10_000).alias(f) for f in features]).first()
    cuts = {f: sorted(set(found[f] or [])) for f in features}
    if not any(cuts.values()):
        return []

    # a value's bin is the number of cuts below it; equal rows merge into counts
    def number(f: str) -> Column:
        below = F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c < F.col(f)) if cuts[f] else F.array()
        return F.size(below).alias(f)

    numbered = [number(f) for f in features]
    binned = (labelled.select(*numbered, bad.alias("bad"), (F.pmod(F.xxhash64(id_col), F.lit(3)) < 2).alias("grow"))
              .groupBy(*features, "bad", "grow").agg(F.count(F.lit(1)).alias("n")).persist())

    def holds(conditions: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, k in conditions:
            out &= F.col(f) > k if above else F.col(f) <= k
        return out

    hits, misses = F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0))
    rules: list[Rule] = []
    left = binned
    try:
        while len(rules) < max_rules:
            conditions = _grow(left.where("grow"), features, holds, hits, misses, max_conditions)
            if not conditions:
                break
            # one pass counts every leading part of the conjunction on the rows held out
            parts = [holds(conditions[:k + 1]) for k in range(len(conditions))]
            counts = left.where(~F.col("grow")).agg(*[
                F.coalesce(F.sum(F.when(p & (F.col("bad") == b), F.col("n"))), F.lit(0)).alias(f"{name}{k}")
                for k, p in enumerate(parts) for name, b in (("p", True), ("n", False))]).first()
            scores = [((counts[f"p{k}"] - counts[f"n{k}"]) / max(1, counts[f"p{k}"] + counts[f"n{k}"]), -k) for k in range(len(parts))]
            keep = 1 - max(scores)[1]
            p, n = counts[f"p{keep - 1}"], counts[f"n{keep - 1}"]
            if p < least or (p + 1) / (p + n + 2) < precision * (p + 1) / (p + 2):
                break
            conditions = conditions[:keep]
            # bin > k means value > cuts[k], bin <= k means value <= cuts[k]
            rules.append(Rule(tuple(Condition(f, above, cuts[f][k]) for f, above, k in conditions), p, n))
            left = left.where(~holds(conditions))
    finally:
        binned.unpersist()
    return rules


def _grow(rows: DataFrame, features, holds, hits, misses, max_conditions) -> list[tuple[str, bool, int]]:
    conditions: list[tuple[str, bool, int]] = []
    while len(conditions) < max_conditions:
        long = rows.where(holds(conditions)).select("bad", "n", F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in features])).alias("e"))
        table: dict[str, dict[int, tuple[int, int]]] = {}
        for r in long.groupBy("e.f", "e.bin").agg(hits.alias("p"), misses.alias("q")).collect():  # features x bins rows
            table.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["q"])
        if not table:
            return conditions
        first = next(iter(table.values()))
        p0, n0 = sum(v[0] for v in first.values()), sum(v[1] for v in first.values())
        if not p0 or not n0:
            return conditions
        best = (0.0, None)
        for f in features:
            counts = table[f]
            low_p = low_n = 0
            for k in sorted(counts)[:-1]:
                low_p, low_n = low_p + counts[k][0], low_n + counts[k][1]
                for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                    if p:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, above, k))
        if best[1] is None:
            return conditions
        conditions.append(best[1])
    return conditions


def labelled_statistics(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Statistics of the labelled rows with ``label`` (the lowest of an id's labels)."""
    one = (labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").alias("label")).where("label is not null")
           .groupBy(id_col).agg(F.min("label").alias("label")))
    return stats.select(id_col, *[f for f in FEATURES]).join(one, id_col)


def learn_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **options) -> list[Rule]:
    """Rules that reject rows like those labelled 0."""
    return learn(labelled_statistics(stats, labels, id_col, label_col), F.col("label") == 0, id_col, **options)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``rule`` (the first that holds, 0 for none) and ``kept``."""
    return (stats.withColumn("rule", rule_number(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))
