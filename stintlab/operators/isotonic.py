"""ML03: isotonic calibration as a mergeable fit.

Pooling adjacent violators over a range of scores leaves blocks of pooled scores. Pooling the blocks of neighbouring
ranges end to end gives the blocks of both together, so ranges are pooled in tasks and merged level by level; only the blocks of
the final step function, which are the model, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import bucket_boundaries, bucket_number

#: neighbouring ranges merged in one task
FAN = 16
BLOCKS = "part long, lo double, hi double, weight double, total double"


def pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks of scores (``lo``, ``hi``, ``weight``, label ``total``) of neighbouring ranges, pooled until their means rise."""
    stack: list[list] = []
    for block in blocks.sort_values("lo")[["lo", "hi", "weight", "total"]].itertuples(index=False):
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, hi, weight, total = stack.pop()
            stack[-1][1], stack[-1][2], stack[-1][3] = hi, stack[-1][2] + weight, stack[-1][3] + total
    out = pd.DataFrame(stack, columns=["lo", "hi", "weight", "total"])
    out.insert(0, "part", blocks["part"].iloc[0])
    return out


def isotonic_blocks(df: DataFrame, score: str = "p", label: str = "y", weight: str | None = None, bounds: list | None = None) -> DataFrame:
    """The final blocks ``lo, hi, weight, value``; rows without score or label don't count, equal scores share a block."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    hist = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("lo"))
            .agg(F.sum(w).alias("weight"), F.sum(w * F.col(label)).alias("total")).where("weight > 0"))
    if bounds is None:
        bounds = bucket_boundaries(df, score)
    parts = len(bounds) + 1
    blocks = hist.select(bucket_number(F.col("lo"), bounds).cast("long").alias("part"), "lo", F.col("lo").alias("hi"), "weight", "total")
    blocks = blocks.groupBy("part").applyInPandas(pool, BLOCKS)
    while parts > 1:
        parts = -(-parts // FAN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(pool, BLOCKS)
    return blocks.select("lo", "hi", "weight", (F.col("total") / F.col("weight")).alias("value"))


@dataclass
class Isotonic:
    """A fitted step function: between blocks it rises linearly, outside it stays at the first or last value."""

    lo: list
    hi: list
    value: list

    @classmethod
    def fit(cls, df: DataFrame, score: str = "p", label: str = "y", weight: str | None = None, bounds: list | None = None) -> "Isotonic":
        rows = isotonic_blocks(df, score, label, weight, bounds).orderBy("lo").collect()  # the model itself
        return cls(*([r[c] for r in rows] for c in ("lo", "hi", "value")))

    def apply(self, score: Column) -> Column:
        """The calibrated value of a score; NULL for a NULL score or an empty model."""
        n = len(self.value)
        if not n:
            return F.lit(None).cast("double")
        x = score.cast("double")
        lo, hi, value = (F.array(*[F.lit(float(v)) for v in part]) for part in (self.lo, self.hi, self.value))
        k = bucket_number(x, self.hi)  # the first block that ends at or above the score
        at = lambda array, i: F.get(array, i.cast("int"))
        inside = F.when((k == 0) | (x >= at(lo, k)), at(value, k))
        rise = (x - at(hi, k - 1)) / (at(lo, k) - at(hi, k - 1))
        between = at(value, k - 1) + rise * (at(value, k) - at(value, k - 1))
        return F.when(x.isNull(), None).when(k >= n, F.lit(float(self.value[-1]))).otherwise(F.coalesce(inside, between))
