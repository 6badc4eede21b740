"""Corpus pipeline over ``documents``: quality rules, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
``documents``. ``run`` applies them in order, with each result written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintlab.llm import near_dedup, packing, quality_rules, substring_dedup
from stintlab.llm.frames import stage
from stintlab.llm.tokens import vocabulary

#: the steps are not all expressible in SQL; tests/llm/test_pipeline.py checks them by brute force
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and the decision list learned from ``labels``."""
    tag = F.xxhash64("text")  # tells rows apart that share an id
    rows = docs.select("doc_id", "text", tag.alias("tag"))
    # staged: a filter on the verdict would otherwise be pushed below the statistics and repeat them
    stats = stage(quality_rules.with_statistics(rows).drop("text"), "statistics")
    rules = quality_rules.learn_quality(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality_rules.judge(stats, rules).where("kept").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_tag"])
    return docs.join(kept, same, "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the smallest
    id. Of rows that share an id the first text in order stays; rows without an id stay."""
    found = near_dedup.near_duplicates(docs, words_each=5)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text"))
    one = (docs.join(kept, "doc_id", "left_semi").withColumn("_place", F.row_number().over(order))
           .where("_place = 1").drop("_place"))
    return one.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 or more words that stand in an earlier one; emptied documents go."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("row"))
    cut = substring_dedup.remove_repeats(rows, carry=["row"], as_is=True).where("n_words > n_removed or n_removed = 0")
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("substring_dedup", substrings), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
