"""Registered queries of this package: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_chunks, centroids, cross_tokens, html_extract, jaccard_join, license_scan, lm_score, near_dedup, packing,
               prefix_hashes, quality_rules, sharding, substring_dedup)
from .frames import stage
from .tokens import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op10_substring_dedup")
def op10(spark, sf_dir):
    return (substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


@register("op6_minhash_near_dedup")
def op6(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words_each=2)


@register("op2_vector_packing")
def op2(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@register("pack_instruction_pairs")
def pack_pairs(spark, sf_dir):
    """Every answer behind its prompt (the turn before it, if that is the user's); only answers bear loss. All three
    limits bind: 2,048 tokens, 8 segments, 1,024 loss-bearing tokens. ``example`` is ``conv_id * 65536 + turn``."""
    turns = table(spark, sf_dir, "conversations")
    prompts = (turns.where("role = 'user'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt")))
    pairs = turns.where("role = 'assistant'").join(prompts.hint("shuffle_hash"), ["conv_id", "turn"], "left")
    part = lambda text, loss: F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(loss).alias("loss"))
    examples = pairs.select((F.col("conv_id") * 65536 + F.col("turn")).alias("example"),
                            F.array(part("prompt", False), part("text", True)).alias("parts"))
    return packing.pack(examples, vocabulary("word_bpe_49k.json"), "example", parts_col="parts", tokens=2048, segments=8,
                        loss_tokens=1024, cut=False)


@register("op5_quality_rules")
def op5(spark, sf_dir):
    stats = stage(quality_rules.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
                  .drop("text"), "statistics")
    rules = quality_rules.learn_quality(stats, table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, rules).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


@register("op3_prefix_fingerprints")
def op3(spark, sf_dir):
    return prefix_hashes.edited_fingerprints(table(spark, sf_dir, "documents"))


@register("op4_chunked_bpe")
def op4(spark, sf_dir):
    return bpe_chunks.encode_texts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                   vocabulary("byte_bpe_50k.tiktoken"), digests=True)


@register("op8_html_main_text")
def op8(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register("op1_ce_difference", lm_score.ORACLE)
def op1(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    out = lm_score.score(table(spark, sf_dir, "documents"), good)
    return out.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "ce_difference")])


@register("op7_license_scan", license_scan.oracle("source || '/' || lang || '/' || (doc_id // 100)::VARCHAR"))
def op7(spark, sf_dir):
    # documents stand for files in directories source/lang/hundred
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"))
    return license_scan.scan(table(spark, sf_dir, "documents"), path)


#: bytes of text in a shard of the registered query
SHARD_BYTES = 1 << 20


@register("op9_extendible_sharding", sharding.oracle(SHARD_BYTES))
def op9(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), limit_bytes=SHARD_BYTES)


@register("op13_centroid_clustering", centroids.oracle())
def op13(spark, sf_dir):
    return centroids.digests(centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5))


@register("op11_cross_token_alignment")
def op11(spark, sf_dir):
    return cross_tokens.align_corpus(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                     vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"))


@register("op12_ngram_jaccard_join", jaccard_join.oracle())
def op12(spark, sf_dir):
    return jaccard_join.join_components(table(spark, sf_dir, "documents"), words_each=4, percent=85)
