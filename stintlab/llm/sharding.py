"""Extendible-hash sharding: shards are hash-prefix buckets that split until each fits a byte limit.

A row's hash is the first ``HASH_BITS`` bits of the MD5 of its key. The directory starts with one bucket; a
bucket over the limit splits on the next bit, all others keep their depth. Splitting is decided on a
histogram: bytes by the first ``d`` bits, summed once over all rows (with partial sums before the shuffle, so a
hot prefix is one row a task), for a ``d`` at which a bucket is expected to hold a sixteenth of the limit. Sums
of shorter prefixes follow from that table alone. Buckets that still exceed the limit at ``d`` go on
with more bits, for their rows only. Rows meet their shard by an equi-join on their prefix.

A bucket whose rows all have one hash (a single row, or rows with one key) cannot split on any bit; it stays as
it is and ``oversized`` tells so when it exceeds the limit.

Defined results: a null key hashes as the empty string; a null text has 0 bytes; rows with equal keys share a
shard; repeated rows are returned as often as they come; an empty table gives an empty result; extra columns are
ignored. Bytes are the UTF-8 length of the whole text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick, stage

HASH_BITS = 60
#: bits beyond the expected depth at which the first histogram is taken
SLACK = 4


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits)


def _leaves(sums: DataFrame, start: int, stop: int, limit: int) -> DataFrame:
    """The shallowest fitting bucket above each fine prefix; ``fine`` prefixes have ``stop`` bits.

    ``sums`` has one row per fine prefix: ``p``, ``bytes``, ``rows``, ``lo`` and ``hi`` (hash range). Buckets of
    ``start`` bits are known to exceed the limit, unless ``start`` is 0.
    """
    levels = F.explode(F.sequence(F.lit(start), F.lit(stop))).alias("depth")
    up = sums.select("*", levels).withColumn("bucket", F.expr(f"shiftright(p, {stop} - depth)"))
    buckets = (up.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"),
                                                 (F.min("lo") == F.max("hi")).alias("one"))
               .where((F.col("shard_bytes") <= limit) | F.col("one")))
    fitting = up.select("p", "depth", "bucket").join(buckets.hint("shuffle_hash"), ["depth", "bucket"])
    best = F.min_by(F.struct("depth", "bucket", "shard_bytes", "shard_rows"), "depth").alias("leaf")
    return fitting.groupBy("p").agg(best).select("p", "leaf.*")


def assign_shards(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 256 << 20) -> DataFrame:
    """Per row: the key, ``n_bytes``, ``shard`` (the bits of its prefix, empty for the undivided table), ``depth``,
    ``shard_bytes``, ``shard_rows`` and ``oversized``."""
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    rows = pick(df, key=key_col, text=text_col).select(
        "key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key_hash(F.col("key")).alias("h"))
    left, start, parts = stage(rows, "sizes"), 0, []
    total = left.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    expected = total / limit_bytes
    while True:
        stop = min(HASH_BITS, start + max(1, math.ceil(math.log2(max(1, expected)))) + SLACK)
        placed = left.withColumn("p", _prefix("h", stop))
        sums = placed.groupBy("p").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                                       F.min("h").alias("lo"), F.max("h").alias("hi"))
        # the leaves grow with the table: never broadcast, however small their file is
        leaves = stage(_leaves(stage(sums, "histogram"), start, stop, limit_bytes), "leaves").hint("shuffle_hash")
        parts.append(placed.join(leaves, "p"))
        deeper = placed.join(leaves, "p", "left_anti").select("key", "n_bytes", "h")
        worst = deeper.groupBy(_prefix("h", stop).alias("p")).agg(F.sum("n_bytes").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        if worst is None:
            break
        left, start, expected = stage(deeper, "oversized"), stop, worst / limit_bytes
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    bits = F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth, '0') END")
    return out.select(F.col("key").alias(key_col), "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"),
                      "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit_bytes).alias("oversized"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, key_col: str = "doc_id") -> None:
    """Write the rows of ``df`` into one folder a shard. Keys must be unique in ``assigned``."""
    shards = assigned.select(key_col, "shard")
    df.join(shards, key_col).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit_bytes: int) -> str:
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
sums AS (SELECT d, h >> ({HASH_BITS} - d) AS p, sum(n)::BIGINT AS bytes, count(*) AS c, min(h) = max(h) AS one
         FROM rows, (SELECT unnest(range(0, {HASH_BITS + 1})) AS d) GROUP BY ALL),
leaf AS (SELECT r.doc_id, r.n, r.h, min(s.d) AS depth FROM rows r JOIN sums s ON s.p = r.h >> ({HASH_BITS} - s.d)
         WHERE s.bytes <= {limit_bytes} OR s.one GROUP BY ALL)
SELECT doc_id, n AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth::INTEGER, '0') END AS shard, depth::INTEGER AS depth,
       s.bytes AS shard_bytes, s.c AS shard_rows, s.bytes > {limit_bytes} AS oversized
FROM leaf l JOIN sums s ON s.d = l.depth AND s.p = l.h >> ({HASH_BITS} - l.depth)
"""
