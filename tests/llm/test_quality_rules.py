import re
from collections import Counter

from pyspark.sql import functions as F

from stintlab.llm import quality_rules as qr

from .helpers import frame, rows, words


def brute(text):
    w, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {q for i in range(len(w) - 7) if count[tuple(w[i:i + 8])] > 1 for q in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_statistics_equal_brute_force(spark):
    data = rows() + [(9001, "a b c d e f g h " * 2, None, None, None), (9002, "a b c d e f g h x " * 3 + "\nrow\nrow\n \n \nrow |#*", None, None, None),
                     (9003, "a b c d e f g", None, None, None), rows()[0]]
    out = qr.with_statistics(frame(spark, data).withColumnRenamed("n_chars", "n_words").withColumnRenamed("lang", "kept"))
    got = sorted((r["doc_id"], *[r[c] for c in qr.BASE], r["base_failed"]) for r in out.collect())
    assert got == sorted((r[0], *brute(r[1])) for r in data)
    assert "kept" in out.columns and out.columns.count("n_words") == 1
    assert qr.with_statistics(frame(spark, [])).count() == 0


def labelled(spark, n=600):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("r"))
    feature = {f: F.lit(0).cast("long") for f in qr.FEATURES}
    feature["symbols_per_1000"] = F.when(F.col("doc_id") % 4 == 0, 500 + F.col("r") % 300).otherwise(F.col("r") % 40)
    feature["repeats_per_1000"] = F.when(F.col("doc_id") % 7 == 0, 300 + F.col("r") % 500).otherwise(F.col("r") % 100)
    feature["n_words"] = 20 + F.col("r")
    stats = df.select("doc_id", *[c.cast("long").alias(f) for f, c in feature.items()])
    bad = (F.col("doc_id") % 4 == 0) | (F.col("doc_id") % 7 == 0)
    labels = df.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality"))
    return stats, labels


def test_learns_separating_rules(spark):
    stats, labels = labelled(spark)
    rules = qr.learn_quality(stats, labels)
    assert {c.feature for r in rules for c in r.conditions} == {"symbols_per_1000", "repeats_per_1000"}
    judged = qr.judge(stats.withColumn("base_failed", F.lit(False)), rules).join(labels, "doc_id")
    wrong = judged.where(F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong <= 6  # 600 rows
    numbers = {r["rule"] for r in judged.select("rule").distinct().collect()}
    assert numbers <= set(range(len(rules) + 1))


def test_no_labels_and_noise_give_no_rules(spark):
    stats, labels = labelled(spark, 200)
    assert qr.learn_quality(stats, labels.limit(0)) == []
    assert qr.learn_quality(stats, labels.withColumn("quality", F.lit(None).cast("int"))) == []
    assert qr.learn_quality(stats, labels.withColumn("quality", F.lit(1))) == []
    assert qr.judge(stats.withColumn("base_failed", F.lit(False)), []).where("kept").count() == 200


def test_held_out_accuracy(spark):
    """Rules learned from half of the labelled documents judge the other half."""
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    stats = qr.with_statistics(docs.join(labels.select("doc_id"), "doc_id").select("doc_id", "text")).drop("text").cache()
    half = F.pmod(F.hash("doc_id"), F.lit(2)) == 0
    rules = qr.learn_quality(stats.where(half), labels)
    held = qr.judge(stats.where(~half), rules).join(labels, "doc_id").where("not base_failed")
    right = held.where(F.col("kept") == (F.col("quality") == 1)).count()
    assert rules and right >= 0.95 * held.count()
