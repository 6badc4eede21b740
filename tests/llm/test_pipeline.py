import corpus_pipeline
from pyspark.sql import functions as F

from stintlab.llm import quality_rules

from .helpers import frame, rows, words
from .test_near_dedup import brute as near_brute
from .test_quality_rules import brute as quality_brute
from .test_substring_dedup import brute as cut_brute

SF = "/root/testdata/sf0.001"


def test_stages_are_named_and_chained(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    step = corpus_pipeline.quality(spark, docs, SF).cache()
    assert step.columns == docs.columns
    stats = quality_rules.with_statistics(docs.select("doc_id", "text")).cache()
    rules = quality_rules.learn_quality(stats, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in quality_rules.judge(stats, rules).where("kept").collect()}
    assert {r["doc_id"] for r in step.collect()} == kept
    assert kept <= {i for i, t in texts.items() if not quality_brute(t)[-1]}

    data = [tuple(r) for r in step.collect()]
    near = corpus_pipeline.near_duplicates(spark, step, SF).cache()
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect()) == [i for i, _, root, keep in near_brute(data, 5) if keep]

    data = [tuple(r) for r in near.collect()]
    cut = corpus_pipeline.substrings(spark, near, SF).cache()
    assert cut.columns == docs.columns
    want = {i: v[0] for i, v in cut_brute(data, 50).items()}
    left = {r["doc_id"]: r for r in cut.collect()}
    assert set(left) == {i for i, (n, gone, _) in want.items() if n > gone or not gone}
    for i, r in left.items():
        assert len(words(r["text"])) == want[i][0] - want[i][1] and r["n_chars"] == len(r["text"])
        assert want[i][1] or r["text"] == texts[i]

    packed = corpus_pipeline.pack(spark, cut, SF)
    assert packed.select("doc_id").distinct().count() == len(left)
    by = packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert by.where("n <> doc_tokens").count() == 0


def test_run_applies_the_stages_in_order(spark, monkeypatch):
    seen = []

    def step(name):
        def apply(spark, docs, sf_dir):
            seen.append((name, docs.columns, docs.count()))
            return docs.where("doc_id > 0") if name != "d" else docs.select("doc_id")

        return apply

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(k, step(k)) for k in "abcd"])
    out = corpus_pipeline.run(spark, SF)
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [(k, c) for k, c, _ in seen] == [(k, columns) for k in "abcd"] and out.columns == ["doc_id"]
    assert seen[0][2] == seen[1][2] + 1 == out.count() + 1


def test_odd_rows_and_clashing_columns(spark):
    data = rows() + [rows()[1], (None, rows()[2][1], None, None, None), (None, None, None, None, None), (rows()[4][0], "other text " * 30, None, None, None)]
    docs = frame(spark, data).withColumn("n_words", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("rest", F.lit(2.0))
    for source in (docs, docs.limit(0)):
        step = source
        for name, f in corpus_pipeline.STAGES[:-1]:
            step = f(spark, step, SF)
            assert step.columns == docs.columns, name
            ids = [r["doc_id"] for r in step.select("doc_id").collect() if r["doc_id"] is not None]
            assert name == "quality_rules" or len(ids) == len(set(ids))
        assert (corpus_pipeline.pack(spark, step, SF).count() > 0) == (source is docs)
