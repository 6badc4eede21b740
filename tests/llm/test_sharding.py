import hashlib
from collections import Counter

from stintlab.llm import sharding

from .helpers import frame, rows


def brute(data, limit):
    items = [(i, len((t or "").encode()), int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)) for i, t, *_ in data]
    out = []

    def split(part, depth):
        size = sum(n for _, n, _ in part)
        if size <= limit or len({h for *_, h in part}) == 1:
            shard = f"{part[0][2]:060b}"[:depth]
            out.extend((str(i), n, shard, depth, size, len(part), size > limit) for i, n, _ in part)
            return
        for bit in "01":
            side = [x for x in part if f"{x[2]:060b}"[depth] == bit]
            if side:
                split(side, depth + 1)

    if items:
        split(items, 0)
    return sorted(out)


def test_equals_recursive_splitting(spark, monkeypatch):
    data = rows() + [rows()[5]] * 30 + [(None, "null key" * 40, None, None, None), (None, None, None, None, None)]
    for limit in (1, 700, 6_000, 10**9):
        got = sorted((str(r[0]), *r[1:]) for r in sharding.assign_shards(frame(spark, data).withColumnRenamed("lang", "h"), limit_bytes=limit).collect())
        assert got == brute(data, limit)
    monkeypatch.setattr(sharding, "SLACK", 0)  # several rounds of deeper histograms
    got = sorted((str(r[0]), *r[1:]) for r in sharding.assign_shards(frame(spark, data), limit_bytes=900).collect())
    assert got == brute(data, 900)


def test_shards_fit_and_prefixes_do_not_overlap(spark):
    out = sharding.assign_shards(frame(spark), limit_bytes=5_000).collect()
    shards = Counter()
    for r in out:
        shards[r["shard"]] += r["n_bytes"]
    assert all(n <= 5_000 or next(r for r in out if r["shard"] == s)["oversized"] for s, n in shards.items())
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    assert sharding.assign_shards(frame(spark, [])).count() == 0


def test_written_shards_read_back(spark, tmp_path):
    df = frame(spark)
    sharding.write_shards(df, sharding.assign_shards(df, limit_bytes=5_000), str(tmp_path / "out"))
    back = spark.read.option("inferSchema", "false").parquet(str(tmp_path / "out"))
    assert back.count() == df.count()


def test_leaves_are_never_broadcast(spark):
    out = sharding.assign_shards(frame(spark), limit_bytes=5_000)
    out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
