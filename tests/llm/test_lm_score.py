import math
from collections import Counter

import numpy as np

from stintlab.llm import lm_score

from .helpers import frame, rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, target):
    texts = [(i, words((t or "").translate(LOWER))) for i, t, *_ in data]
    vocabulary = {w for _, ws in texts for w in ws}
    docs = [(i, ["<s>"] + ws + ["</s>"]) for i, ws in texts]
    models = []
    for members in ([d for d in docs if d[0] in target and d[0] is not None], docs):
        pairs = Counter(p for _, e in members for p in zip(e, e[1:]))
        single, history = Counter(), Counter()
        for (h, w), n in pairs.items():
            single[w] += n
            history[h] += n
        models.append((pairs, single, history, sum(single.values())))
    out = []
    for i, e in docs:
        losses = []
        for pairs, single, history, n in models:
            loss = 0.0
            for h, w in zip(e, e[1:]):
                seen = max(1, history[h])
                p = 0.75 * pairs[h, w] / seen + (1 - 0.75 * history[h] / seen) * (single[w] + 1) / (n + len(vocabulary) + 2)
                loss -= math.log(p)
            losses.append(loss / (len(e) - 1))
        out.append((str(i), len(e) - 2, round(losses[0], 6), round(losses[1], 6), round(losses[0] - losses[1], 6)))
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    data = rows() + [rows()[1], (None, "no id", None, None, None), (None, None, None, None, None)]
    target = {r[0] for r in rows() if r[0] % 2}
    ids = spark.createDataFrame([(i,) for i in target] + [(None,), (1,)], "which long")
    # one chunk and two ranges, then many of both
    for chunk, keys in ((lm_score.CHUNK, lm_score.RANGE), (700, 100)):
        monkeypatch.setattr(lm_score, "CHUNK", chunk)
        monkeypatch.setattr(lm_score, "RANGE", keys)
        out = lm_score.score(frame(spark, data).withColumnRenamed("lang", "target").withColumnRenamed("source", "chunk"), ids)
        got = sorted((str(r[0]), r[1], round(r[2], 6), round(r[3], 6), round(r[4], 6)) for r in out.collect())
        for a, b in zip(got, brute(data, target), strict=True):
            assert a[:2] == b[:2] and all(abs(x - y) < 2e-6 for x, y in zip(a[2:], b[2:]))


def test_string_ids(spark):
    data = [("a", "red green red"), ("b", "blue"), (None, "red")]
    got = lm_score.score(spark.createDataFrame(data, "doc_id string, text string"), spark.createDataFrame([("a",)], "id string")).collect()
    want = brute(data, {"a"})
    for a, b in zip(sorted((str(r[0]), *r[1:]) for r in got), want, strict=True):
        assert a[:2] == b[:2] and all(abs(x - y) < 2e-6 for x, y in zip(a[2:], b[2:]))


def test_blocks_round_trip():
    random = np.random.default_rng(5)
    for bits, size in ((1, 1), (1, 3000), (9, 700)):
        base = 1 << 63
        keys = np.unique(random.integers(0, 1 << 64 - bits, size, dtype=np.uint64)) + np.uint64(base)
        keys = np.union1d(keys, np.array([base, base + (1 << 64 - bits) - 1], np.uint64))
        target, n = random.integers(0, 1 << 32, (2, len(keys)))
        low, rest = lm_score.encode_block(base, keys, target, n)
        for a, b in zip(lm_score.decode_block(base, low, rest), (keys, target, n), strict=True):
            assert (a == b).all()


def test_texts_are_shuffled_once(spark):
    out = lm_score.score(frame(spark), spark.createDataFrame([(1,)], "id long"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("== Initial Plan ==")]
    assert "ReusedExchange" in final and "Broadcast" not in final


def test_target_like_texts_score_lower(spark):
    data = [(k, ("red green blue " if k % 2 else "one two three ") * 20, None, None, None) for k in range(40)]
    ids = spark.createDataFrame([(k,) for k in range(1, 20, 2)], "id long")
    got = {r["doc_id"]: r["ce_difference"] for r in lm_score.score(frame(spark, data), ids).collect()}
    assert max(got[k] for k in range(1, 40, 2)) < min(got[k] for k in range(0, 40, 2))


def test_no_targets_and_empty_tables(spark):
    none = spark.createDataFrame([], "id long")
    assert lm_score.score(frame(spark), none).count() == len(rows())
    assert lm_score.score(frame(spark, []), none).count() == 0


def big(n):
    """``n`` background words, and target texts with rare words and a rare pair of frequent words."""
    filler = " ".join(f"w{k * k % 97}" for k in range(n))
    return [(0, filler, None, None, None), (1, "zebra quagga " * 2 + "w1 w5 w1 w5", None, None, None), (2, "zebra w3", None, None, None),
            (3, "okapi w3 w1 w5", None, None, None), (4, "w5 w1", None, None, None)]


def whole(spark, data):
    got = lm_score.score(frame(spark, data), spark.createDataFrame([(1,)], "id long")).collect()
    for a, b in zip(sorted((str(r[0]), *r[1:]) for r in got), brute(data, {1}), strict=True):
        assert a[:2] == b[:2] and all(abs(x - y) < 2e-6 for x, y in zip(a[2:], b[2:]))
    return {r["doc_id"]: r["ce_difference"] for r in got}


def test_rare_words_are_in_the_model(spark):
    # zebra: 3 of 150,018 words, okapi: 1
    found = whole(spark, big(150_000))
    assert found[2] < found[3]


def test_rare_bigrams_are_in_the_model(spark):
    # 'w1 w5' makes up 3 of some 450,000 bigrams, and occurs in the filler never
    data = big(450_000)
    assert "w1 w5" not in data[0][1]
    whole(spark, data)
