import numpy as np

from stintlab.llm import near_dedup
from stintlab.llm import textbytes as tb
from stintlab.llm.components import components

from .helpers import frame, rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, k, percent=80):
    sets = []
    for i, text, *_ in data:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = {r[0]: r[0] for r in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (a, *_) in enumerate(data):
        for q in range(p):
            b = data[q][0]
            common = len(sets[p] & sets[q])
            if None not in (a, b) and common and 100 * common >= percent * len(sets[p] | sets[q]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, *_), s in zip(data, sets) if i is not None)


def got(out):
    return sorted(tuple(r) for r in out.where("doc_id is not null").collect())


def test_equals_brute_force(spark):
    data = rows()
    data += [data[0], (data[7][0], data[1][1], "en", "s", 0), (None, data[0][1], "en", "s", 0), (None, None, None, None, None)]
    for k in (2, 5):
        out = near_dedup.near_duplicates(frame(spark, data), words_each=k).cache()
        assert got(out) == brute(data, k)
        assert [tuple(r)[2:] for r in out.where("doc_id is null").collect()] == [(None, True)] * 2


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"w{k}" for k in range(120)]
    data = []
    for k in range(25):  # each differs from the next in one place more; the ends are unlike
        data.append((100 - k, " ".join(base[:40 - k] + [f"c{j}" for j in range(k)] + base[40:]), "en", "s", 0))
    assert got(near_dedup.near_duplicates(frame(spark, data), words_each=2)) == brute(data, 2)


def test_sketch_estimates_similarity():
    r = np.random.default_rng(5)
    for shared, own in ((900, 100), (300, 700), (8, 2)):
        hits = []
        for _ in range(30):
            pool = r.integers(0, 2**63, shared + 2 * own).astype(np.uint64)
            a, b = pool[:shared + own], np.concatenate([pool[:shared], pool[shared + own:]])
            s = near_dedup.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert (s != 0).all()  # every coordinate fills
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - shared / (shared + 2 * own)) < 0.05


def test_components_and_empty_tables(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (40, 45), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{k: 0 for k in range(31)}, 50: 40, 40: 40, 45: 40}
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_words_of_batches():
    import pyarrow as pa
    texts = [r[1] for r in rows()]
    for group in tb.groups(pa.array(texts, pa.string()), 500):
        starts, ends, bounds = tb.word_spans(group.data, group.offsets)
        for i, row in enumerate(group.rows):
            mine = [group.data[a:b].tobytes().decode() for a, b in zip(starts[bounds[i]:bounds[i + 1]], ends[bounds[i]:bounds[i + 1]])]
            assert mine == words(texts[row])
