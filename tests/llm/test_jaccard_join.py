import random

import numpy as np
import pytest

from stintlab.llm import jaccard_join as jj

from .helpers import frame, rows, words
from .test_near_dedup import LOWER, brute


def got(out):
    return sorted(tuple(r) for r in out.where("doc_id is not null").collect())


def sets_of(data, k):
    out = {}
    for i, text, *_ in data:
        w = words((text or "").translate(LOWER))
        out[i] = {tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def crowd(seed=11):
    """A common line in most texts, two groups of near copies above and below the threshold, small sets."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    texts = [f"{line} " + " ".join(word() for _ in range(r.randint(3, 90))) for _ in range(70)]
    for edits in (1, 2, 4):
        base = [word() for _ in range(110)]
        for _ in range(45):
            copy = base[:]
            for at in r.sample(range(110), edits):
                copy[at] = word()
            texts.append(" ".join(copy))
    few = [word() for _ in range(14)]
    texts += [" ".join(few[:n]) for n in range(1, 15)] + [" ".join(few[1:])]
    return [(k + 1, t, "en", "s", 0) for k, t in enumerate(texts)]


@pytest.mark.parametrize("frequent, cut", [(32, None), (3, 0), (3, 10**6)])
def test_equals_brute_force(spark, frequent, cut):
    """With the boundary by cost, with lists only and with subsets only; with many elements put last."""
    data = rows() + [(5000 + i, *rest) for i, *rest in crowd()]
    data += [data[0], (data[7][0], data[1][1], "en", "s", 0), (None, data[0][1], "en", "s", 0), (None, None, None, None, None)]
    out = jj.join_components(frame(spark, data), words_each=4, percent=85, frequent=frequent, cut=cut).cache()
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert got(out) == [r[:3] for r in brute(data, 4, 85)]
    assert sorted(r[1] > 0 for r in out.where("doc_id is null").collect()) == [False, True]


def test_pairs_lose_no_link(spark):
    data = crowd(5)
    pairs, member = jj.similar_pairs(frame(spark, data), words_each=4, percent=85, frequent=8)
    sets = sets_of(data, 4)
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {r["id"]: r["rep"] for r in member.collect()} == rep
    reps = sorted(set(rep.values()))
    expected = {(a, b): len(sets[a] & sets[b]) for a in reps for b in reps
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]): r["common"] for r in pairs.collect()} == expected and len(expected) > 500


@pytest.mark.parametrize("percent", [51, 80, 85, 90, 100])
def test_beginnings_of_similar_sets_meet(percent):
    r = np.random.default_rng(percent)
    for _ in range(3000):
        pool = r.permutation(400)
        n = int(r.integers(2, 60))
        a = set(pool[:n].tolist())
        b = set(r.permutation(sorted(a))[:n - int(r.integers(0, n // 2 + 1))].tolist()) | set(pool[n:n + int(r.integers(0, n // 2 + 1))].tolist())
        if a == b or 100 * len(a & b) < percent * len(a | b):
            continue
        firsts = [sorted(s)[:jj.beginning(len(s), percent) + 1] for s in (a, b)]
        assert len(set(firsts[0]) & set(firsts[1])) >= 2
        assert set(firsts[0][:-1] if len(firsts[0]) > jj.beginning(len(a), percent) else firsts[0]) & set(firsts[1][:jj.beginning(len(b), percent)])


def test_boundary_by_cost():
    assert jj.boundary([]) == 0
    assert jj.boundary([(10, 5, 50), (20, 30, 60), (40, 500, 70)]) == 20
    assert jj.boundary([(10, 50, 5), (20, 50, 5)]) == 0
    assert jj.boundary([(10, 9, 5), (20, 1, 50)]) == 20  # a dear class below a cheap one


def test_empty_table_and_texts(spark):
    assert jj.join_components(frame(spark, [])).count() == 0
    data = [(1, None, "a", "b", 0), (2, "", "a", "b", 0), (3, "one", "a", "b", 0), (4, "ONE", "a", "b", 0), (5, " \n", "a", "b", 0)]
    assert got(jj.join_components(frame(spark, data))) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 0, 5)]
