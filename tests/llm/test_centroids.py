import hashlib
import math

import numpy as np
import pytest

from stintlab.llm import centroids


def brute(rows: list[tuple], k: int, rounds: int, dim: int, scale: int = 256, seed: int = 2) -> list[tuple]:
    """The same clustering by plain Python integers and full distances ."""
    kept = [(i, [int(math.floor(scale * float(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))[::-1]

    for _ in range(rounds):
        dealt = [nearest(v)[0] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, dealt) if c == n]
            if mine:
                centroids[n] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    return [(i, c, d, sum(e for _, o, e in found if o == c), sum(e for _, _, e in found),
             hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]




def frame(spark, data):
    return spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, cluster string")


def got(out):
    return sorted(tuple(r) for r in centroids.digests(out).collect())


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(5, dim))
    return [(int(i), (middles[i % 5] + 0.4 * r.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("n, k, rounds", [(120, 7, 3), (60, 40, 2), (9, 12, 4), (30, 1, 0)])
def test_equals_full_distances(spark, n, k, rounds):
    data = vectors(n, 6, n)
    out = centroids.cluster(frame(spark, data), k, rounds, dim=6)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert got(out) == sorted(brute(data, k, rounds, 6))


def test_odd_rows_ties_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = vectors(25, 3, 1)
    data += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [nan, 0.0, 0.0]), (105, [inf, 0.0, 0.0])]
    data += [data[0], data[0], (data[1][0], data[2][1])]  # repeated rows; one id with two vectors
    data += [(200 + j, [0.5, 0.5, 0.5]) for j in range(30)]  # equal seeds: ties go to the smaller number, others stay empty
    assert got(centroids.cluster(frame(spark, data), 10, 4, dim=3)) == sorted(brute(data, 10, 4, 3))
    data = vectors(8, 3, 2) + [(None, [9.0, 9.0, 9.0])]
    found = centroids.cluster(frame(spark, data), 3, 2, dim=3)
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in centroids.digests(found).collect()), key=key) == sorted(brute(data, 3, 2, 3), key=key)


def test_empty_table_and_too_large_components(spark):
    out = centroids.digests(centroids.cluster(frame(spark, [(1, None)]), 3, 2, dim=3))
    assert out.count() == 0 and out.columns[-1] == "centroid_sha256"
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster(frame(spark, [(1, [1e9, 0.0, 0.0])]), 3, 2, dim=3)


def test_only_moved_components_are_touched():
    r = np.random.default_rng(0)
    x, old = r.integers(-9, 9, (50, 8)), r.integers(-9, 9, (4, 8))
    new = old.copy()
    new[1, 3] += 5
    new[2] -= 1
    assert (centroids.moved(x, x @ old.T, new - old) == x @ new.T).all()


def test_sql_says_the_same(spark):
    import duckdb

    data = vectors(80, 64, 3)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", data)
    found = con.execute(centroids.oracle(6, 3)).fetchall()
    assert sorted(found) == sorted(brute(data, 6, 3, 64)) == got(centroids.cluster(frame(spark, data), 6, 3))
