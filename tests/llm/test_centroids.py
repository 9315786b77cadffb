import hashlib
import math

import numpy as np
import pytest
from oracle import differences

from larkspur.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>, owner int, v string, wide int, distance string"


def brute(rows, clusters=16, rounds=3, scale=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by whole rounds with Python's integers."""
    whole = lambda x: int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)
    kept = [(i, [whole(c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:clusters]]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for _, v in kept]
        return [min((x, i) for i, x in enumerate(row)) for row in d]

    for _ in range(rounds):
        got = assign()
        for i in range(len(c)):
            if mine := [v for (_, v), (_, o) in zip(kept, got, strict=True) if o == i]:
                c[i] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    got = assign()
    fit = lambda n: n if n < 1 << 63 else None
    per = {i: sum(d for d, o in got if o == i) for i in range(len(c))}
    far = {o for d, o in got if fit(d) is None}
    total = None if far else fit(sum(per.values()))
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(i, o, fit(d), None if o in far else fit(per[o]), total, name[o]) for (i, _), (d, o) in zip(kept, got, strict=True)]


def same(spark, rows, parts=3):
    found = centroids.cluster(spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], SCHEMA).repartition(parts))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(brute(rows), key=str), key
    return got


def test_query_equals_sql(spark, sf):
    assert differences(queries.op12_delta_lloyd(spark, sf), queries.ORACLE_SQL["op12_delta_lloyd"], sf)[1:] == (0, 0)


def test_random_vectors_with_ties_and_a_hot_vector(spark):
    r = np.random.default_rng(5)
    x = r.integers(-2, 3, (400, 64)) / 64
    x[50:200] = x[3]
    same(spark, [(int(i), v.tolist()) for i, v in enumerate(x)])


def test_odd_rows(spark):
    one = [0.5] * 64
    rows = [(1, one), (1, one), (None, [0.25] * 64), (2, None), (3, [1.0] * 63), (4, [None] + one[1:]), (5, [float("nan")] + one[1:]), (6, [float("-inf")] + one[1:]), (7, []), (8, [-0.01] * 64)]
    assert len(same(spark, rows)) == 4
    assert same(spark, []) == []
    assert len(same(spark, [(9, one)], 1)) == 1


@pytest.mark.parametrize("large", [3e4, 2.0**21, -1e12, 1e300, -1.7e308])
def test_components_of_any_size(spark, large):
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(0, 1, (60, 64)))]
    rows[7][1][5] = large
    rows[8][1][5] = large
    rows[9][1][0] = -large
    same(spark, rows)


def test_only_moved_centroids_are_compared(monkeypatch):
    """A row whose owner stays meets the moved centroids alone; the result is that of a full round."""
    r = np.random.default_rng(7)
    x, c = r.integers(-9, 10, (300, 8)), r.integers(-9, 10, (6, 8)).tolist()
    owner, best = centroids.nearest(x, c, np.full(300, -1, np.int32), np.zeros(300, np.int64), np.zeros(300, bool), [True] * 6)
    c[2], c[4] = (r.integers(-9, 10, (2, 8))).tolist()
    moved = [False, False, True, False, True, False]
    met = []
    monkeypatch.setattr(centroids, "squared", lambda rows, m, f=centroids.squared: met.append(len(rows)) or f(rows, m))
    got = centroids.nearest(x, c, owner, best.astype(np.int64), np.ones(300, bool), moved)
    stays = int((~np.array(moved)[owner]).sum())
    assert met == [300 - stays] * 6 + [stays] * 2
    want = centroids.nearest(x, c, owner, best, np.zeros(300, bool), [True] * 6)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
