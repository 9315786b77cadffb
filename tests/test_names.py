import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import patterns as P
from larkspur.operators import names


def mutated(r, name, n):
    for _ in range(n):
        i = r.randrange(len(name))
        kind = r.randrange(4)
        if kind == 0:
            name = name[:i] + r.choice("abcxyz-1") + name[i:]
        elif kind == 1 and len(name) > 3:
            name = name[:i] + name[i + 1 :]
        elif kind == 2:
            name = name[:i] + r.choice(P.NEIGHBOURS.get(name[i], "q") or "q") + name[i + 1 :]
        elif i + 1 < len(name):
            name = name[:i] + name[i + 1] + name[i] + name[i + 2 :]
    return name


def sample(seed):
    r = random.Random(seed)
    popular = {"".join(r.choice("abcdelnorst-") for _ in range(r.choice([3, 4, 5, 6, 8, 11, 17, 30]))) for _ in range(150)}
    candidates = {mutated(r, p, r.randrange(5)) for p in popular for _ in range(4)} | {"".join(r.choice("abcdelnorst") for _ in range(7)) for _ in range(60)}
    return sorted(c for c in candidates if c), sorted(popular)


@pytest.mark.parametrize("ceiling", [2.0, 1.2, 0.6])
def test_near_misses_equal_all_pairs(spark, ceiling):
    candidates, popular = sample(int(ceiling * 10))
    got = {(r["candidate"], r["target"]): round(r["distance"], 6) for r in names.near_misses(spark.createDataFrame([(c,) for c in candidates], "name string"), spark.createDataFrame([(p,) for p in popular], "name string"), ceiling=ceiling).collect()}
    want = {}
    for c in candidates:
        for p in popular:
            if len(c) >= 3 and len(p) >= 5 and c != p and abs(len(c) - len(p)) <= 3:
                d = names.weighted_distance(c, p, ceiling)
                if 0 < d <= ceiling:
                    want[c, p] = round(d, 6)
    assert got == want and len(want) > 30


def test_few_pairs_are_compared(spark):
    r = random.Random(9)
    popular = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(6, 14))) for _ in range(3000)]
    candidates = [mutated(r, p, 1) for p in popular[:1000]]
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    pairs = names.signature_pairs(frame(candidates, "bare"), frame(popular, "name"), 5, 2, 2).count()
    alike = sum(abs(len(c) - len(p)) <= 3 for c in candidates for p in popular)
    assert pairs < alike / 10


def test_within_band_equals_all_pairs(spark):
    candidates, popular = sample(4)
    got = {(r["bare"], r["target"], r["edits"]) for r in names.within_band(spark.createDataFrame([(c, 1) for c in candidates], "bare string, size int"), spark.createDataFrame([(p,) for p in popular], "name string"), 2, 3).collect()}
    c, p = (spark.createDataFrame([(x,) for x in rows], f"{n} string") for n, rows in (("bare", candidates), ("target", popular)))
    near = c.crossJoin(p).where("bare <> target AND abs(length(bare) - length(target)) <= 2").withColumn("edits", F.levenshtein("bare", "target")).where("edits <= 3")
    assert got == {tuple(r) for r in near.collect()}


def test_typosquats_equal_brute_force(spark):
    """The precedence of kinds, then distance and name, over all candidates and popular names."""
    candidates, popular = sample(6)
    candidates += [f"@x/{popular[3]}", popular[5].replace("-", "_") + "_", popular[7] + "-js"]
    c, p = (spark.createDataFrame([(x,) for x in rows], "name string") for rows in (candidates, popular))
    got = {r["candidate"]: (r["kind"], r["target"]) for r in names.typosquats(c, p).collect()}
    exact = {}
    for r in names.variant_matches(c, p).collect():
        exact.setdefault(r["candidate"], []).append((names.KINDS.index(r["kind"]), r["distance"], r["target"]))
    want = {}
    for x in candidates:
        if x.lower() in popular:
            continue
        short = x.split("/")[-1]
        near = [(names.KINDS.index("near_miss"), d, t) for t in popular if len(short) >= 3 and len(t) >= 5 and abs(len(t) - len(short)) <= 3 and 0 < (d := names.weighted_distance(short, t, 2.0)) <= 2]
        if found := sorted(exact.get(x, []) + near):
            want[x] = (names.KINDS[found[0][0]], found[0][2])
    assert got == want
