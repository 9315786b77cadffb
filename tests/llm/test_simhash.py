import numpy as np
import pytest
import xxhash

from larkspur.llm import queries, simhash
from larkspur.llm.components import components


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    a = np.array(fps, np.uint64)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(a)):
            near = np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 4)
            low = min(label[j] for j in near)
            for j in near:
                if label[j] != low:
                    label[j], changed = low, True
    return label


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [slow_fingerprint(d["text"]) for d in docs]
    want = dict(zip([d["doc_id"] for d in docs], zip([f"{f:016x}" for f in fps], slow_components([d["doc_id"] for d in docs], fps), strict=True), strict=True))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, sf).collect()}
    assert got == want


def _cloud(n, seed=0):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    return [int(base[i % 4] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)))) for i in range(n)]


def test_links_of_dense_groups(spark):
    fps = sorted(set(_cloud(900)))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, 4)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = [roots.get(s, s) for s in signed]
    assert got == slow_components(signed, fps)


def test_signatures_find_every_pair_within_distance(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    other = [int(b) ^ sum(1 << int(k) for k in r.choice(64, 4, replace=False)) for b in base]
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in {*map(int, base), *other}], "fp long")
    roots = {x["node"]: x["root"] for x in components(simhash.links(df, 3)).collect()}
    at = lambda f: roots[int(np.uint64(f).view(np.int64))]
    assert all(at(b) == at(o) for b, o in zip(base, other, strict=True))


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(df).collect()} == {**dict.fromkeys(range(61), 0), 99: 99, 100: 99}


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fp"] == by[4]["fp"] == by[5]["fp"] == 0 and by[5]["component_id"] == 3
    kept = simhash.survivors(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(8) == 1 and 4 not in ids and 3 in ids and None in ids
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.survivors(no_docs).collect() == []


def test_survivors_of_null_and_repeated_ids(spark):
    """One row of each group, whatever ids its rows have."""
    text = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (7, text[2]), (1, text[3]), (5, text[3]), (5, text[4]), (5, text[4]), (5, text[5]), (9, text[5])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long")
    got = simhash.survivors(docs).collect()
    assert sorted(r["text"] for r in got) == sorted(text)
    ids = {r["text"]: r["doc_id"] for r in got}
    assert [ids[t] for t in text] == [None, None, 7, 1, 5, 5]
    assert all(rows[r["row"]] == (r["doc_id"], r["text"]) for r in got)


def test_hot_fingerprints_meet_by_broadcast(spark):
    """A text that most rows have, beside others: the same result as by brute force."""
    rows = [(i, "the one text that most rows have" if i % 4 else f"some other words {i} here and there {i * i}") for i in range(120)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    fp = {d: simhash.fingerprint(t, 4) for d, t in rows}
    least = {}
    for d in sorted(fp):
        least[d] = min([least[e] for e in least if bin(fp[e] ^ fp[d]).count("1") <= 4], default=d)
    assert {d: c for d, c in got.items() if d % 4} == {d: 1 for d in fp if d % 4}
    assert len(got) == 120


@pytest.mark.parametrize("segment", range(3))
def test_frequent_signatures_lose_no_link(segment):
    """Fingerprints that share a segment but for one bit, in chains and apart; as by comparing all pairs."""
    r = np.random.default_rng(segment)
    low, bits = simhash.SEGMENTS[segment]
    fixed = np.uint64(((1 << bits) - 1 & ~1) << low)
    base = r.integers(0, 1 << 63, 150).astype(np.uint64) & ~fixed
    near = [base]
    for _ in range(3):
        flips = np.zeros(150, np.uint64)
        for _ in range(2):
            flips |= np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64)
        near.append(near[-1] ^ (flips & ~fixed))
    fps = np.unique(np.concatenate(near))
    a, b = simhash._forest(simhash.links_of_many(fps, simhash.MASKS[segment]))
    assert (np.bitwise_count(a ^ b) >= 0).all()
    label = {int(f): i for i, f in enumerate(fps.tolist())}

    def roots(pairs):
        up = list(range(len(fps)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in pairs:
            x, y = find(label[int(x)]), find(label[int(y)])
            up[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(fps))]

    close = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if bin(int(x) ^ int(y)).count("1") <= 4]
    assert roots(zip(a.tolist(), b.tolist(), strict=True)) == roots(close)
    assert simhash._segment((low << 22) - (1 << 32 if low << 22 >= 1 << 31 else 0)) == segment
