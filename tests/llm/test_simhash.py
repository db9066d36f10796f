import numpy as np
import pytest
import xxhash
from helpers import ODD, WORD, docs, lower
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import queries, simhash


def fingerprint(text):
    words = WORD.findall(lower(text))
    own = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(rows):
    """doc_id -> smallest doc_id reachable, by comparing all pairs."""
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted((d if d is not None else -1, f"{f:016x}", least.get(find(f))) for d, f in rows)


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [(r.doc_id, fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op10_simhash_near_dedup(spark, sf)) == components(rows)


def test_odd_rows(spark):
    assert got(simhash.near_duplicates(docs(spark))) == components([(d, fingerprint(t)) for d, t in ODD])
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_links_with_large_and_small_buckets(spark, most):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(60):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        fps.add(x)
        for _ in range(int(rng.integers(0, 12))):  # chains of small changes
            for b in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
                x ^= 1 << b
            fps.add(x)
    rows = list(enumerate(sorted(fps)))
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(signed, max_bucket=most)).collect()}
    groups = {}
    for d, f in rows:
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(root.get(s, s), []).append(d)
    want = {}
    for d, _, c in components(rows):
        want.setdefault(c, []).append(d)
    assert sorted(groups.values()) == sorted(want.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, (1 << 64) - 1), st.integers(0, 63), st.integers(0, 63)), min_size=1, max_size=30), st.sampled_from([1 << 20, 4]))
def test_near_pairs(seeds, most):
    rows = sorted({(b, y) for b, x, p, q in seeds for y in (x, x ^ (1 << p), x ^ (1 << p) ^ (1 << q))})
    bucket, fps = np.array([b for b, _ in rows]), np.array([f for _, f in rows], dtype=np.uint64)
    order = np.lexsort((simhash.gray_rank(fps), bucket))
    bucket, fps = bucket[order], fps[order]
    out = sorted((int(i), int(j)) for a, b in simhash.near_pairs(bucket, fps, most=most) for i, j in zip(a, b, strict=True))
    every = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bucket[i] == bucket[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3]
    assert out == every


def test_one_of_each_group_stays(spark):
    df = docs(spark)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 8, 9, 10, 11, 12]
