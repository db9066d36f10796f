import random

import numpy as np
from helpers import ODD, docs

import corpus_pipeline
from tidewheel.llm import near_copies, simhash


def sets(text):
    w = (text or "").lower().encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def roots(rows, least=0.8):
    """Groups by comparing all pairs."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if alike(s, t) >= least:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d, _ in rows}


def planted(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(800)]
    rows = []
    for family in range(25):
        base = rng.choices(words, k=rng.randint(80, 300))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 6)):
            own = list(base)
            for at in rng.sample(range(len(own)), max(1, len(own) // 70)):
                own[at] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    return rows


def test_groups_are_those_of_all_pairs(spark):
    rows = planted()
    want = roots(rows)
    got = {r.doc_id: r.root for r in near_copies.near_copies(docs(spark, rows)).collect()}
    assert all(want[d] == want[r] for d, r in got.items())  # nothing is grouped that is not alike
    paired = [d for d in want if sum(want[x] == want[d] for x in want) > 1]
    assert sum(got.get(d) == want[d] for d in paired) >= 0.95 * len(paired) and len(paired) > 50


def test_odd_rows(spark):
    got = {r.doc_id: r.root for r in near_copies.near_copies(docs(spark)).collect()}
    assert got[6] == 5 and got[2] == got[7] == 1 and None not in got and 3 not in got
    assert near_copies.near_copies(docs(spark, [])).collect() == [] and ODD


def test_the_stage_keeps_one_of_each_group(spark, sf):
    rows = planted(9)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), sf).collect()}
    want = set(roots(rows).values())
    assert want <= kept | {0} and len(kept) <= len(want) + 2


def test_look_alikes_hide_no_pair(spark):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(225)]
    rows = []
    for k in range(400):  # variants of a template, any two at about 0.78
        own = list(base)
        for j, at in enumerate(rng.sample(range(5, 220, 10), 3)):
            own[at] = f"v{k}x{j}"
        rows.append((len(rows), " ".join(own)))
    for d in range(60):  # partners: one block of theirs differs
        words = rows[d][1].split()
        rows.append((len(rows), " ".join(words[:-18] + [f"p{d}x{i}" for i in range(18)])))
    got = {r.doc_id: r.root for r in near_copies.near_copies(docs(spark, rows)).collect()}
    want = roots(rows)
    assert got == {d: r for d, r in want.items() if sum(x == r for x in want.values()) > 1} and len(got) >= 120


def test_lists_and_stars_by_hand():
    n = np.array([10, 9, 4, 10, 7])
    row, key = near_copies.lists(np.array([1, 1, 1, 2, 2]), n, np.arange(5))
    assert sorted(row.tolist()) == [0, 1] and len(set(key.tolist())) == 1  # 4 is too short for 9, 7 for 10
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 50, 1, 2, 51, 100, 3, 7)]
    assert near_copies.stars(sets).tolist() == [0, 1, 0, 0, 1, 5, 0, 7]


def edited(seed=11, least=0.8, most=0.9):
    """Pairs that differ by one block, put in or cut out, with similarities between the two."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(2000)]
    rows = []
    while len(rows) < 200:
        base = rng.choices(words, k=rng.randint(60, 400))
        size, at = rng.randint(4, 80), rng.choice([0, len(base), rng.randrange(len(base))])
        other = base[:at] + rng.choices(words, k=size) + base[at:] if rng.random() < 0.5 else base[:at] + base[at + size :]
        if least <= alike(" ".join(base), " ".join(other)) < most:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    return rows


def test_blocks_put_in_or_cut_out(spark):
    rows = edited()
    assert {r.doc_id: r.root for r in near_copies.near_copies(docs(spark, rows)).collect()} == roots(rows)


def test_a_document_that_goes_still_links(spark):
    # 0 and 1 link by fingerprint, 1 and 2 are at 0.8 or more, 0 and 2 are not
    rng = random.Random(2)
    while True:
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        first, last = list(base), list(base)
        first[-1] = "other"
        last[:6] = [f"u{rng.randrange(10**6)}" for _ in range(6)]
        first, base, last = (" ".join(x) for x in (first, base, last))
        a, b, c = (simhash.fingerprint(x.encode()) for x in (first, base, last))
        if (a ^ b).bit_count() <= 3 and min((a ^ c).bit_count(), (b ^ c).bit_count()) > 3 and alike(base, last) >= 0.8 > alike(first, last):
            break
    kept = near_copies.one_of_each(docs(spark, [(0, first), (1, base), (2, last)])).collect()
    assert [r.doc_id for r in kept] == [0]


def test_bitmaps_part_no_near_sets():
    rng = np.random.default_rng(1)
    for size in (5, 40, 900, 20_000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.append(a[size // 9 :], rng.integers(0, 1 << 63, size // 9, dtype=np.uint64)))
        bits = np.stack([near_copies.bitmap(x) for x in (a, b)])
        assert (near_copies.bitmap(a) == near_copies.bitmap(a.copy())).all()
        assert near_copies.similarity(a, b) >= 0.8 or size == 5
        if near_copies.similarity(a, b) >= 0.8:
            assert near_copies.possible(np.array([len(a), len(b)]), bits).tolist() == [0, 0]
    far = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(2)]
    assert near_copies.possible(np.array([300, 300]), np.stack([near_copies.bitmap(x) for x in far])).tolist() == [0, 1]


def test_bitmaps_of_long_sets():
    rng = np.random.default_rng(4)
    new = lambda size: np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    long = new(20_000)
    # unlike ones that share a passage, a near one, and near pairs on both sides of a size at which bitmaps double
    a, b = new(1020), new(16_300)
    sets = [long, np.append(long[:500], new(19_500)), new(5000), new(40), np.append(long[1500:], new(1500)), a, np.append(a, new(100)), b, np.append(b, new(2000)), new(5100)]
    bits = [near_copies.bitmap(x) for x in sets]
    assert len(bits[5]) * 2 == len(bits[6]) and len(bits[7]) * 2 == len(bits[8])
    assert near_copies.possible(np.array([len(x) for x in sets]), bits).tolist() == [0, 1, 2, 3, 0, 5, 5, 7, 7, 9]
    for size in (1023, 1024, 1025, 3000):
        x = new(size)
        assert (near_copies.folded(near_copies.bitmap(x, 256), len(near_copies.bitmap(x))) == near_copies.bitmap(x)).all()
