import random
from itertools import combinations

import pytest
from helpers import ODD, docs

from tidewheel.llm import decontamination, queries


def words(text):
    return [x for w in (text or "").lower().encode().split() if (x := "".join(filter(str.isalnum, w.decode())))]


def overlaps(text, item, window=13, tolerance=0.2):
    """Whether some window of the item stands in the text with few substitutions, at any place."""
    a, b = words(text), words(item)
    need = min(window, len(b))
    if not need:
        return False
    for d in range(-len(b) + need, len(a) - need + 1):
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        same = [b[k] == a[k + d] for k in range(lo, hi)]
        if any(sum(same[k : k + need]) >= need - int(tolerance * need) for k in range(len(same) - need + 1)):
            return True
    return False


def test_whole_table(spark, sf):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op3_benchmark_decontamination(spark, sf).collect()}
    sets = {i: set(words(t)) for i, t in bench.items()}
    want = set()
    for d, t in table.items():
        own = set(words(t))
        for i, item in bench.items():
            if len(own & sets[i]) >= 0.5 * len(sets[i]) and overlaps(t, item):
                want.add((d, i))
    assert got == want and got


def test_every_place_of_the_allowed_substitutions_is_found():
    """Items of 1 to 16 words in the middle of other words, with every choice of words changed that the tolerance allows."""
    for size in range(1, 17):
        need = min(size, 13)
        item = [f"i{size}x{k}" for k in range(size)]
        index, own = decontamination.Index([(7, " ".join(item).encode())]), decontamination.Words()
        texts, places = [], []
        for lo in range(size - need + 1):
            for e in range(int(0.2 * need) + 1):
                for changed in combinations(range(lo, lo + need), e):
                    text = [w if lo <= k < lo + need and k not in changed else f"other{k}" for k, w in enumerate(item)]
                    texts.append(" ".join(["a", "b", *text, "c"]).encode())
                    places.append((lo, e))
        found = {m[0]: m for m in index.matches(*own.of(texts))}
        assert sorted(found) == list(range(len(texts)))
        for t, (lo, e) in enumerate(places):
            _, item_id, doc_start, item_start, n, equal, _ = found[t]
            assert item_id == 7 and doc_start == item_start + 2 and item_start <= lo and item_start + n >= lo + need and equal == need - e


def test_an_overlap_does_not_reach_over_words_that_differ():
    item = [f"w{k}" for k in range(40)]
    text = [w if not 14 <= k < 22 else "x" for k, w in enumerate(item)]
    index, own = decontamination.Index([(1, " ".join(item).encode())]), decontamination.Words()
    ((_, _, start, _, n, equal, share),) = index.matches(*own.of([" ".join(text).encode()]))
    assert (start, n, equal, share) == (20, 20, 18, 18 / 40)


VOCABULARY = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("block_words", [400_000, 60])
def test_substitutions(spark, block_words):
    rng = random.Random(3)
    bench = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(14, 50)))) for i in range(20)] + [(50, "short item here"), (51, ""), (52, None), (53, "one"), (None, "an item that has no id but words " * 3)]
    rows, want = [], set()
    for k in range(60):
        item = bench[k % 20][1].split()
        for j in range(k // 20, len(item), 9):  # up to one word in nine is another
            item[j] = "changed"
        rows.append((k, " ".join([*rng.choices(VOCABULARY, k=30), *item, *rng.choices(VOCABULARY, k=30)])))
        want.add((k, k % 20))
    rows += [(100 + k, " ".join(rng.choices(VOCABULARY, k=80))) for k in range(60)]
    rows += [(200, "A Short, item -- here!"), (201, "short other here"), (202, "say one thing"), (203, "an item that has no id but words an item that has no id but words an item that has no id but words")]
    b = spark.createDataFrame([(i, t, 1, "x") for i, t in bench], "item_id long, text string, doc_id int, lang string")
    found = decontamination.contaminations(docs(spark, rows), b, block_words=block_words).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert want <= got and {(200, 50), (202, 53), (203, None)} <= got
    assert not [p for p in got - want if p[0] >= 100 and p not in {(200, 50), (202, 53), (203, None)}]
    one = next(r for r in found if (r.doc_id, r.item_id) == (0, 0))
    assert one.doc_start == 30 and one.item_start == 0
    kept = {r.doc_id for r in decontamination.clean(docs(spark, rows), b).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_odd_rows(spark):
    b = spark.createDataFrame([(1, "one two three"), (2, "<|endoftext|> and"), (3, "A b C. " * 9)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(docs(spark), b).collect()}
    assert {(5, 1), (6, 1), (11, 2), (12, 3)} == got
    assert decontamination.contaminations(docs(spark, []), b).collect() == []
    assert decontamination.contaminations(docs(spark), b.limit(0)).collect() == []
    assert decontamination.clean(docs(spark), b).columns == docs(spark).columns
    assert decontamination.clean(docs(spark), b).count() == len(ODD) - 5
