import zlib
from collections import defaultdict

from helpers import ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import queries, sharding


def held(rows, texts, shards=24):
    key = lambda x: (str(x[0]), *x[1:])
    raw = [(d, (t or "").encode()) for d, t in texts]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=key) == sorted(((d, len(b) + 8, zlib.crc32(b)) for d, b in raw), key=key)
    places, load = defaultdict(list), [0] * shards
    for r in rows:
        places[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return load


def test_whole_table(spark, sf):
    sf = sf.replace("0.001", "0.01")
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    load = held(queries.op4_sharding(spark, sf).collect(), table)
    assert max(load) < 1.02 * sum(load) / len(load)


def test_odd_rows(spark):
    rows, m = sharding.sharded(docs(spark), shards=5, slots=64)
    held(rows.collect(), ODD, 5)
    assert sharding.sharded(docs(spark, []))[0].collect() == []
    assert sharding.map_table(spark, m).count() == 64


def test_maps_are_kept_and_edited(spark, tmp_path):
    """A second run uses the map of the first; more shards and a grown table make new versions of it, which move few records."""
    path, rows = f"file://{tmp_path}/maps", [(k, "x" * (k % 50)) for k in range(3000)]
    first, m1 = sharding.sharded(docs(spark, rows), 5, 256, maps=path)
    again, m2 = sharding.sharded(docs(spark, rows), 5, 256, maps=path)
    assert m1.version == 1 and m1 == m2 == sharding.kept_map(spark, path)
    assert {(r.doc_id, r.shard) for r in first.collect()} == {(r.doc_id, r.shard) for r in again.collect()}
    grown, m3 = sharding.sharded(docs(spark, rows), 6, 256, maps=path)
    load = held(grown.collect(), rows, 6)
    assert m3.version == 2 and max(load) < 1.1 * sum(load) / 6
    assert sum(a != b for a, b in zip(m1.owner, m3.owner, strict=True)) < 256 / 3
    more = [*rows, *((10_000, "y" * 40) for _ in range(2000))]  # a hot id: its slot is no one's to split, but its rows are
    hot, m4 = sharding.sharded(docs(spark, more), 6, 256, maps=path)
    held(hot.collect(), more, 6)
    assert m4.version == 3 and sharding.kept_map(spark, path) == m4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=64, max_size=64), st.integers(1, 6), st.integers(1, 8))
def test_rebalancing(sizes, before, after):
    old = sharding.fresh_map(sizes, before)
    new = sharding.rebalanced(old, sizes, after)
    assert new.version == 2 and sharding.SlotMap.from_json(new.to_json()) == new
    load = [sum(s for s, k in zip(sizes, new.owner, strict=True) if k == j) for j in range(after)]
    assert all(0 <= k < after for k in new.owner) and max(load) <= sum(sizes) / after + 2 * max(sizes)
    again = sharding.rebalanced(new, sizes)
    assert sum(a != b for a, b in zip(again.owner, new.owner, strict=True)) <= 16
    moved = sum(s for s, a, b in zip(sizes, old.owner, new.owner, strict=True) if a != b)
    if after >= before:  # a growing map moves little more than what the new shards need
        assert moved <= sum(sizes) * (1 - before / after) + (before + 1) * max(sizes)
