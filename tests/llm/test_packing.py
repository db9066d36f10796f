import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewheel.llm import packing, queries

LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_tokenizers_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert packing.token_ids(text, packing.default_vocabulary()).tolist() == ids_of(text)


def whole(rows, texts, capacity=2048):
    places, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append(r)
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    for doc, text in texts.items():
        ids = np.array(ids_of(text), dtype="<u4")
        got = sorted(seen.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and sum(r.length for r in got) == len(ids)
        assert len(got) == -(-len(ids) // capacity) and all(r.length == capacity for r in got[1:])
        at = 0
        for r in got:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    assert not seen
    return len(places), sum(r.length for r in rows)


def test_whole_table(spark, sf):
    rows = queries.op2_best_fit_packing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n, total = whole(rows, texts)
    assert n <= -(-total // 2048) + 1


def test_odd_rows(spark):
    own = [r for k, r in enumerate(ODD) if r[0] is not None and k != 6]
    whole(packing.packed(docs(spark, own)).collect(), dict(own))
    rows = packing.packed(docs(spark)).collect()
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 6 for r in rows) == 2
    assert packing.packed(docs(spark, [])).collect() == []


def best_fit(lengths, capacity):
    """Sequences that plain best-fit decreasing opens."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_a_task_is_best_fit_decreasing(lengths):
    own = sorted(lengths, reverse=True)
    bins = defaultdict(list)
    for k, seq, at in packing.best_fit({}, enumerate(own), 20, iter(range(100))):
        assert at == sum(own[j] for j in bins[seq])
        bins[seq].append(k)
    assert sum(map(len, bins.values())) == len(own) and len(bins) == best_fit(lengths, 20)
    assert all(sum(own[k] for k in x) <= 20 for x in bins.values())


def test_successors_resolve_conflicts_by_rank():
    """Four documents of at most 4 below gaps of at least 9 and of at least 5: the near range first, two documents to each far gap."""
    docs_, gaps = packing.successors([(0, 0, 0, 1, 9), (1, 0, 0, 2, 5), (2, 4, 4, 0, 0), (3, 0, 0, 3, 1)])
    assert docs_ == [(2, 0, 2, 0, 1), (2, 2, 4, 2, 2)] and gaps == [(1, 0, 2, 0), (0, 0, 1, 2)]


@pytest.mark.parametrize(("name", "task_rows"), [("mixed", 1 << 20), ("mixed", 300), ("long", 300), ("equal", 100), ("short", 500), ("halves", 200)])
def test_supersteps_need_no_more_sequences_than_best_fit_decreasing(spark, name, task_rows):
    rng = np.random.default_rng(5)
    lengths = {
        "mixed": np.clip(rng.lognormal(5, 1.3, 3000), 1, 2048),
        "long": rng.integers(600, 2049, 2000),
        "equal": np.full(1000, 700),
        "short": rng.integers(1, 40, 4000),
        "halves": np.concatenate([rng.integers(900, 1149, 1500), rng.integers(1, 200, 1500)]),
    }[name].astype(int)
    own = spark.createDataFrame([(k if k % 9 else None, 0, 0, int(n)) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
    rows = packing.pack(own, task_rows=task_rows).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.length for r in rows) == sorted(lengths.tolist())
    for x in places.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    least = best_fit(lengths.tolist(), 2048)
    # each task may leave one sequence that nothing shorter fills
    assert len(places) <= (least if task_rows > len(lengths) else least * 1.01 + len(lengths) // task_rows)


def test_sequences_hold_the_ids(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    texts = {r.doc_id: r.text for r in table.collect()}
    got = packing.sequences(table.where("doc_id is not null")).collect()
    assert sum(len(r.ids) for r in got) == sum(len(ids_of(t)) for t in texts.values())
