import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, crc, docs

from tidewheel.llm import ctw, queries


def kt(a, b):
    """Probability of any sequence of a zeros and b ones, one symbol at a time."""
    p, zeros, ones = 0.0, 0, 0
    for bit, times in ((0, a), (1, b)):
        for _ in range(times):
            p += math.log(((ones if bit else zeros) + 0.5) / (zeros + ones + 1))
            zeros, ones = zeros + (not bit), ones + bit
    return p


class Tree:
    """Context-tree weighting by the book: every node of every decision in a dict."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        self.below = defaultdict(set)
        for t in texts:
            for context, prefix, bit in self.decisions(t):
                for d in range(depth + 1):
                    self.n[prefix, context[:d]][bit] += 1
                    if d:
                        self.below[prefix, context[: d - 1]].add(context[:d])
        self.weighted = {}

    def decisions(self, text):
        whole = [0] * self.depth + [x for w in [*text.lower().split(), b""] for x in (*w, 32)]
        for i in range(self.depth, len(whole)):
            context, byte = tuple(reversed(whole[i - self.depth : i])), whole[i]
            for k in range(8):
                yield context, (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1

    def w(self, prefix, s):
        if (prefix, s) not in self.weighted:
            own = kt(*self.n[prefix, s]) if (prefix, s) in self.n else 0.0
            if len(s) == self.depth:
                out = own
            else:
                out = np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(self.w(prefix, c) for c in self.below.get((prefix, s), ())))
            self.weighted[prefix, s] = out
        return self.weighted[prefix, s]

    def p(self, prefix, context, bit):
        """Mixed over depths: the sum of each node's own estimate under its weight."""
        total, rest = 0.0, 1.0
        for d in range(self.depth + 1):
            s = context[:d]
            a = self.n.get((prefix, s), [0, 0])
            own = 1.0 if d == self.depth else math.exp(math.log(0.5) + kt(*a) - self.w(prefix, s))
            total += rest * own * (a[bit] + 0.5) / (sum(a) + 1)
            rest *= 1 - own
        return total

    def score(self, text):
        return sum(math.log10(self.p(prefix, context, bit)) for context, prefix, bit in self.decisions(text))


SOME = [(1, "the cat sat on the mat"), (2, "the cat ate"), (3, None), (4, "über die Katze the"), (5, "Zzz aaaa bbbb"), (6, "the cat sat on the mat"), (8, "dog THE cat"), (9, ""), (11, "über Katze unknownword"), (None, "the end")]


def test_brute_force(spark):
    rows = {(r.doc_id, r.n_tokens, r.score): r for r in ctw.scored(docs(spark, SOME)).collect()}
    assert len(rows) == len(SOME)
    train = [(t or "").encode() for d, t in SOME if d is None or crc(d, 7) != 2]
    tree = Tree(train, ctw.DEPTH)
    words = Counter(w for t in train for w in [*t.lower().split(), b""])
    n, v = sum(words.values()), len(words)
    by_doc = {r.doc_id: r for r in rows.values()}
    for d, t in SOME:
        r, own = by_doc[d], [*(t or "").encode().lower().split(), b""]
        assert r.held_out == (d is not None and crc(d, 7) == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in words for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.score == pytest.approx(tree.score((t or "").encode()), rel=1e-6)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (sum(map(len, own)) + len(own)), rel=1e-9)


def test_the_tree_is_a_distribution():
    """Chances of all next bytes after a context sum to one."""
    keys = np.unique(np.concatenate([k for k, _, _ in ctw.places([b"abc abd", b"xb", b"abc ab"])]))
    every = np.unique(np.concatenate([keys, *(((keys >> np.uint64(8)) << np.uint64(8)) + np.uint64(x) for x in range(256))]))
    n = np.where(np.isin(every, keys), 5, 0)
    sums = defaultdict(list)
    for rows in ctw.top_rows(every, n):
        for c, *x in zip(*rows, strict=True):
            sums[int(c)].append(x)
    top = ctw.Top(np.array(list(sums)), *np.array([[sum(x) for x in zip(*xs, strict=True)] for xs in sums.values()]).T)
    p = 10 ** ctw.log10_of(every, n, top)
    _, of = np.unique(every >> np.uint64(8), return_inverse=True)
    assert np.allclose(np.bincount(of, weights=p), 1.0)


def test_a_word_is_predicted_from_the_words_before_it(spark):
    """Texts of the same words score apart by their order, the order that was trained on first."""
    train = [(d, "red car blue sky green hill " * 3) for d in range(200) if crc(d, 7) != 2]
    held = [d for d in range(1000, 1100) if crc(d, 7) == 2][:2]
    rows = {r.doc_id: r for r in ctw.scored(docs(spark, [*train, (held[0], "red car blue sky green hill"), (held[1], "car red sky blue hill green")])).collect()}
    assert rows[held[0]].base_score == pytest.approx(rows[held[1]].base_score)
    assert rows[held[0]].score > rows[held[1]].score + 5


def test_slices_of_a_long_text_keep_their_contexts():
    text = bytes(np.random.default_rng(3).integers(97, 123, 10_000).astype(np.uint8))
    whole = np.concatenate([k for k, _, _ in ctw.places([text, b"x"], step=1 << 20)])
    assert np.array_equal(whole, np.concatenate([k for k, _, _ in ctw.places([text, b"x"], step=97)]))


def test_packing_of_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 1000).astype(np.uint64))
    assert np.array_equal(ctw.unpacked(ctw.packed(keys)), keys)
    found = {int(k): p for p, at in ctw.dealt(keys, 7) for k in keys[at]}
    assert len(found) == len(keys) and set(found.values()) == set(range(7))
    assert [len(k) for k, _ in ctw.runs(np.arange(10, dtype=np.uint64) << 32, np.ones(10), most=3)] == [3, 3, 3, 1]
    assert [len(k) for k, _ in ctw.runs(np.array([0, 1, 2, 3, 4, 1 << 32, 2 << 32], dtype=np.uint64), np.ones(7), most=3)] == [5, 2]


def test_odd_rows(spark):
    rows = ctw.scored(docs(spark)).collect()
    assert len(rows) == len(ODD) and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert ctw.scored(docs(spark, [])).collect() == []
    alone = ctw.scored(docs(spark, [(d, "never trained on") for d in range(40) if crc(d, 7) == 2])).collect()
    assert alone and all(r.train_tokens == 0 and r.base_score == 0 for r in alone)


def test_held_out_texts_beat_unigrams(spark, sf):
    """On 10,000 documents. On 1,000 the tree has seen too little and is level with them (-234,584 to -234,375)."""
    rows = [r for r in queries.op6_lm_scoring(spark, sf.replace("0.001", "0.1")).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


def test_hashes_of_words():
    """Equal for equal words alone, of any length and wherever pieces are cut."""
    words = [b"", b"a", b"a\0", b"a\0\0", *(b"x" * n for n in range(1, 80)), *(b"y" * n + b"z" for n in range(80)), "über".encode(), "漢字".encode()]
    of = {w: next(ctw.word_hashes([w + b" "]))[0][0] for w in words}
    assert len(set(of.values())) == len(words)
    bodies = [b"", b" ".join(words[1:]), b" ".join(words[:0:-1] * 3), b"a"]
    streams = [ctw.stream(b) for b in bodies]
    for step in (1, 50, 1 << 22):
        hashes, which = (np.concatenate(x) for x in zip(*ctw.word_hashes(streams, step=step), strict=True))
        for i, b in enumerate(bodies):
            assert hashes[which == i].tolist() == [of[w] for w in [*(b.split(b" ") if b else []), b""]]


def test_entries_keep_large_counts():
    key, n = np.arange(6, dtype=np.uint64) << np.uint64(40), np.array([0, 1, 255, 256, 510, 100_001])
    folded = ctw.Pieces(lambda x: ctw.as_entries(*ctw.summed(x)), most=4)
    for _ in range(3):
        folded.add(ctw.as_entries(key, n))
    found, sums = ctw.summed(folded.all())
    assert np.array_equal(found, key) and np.array_equal(sums, 3 * n)


@pytest.fixture
def block(monkeypatch):
    """Counts and scores texts as one block, with made-up chances; returns the rows of scores."""

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(ctw, "TaskContext", Task)

    def run(texts):
        table = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "held_out": [i % 7 == 2 for i in range(len(texts))]})
        rows = []
        for r in (r for batch in ctw._blocks(iter([table]), 5) for r in batch.to_pylist()):
            size = len(r.pop("keys") or b"") // 8
            r["p"] = None if r["kind"] == ctw.DOCS else ctw.planes(np.full(size, -0.25, np.float32)) if r["kind"] == ctw.KEYS else ctw.planes(np.full(size, 2, np.int64))
            rows.append(r)
        sent = ctw._batch(ctw.SENT, **{c: [r.get(c) for r in rows] for c in ctw.SENT})
        return [r for batch in ctw._score(iter([sent]), 5, 1000, 100) for r in batch.to_pylist()]

    return run


def test_words_are_hashed_together(block, monkeypatch):
    """No Python call for a word of 32 bytes or less (one for each distinct word, twice or more, before)."""
    calls = []
    monkeypatch.setattr(ctw, "xxh64_intdigest", lambda w: calls.append(w) or 7)
    texts = ["", "a b " + "c" * 33, " ".join(f"word{i}" for i in range(500))]
    rows = block(texts)
    assert set(calls) == {b"c" * 33}
    assert [r["n_tokens"] for r in rows] == [len(t.split()) + 1 for t in texts]
    assert [r["score"] for r in rows] == [-0.25 * len(ctw.stream(t.encode())) for t in texts]
