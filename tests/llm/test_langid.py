import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, crc, docs

from tidewheel.llm import langid, queries

EDGE = "\x01"


def kneser_ney(words, order, alphabet):
    """Interpolated Kneser-Ney by the book, in dicts: a function from (context, character) to a probability."""
    tables = {order: Counter()}
    for w, n in words.items():
        text = EDGE * (order - 1) + w + EDGE
        for i in range(len(w) + 1):
            tables[order][text[i : i + order]] += n
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    disc, mass, kinds = {}, defaultdict(int), defaultdict(int)
    for k, t in tables.items():
        ones, twos = sum(n == 1 for n in t.values()), sum(n == 2 for n in t.values())
        disc[k] = ones / (ones + 2 * twos) if ones else 0.5
        for g, n in t.items():
            mass[k, g[:-1]] += n
            kinds[k, g[:-1]] += 1

    def p(context, c, k=order):
        if not k:
            return 1 / alphabet
        context = context[len(context) - k + 1 :]
        below = p(context, c, k - 1)
        m = mass.get((k, context), 0)
        return max(tables[k].get(context + c, 0) - disc[k], 0) / m + disc[k] * kinds[k, context] / m * below if m else below

    return p


def test_models_are_kneser_ney():
    corpora = {"a": Counter({"banana": 3, "band": 2, "an": 5, "nab": 1}), "b": Counter({"über": 2, "band": 1, "raum": 4, "r": 1})}
    languages = sorted(corpora)
    batch = langid.counted(Counter({(x, w): n for x, c in corpora.items() for w, n in c.items()})).to_pylist()
    grams = sorted({r["gram"] for r in batch})
    table = np.zeros((len(grams), 2))
    for r in batch:
        table[grams.index(r["gram"]), languages.index(r["lang"])] = r["n"]
    model = langid.Model(grams, table, languages)
    own = ["banana", "band", "raum", "zzz", "a", "übern"]
    got, n = model.score(own)
    assert n.tolist() == [len(w) + 1 for w in own]
    for j, x in enumerate(languages):
        p = kneser_ney(corpora[x], langid.ORDER, langid.ALPHABET)
        for i, w in enumerate(own):
            text = EDGE * 3 + w + EDGE
            want = sum(math.log(max(p(text[k : k + 3], text[k + 3]), 1e-12)) for k in range(len(w) + 1))
            assert got[i, j] == pytest.approx(want, rel=1e-4)


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) < 0.1 * len(rows)


def test_odd_rows(spark):
    rows = langid.identified(docs(spark)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = [t for d, t in ODD if d == r.doc_id][0]
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
    assert langid.identified(docs(spark, [])).collect() == []
    unlabelled = docs(spark, [(1, "some text"), (3, "more")])
    assert {(r.lang_pred, r.score) for r in langid.identified(unlabelled).collect()} == {("und", 0.0)}


def test_foreign_text_is_rejected(spark):
    rows = [(2 * i + 1, f"the quick brown fox number {w} jumps over the lazy dog and runs home to {w}") for i, w in enumerate("one two three four five six seven eight nine ten".split() * 20)]
    df = docs(spark, [*rows, (1000, "щука ёрш плотва окунь"), (1002, "the fox runs over the dog")])
    got = {r.doc_id: r for r in langid.identified(df).collect()}
    assert got[1000].rejected and not got[1002].rejected


def test_a_long_run_is_read_to_its_end():
    found = ["\x01\x01\x01a", "\x01\x01ab", "\x01aba", "abab", "baba", "\x01\x01\x01c", "\x01\x01cd", "\x01cdc", "cdcd", "dcdc"]
    model = langid.Model(found, np.array([[9, 0]] * 5 + [[0, 9]] * 5), ["ab", "cd"])
    run = langid.entropies(model)
    text = "ab" * 40 + "cd" * 30_000
    h = run([text.encode(), ("ab" * 40).encode(), b"ab " + text.encode()])
    assert h.argmin(axis=1).tolist() == [1, 0, 1]
    whole, n = model.score([text])
    assert np.allclose(h[0], -whole[0] / n[0], rtol=1e-4)
    for step in (1, 7, 64):
        assert np.allclose(model.score_long(text[:300], step)[0], model.score([text[:300]])[0][0], rtol=1e-4)
    assert langid.Scored()[text.encode()] == text
