import random

import numpy as np
from helpers import ODD, crc, docs
from pyspark.sql import functions as F

from tidewheel.llm import queries, toxicity

PLAIN = [f"{a}{b}" for a in ("ba", "do", "ke", "li", "mu", "no", "pe") for b in ("ra", "ti", "so", "na", "ven", "lor", "mex", "qui")]
RUDE = ["grumpfool", "grumpdolt", "grumpass", "snarkpig", "snarkrat", "snarkbug"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(PLAIN, k=rng.randint(20, 60))
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900)
    labels = spark.createDataFrame([(d, 1, y, "x") for d, _, y in rows], "doc_id long, quality int, toxic int, lang string")
    got = {r.doc_id: r for r in toxicity.classified(docs(spark, [(d, t) for d, t, _ in rows]), labels).collect()}
    held = [(got[d], y) for d, _, y in rows if crc(d, 3) == 1]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(r.predicted == y for r, y in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_on_the_tables(spark, sf):
    sf = sf.replace("0.001", "0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op1_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in rows)
    assert hit >= 0.7 * sum(truth[r.doc_id] for r in rows) and hit >= 0.95 * sum(r.predicted for r in rows)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(d, None if d == 4 else d % 2) for d, _ in ODD if d] + [(1, 1), (999, 1)], "doc_id long, toxic int")
    rows = toxicity.classified(docs(spark), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classified(docs(spark, []), labels).collect() == []
    none = toxicity.classified(docs(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def test_scores_by_hand():
    """Tabulated look-ups give what convolution over embeddings gives."""
    rows = corpus(200, 4)
    net = toxicity.trained([t.encode() for _, t, _ in rows], np.array([y for _, _, y in rows]), ["en"] * 200, epochs=2)
    hashes, sizes = toxicity.Hashes().of([b"bara doti grumpfool kelor", b"", b"one unseenword"])
    got, at = net.logit(net.rows(hashes), sizes), 0
    for k, n in enumerate(sizes):
        x = net.embed[net.rows(hashes[at : at + n])].sum(axis=1)
        pooled = []
        for w, (filters, bias) in enumerate(zip(net.conv, net.bias, strict=True)):
            wide = np.concatenate([x, np.zeros((3, x.shape[1]))])
            z = [sum(wide[i + j] @ filters[j] for j in range(len(filters))) for i in range(n)]
            pooled.append(np.maximum(np.max(z, axis=0) + bias, 0))
        want = (np.concatenate(pooled) @ net.out + net.out_bias) * net.scale[0] + net.scale[1]
        assert np.isclose(got[k], want, rtol=1e-3, atol=1e-4)
        at += n


def test_thresholds():
    score, y = np.linspace(0, 1, 101), (np.linspace(0, 1, 101) > 0.605).astype(float)
    assert 0.6 <= toxicity.best_threshold(score, y) <= 0.61
    assert toxicity.best_threshold(score, np.zeros(101)) == toxicity.CUT
    a, b = toxicity.platt(np.array([-3.0, -2, -1, 1, 2, 3] * 50), np.array([0, 0, 1, 0, 1, 1] * 50))
    assert a > 0 and abs(b) < 0.5


def test_a_score_depends_on_its_own_text_only():
    rows = corpus(400)
    net = toxicity.trained([r[1].encode() for r in rows], np.array([r[2] for r in rows]), ["en"] * len(rows))
    texts, own = [b"bara", b"", b"grumpfool snarkpig", b"doti x " * 30, b"grumpass"], toxicity.Hashes()

    def score(some):
        hashes, sizes = own.of(some)
        return net.score(net.rows(hashes), sizes)

    assert np.allclose(score(texts), [score([t])[0] for t in texts], rtol=1e-5)
    assert np.allclose(score(texts)[::-1], score(texts[::-1]), rtol=1e-5)


def test_gradients_are_those_of_the_loss():
    """Against differences of the loss, in double precision, for every parameter of a small net."""
    rng = np.random.default_rng(2)
    net = toxicity.Net(np.arange(1, 10, dtype=np.uint32), rng.normal(size=(10, 3)), [rng.normal(size=(w, 3, 2)) for w in (1, 2, 3)], [rng.normal(size=2) for _ in range(3)], rng.normal(size=6), 0.0)
    net.embed[0] = 0
    n, y, bias = np.array([5, 4, 7]), np.array([1.0, 0.0, 1.0]), 0.3
    r = rng.integers(1, 10, (int(n.sum()), 3))
    for end in np.cumsum(n):
        r[end - 3 : end] = 0  # what follows every text

    def loss(shift=0.0):
        z = net.maxima(r, n, net.tabulated()) @ net.out + bias + shift
        p = 1 / (1 + np.exp(-z))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g_conv, g_bias, g_out, g_shift, touched, moved = toxicity.gradients(net, bias, r, n, y)
    g_embed = np.zeros_like(net.embed)
    np.add.at(g_embed, touched.ravel(), np.repeat(moved, 3, axis=0))
    h = 1e-6
    assert abs((loss(h) - loss(-h)) / (2 * h) - g_shift) < 1e-6
    for values, g in [*zip(net.conv, g_conv, strict=True), *zip(net.bias, g_bias, strict=True), (net.out, g_out), (net.embed[1:], g_embed[1:])]:
        for i in np.ndindex(values.shape):
            at = values[i]
            values[i] = at + h
            up = loss()
            values[i] = at - h
            down = loss()
            values[i] = at
            assert abs((up - down) / (2 * h) - g[i]) < 1e-6


def test_the_sample_is_bounded_however_often_an_id_stands(spark):
    rows = [(1, f"text {k % 7}") for k in range(500)] + [(2, "other"), (3, "x" * 5000)]
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    got = toxicity.labelled(docs(spark, rows), labels, every, sample=20)
    assert 0 < len(got) < 100
    key = lambda x: sorted((r.text, r.toxic) for r in x)
    assert key(got) == key(toxicity.labelled(docs(spark, rows), labels, every, sample=20))
    assert sum(len(r.text) for r in toxicity.labelled(docs(spark, rows), labels, every, sample_bytes=2000)) < 5000 + 2000
