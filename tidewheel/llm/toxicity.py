"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of those of three hashes: the word, its first four and its first five letters, so that words unseen in
training share what was learned of their stems. Hashes that fewer than `SEEN` training texts use share a zero embedding.
Filters of widths 1, 2 and 3 run over the embeddings, the maximum over a text's places is taken for each filter, and a logistic unit
reads the maxima. Training is by Adam on the driver; the epoch with the lowest loss on held-back texts is kept and its output is
calibrated on them (Platt). Thresholds by language are chosen on the same texts; they turn scores into `toxic_by_language`, and
never enter a score.

Bounded sample (parameters `sample`, `sample_bytes`): about that many labelled texts, and about so many bytes of them at most, drawn by
hashes of id and text, whole, come to the driver. Rows that repeat an id count as often as they stand, but when they would make the
sample over twice as large, fewer of them are drawn. `VOCABULARY` bounds the embeddings.
Scoring: the filters' products with every embedding are tabulated once, so a word costs one look-up, whatever the text's length.

Defined results: an empty or null text has the score of no word at all; with fewer than two labels of either kind to learn from, every score is the share
of label 1 (0 without labels). Null labels are left out. Repeated rows are rows. Ties do not arise: a row's score depends on its text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from tidewheel.llm.common import id_remainder, map_arrow, sliced
from tidewheel.plans.scratch import materialize, release

SAMPLE, SAMPLE_BYTES, SEEN, VOCABULARY, DIM, WIDTHS, FILTERS = 10_000, 64 << 20, 3, 1 << 17, 12, (1, 2, 3), 8
EPOCHS, BATCH, RATE, CUT = 8, 64, 0.01, 0.7


class Hashes(dict):
    """The three hashes of each word by its bytes: letters and digits only, lower case; zeros if it has none. Bounded."""

    most = 300_000

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) > self.most:
            self.clear()
        plain = "".join(filter(str.isalnum, word.decode("utf-8", "replace").lower()))
        self[word] = out = (xxh32_intdigest(plain) | 1, xxh32_intdigest("4" + plain[:4]) | 1, xxh32_intdigest("5" + plain[:5]) | 1) if plain else (0, 0, 0)
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts' words one after another (words x 3), and how many each text has. Zeros follow every text, as many as the widest filter has places; its maxima are taken without the last of them, so that no filter reaches into the next."""
        end = [(0, 0, 0)] * WIDTHS[-1]
        each = [[*(self[w] for w in t.split()), *end] for t in texts]
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        flat = chain.from_iterable(chain.from_iterable(each))
        return np.fromiter(flat, dtype=np.uint32, count=3 * int(sizes.sum())).reshape(-1, 3), sizes


@dataclass
class Net:
    """Weights; row 0 of `embed` is the zero embedding. keys: sorted hashes of rows 1, 2, ..."""

    keys: np.ndarray
    embed: np.ndarray
    conv: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    base: float | None = None  # the only score, if there was too little to learn from
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(hashes.shape, dtype=np.int32)
        out = np.empty(hashes.shape, dtype=np.int32)
        for lo in range(0, len(hashes), 1 << 18):
            own = hashes[lo : lo + (1 << 18)]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            out[lo : lo + len(own)] = np.where(self.keys[at] == own, at + 1, 0)
        return out

    def tabulated(self) -> list[list[np.ndarray]]:
        """For each width and offset: every embedding times that part of the filters."""
        return [[self.embed @ part for part in w] for w in self.conv]

    def maxima(self, rows: np.ndarray, sizes: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """The maximum of every filter over each text."""
        firsts, best = np.cumsum(sizes) - sizes, []
        for w, parts in enumerate(tables):
            z = parts[0][rows[:, 0]] + parts[0][rows[:, 1]] + parts[0][rows[:, 2]]
            for k in range(1, len(parts)):
                for j in range(3):
                    z[:-k] += parts[k][rows[k:, j]]
            z[past(sizes)] = -np.inf
            best.append(np.maximum(np.maximum.reduceat(z, firsts, axis=0) + self.bias[w], 0))
        return np.concatenate(best, axis=1)

    def logit(self, rows: np.ndarray, sizes: np.ndarray, tables=None, step: int = 128) -> np.ndarray:
        """Before the logistic function, some texts at a time."""
        tables, ends, out = tables or self.tabulated(), np.concatenate([[0], np.cumsum(sizes)]), []
        for lo in range(0, len(sizes), step):
            own = sizes[lo : lo + step]
            part = self.maxima(rows[ends[lo] : ends[lo + len(own)]], own, tables)
            out.append((part @ self.out + self.out_bias) * self.scale[0] + self.scale[1])
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, rows: np.ndarray, sizes: np.ndarray, tables=None) -> np.ndarray:
        if self.base is not None:
            return np.full(len(sizes), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logit(rows, sizes, tables), -40, 40).astype(np.float64)))


def past(sizes: np.ndarray) -> np.ndarray:
    """Places from which the widest filter reaches into the next text."""
    return (np.cumsum(sizes)[:, None] - np.arange(1, WIDTHS[-1])).ravel()


def gradients(net: Net, bias: float, r: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple:
    """Of the mean logistic loss of texts (r: rows of the embedding for each place, n: places of each text): by filters, their biases, the output's weights and its bias; then rows of the embedding that take part (three a place) and the gradient of each place."""
    x = net.embed[r].sum(axis=1)
    tops, at, z0 = [], [], np.cumsum(n) - n
    for w, filters in enumerate(net.conv):
        z = x @ filters[0]
        for k in range(1, len(filters)):
            z[:-k] += x[k:] @ filters[k]
        z[past(n)] = -np.inf
        place = np.stack([z[a : a + c].argmax(axis=0) + a for a, c in zip(z0, n, strict=True)])
        at.append(place)
        tops.append(np.take_along_axis(z, place, axis=0) + net.bias[w])
    pooled = np.maximum(np.concatenate(tops, axis=1), 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + bias, -30, 30)))
    d = ((p - y) / len(n)).astype(net.embed.dtype)
    back = (d[:, None] * net.out) * (pooled > 0)
    g_conv, g_bias, touched, moved = [], [], [], []
    for w, filters in enumerate(net.conv):
        own = back[:, w * filters.shape[2] : (w + 1) * filters.shape[2]]
        g = np.zeros_like(filters)
        for k in range(len(filters)):
            place, some = at[w] + k, own != 0
            g[k] = np.einsum("bf,bfd->df", own, x[place])
            touched.append(r[place[some]])
            moved.append((own[:, :, None] * filters[k].T[None])[some])
        g_conv.append(g)
        g_bias.append(own.sum(axis=0))
    return g_conv, g_bias, pooled.T @ d, d.sum(), np.concatenate(touched), np.concatenate(moved)


def _adam(parameters: list[np.ndarray], rate: float):
    first, second, t = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0

    def step(gradients: list[np.ndarray]) -> None:
        nonlocal t
        t += 1
        for p, g, a, b in zip(parameters, gradients, first, second, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    return step


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits that fit labels best, by Newton steps with a small pull to (1, 0)."""
    w, x = np.array([1.0, 0.0]), np.stack([logit, np.ones(len(logit))], axis=1).astype(np.float64)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def best_threshold(score: np.ndarray, y: np.ndarray, default: float = CUT) -> float:
    """The cut with the highest F1, halfway to the next lower score; the default if there are under five of label 1."""
    if y.sum() < 5:
        return default
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def trained(texts: list[bytes], y: np.ndarray, langs: list[str | None], seed: int = 11, epochs: int = EPOCHS) -> Net:
    """A net fitted to labelled texts."""
    y = np.asarray(y, dtype=np.float64)
    rng = np.random.default_rng(seed)
    empty = Net(np.zeros(0, dtype=np.uint32), np.zeros((1, DIM), dtype=np.float32), [], [], np.zeros(0), 0.0, base=float(y.mean()) if len(y) else 0.0)
    if min(y.sum(), len(y) - y.sum()) < 2:
        return empty
    parts = []
    hashing = Hashes()
    for lo in range(0, len(texts), 256):  # word lists of a few texts at a time
        parts.append(hashing.of(texts[lo : lo + 256]))
    hashing.clear()
    hashes, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    firsts = np.cumsum(sizes) - sizes
    used = [np.unique(hashes[a : a + n]) for a, n in zip(firsts, sizes, strict=True)]
    kinds, seen = np.unique(np.concatenate(used), return_counts=True)
    kinds, seen = kinds[kinds > 0], seen[kinds > 0]
    order = np.lexsort((kinds, -seen))[:VOCABULARY]
    keys = np.sort(kinds[order][seen[order] >= SEEN])
    normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    net = Net(keys, normal(len(keys) + 1, DIM, by=0.1), [normal(w, DIM, FILTERS, by=0.3) for w in WIDTHS], [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), by=0.3), float(np.log(y.mean() / (1 - y.mean()))))
    net.embed[0] = 0
    rows = net.rows(hashes)
    del hashes, used
    # one in five is held back; copies of a text fall on the same side
    side = np.array([xxh32_intdigest(t) % 5 == 0 for t in texts])
    train, hold = np.flatnonzero(~side), np.flatnonzero(side)
    if not len(train) or min(y[hold].sum(), (1 - y[hold]).sum()) < 2:
        train = hold = np.arange(len(y))
    bias = np.array([net.out_bias], dtype=np.float32)
    step = _adam([*net.conv, *net.bias, net.out, bias], RATE)
    squares = np.zeros(len(net.embed), dtype=np.float32)  # embeddings take Adagrad: only rows in use move
    gather = lambda which: (np.concatenate([rows[firsts[i] : firsts[i] + sizes[i]] for i in which]), sizes[which])
    best, kept = np.inf, None
    for _ in range(epochs):
        turn = rng.permutation(train)
        for lo in range(0, len(turn), BATCH):
            which = turn[lo : lo + BATCH]
            r, n = gather(which)
            r = np.where(rng.random(r.shape) < 0.15, 0, r)  # hashes left out at random
            g_conv, g_bias, g_out, g_shift, touched, moved = gradients(net, float(bias[0]), r, n, y[which])
            g_conv = [g + 1e-4 * filters for g, filters in zip(g_conv, net.conv, strict=True)]
            step([*g_conv, *g_bias, g_out + 1e-4 * net.out, np.array([g_shift], dtype=np.float32)])
            hit, place = np.unique(touched, return_inverse=True)
            gx = np.zeros((len(hit), DIM), dtype=np.float32)
            np.add.at(gx, place.ravel(), np.repeat(moved, 3, axis=0))
            squares[hit] += (gx * gx).sum(axis=1)
            net.embed[hit] -= 0.05 * gx / np.sqrt(squares[hit] + 1e-8)[:, None]
            net.embed[0] = 0
        net.out_bias = float(bias[0])
        s = net.score(*gather(hold))
        loss = float(-np.mean(y[hold] * np.log(s + 1e-9) + (1 - y[hold]) * np.log(1 - s + 1e-9)))
        if loss < best:
            best, kept = loss, (net.embed.copy(), [c.copy() for c in net.conv], [b.copy() for b in net.bias], net.out.copy(), net.out_bias)
    net.embed, net.conv, net.bias, net.out, net.out_bias = kept
    net.scale = platt(net.logit(*gather(hold)), y[hold])
    s = net.score(*gather(hold))
    for lang in {x for x in langs if x is not None}:
        of = np.array([langs[i] == lang for i in hold])
        net.thresholds[lang] = best_threshold(s[of], y[hold][of])
    return net


def labelled(docs: DataFrame, labels: DataFrame, where: Column, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list:
    """About `sample` rows (text, lang, toxic) of documents with a label where `where` holds of doc_id. Labels are drawn first, so the documents are only read, not moved."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(where & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    total = own.count()
    if not total:
        return []
    few = own.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / total))).dropDuplicates()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    drawn = materialize(texts.join(F.broadcast(few), "doc_id"), "labelled")  # few: about `sample` narrow rows
    got = drawn.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    rate = min(1.0, 2 * sample / max(1, got["n"]), sample_bytes / max(1, got["b"] or 0))
    # of rows that are alike their share is drawn, rounded up or down by a hash
    alike = drawn.groupBy("doc_id", "text", "lang", "toxic").count()
    share = F.floor(F.col("count") * rate + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000).cast("int")
    out = alike.where(share > 0).select("text", "lang", "toxic", F.explode(F.sequence(F.lit(1), share))).select("text", "lang", "toxic").collect()
    release(drawn)
    return out


def fitted(docs: DataFrame, labels: DataFrame, where: Column, sample: int = SAMPLE) -> Net:
    # rows come in any order; training sees them in one
    rows = sorted(((r["text"] or "").encode(), r["lang"] or "", r["toxic"]) for r in labelled(docs, labels, where, sample))
    return trained([t for t, _, _ in rows], np.array([y for _, _, y in rows]), [x or None for _, x, _ in rows])


def scored(docs: DataFrame, net: Net, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted (score >= cut), threshold (of the row's language, else cut) and toxic_by_language of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, own = sent.value, Hashes()
        tables = net.tabulated()
        for part, texts in sliced(batches, "text", 2 << 20):
            hashes, sizes = own.of(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(net.score(net.rows(hashes), sizes, tables))], names=["doc_id", "lang", "score"])

    rows = map_arrow(docs, run, "doc_id long, lang string, score double")
    pairs = [x for k, v in sorted(net.thresholds.items()) for x in (F.lit(k), F.lit(v))]
    threshold = F.coalesce(F.element_at(F.create_map(*pairs), F.col("lang")), F.lit(cut)) if pairs else F.lit(cut)
    return rows.select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("toxic_by_language"))


def classified(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """scored() of docs by a net that learns from labels of ids whose remainder is not `held`, and held_out."""
    remainder = id_remainder(F.col("doc_id"), folds)
    net = fitted(docs, labels, remainder != held, sample)
    return scored(docs, net).withColumn("held_out", remainder == held)
