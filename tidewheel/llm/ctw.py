"""Language-model scoring by context-tree weighting.

A text is its words, each closed by a space, then one more space, the end (an empty word). Bytes are split into eight binary
decisions. Each decision is predicted from the `DEPTH` bytes before it, whatever words they belong to, at all depths from none to
`DEPTH`, the nearest byte first; before a text stand zeros. In every node of the context tree a Krichevsky-Trofimov estimator has
counted the training texts' decisions, and a node's weighted probability is half its own estimate and half the product of its
children's. A text is scored by the trained tree: at each decision the depths are mixed by their weights after training.

Distribution: a context and the byte after it are a key of seven bytes. Each task turns its documents into blocks of about `BLOCK`
bytes and counts a block's distinct keys and words by sorting arrays, without a Python call a place or word; what stands in every
document is one entry a block. Keys, and hashes of words, travel packed, some thousands a row, dealt by their hash to parts whose
number follows the bytes of the texts, so that none is hot.
Distinct keys are then dealt by their nearest `TOP` bytes: subtrees below these are weighted where their keys are, and only the nodes
of the levels above come to the driver (they depend on the alphabet: 255 a pair of bytes that occurs at most). Chances go back to the
parts, from there to the blocks, which score their documents place by place. All counts cover all training texts. Words are told
apart by 64 bits: among a billion words two share a count with a chance of 3 %.

Defined results: null text is empty text, of one token (the end). Rows with a null id are training rows. Repeated rows are rows and count as
often as they stand. Texts of any length are read in slices. An empty table gives no rows; with nothing to train on every decision
has probability one half. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewheel.llm.common import id_remainder, map_arrow, partitions, sliced
from tidewheel.plans.scratch import materialize, release

DEPTH, TOP = 6, 3
BLOCK, PART = 48 << 20, 64 << 20
HALF = math.log(0.5)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def log_gamma_half(n: np.ndarray, half: float) -> np.ndarray:
    """log gamma(n + half) for whole n >= 0; half is 0.5 or 1."""
    z = n + half
    low = np.where(z < 8, z + 8, z)
    out = (low - 0.5) * np.log(low) - low + 0.5 * math.log(2 * math.pi) + 1 / (12 * low) - 1 / (360 * low**3) + 1 / (1260 * low**5)
    for k in range(8):  # gamma(z) = gamma(z + 8) / (z (z + 1) ... (z + 7))
        out -= np.where(z < 8, np.log(z + k), 0.0)
    return out


_SMALL = {half: log_gamma_half(np.arange(4096.0), half) for half in (0.5, 1.0)}


def _log_gamma(n: np.ndarray, half: float) -> np.ndarray:
    table = _SMALL[half]
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    if len(large := np.flatnonzero(n >= len(table))):
        out[large] = log_gamma_half(n[large], half)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to any sequence with these counts."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - math.log(math.pi)


def stream(body: bytes) -> bytes:
    """The bytes to predict of words joined by spaces."""
    return body + b"  " if body else b" "


def places(streams: list[bytes], step: int = 1 << 21, most: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """The key of every place (the DEPTH bytes before it, nearest first, then its own byte), some `step` places at a time; for each key a number under `most`, and the stream of each number."""
    held: list[bytes] = []
    sizes: list[int] = []
    which: list[int] = []

    def close() -> tuple[np.ndarray, np.ndarray, list[int]]:
        flat, n = b"".join(held) + b"\0" * 8, np.array(sizes)
        windows = np.ndarray(len(flat) - 7, dtype="<u8", buffer=flat, strides=(1,))
        key, byte = windows << 8 * (8 - DEPTH), windows >> 8 * DEPTH
        key >>= 8 * (7 - DEPTH)
        byte &= 255
        key |= byte
        ends = np.cumsum(n + DEPTH)
        own = np.concatenate([key[to - size : to] for to, size in zip((ends - DEPTH).tolist(), sizes, strict=True)])
        return own, np.repeat(np.arange(len(n), dtype=np.uint64), n), list(which)

    total = 0
    for i, s in enumerate(streams):
        for lo in range(0, len(s), step):
            own = s[lo : lo + step]
            held += [s[max(0, lo - DEPTH) : lo].rjust(DEPTH, b"\0"), own]
            sizes.append(len(own))
            which.append(i)
            total += len(own)
            if total >= step or len(which) == most:
                yield close()
                held, sizes, which, total = [], [], [], 0
    if which:
        yield close()


def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several sorted arrays, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n[order], first)


def planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then all second bytes, and so on: what compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def dealt(of: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that the hashes of `of` lead to, and the places in `of` that fall to it, in order."""
    part = ((of * _MULT) >> 40) % parts
    order = np.argsort(part.astype(np.int32), kind="stable")
    ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))
    for p in np.unique(part).astype(np.int64).tolist():
        yield p, order[(ends[p - 1] if p else 0) : ends[p]]


def by_group(batches: Iterator[pa.RecordBatch], groups: tuple[str, ...], *columns: str) -> Iterator[tuple[tuple, list[list]]]:
    """Values and columns of each group of a partition sorted by groups."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*groups, *columns)), strict=True):
            if row[: len(groups)] != at and rows:
                yield at, [list(x) for x in zip(*rows, strict=True)]
                rows = []
            at = row[: len(groups)]
            rows.append(row[len(groups) :])
    if rows:
        yield at, [list(x) for x in zip(*rows, strict=True)]


class Level:
    """The nodes of one depth and bit: sorted codes (the context, then the bits so far), counts, and log probabilities."""

    def __init__(self, codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.codes, self.zeros, self.ones = codes, zeros, ones
        self.kt = self.weighted = log_kt(zeros, ones)

    def under(self, below: np.ndarray) -> None:
        """Mix in the sum of the children's log probabilities."""
        self.weighted = np.logaddexp(HALF + self.kt, HALF + below)

    def own(self) -> np.ndarray:
        """The weight of this node's own estimate after training, at a node with children."""
        return np.exp(HALF + self.kt - self.weighted)

    def one(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def levels(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """The eight levels of nodes of one depth over sorted distinct keys (context of that depth, then a byte) with counts."""
    out = []
    for k in range(8):
        code, bit = (keys >> (8 - k)).astype(np.int64), (keys >> (7 - k) & 1).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        out.append(Level(code[first], np.add.reduceat(n * (1 - bit), first), np.add.reduceat(n * bit, first)))
    return out


def parent(codes: np.ndarray, k: int) -> np.ndarray:
    """The codes of the nodes one depth up (the farthest byte of the context goes), with the same k bits."""
    return codes >> (8 + k) << k | codes & ((1 << k) - 1)


def subtrees(keys: np.ndarray, n: np.ndarray) -> list[list[Level]]:
    """Levels of depths TOP to DEPTH over sorted distinct whole keys, weighted from the deepest up."""
    n = n.astype(np.float64)
    tree = {DEPTH: levels(keys, n)}
    for d in range(DEPTH - 1, TOP - 1, -1):
        keys = keys >> 16 << 8 | keys & 255
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) > 0]))
        keys, n = keys[order][first], np.add.reduceat(n[order], first)
        tree[d] = levels(keys, n)
        for k, (up, down) in enumerate(zip(tree[d], tree[d + 1], strict=True)):
            up.under(np.bincount(np.searchsorted(up.codes, parent(down.codes, k)), weights=down.weighted, minlength=len(up.codes)))
    return [tree[d] for d in range(TOP, DEPTH + 1)]


def runs(key: np.ndarray, n: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and counts in runs of about `most` that hold whole contexts of TOP bytes."""
    head = key >> 8 * (DEPTH + 1 - TOP)
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    at = 0
    while at < len(key):
        k = int(np.searchsorted(first, at + most, "right")) - 1
        to = int(first[k]) if first[k] > at else int(first[k + 1]) if k + 1 < len(first) else len(key)
        if at + most >= len(key):
            to = len(key)
        yield key[at:to], n[at:to]
        at = to


class Top:
    """Depths under TOP: for each bit, the codes at the deepest of them with the mixture so far (`sum`) and the weight left for deeper nodes (`rest`)."""

    def __init__(self, code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """code (bit << 32 | node), counts and the children's summed log probability of each node at depth TOP - 1."""
        order = np.argsort(code)
        code, zeros, ones, below = code[order], zeros[order], ones[order], below[order]
        self.codes, self.sum, self.rest = [], [], []
        for k in range(8):
            own = code >> 32 == k
            chain, up = [Level(code[own] & 0xFFFFFFFF, zeros[own], ones[own])], []
            chain[0].under(below[own])
            for _ in range(TOP - 1):
                low = chain[-1]
                codes, place = np.unique(parent(low.codes, k), return_inverse=True)
                add = lambda x, place=place, size=len(codes): np.bincount(place, weights=x, minlength=size)
                chain.append(Level(codes, add(low.zeros), add(low.ones)))
                chain[-1].under(add(low.weighted))
                up.append(place)
            w = chain[-1].own()
            mixed, rest = w * chain[-1].one(), 1 - w
            for node, place in zip(chain[-2::-1], up[::-1], strict=True):
                w = node.own()
                mixed, rest = mixed[place] + rest[place] * w * node.one(), rest[place] * (1 - w)
            self.codes.append(chain[0].codes)
            self.sum.append(mixed)
            self.rest.append(rest)


def top_rows(key: np.ndarray, n: np.ndarray) -> Iterator[list[np.ndarray]]:
    """code, zeros, ones and below of Top from the subtrees of sorted distinct keys."""
    for k, node in enumerate(subtrees(key, n)[0]):
        code, place = np.unique(parent(node.codes, k), return_inverse=True)
        yield [k << 32 | code, *(np.bincount(place, weights=x, minlength=len(code)) for x in (node.zeros, node.ones, node.weighted))]


def log10_of(keys: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of the byte of each sorted distinct key after its context."""
    tree, out = subtrees(keys, n), np.zeros(len(keys))
    for k in range(8):
        place = np.searchsorted(top.codes[k], parent(tree[0][k].codes, k))
        mixed, rest = top.sum[k][place], top.rest[k][place]
        for d, by_bit in enumerate(tree):
            node = by_bit[k]
            if d:
                place = np.searchsorted(tree[d - 1][k].codes, parent(node.codes, k))
                mixed, rest = mixed[place], rest[place]
            w = node.own() if d + 1 < len(tree) else 1.0
            mixed, rest = mixed + rest * w * node.one(), rest * (1 - w)
        code = (keys >> (8 - k)).astype(np.int64)
        p = mixed[np.searchsorted(tree[-1][k].codes, code)]
        out += np.log10(np.where(keys >> (7 - k) & 1 == 1, p, 1 - p))
    return out


#: Kinds of rows: packed keys, packed hashes of words (n: counts, p: chances or counts), and packed documents.
KEYS, WORDS, DOCS = 0, 1, 2
TYPES = {"kind": pa.int32(), "block": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "n": pa.binary(), "p": pa.binary(), "total": pa.int64(), "distinct": pa.int64(), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "body": pa.binary(), "size": pa.int64()}
_NAMES = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.bool_()): "array<boolean>"}
BLOCKS = ["kind", "block", "part", "keys", "n", "doc_id", "held_out", "body", "size"]
DISTINCT = ["kind", "part", "keys", "n", "total", "distinct"]
CHANCES = ["kind", "part", "block", "keys", "p"]
SENT = ["kind", "block", "part", "p", "doc_id", "held_out", "body", "size"]
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def schema(names: list[str]) -> str:
    return ", ".join(f"{c} {_NAMES[TYPES[c]]}" for c in names)


def _batch(names: list[str], **cols) -> pa.RecordBatch:
    size = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[c], TYPES[c]) if c in cols else pa.nulls(size, TYPES[c]) for c in names], names=names)


#: Masks of a number's first 0 to 8 bytes.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every bit depends on all bits (the end of MurmurHash3)."""
    x = (x ^ x >> 33) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> 33) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> 33


def word_hashes(streams: list[bytes], step: int = 1 << 22, longest: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hash of every word, the ends too, and the number of its stream, some `step` bytes at a time. Words of up to `longest` bytes are mixed eight bytes a time, all together; longer ones have their XXH64."""
    held: list[bytes] = []
    which: list[int] = []

    def close() -> tuple[np.ndarray, np.ndarray]:
        flat = b"".join(held)
        ends = np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = ends - starts
        windows = np.ndarray(len(flat) + 1, dtype="<u8", buffer=flat + b"\0" * 8, strides=(1,))
        out = mixed_bits(windows[starts] & FIRST[np.minimum(size, 8)] ^ size.astype(np.uint64) * _MULT)
        for at in range(8, longest, 8):
            more = np.flatnonzero(size > at)
            out[more] = mixed_bits(out[more] ^ windows[starts[more] + at] & FIRST[np.minimum(size[more] - at, 8)])
        for i in np.flatnonzero(size > longest).tolist():
            out[i] = xxh64_intdigest(flat[starts[i] : ends[i]])
        return out, np.array(which)[np.searchsorted(np.cumsum(list(map(len, held))), ends, "right")]

    total = 0
    for i, s in enumerate(streams):
        lo = 0
        while lo < len(s):
            hi = s.find(b" ", lo + step - 1) + 1 or len(s)  # a stream ends with a space
            held.append(s[lo:hi])
            which.append(i)
            total, lo = total + hi - lo, hi
            if total >= step:
                yield close()
                held, which, total = [], [], 0
    if held:
        yield close()


def firsts(x: np.ndarray) -> np.ndarray:
    """Where each distinct number of a sorted array begins."""
    new = np.empty(len(x), dtype=bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def summed(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of entries (a key, then a byte that counts), and the sums of their counts. Sorts them in place."""
    entries.sort()
    key = entries >> 8
    first = firsts(key)
    return key[first], np.add.reduceat(entries & 255, first).astype(np.int64) if len(first) else first


def as_entries(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Keys and counts as entries; a count over 255 takes several."""
    out = key << 8
    out |= np.minimum(n, 255).astype(np.uint64)
    large = np.flatnonzero(n > 255)
    left = n[large] - 255
    times = -(-left // 255)
    more = np.repeat(key[large] << 8 | 255, times)
    more[np.cumsum(times) - 1] -= (255 * times - left).astype(np.uint64)
    return np.concatenate([out, more]) if len(more) else out


def distinct_of(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. Sorts x in place."""
    x.sort()
    return x[firsts(x)]


class Pieces:
    """One array from many pieces, folded together whenever they have doubled; fold takes an array that it may change."""

    def __init__(self, fold: Callable[[np.ndarray], np.ndarray], most: int = 4 << 20):
        self.fold, self.most, self.limit, self.size = fold, most, most, 0
        self.held: list[np.ndarray] = []

    def add(self, x: np.ndarray) -> None:
        self.held.append(self.fold(x))
        self.size += len(self.held[-1])
        if self.size > self.limit:
            self.all()
            self.limit = max(self.most, 2 * self.size)

    def all(self) -> np.ndarray:
        if len(self.held) > 1:
            self.held = [self.fold(np.concatenate(self.held))]
            self.size = len(self.held[0])
        return self.held[0] if self.held else np.zeros(0, dtype=np.uint64)


class Words:
    """Distinct hashes of words and how often they count, from many pieces."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Hashes in any order; counts: whether each one counts."""
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = firsts(hashes)
        self.keys.append(hashes[first])
        self.n.append(np.add.reduceat(counts[order].astype(np.int64), first))
        if len(self.keys) > 16:
            self.keys, self.n = ([x] for x in self.all())

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(self.keys, self.n)


def counted(bodies: list[bytes], held: list[bool], keys: Pieces, words: Words) -> None:
    """Adds the keys and words of texts; those of held texts count for nothing."""
    train = np.array([not x for x in held], dtype=np.uint64)
    streams = [stream(b) for b in bodies]
    for key, slot, which in places(streams, most=len(streams)):
        key <<= 8
        key |= train[which][slot.view(np.int64)]
        keys.add(key)
    for own, which in word_hashes(streams):
        words.add(own, train[which])


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows for documents, and for each block's distinct keys and words by part (n: counts in training texts)."""
    task = TaskContext.get().partitionId()
    seq = size = 0
    fold = lambda x: as_entries(*summed(x))
    keys, words = Pieces(fold), Words()

    def closed() -> Iterator[pa.RecordBatch]:
        for kind, (key, n) in ((KEYS, summed(keys.all())), (WORDS, words.all())):
            rows = [(p, packed(key[at]), planes(n[at].astype(np.uint32))) for p, at in dealt(key, parts)]
            for lo in range(0, len(rows), 1000):
                part, own, n = zip(*rows[lo : lo + 1000], strict=True)
                yield _batch(BLOCKS, kind=[kind] * len(part), block=[task << 24 | seq] * len(part), part=part, keys=own, n=n)

    for piece, texts in sliced(batches, "text"):
        held = piece.column("held_out").to_pylist()
        bodies = [b" ".join(t.lower().split()) for t in texts]
        counted(bodies, held, keys, words)
        joined = b"\n".join(bodies)
        yield _batch(BLOCKS, kind=[DOCS], block=[task << 24 | seq], doc_id=[piece.column("doc_id").to_pylist()], held_out=[held], body=[pa.compress(joined, "zstd", asbytes=True)], size=[len(joined)])
        size += sum(map(len, texts))
        if size > BLOCK:
            yield from closed()
            seq, size, keys, words = seq + 1, 0, Pieces(fold), Words()
    if keys.held:
        yield from closed()


def _merge(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The distinct words of each part, with the sum and number of their counts; its distinct keys, dealt by their nearest bytes (`part` is now that of the nearest bytes)."""
    for (part, kind), (keys, n) in by_group(batches, ("part", "kind"), "keys", "n"):
        key, n = merged([unpacked(x) for x in keys], [from_planes(x, np.uint32).astype(np.int64) for x in n])
        if kind == WORDS:
            yield _batch(DISTINCT, kind=[WORDS], part=[part], keys=[packed(key)], n=[planes(n)], total=[int(n.sum())], distinct=[int((n > 0).sum())])
            continue
        part, own, n = zip(*((p, packed(key[at]), planes(n[at])) for p, at in dealt(key >> 8 * (DEPTH + 1 - TOP), parts)), strict=True)
        yield _batch(DISTINCT, kind=[KEYS] * len(part), part=part, keys=own, n=n)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, (keys, n) in by_group(batches, ("part",), "keys", "n"):
        yield from runs(*merged([unpacked(x) for x in keys], [from_planes(x, np.int64) for x in n]))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chances (or counts) of each block's keys, in their order; of a part and kind, rows with chances come first (their block is null)."""
    at, table = None, None
    for batch in batches:
        for part, kind, block, keys, p in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "block", "keys", "p")), strict=True):
            if (part, kind) != at:
                at, table, held, of = (part, kind), None, [], np.float32 if kind == KEYS else np.int64
            if block is None:
                held.append((unpacked(keys), from_planes(p, of)))
                continue
            if table is None:
                own, chance = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(own)
                table, held = (own[order], chance[order]), []
            yield _batch(SENT, kind=[kind], block=[block], part=[part], p=[planes(table[1][np.searchsorted(table[0], unpacked(keys))])])


def _score(batches: Iterator[pa.RecordBatch], parts: int, n_train: int, n_kinds: int) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of each block; what its chances belong to is worked out anew from the documents, in the same order."""
    for _, (kinds, part, p, ids, held, bodies, sizes) in by_group(batches, ("block",), "kind", "part", "p", "doc_id", "held_out", "body", "size"):
        own = [i for i, kind in enumerate(kinds) if kind == DOCS]
        texts = {i: pa.decompress(bodies[i], sizes[i], "zstd", asbytes=True).split(b"\n") for i in own}
        keys, words = Pieces(distinct_of), Pieces(distinct_of)
        for i in own:
            streams = [stream(b) for b in texts[i]]
            for key, _, _ in places(streams, most=len(streams)):
                keys.add(key)
            for word, _ in word_hashes(streams):
                words.add(word)
        tables = []
        for kind, numbers, of in ((KEYS, keys, np.float32), (WORDS, words, np.int64)):
            told = {part[i]: p[i] for i, k in enumerate(kinds) if k == kind}
            key = numbers.all()
            value = np.empty(len(key), dtype=of)
            for q, at in dealt(key, parts):
                value[at] = from_planes(told[q], of)
            tables.append((key, value))
        (key, chance), (word, count) = tables
        chance, base_of = chance.astype(np.float64), np.log10((count + 1) / (n_train + n_kinds + 1))
        for i in own:
            score, base, tokens, known = (np.zeros(len(texts[i])) for _ in range(4))
            streams = [stream(b) for b in texts[i]]
            for both, slot, which in places(streams):
                both <<= 8
                both |= slot
                both.sort()
                at = both >> 8
                first = firsts(at)
                each = np.repeat(chance[np.searchsorted(key, at[first])], np.diff(first, append=len(at)))
                np.add.at(score, which, np.bincount((both & 255).view(np.int64), weights=each, minlength=len(which)))
            for own_words, which in word_hashes(streams):
                order = np.argsort(own_words)
                at, which = own_words[order], which[order]
                first = firsts(at)
                place = np.repeat(np.searchsorted(word, at[first]), np.diff(first, append=len(at)))
                for sums, weights in ((base, base_of[place]), (tokens, None), (known, count[place] > 0)):
                    sums += np.bincount(which, weights=weights, minlength=len(sums))
            bits = -score / math.log10(2) / np.array([len(s) for s in streams])
            cols = [pa.array(ids[i], pa.int64()), pa.array(held[i], pa.bool_()), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array([n_train] * len(base), pa.int64()), pa.array(base), pa.array(score), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ")])


def scored(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score (log10 probability of the text under the tree) and bits_per_byte."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (id_remainder(F.col("doc_id"), folds) == held).alias("held_out"))
    parts = max(partitions(spark), (own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // PART)
    # parts and blocks are numbers, which tasks take in turn
    together = lambda df, *by: df.repartitionById(parts, F.expr(f"CAST(({by[0]} >> 24) + ({by[0]} & 16777215) AS int)")).sortWithinPartitions(*by)
    rows = materialize(map_arrow(own, lambda batches: _blocks(batches, parts), schema(BLOCKS)), "blocks")
    keys = rows.where(F.col("kind") != DOCS)
    distinct = materialize(map_arrow(together(keys.select("part", "kind", "keys", "n"), "part", "kind"), lambda batches: _merge(batches, parts), schema(DISTINCT)), "distinct")
    total = distinct.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    n_train, n_kinds = total["n"] or 0, total["v"] or 0

    tree = together(distinct.where(F.col("kind") == KEYS).select("part", "keys", "n"), "part")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _trees(batches):
            for cols in top_rows(key, n):
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["code", "zeros", "ones", "below"])

    weighed = map_arrow(tree, weigh, "code long, zeros double, ones double, below double").groupBy("code").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    top = spark.sparkContext.broadcast(Top(*(weighed.column(c).to_numpy() for c in ("code", "zeros", "ones", "below"))))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _trees(batches):
            p = log10_of(key, n, top.value).astype(np.float32)
            part, own, chance = zip(*((i, packed(key[at]), planes(p[at])) for i, at in dealt(key, parts)), strict=True)
            yield _batch(CHANCES, kind=[KEYS] * len(part), part=part, keys=own, p=chance)

    known = distinct.where(F.col("kind") == WORDS).select("kind", "part", F.lit(None).cast("long").alias("block"), "keys", F.col("n").alias("p"))
    asked = keys.select("kind", "part", "block", "keys", F.lit(None).cast("binary").alias("p"))
    told = map_arrow(together(map_arrow(tree, predict, schema(CHANCES)).union(known).union(asked), "part", "kind", "block"), _told, schema(SENT))
    texts = rows.where(F.col("kind") == DOCS).select("kind", "block", "part", F.col("n").alias("p"), "doc_id", "held_out", "body", "size")
    out = materialize(map_arrow(together(told.union(texts), "block"), lambda batches: _score(batches, parts, n_train, n_kinds), SCORED), "scores")
    release(rows, distinct)
    top.destroy()
    return out
