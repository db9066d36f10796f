"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: it hashes the words at its ones and ignores those at its zeros. Every window of a
benchmark item and of a document is hashed under every mask; equal hashes put a place in the document next to a place in the
item. Around such a hit the two texts are compared word by word along the diagonal, where substituted words count as differences.
A document is contaminated by an item if some `window` words in a row (the whole item if it is shorter) differ in at most
`tolerance` of them.

The masks follow from window and tolerance: a window of n words that may differ in e is dealt in turn to e + 2 groups, and each mask
ignores e of the groups. Wherever the differences stand, one mask ignores them all, so no overlap is missed. Items shorter than the
window have masks of their own length.

Distribution: documents never move. The benchmark is dealt to blocks of about `block_words` words; the seed index of one block, of
that size at most, goes to every task, and documents are read once for each block (once for benchmarks up to 400,000 words). A
hash that many documents share is therefore no hot key.

Words are lower-cased, and characters that are no letters or digits are left out; a word with none disappears. Defined results: null
and empty texts and items have no hits; repeated documents each have their rows,
repeated items too; a null doc_id or item_id is carried as it is. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewheel.llm.common import map_arrow, ranges, sliced
from tidewheel.plans.scratch import materialize

WINDOW, TOLERANCE, BLOCK_WORDS = 13, 0.2, 400_000
HITS = "item_id long, doc_start int, item_start int, n_words int, n_equal int, overlap double"


class Words(dict):
    """Hash of each word by its bytes, 0 for a word without letters or digits. Bounded: forgets all beyond `most` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        plain = "".join(filter(str.isalnum, word.decode("utf-8", "replace")))
        self[word] = out = xxh64_intdigest(plain) | 1 if plain else 0
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the texts' words, one text after another, and how many each has."""
        each = [[h for w in t.decode("utf-8", "replace").lower().encode().split() if (h := self[w])] for t in texts]
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return np.fromiter(chain.from_iterable(each), dtype=np.uint64, count=int(sizes.sum())), sizes


def allowed(n: int, tolerance: float) -> int:
    """How many of n words may differ."""
    return int(tolerance * n + 1e-9)


def masks(n: int, e: int) -> list[str]:
    """Masks over n words, ones compared and zeros ignored, one of which ignores any e of the words."""
    groups = min(n, e + 2)
    return ["".join("0" if k % groups in left else "1" for k in range(n)) for left in combinations(range(groups), e)]


def factors(n: int) -> np.ndarray:
    """An odd multiplier for each place of a mask."""
    k = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (k ^ (k >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)


def seeds(words: np.ndarray, masks: list[str]) -> Iterator[np.ndarray]:
    """For each mask the hash of every window of `words` under it."""
    longest = max(map(len, masks), default=0)
    scaled = [words * f for f in factors(longest)]
    for mask in masks:
        n = max(len(words) - len(mask) + 1, 0)
        out = np.zeros(n, dtype=np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                out += scaled[k][k : k + n]
        yield out ^ (out >> np.uint64(32))


class Index:
    """Seeds of one block of items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW, tolerance: float = TOLERANCE):
        self.ids, self.window, self.tolerance = [i for i, _ in items], window, tolerance
        flat, sizes = Words().of([t for _, t in items])
        self.starts, self.sizes, self.words = np.cumsum(sizes) - sizes, sizes, flat
        self.masks, self.tables = [], []
        item = np.repeat(np.arange(len(sizes)), sizes)
        for n in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            own = masks(n, allowed(n, tolerance))
            self.masks += own
            for mask, h in zip(own, seeds(flat, own), strict=True):
                at = np.arange(len(h))
                of = sizes[item[at]]
                at = at[(at + n <= self.starts[item[at]] + of) & (np.minimum(of, window) == n)]
                order = at[np.argsort(h[at], kind="stable")]
                bits = np.zeros(1 << 22, dtype=bool)
                bits[(h[at] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
                self.tables.append((h[order], item[order], order - self.starts[item[order]], bits))

    def hits(self, words: np.ndarray, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) with a seed in common. words: of all texts; text: which text each stands in; the diagonal is the place in the text less that in the item."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for mask, own, (h, item, at, bits) in zip(self.masks, seeds(words, self.masks), self.tables, strict=True):
            place = np.flatnonzero(bits[(own & np.uint64(len(bits) - 1)).astype(np.int64)])
            place = place[text[place] == text[place + len(mask) - 1]]  # windows inside one text
            lo, hi = np.searchsorted(h, own[place], "left"), np.searchsorted(h, own[place], "right")
            n = hi - lo
            row, place = np.repeat(lo, n) + ranges(n), np.repeat(place, n)
            found.append(np.stack([text[place], item[row], place - starts[text[place]] - at[row]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, words: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        """For each text and item the best overlap that passes: text, item, text start, item start, words, equal words, share of the item. Every `window` words in a row of an overlap pass; the one with the most equal words is the best, the first of several."""
        best: dict[tuple[int, int], tuple] = {}
        starts = np.cumsum(sizes) - sizes
        for t, i, d in self.hits(words, np.repeat(np.arange(len(sizes)), sizes), starts).tolist():
            size, of_text, of_item = int(self.sizes[i]), int(starts[t]), int(self.starts[i])
            lo, hi = max(0, -d), min(size, int(sizes[t]) - d)
            need = min(self.window, size)
            if hi - lo < need:
                continue
            equal = np.concatenate([[0], np.cumsum(self.words[of_item + lo : of_item + hi] == words[of_text + d + lo : of_text + d + hi])])
            good = np.flatnonzero(equal[need:] - equal[:-need] >= need - allowed(need, self.tolerance))
            if not len(good):
                continue
            cut = np.flatnonzero(np.diff(good) > 1)
            first, last = good[np.append(0, cut + 1)], good[np.append(cut, len(good) - 1)] + need
            n = equal[last] - equal[first]
            k = int(n.argmax())
            if (t, i) not in best or n[k] > best[t, i][3]:
                best[t, i] = (lo + int(first[k]) + d, lo + int(first[k]), int(last[k] - first[k]), int(n[k]), int(n[k]) / size)
        return [(t, self.ids[i], *v) for (t, i), v in sorted(best.items())]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items (item_id, text) in blocks of about `block_words` words; one block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-total // block_words)
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], r["text"].encode()) for r in own.collect()]


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, tolerance: float = TOLERANCE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for every document and item that overlap: doc_id, item_id, doc_start and item_start (words), n_words, n_equal, overlap (equal words as a share of the item)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], f"doc_id long, {HITS}")
    schema, names = out.schema, out.columns
    for k, items in enumerate(blocks(benchmark, block_words)):
        sent = spark.sparkContext.broadcast(Index(items, window, tolerance))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, own = sent.value, Words()
            for part, texts in sliced(batches, "text"):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[t], *m) for t, *m in index.matches(*own.of(texts))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        found = map_arrow(docs, run, schema)
        if k:  # one index at a time: what the block before found is written, and its index is dropped
            out = materialize(out, "overlaps")
            before.destroy()
        out, before = found if not k else out.union(found), sent
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, tolerance: float = TOLERANCE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all columns, that no item contaminates. Every row is judged by its own text, whatever its id."""
    spark = docs.sparkSession
    before, cast = None, docs.schema["text"].dataType.typeName() != "string"
    for items in blocks(benchmark, block_words):
        if before is not None:
            docs = materialize(docs, "clean")
            before.destroy()
        before = sent = spark.sparkContext.broadcast(Index(items, window, tolerance))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, own = sent.value, Words()
            for part, texts in sliced(batches, "_text" if cast else "text"):
                bad = {t for t, *_ in index.matches(*own.of(texts))}
                part = part.drop_columns(["_text"]) if cast else part
                yield part.filter(pa.array([t not in bad for t in range(len(texts))]))

        docs = map_arrow(docs.withColumn("_text", F.col("text").cast("string")) if cast else docs, run, docs.schema)
    return docs
