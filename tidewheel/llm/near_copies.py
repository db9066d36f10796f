"""Near copies by similarity, from a search that is complete: a prefix-filtered join on 5-word shingles.

Texts are near copies if their sets of 5-word shingles have a similarity (shared by all) of 0.8 or more. Groups are the connected
components of near copies.

Equal sets are one from the start. For the others shingles have an order, those that are common in a sample of texts last; which
sample is drawn alters the work, never the result. Two sets of n shingles or less that are near share one of the first
n - ceil(0.8 n) + 1 of each, so all near copies meet at a shingle of both their prefixes. The texts at a shingle are a list, cut
where sizes are too far apart and where parity bitmaps of the sets (twice as many bits as shingles, `WORDS` longs at least) differ in
more bits than near sets differ in shingles; equal lists are one, and so are all lists that members in common lead to, up to `WHOLE`
members and `WHOLE_SHINGLES` shingles. All pairs of a list are compared exactly in its task, but for those that earlier pairs of it
have linked; a list returns stars and not pairs, so a group of n copies costs n rows a list.

A list is read by one task; its pairs that are not near take time with the square of the list's length.

Defined results: texts of fewer than five words have one shingle; texts without words are alike; rows without an id take no part;
rows that repeat an id are one document, near a copy if any of its texts is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_64_intdigest

from tidewheel.llm.common import counted_side, map_arrow, partitions, ranges, sliced
from tidewheel.llm.simhash import components, digests, near_duplicates, whole_buckets, without
from tidewheel.plans.scratch import materialize, release

WIDE, SIMILARITY = 5, 0.8
WORDS = 32  # of a bitmap, at least
WHOLE, WHOLE_SHINGLES = 8192, 8_000_000
SAMPLE, COMMON = 20_000, 500_000  # texts that tell which shingles are common, and how many of those are sent to the executors


def shingles(text: bytes, k: int = WIDE) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles, sorted."""
    return np.unique(np.frombuffer(b"".join(digests(text, k)), dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared by all of two sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def common(docs: DataFrame, texts: int = SAMPLE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about `texts` texts have, sorted, and the place of each by how many have it (from 1, the commonest last)."""
    rate = min(1.0, texts / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in sliced(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in texts]).view(np.int64))], names=["h"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    found = map_arrow(drawn.select("text"), run, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(most).toArrow()
    keys = found.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def prefix(own: np.ndarray, order: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a sorted set: any other set that is near shares one of its own first ones with them."""
    keys, place = order
    rank = np.zeros(len(own), dtype=np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        rank = np.where(keys[at] == own, place[at], 0)
    return own[np.argsort(rank, kind="stable")[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1]]


def mixed(own: np.ndarray) -> np.ndarray:
    """Hashes of longs, to be added up over a list."""
    h = own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def bitmap(own: np.ndarray, words: int = WORDS) -> np.ndarray:
    """For each bit whether an odd number of the set's shingles fall on it: two bits a shingle or more, a power of two of `words` or more. Bitmaps of two sets differ in no more bits than the sets in shingles."""
    while 32 * words < len(own):
        words *= 2
    return np.packbits(np.bincount((own >> np.uint64(7)).astype(np.int64) % (64 * words), minlength=64 * words) & 1).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of fewer words that a longer one's set has."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def lists(bucket: np.ndarray, n: np.ndarray, own: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Rows in lists of two or more, and each one's list by a hash of its members: rows of one bucket whose sizes n lead from one to the next within `least`. own: the set's number. Of equal lists the first is returned."""
    order = np.lexsort((own, n, bucket))
    bucket, n, own = bucket[order], n[order], own[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (n[:-1] < least * n[1:] - 1e-9)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    h = mixed(own)
    key = np.add.reduceat(h, first) if len(first) else h
    some = np.flatnonzero(size > 1)
    some = some[np.unique(key[some], return_index=True)[1]]
    rows = np.repeat(first[some], size[some]) + ranges(size[some])
    return order[rows], np.repeat(key[some], size[some]).view(np.int64)


def grouped(m: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first of each one's component; near(i, later): which of `later` are near i. All pairs that are not yet in one component are compared."""
    root = np.arange(m)
    for i in range(m - 1):
        later = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if len(later) and len(found := later[near(i, later)]):
            joined = np.append(root[found], root[i])
            root[np.isin(root, joined)] = joined.min()
    return root


def possible(n: np.ndarray, bits: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Components of the sets of n shingles that sizes and bitmaps do not show to be too far apart. Of two bitmaps the longer one is folded."""
    order = np.argsort(n, kind="stable")
    n, words = n[order], np.array([len(bits[i]) for i in order])
    levels = {}
    for w in np.unique(words):
        # what the sets with bitmaps of w words can be near to, of those after them
        first, end = np.searchsorted(words, w), np.searchsorted(n, n[np.searchsorted(words, w, "right") - 1] / least + 1e-5, "right")
        levels[w] = first, np.stack([folded(bits[i], w) for i in order[first:end]])

    def near(i: int, j: np.ndarray) -> np.ndarray:
        first, own = levels[words[i]]
        out = n[j] * least <= n[i] + 1e-6
        j = j[out]
        out[out] = np.bitwise_count(own[j - first] ^ own[i - first]).sum(axis=1, dtype=np.int64) <= (n[j] + n[i]) * (1 - least) / (1 + least) + 1e-6
        return out

    root = np.empty_like(order)
    root[order] = grouped(len(n), near)
    least_row = np.full(len(n), len(n))
    np.minimum.at(least_row, root, np.arange(len(n)))
    return least_row[root]


def stars(sets: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Components of near sets."""
    m = len(sets)
    if m == 2:
        return np.array([0, int(similarity(*sets) < least)])
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    number = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]]), dtype=np.int32)
    del flat
    local = np.empty(len(order), dtype=np.int32)
    local[order] = number
    count = np.bincount(number)
    rows, ends = np.repeat(np.arange(m, dtype=np.int32), n)[order], np.cumsum(count)
    del order, number
    at = np.cumsum(n) - n

    def near(i: int, later: np.ndarray) -> np.ndarray:
        if len(later) <= 4:
            return np.array([similarity(sets[i], sets[j]) >= least for j in later])
        own = local[at[i] : at[i] + n[i]]
        both = np.bincount(rows[np.repeat(ends[own] - count[own], count[own]) + ranges(count[own])], minlength=m)[later]
        return both / (n[i] + n[later] - both) >= least

    return grouped(m, near)


def whole_lists(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """The rows of each list, of a partition sorted by list."""
    at, rows = None, []
    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("list", *columns)), strict=True):
            if key != at and rows:
                yield rows
                rows = []
            at = key
            rows.append(row)
    if rows:
        yield rows


def near_edges(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) of ids that connect just what near copies connect; docs: doc_id (not null) and text."""
    sent = docs.sparkSession.sparkContext.broadcast(common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, "text", 1 << 20):
            sets = [shingles(t) for t in texts]
            own = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            first = [prefix(s, sent.value, least).view(np.int64) if len(s) else s.view(np.int64) for s in sets]
            ends = np.append(0, np.cumsum([len(x) for x in first])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(ends, np.concatenate(first)), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "own", "n", "first", "bits"])

    own = materialize(map_arrow(docs.select("doc_id", "text"), run, "doc_id long, own long, n int, first array<long>, bits binary"), "prefixes")
    # equal sets meet here: each names the smallest id that has it
    least_id = materialize(own.groupBy("own").agg(F.min("doc_id").alias("id")), "sets")
    named = own.select("doc_id", "own").join(least_id, "own")
    equal = materialize(named.where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")), "equal")
    each = own.join(least_id.select("own", F.col("id").alias("doc_id")), ["own", "doc_id"]).dropDuplicates(["own"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own, doc, n in whole_buckets(batches, "own", "id", "n"):
            row, key = lists(bucket, n, own, least)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row]), pa.array(doc[row])], names=["list", "own", "id"])

    spread = each.select(F.explode("first").alias("bucket"), "own", F.col("doc_id").alias("id"), "n").repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    met = map_arrow(spread, meet, "list long, own long, id long").distinct()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_lists(batches, "own", "id", "n", "bits"):
            own, doc, n = (np.array(x, dtype=np.int64) for x in list(zip(*rows, strict=True))[:3])
            root = possible(n, [np.frombuffer(r[3], dtype=np.uint64) for r in rows], least)
            size = np.bincount(root, minlength=len(root))
            key = np.zeros(len(root), dtype=np.uint64)
            np.add.at(key, root, mixed(own))
            at = np.flatnonzero(size[root] > 1)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(key[root[at]].view(np.int64)), pa.array(own[at]), pa.array(doc[at])], names=["list", "own", "id"])

    drawn = met.join(each.select("own", "n", "bits"), "own").repartition(partitions(docs.sparkSession), "list").sortWithinPartitions("list")
    parts = materialize(map_arrow(drawn.select("list", "own", "id", "n", "bits"), part, "list long, own long, id long").distinct(), "lists")
    # a set in many lists would be sent to each
    root = materialize(components(parts.join(parts.groupBy("list").agg(F.min("own").alias("a")), "list").select("a", F.col("own").alias("b"))), "whole")
    sized = root.join(each.select("own", "n"), root["node"] == each["own"]).groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    whole = root.join(sized.where((F.col("m") <= WHOLE) & (F.col("n") <= WHOLE_SHINGLES)), "root").select(F.col("node").alias("own"), "root")
    members = materialize(parts.join(whole, "own", "left").select(F.coalesce("root", "list").alias("list"), "own", "id").distinct(), "members")
    release(own, least_id, parts, root)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in sliced(batches, "text", 1 << 20):
            own = [shingles(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([xxh3_64_intdigest(s) for s in own], dtype=np.uint64).view(np.int64)), pa.array(own, pa.binary())], names=["own", "s"])

    wanted = counted_side(members.select(F.col("id").alias("doc_id")).distinct())
    of = map_arrow(docs.join(wanted, "doc_id", "left_semi").select("text"), sets, "own long, s binary").groupBy("own").agg(F.first("s").alias("s"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_lists(batches, "id", "s"):
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            root = stars([np.frombuffer(r[1], dtype=np.uint64) for r in rows], least)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[root[at]]), pa.array(ids[at])], names=["a", "b"])

    dealt = members.join(of, "own").select("list", "id", "s").repartition(partitions(docs.sparkSession), "list").sortWithinPartitions("list")
    return map_arrow(dealt, compare, "a long, b long").union(equal).where("a <> b").distinct()


def near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and root (the smallest id of its group) of every document that has a near copy."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return components(near_edges(docs, least)).select(F.col("node").alias("doc_id"), "root")


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay when one document of each group does, the one with the smallest id. Groups are the components of both relations together, so that a document links others even if it goes: fingerprints of op10's contract (equal texts among them), and near copies."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    linked = near_duplicates(own).where("doc_id > component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    return without(docs, components(linked.union(near_edges(own, least))).where("node > root").select(F.col("node").alias("doc_id")))
