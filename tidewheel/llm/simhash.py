"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64 bits of 3-word shingles, XXH64 seed 42. Two fingerprints link if they differ in at most 3 bits.

Distribution: two such fingerprints agree on one of four 16-bit blocks. Each distinct fingerprint goes to four buckets, one for
each masked pattern (block, value); a bucket with over `max_bucket` fingerprints is dealt anew by four 12-bit blocks of its other
48 bits, one of which agrees as well, so that no link is lost and no bucket outgrows a task. In a bucket the fingerprints are
sorted by Gray rank; the tree above them has as nodes the masked bit patterns that runs of them share, a byte a level. The
search descends on pairs of nodes, adds up the bits in which their patterns differ and drops a pair (and all below it) beyond 3.
A bucket returns not its links but a star for each of its connected components, so a group of n copies costs n rows.

Components: alternating large-star and small-star rounds over the star edges, written to the shared folder each round.

Defined results: a text without words (null too) has fingerprint zero and links like any other; fewer than three words make one
shingle. A null doc_id is kept and never becomes the component's id unless all of its members are null. Repeated rows are rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tidewheel.llm.common import counted_side, map_arrow, partitions, ranges, sliced
from tidewheel.plans.scratch import materialize

SHINGLE, SEED, BITS = 3, 42, 3


def digests(text: bytes, k: int = SHINGLE) -> list[bytes]:
    """The 8-byte hashes of every k-word shingle, repeats included."""
    words = text.lower().split()
    if len(words) <= k:
        return [xxh64_digest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    last = k - 1
    return [xxh64_digest(joined[e - len(w) + i : f + i + last], SEED) for i, (w, e, f) in enumerate(zip(words, ends, ends[last:], strict=False))]


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    own = digests(text, k)
    if not own:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join(own), dtype=np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, "text", 1 << 20):
            fps = np.array([fingerprint(t, k) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(docs, run, docs.schema["doc_id"].dataType.simpleString().join(["doc_id ", ", fp long"]))


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint (uint64) in the Gray order: the number whose Gray code it is."""
    out = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _tree(bucket: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of the index over rows sorted by (bucket, Gray rank): for each level the first row of every node, and the byte its pattern adds. Level 0 has a node for each bucket; a prefix of the Gray rank is a prefix of the fingerprint."""
    edge = np.empty(len(fps), dtype=bool)
    edge[:1] = True
    edge[1:] = bucket[1:] != bucket[:-1]
    levels = [(np.flatnonzero(edge), None)]
    for shift in range(56, -8, -8):
        top = fps >> np.uint64(shift)
        edge = edge.copy()
        edge[1:] |= top[1:] != top[:-1]
        first = np.flatnonzero(edge)
        levels.append((first, (top[first] & np.uint64(255)).astype(np.uint8)))
    return levels


def near_pairs(bucket: np.ndarray, fps: np.ndarray, bits: int = BITS, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i < j) of one bucket that differ in at most `bits` bits, in pieces; rows are distinct and sorted by (bucket, Gray rank). At most about `most` node pairs of a level are open at a time."""
    levels = _tree(bucket, fps)
    n = len(levels) - 1
    below = []  # children of node i of level k: below[k][i] .. below[k][i + 1]
    for k in range(n):
        below.append(np.append(np.searchsorted(levels[k + 1][0], levels[k][0]), len(levels[k + 1][0])))
    roots = np.arange(len(levels[0][0]))
    stack = [(0, roots, roots, np.zeros(len(roots), dtype=np.uint8))]
    while stack:
        k, a, b, far = stack.pop()
        if k == n:
            if (own := a < b).any():
                yield a[own], b[own]
            continue
        na, nb = below[k][a + 1] - below[k][a], below[k][b + 1] - below[k][b]
        size = na * nb
        if len(a) > 1 and size.sum() > most:
            half = len(a) // 2
            stack += [(k, a[:half], b[:half], far[:half]), (k, a[half:], b[half:], far[half:])]
            continue
        which = np.repeat(np.arange(len(a)), size)
        nth = ranges(size)
        x, y = below[k][a[which]] + nth // nb[which], below[k][b[which]] + nth % nb[which]
        pattern = levels[k + 1][1]
        far = far[which] + np.bitwise_count(pattern[x] ^ pattern[y])
        keep = (far <= bits) & (x <= y)
        if k == n - 1:
            keep &= x < y
        stack.append((k + 1, x[keep], y[keep], far[keep]))


def _stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The first row of each row's component."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if not (open_ := a != b).any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def whole_buckets(batches: Iterator[pa.RecordBatch], *columns: str, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """The column `bucket` and others of whole buckets of a partition sorted by bucket, several small ones at a time."""
    names = ("bucket", *columns)
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in names))
        if sum(len(x[0]) for x in held) < most:
            continue
        own = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        at = int(np.searchsorted(own[0], own[0][-1]))  # the last bucket may go on
        if at:
            yield tuple(x[:at] for x in own)
        held = [tuple(x[at:] for x in own)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def dealt(rows: DataFrame, max_bucket: int = 1 << 20) -> DataFrame:
    """rows (t, fp distinct within t, and others) in the buckets of their table t: four times, by the masked patterns (block, value) of their fingerprint. A bucket with over `max_bucket` rows is dealt anew by four 12-bit blocks of the other 48 bits."""
    block = lambda at: F.expr(f"shiftrightunsigned(fp, {at}) & 65535")
    four = rows.select("*", F.posexplode(F.array(*(block(s) for s in (0, 16, 32, 48)))).alias("_m", "_v"))
    four = four.withColumn("bucket", F.col("t") * F.lit(262_144).cast("long") + F.col("_m") * 65536 + F.col("_v"))
    # 262,144 patterns a table at most
    large = four.groupBy("bucket").count().where(F.col("count") > max_bucket).select("bucket", F.lit(True).alias("_large"))
    both = four.join(F.broadcast(large), "bucket", "left")
    rest = F.expr("CASE _m WHEN 0 THEN shiftrightunsigned(fp, 16) WHEN 1 THEN (shiftrightunsigned(fp, 32) << 16) | (fp & 65535) WHEN 2 THEN (shiftrightunsigned(fp, 48) << 32) | (fp & 4294967295) ELSE fp & 281474976710655 END")
    deeper = F.transform(F.array(*map(F.lit, range(4))), lambda s: F.lit(1 << 40) + F.col("bucket") * 16384 + s * 4096 + F.call_function("shiftright", rest, s * 12).bitwiseAND(F.lit(4095)))
    return both.withColumn("bucket", F.explode(F.when(F.col("_large"), deeper).otherwise(F.array(F.col("bucket"))))).drop("_m", "_v", "_large")


def links(fps: DataFrame, bits: int = BITS, max_bucket: int = 1 << 20) -> DataFrame:
    """Star edges (a, b), a < b as signed longs, of the components within each bucket; fps: distinct fp. Together they connect just what the links connect (bits: at most 3)."""
    if bits > 3:
        raise ValueError("four blocks find differences of at most 3 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, fp in whole_buckets(batches, "fp"):
            own = fp.view(np.uint64)
            order = np.lexsort((gray_rank(own), bucket))
            bucket, own, fp = bucket[order], own[order], fp[order]
            root = _stars(len(own), near_pairs(bucket, own, bits))
            at = np.flatnonzero(root != np.arange(len(root)))
            a, b = fp[at], fp[root[at]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    spread = dealt(fps.select(F.lit(0).alias("t"), "fp"), max_bucket).select("bucket", "fp").repartition(partitions(fps.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_arrow(spread, run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges (a, b)."""
    edges = materialize(edges.where("a <> b").select("a", "b"), "edges")
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: edges now lead from the larger to the smaller node
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.m").alias("a"), F.col("x.b").alias("b")).where("a <> b").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
    own = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return own.union(edges.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, k: int = SHINGLE, bits: int = BITS, max_bucket: int = 1 << 20) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id that links reach) of every row."""
    own = materialize(fingerprints(docs, k), "fingerprints")
    # copies meet here, before anything is dealt to buckets
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    root = materialize(components(links(distinct.select("fp"), bits, max_bucket)), "roots")
    member = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = member.join(least, "root").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs (with all their columns) that stay when one document of each group does: the smallest doc_id. Rows that repeat a doc_id are one document and stay if it does; rows without a doc_id always stay."""
    return without(docs, near_duplicates(docs, **how).where("doc_id > component_id").select("doc_id"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids."""
    return docs.join(counted_side(ids.distinct()), "doc_id", "left_anti").select(*docs.columns)
