"""Best-fit packing of token sequences.

Documents become runs of token ids with a closing id 0. Runs longer than a sequence are cut; every other run stays whole.

Bulk-synchronous best-fit: documents and the gaps of open sequences are tables of rows. Lengths are taken in bands, each half as long
as the one before. In a superstep the band's documents and the gaps over its lower end are range-sorted together, by falling value,
to tasks of about `TASK_ROWS` rows. Each task gives its documents, the longest first, the smallest of its gaps that holds them
(best fit); what it has left, gaps of its range and documents, is summed up in one row. A scan of these rows finds for the
documents that are left the successor ranges whose gaps are left; conflicts are resolved by rank: the i-th such document meets the
i-th gap (or the gap that i falls to, if the gaps hold several), by a join on that number. Gaps are updated, and documents that no
gap could take are range-sorted once more and open sequences, best-fit within their task. Then the next band follows.
The last band takes all that is shorter than 1 / `FLOOR` of a sequence. Only counts by length, a row for each task and the scan's
intervals come to the driver.

Defined results: null text is empty text, one piece of one token. Ties and repeated rows are packed as documents of their own; ranges split them by row number. A very long
text is cut into pieces of its own.
An empty table gives no rows. Columns other than the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import map_arrow, sliced
from tidewheel.plans.scratch import materialize

CAPACITY, TASK_ROWS, FLOOR = 2048, 200_000, 32
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """byte_bpe_50k of `tokenizers`, read from the same vocabulary's rank file: the same ids four times as fast. As in that tokenizer's default, the special string in a text is its id."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """The ids of one document, id 0 last, as little-endian unsigned 32-bit numbers."""
    ids = encoder(vocabulary).encode(text, allowed_special="all") if text else []
    return np.array([*ids, 0], dtype="<u4")


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of n tokens; the first takes what is over."""
    at = 0
    while at < n:
        size = (n - at) % capacity or capacity
        yield at, size
        at += size


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and with_ids: ids) of every piece of every document (doc_id, text)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                ids = token_ids(text.decode("utf-8", "replace"), path)
                for k, (at, size) in enumerate(cut(len(ids), capacity)):
                    own = ids[at : at + size]
                    rows.append((doc, k, at, size, zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if with_ids else ()))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names[: len(cols)])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(gaps: dict[int, list[int]], docs: Iterator[tuple[int, int]], capacity: int, fresh: Iterator[int] | None = None) -> Iterator[tuple[int, int | None, int]]:
    """For each (row, length) of docs: the row, the sequence that takes it and its offset there, or None and the length. gaps: sequences by gap, brought up to date; fresh: numbers of new sequences, which open when no gap holds a document."""
    open_gaps = sum(1 << g for g, own in gaps.items() if own)  # a bit for each gap that some sequence has
    for row, length in docs:
        if above := open_gaps >> length:
            gap = length + (above & -above).bit_length() - 1
            seq = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
        elif fresh is not None:
            gap, seq = capacity, next(fresh)
        else:
            yield row, None, length
            continue
        if left := gap - length:
            gaps.setdefault(left, []).append(seq)
            open_gaps |= 1 << left
        yield row, seq, capacity - gap


PLACED, GAP, DOC = 0, 1, 2
SWEPT = "part int, what int, row long, seq long, value int, nth long"
_SWEPT = [x.split()[0] for x in SWEPT.split(", ")]


def sweep(batches: Iterator[pa.RecordBatch], capacity: int, step: int | None = None) -> Iterator[pa.RecordBatch]:
    """One task's share of a superstep over its range of gaps and documents (kind, id, value; the largest first): placements, gaps that are left and documents that found none. nth numbers the documents, and from the smallest the gaps that every lower range may use. With a step (its number), documents that find none open sequences."""
    part = TaskContext.get().partitionId()
    kind, own, value = [], [], []
    for b in batches:
        kind.append(b.column("kind").to_numpy())
        own.append(b.column("id").to_numpy())
        value.append(b.column("value").to_numpy())
    if not sum(map(len, kind)):
        return
    kind, own, value = np.concatenate(kind), np.concatenate(own), np.concatenate(value)
    gaps: dict[int, list[int]] = {}
    for g, seq in zip(value[kind == GAP].tolist(), own[kind == GAP].tolist(), strict=True):
        gaps.setdefault(g, []).append(seq)
    fresh = None if step is None else count((step << 56) | (part << 32))
    docs = zip(own[kind == DOC].tolist(), value[kind == DOC].tolist(), strict=True)
    rows, left, lowest, nth = [], 0, int(value[-1]), 0
    for row, seq, at in best_fit(gaps, docs, capacity, fresh):
        if seq is None:
            rows.append((part, DOC, row, None, at, left))
            left += 1
        else:
            rows.append((part, PLACED, row, seq, at, None))
    for g in sorted(gaps):
        for seq in gaps[g]:
            rows.append((part, GAP, None, seq, g, nth if g >= lowest else None))
            nth += g >= lowest
    for lo in range(0, len(rows), 1 << 16):
        cols = zip(*rows[lo : lo + (1 << 16)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=_SWEPT)


def successors(summary: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """Which gaps that one range has left go to which documents of lower ranges, the nearest range first. summary: (part, documents left, the longest of them, gaps left, the smallest of them) by falling value. A gap takes as many documents as any of that range's gaps can hold of the longest. Intervals (part, first, end, slot, documents a slot) of documents, and (part, first, end, slot) of gaps; equal slots meet."""
    stack: list[list[int]] = []  # part, first gap that is left, end, smallest
    docs, gaps, slot = [], [], 0
    for part, n, longest, free, smallest in summary:
        at = 0
        while at < n and stack:
            q, first, end, least = stack[-1]
            each = max(1, least // longest)
            take = min(end - first, -(-(n - at) // each))
            to = min(n, at + take * each)
            docs.append((part, at, to, slot, each))
            gaps.append((q, first, first + take, slot))
            slot, at = slot + take, to
            stack[-1][1] += take
            if stack[-1][1] == end:
                stack.pop()
        if free:
            stack.append([part, 0, free, smallest])
    return docs, gaps


def pack(parts: DataFrame, capacity: int = CAPACITY, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows of `parts` (with doc_id, piece, start and a length from 1 to capacity) and the sequence_id and offset of each."""
    spark = parts.sparkSession
    parts = materialize(parts.withColumn("_row", F.monotonically_increasing_id()), "cut")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    # a third of the lengths and more in each band, down to a fixed floor
    edges = [capacity]
    while edges[-1] > max(1, capacity // FLOOR):
        edges.append(edges[-1] // 2)
    edges[-1] = 0
    gaps, placed, written = None, [], []
    for step, (hi, lo) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if not (n := sum(c for x, c in counts.items() if lo < x <= hi)):
            continue
        docs = parts.where((F.col("length") > lo) & (F.col("length") <= hi)).select(F.lit(DOC).alias("kind"), F.col("_row").alias("id"), F.col("length").cast("int").alias("value"))
        order = [F.desc("value"), "kind", "id"]
        sorted_ = lambda df, n: df.repartitionByRange(max(1, -(-n // task_rows)), *order).sortWithinPartitions(*order)
        if gaps is not None:
            fit = gaps.where(F.col("value") > lo)
            swept = materialize(map_arrow(sorted_(docs.union(fit.select(F.lit(GAP).alias("kind"), F.col("seq").alias("id"), "value")), n + fit.count()), lambda b: sweep(b, capacity), SWEPT), "swept")
            of = {(r["part"], r["what"]): r for r in swept.where("nth is not null").groupBy("part", "what").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}  # two rows a task
            get = lambda p, what, c: of[p, what][c] if (p, what) in of else 0
            to_docs, to_gaps = successors([(p, get(p, DOC, "n"), get(p, DOC, "hi"), get(p, GAP, "n"), get(p, GAP, "lo")) for p in sorted({p for p, _ in of})])
            found = spark.createDataFrame(to_docs, "part int, a long, b long, slot long, each long"), spark.createDataFrame(to_gaps, "part int, a long, b long, slot long")
            near = lambda what, x: swept.where(F.col("what") == what).join(F.broadcast(x), [swept["part"] == x["part"], swept["nth"] >= x["a"], swept["nth"] < x["b"]], "left").drop(x["part"])  # two intervals a task
            asking = near(DOC, found[0]).withColumn("slot", F.col("slot") + F.expr("(nth - a) div each"))
            giving = near(GAP, found[1]).withColumn("slot", F.col("slot") + F.col("nth") - F.col("a"))
            pairs = materialize(asking.where("slot is not null").select("row", "nth", "slot", F.col("value").alias("length")).join(giving.where("slot is not null").select("slot", "seq", F.col("value").alias("gap")), "slot"), "pairs") if to_docs else None
            gap_rows = [giving.where("slot is null").select("seq", "value"), gaps.where(F.col("value") <= lo).select("seq", "value")]
            placed.append(swept.where(F.col("what") == PLACED).select("row", "seq", F.col("value").alias("offset")))
            if pairs is not None:
                before = F.coalesce(F.sum("length").over(W.partitionBy("slot").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a slot holds one sequence's documents
                placed.append(pairs.select("row", "seq", (capacity - F.col("gap") + before).cast("int").alias("offset")))
                gap_rows.append(pairs.groupBy("seq", "gap").agg(F.sum("length").alias("s")).select("seq", (F.col("gap") - F.col("s")).cast("int").alias("value")).where("value > 0"))
            docs = asking.where("slot is null").select(F.lit(DOC).alias("kind"), F.col("row").alias("id"), "value")
            n = docs.count()
        else:
            gap_rows = []
        if n:
            opened = materialize(map_arrow(sorted_(docs, n), lambda b, step=step: sweep(b, capacity, step), SWEPT), "opened")
            placed.append(opened.where(F.col("what") == PLACED).select("row", "seq", F.col("value").alias("offset")))
            gap_rows.append(opened.where(F.col("what") == GAP).select("seq", "value"))
        gaps = materialize(reduce(DataFrame.union, gap_rows), "gaps")
    if not placed:
        return parts.drop("_row").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    at = reduce(DataFrame.union, placed).select(F.col("row").alias("_row"), F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return parts.join(at, "_row").drop("_row")


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of docs with their sequence and offset."""
    return pack(pieces(docs, capacity, vocabulary), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and doc_ids and offsets of their pieces in order. A sequence is bounded by `capacity`."""
    placed = pack(pieces(docs, capacity, vocabulary, with_ids=True), capacity)
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(own.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
