"""What the operators share: tables, Arrow slices and hashes."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans.scratch import materialize

#: Whitespace of all word contracts, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % m, F.lit(-1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; they need not have it on their path."""
    if spark.sparkContext.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tidewheel-ship-"), "tidewheel.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(spark.sparkContext.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices with about `limit` bytes of `column` (one row at least), and that column as bytes; a null becomes empty. Bounds a worker's memory whatever the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            floor = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, floor + limit, "right")))
            part = batch.slice(at, to - at)
            texts = pc.cast(part.column(column), pa.large_binary()).to_pylist()
            yield part, [t or b"" for t in texts]
            at = to


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value evaluated once, wherever `of` reads it (inside lambdas too)."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def counted_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df written and counted: to be broadcast in a join if it has `most` narrow rows at most, else joined by shuffling. Spares the other side, which carries texts, the shuffle."""
    own = materialize(df, "side")
    return F.broadcast(own) if own.count() <= most else own
