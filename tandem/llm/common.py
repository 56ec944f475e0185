"""What the operators share: saved tables, Arrow batches as byte arrays, bounded bitmaps."""
from __future__ import annotations

import gc
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.session import ensure_checkpoint_dir

#: Bytes of text that are held as one set of arrays.
CHUNK = 1 << 20
#: Bits of a bitmap of hashes; its size does not depend on the data.
BITS = 22


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers with the job, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_tandem_shipped", False):
        return
    folder = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(folder.rglob("*.py")):
            z.write(p, str(p.relative_to(folder.parent)))
    name = f"{shared(spark)}/tandem-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(data.getvalue())
    out.close()
    sc.addPyFile(name)
    sc._tandem_shipped = True


def shared(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which all machines share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage at files that outlive any executor; the rows are computed once
    and every later read sees the same ones. The folder is the cluster's to clear.
    """
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that no plan reads any more, and let Spark drop the shuffle files of finished steps.

    Spark's cleaner frees shuffle files once the driver's garbage collector has met the plans they belong to.
    """
    for table in tables:
        path = getattr(table, "_saved_at", None)
        if path:
            sc = table.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
            table._saved_at = None
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def as_bytes(name: str) -> Column:
    """A text column as its UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b"")).alias(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def row_key(doc_id: str, text: str) -> Column:
    """A 64-bit name of a row by its content: equal rows have the same one, in every run."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK,
           rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``limit`` bytes of ``name`` and ``rows`` rows, but one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = min(max(int(np.searchsorted(ends, base + limit, "right")), start + 1), start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped; workers give back what they no longer use."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def ints(values: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.array(values.astype(np.int64) if kind == pa.int64() else values, type=kind)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """``values`` cut into consecutive lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def bitmap(hashes: DataFrame, name: str, bits: int = BITS) -> np.ndarray:
    """A bit for each value of ``hashes[name]`` modulo ``2**bits``, as bytes.

    At most ``2**bits`` numbers reach the driver and ``2**bits / 8`` bytes go to the
    executors, however many values there are; a full bitmap only filters less. For
    use in front of an exact join, never in place of one.
    """
    slot = F.col(name).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("slot")
    found = hashes.select(slot).distinct().toArrow().column("slot").to_numpy()
    out = np.zeros(1 << bits, bool)
    out[found] = True
    return np.packbits(out, bitorder="little")


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.int64) & (len(bits) * 8 - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def sieve(batch: pa.RecordBatch, key: str, bits: np.ndarray, keep: bool = True) -> pa.RecordBatch:
    """The rows of a batch whose ``key`` may be in the bitmap, or with ``keep=False`` those that cannot be.

    For tasks that run Python anyway: a filter of its own would hold a second worker.
    """
    return batch.filter(pa.array(in_bitmap(bits, batch.column(key).to_numpy(zero_copy_only=False)) == keep))


def bitmap_filter(df: DataFrame, key: str, bits: np.ndarray, keep: bool = True) -> DataFrame:
    """The rows whose ``key`` (long) may be in the bitmap, or with ``keep=False`` those that cannot be."""
    ship(df.sparkSession)
    packed = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(keys):
        import pandas as pd

        from tandem.llm.common import in_bitmap as look
        return pd.Series(look(packed.value, keys.to_numpy()) == keep)

    return df.where(test(F.col(key)))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))
