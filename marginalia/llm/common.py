"""Shared plumbing: the cluster's shared folder, written intermediate tables, byte-level word hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch; together with the slices below it bounds a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: UTF-8 bytes of text that are turned into numpy arrays at a time; one text longer than that stands alone.
SLICE_BYTES = 1 << 20
#: Bytes that are hashed at a time.
PIECE_BYTES = 1 << 18

_written: list[tuple[object, str]] = []


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.marginalia.shared", "")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.marginalia.shared", found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _clear() -> None:
    for spark, path in _written:
        try:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the context may have ended; the folder is then the cluster's to clear
            return


atexit.register(_clear)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/marginalia/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() from which everything that needs them has been written."""
    for df in tables:
        drop_path(df.sparkSession, df._written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A new schema with further columns; StructType.add would change the frame's own."""
    return T.StructType([*schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items())])


def input_bytes(df: DataFrame) -> int:
    """Size of the files below df as Catalyst sees it; a number, not a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


# --- bytes of text as numpy arrays -----------------------------------------------------------------


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, UTF-8 bytes, offsets) of consecutive rows of at most `most` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of decontamination and shingles: digits, letters, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[65:91] = True
WORD[128:] = True
#: Tokens of the language model: all but blanks.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, PIECE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def words_of(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z lower-cased, row of each word). kind: which bytes belong to words."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = kind[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # pieces end where a word ends
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE_BYTES, "right")))
        at, to = starts[a], ends[b - 1]
        up, down = _powers(int(to - at) + 1)
        sums = np.zeros(int(to - at) + 1, np.uint64)
        np.cumsum(_BYTES[LOWER[buf[at:to]]] * up[: to - at], out=sums[1:])
        hashes[a:b] = (sums[ends[a:b] - at] - sums[starts[a:b] - at]) * down[starts[a:b] - at]
        a = b
    return mix(hashes), np.searchsorted(offsets, starts, "right") - 1


def shingles_of(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word's index) of each run of k words within one row."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + m]
    same = rows[:m] == rows[k - 1 :]
    at = np.flatnonzero(same)
    return mix(out[at]), rows[at], at


# --- arrays in the shared folder ------------------------------------------------------------------


def write_array(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all: a task that is run again replaces it with the same bytes."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array. From a store without local paths it is first copied
    to a file of the worker's own that has no name any more and goes with the mapping."""
    fs, path = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        where = f"{path}/{name}"
        return np.memmap(where, dtype, "r") if os.path.getsize(where) else np.zeros(0, dtype)
    with tempfile.TemporaryFile() as own, fs.open_input_stream(f"{path}/{name}") as src:
        while block := src.read(1 << 24):
            own.write(block)
        own.flush()
        return np.memmap(own, dtype, "r") if own.tell() else np.zeros(0, dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane, which a shuffle's compression makes small."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def added_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of each value over equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)
