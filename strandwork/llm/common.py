"""Shared helpers: tables, written intermediates, and words of Arrow text columns as numpy arrays."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: glibc's malloc_trim, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_M1, _M2, _GRAM = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C17)
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it is not installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    reachable(spark)
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system. Workers are used again by later stages and would keep what an earlier one had at its peak."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with about `limit` bytes of text each; one longer text is a slice of its own."""
    release()
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
    release()


def flat(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column with eight zero bytes behind them, and each text's offsets. Nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0]) if len(texts) else 0
    data = np.zeros(size + 8, dtype=np.uint8)
    if size:
        part = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        data[:size] = _LOWER[part] if lower else part
    return data, (offsets - offsets[0]) if len(texts) else np.zeros(1, dtype=np.int64)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of the first word of each text (one more at the end)."""
    size = int(offsets[-1])
    solid = ~_SPACE[data[:size]]
    edges = offsets[(offsets > 0) & (offsets < size)]
    before = np.zeros(size, dtype=bool)
    before[1:] = solid[:-1]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(size, dtype=bool)
    after[:-1] = solid[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time. `data` ends in eight spare bytes."""
    loads = np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    length = ends - starts
    h = mixed(length.astype(U64) + _GRAM)
    step, at = 0, np.arange(len(starts))
    while len(at):
        left = length[at] - step
        part = loads[starts[at] + step] & _LOW[np.minimum(left, 8)]
        h[at] = mixed(h[at] * _GRAM + part)
        step += 8
        at = at[left > 8]
    return h


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words of the whole array, text borders ignored."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    g = np.zeros(count, dtype=U64)
    for j in range(n):
        g = g * _GRAM + words[j:j + count]
    return mixed(g)


def inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which n words of one text begin, and for each text the number of its first such place."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    begins = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    return at, begins


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and code point of each character; `data` ends in spare bytes."""
    lead = np.flatnonzero((data[:int(offsets[-1])] & 0xC0) != 0x80)
    code = data[lead].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    first = code[wide]
    for low, high, extra, keep in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        these = wide[(first >= low) & (first < high)]
        value = code[these] & keep
        for k in range(1, extra + 1):
            value = (value << 6) | (data[lead[these] + k] & 0x3F)
        code[these] = value
    return lead, code
