"""Shared pieces: scratch tables in the cluster's shared folder, and vectorised word hashing on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Word separators: space and the control characters tab to carriage return.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_RADIX, _SEQ = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd multipliers


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where it is unset in a local session, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get()
    return base.rstrip("/")


class Scratch:
    """Tables of one run, written as Parquet below the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that hands its freed memory back to the system at the end of its task.

    Spark uses a Python worker again for later tasks, and the allocators would keep what the largest one needed.
    """

    @wraps(run)
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return go


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches' rows in smaller batches: what is made of a batch's texts is larger than the texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes each output bit with probability one half."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_RADIX))
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), _U(base))
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 1 << 21:
            _powers[base] = have
    return have[:n]


def text_blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into blocks of about ``limit`` bytes: first row, bytes, offsets. Nulls count as empty; no text is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z as a-z with ``fold``), and for each text the index of its first word."""
    first, last, at = word_spans(data, offsets)
    if not len(first):
        return np.zeros(0, np.uint64), at
    lens = last - first
    begin = np.cumsum(lens) - lens
    total = int(begin[-1] + lens[-1])
    place = np.arange(total, dtype=np.int64) - np.repeat(begin, lens)
    # words cover the bytes that are not separators, in order
    parts = (_BYTE_FOLDED if fold else _BYTE)[data[~SEPARATOR[data]]] * powers(_RADIX, int(lens.max()))[place]
    return mix(np.add.reduceat(parts, begin) + lens.astype(np.uint64) * _U(_SEQ)), at


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` neighbouring words, by start; texts' borders are the caller's business."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = pow(_SEQ, -1, 1 << 64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_SEQ, len(words)), out=total[1:])
    return mix((total[length:] - total[:-length]) * powers(inverse, n) + _U(length))
