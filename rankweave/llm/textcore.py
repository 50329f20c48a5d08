"""Byte-level text primitives on Arrow batches, shared by the operators here.

Texts stay UTF-8 bytes: words are runs of bytes of one class, so a whole slice of
documents is tokenised and hashed by a few numpy passes, never word by word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` well-spread 64-bit values that depend on ``seed`` alone."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003 & (2**64 - 1))) * _U(_STEP))


_BYTE = seeds(256, 7)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_BASE = int(seeds(1, 11)[0]) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {_BASE: np.ones(1, _U), _INVERSE: np.ones(1, _U)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, 2 * len(_powers[base])), _U(base), _U)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def prefix_hash(buf: np.ndarray, lower: bool = True) -> np.ndarray:
    """Running polynomial sums from which :func:`span_hash` takes any span in O(1)."""
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum((_LOWER_BYTE if lower else _BYTE)[buf] * _power(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes hash alike wherever they stand."""
    raw = (prefix[end] - prefix[start]) * _power(_INVERSE, len(prefix))[start]
    return mix(raw + (end - start).astype(_U) * _U(_STEP))


def hash_bytes(data: bytes, lower: bool = True) -> int:
    """The hash that :func:`span_hash` gives to ``data`` inside any text."""
    buf = np.frombuffer(data, np.uint8)
    return int(span_hash(prefix_hash(buf, lower), np.array([0]), np.array([len(buf)]))[0])


#: Word characters by byte: letters, digits and all of non-ASCII; or all but white space.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
NON_SPACE = np.ones(256, bool)
NON_SPACE[9:14] = NON_SPACE[32] = False


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``, and where each document's words begin.

    Document i is ``buf[offs[i]:offs[i+1]]`` and has the words ``ptr[i]:ptr[i+1]``.
    """
    mask = is_word[buf]
    before = np.empty_like(mask)
    before[1:] = mask[:-1]
    after = np.empty_like(mask)
    after[:-1] = mask[1:]
    if len(mask):
        before[0] = after[-1] = False
        before[offs[:-1][offs[:-1] < len(mask)]] = False
        after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def as_strings(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls; a null text is an empty one."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not (pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) or pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type)):
        arr = arr.cast(pa.string())
    return pc.fill_null(arr, "" if "string" in str(arr.type) else b"") if arr.null_count else arr


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes.

    No row is left out or cut; a row above the limit is a run of its own.
    """
    arr = as_strings(arr)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if not len(arr):
        return
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, len(arr))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def rolling_hash(buf: np.ndarray, n: int) -> np.ndarray:
    """The hash of every span of ``n`` bytes, letters' case kept."""
    sums = prefix_hash(buf, lower=False)
    raw = sums[n:] - sums[: len(sums) - n]
    raw *= _power(_INVERSE, len(sums))[: len(raw)]
    raw += _U(n * _STEP & (2**64 - 1))
    return mix(raw)


def running(words: np.ndarray) -> np.ndarray:
    """Running sums of word hashes, with a leading 0, from which :func:`window_hash` takes any window of words."""
    out = np.zeros(len(words) + 1, _U)
    np.cumsum(words * _power(_BASE, len(words)), out=out[1:])
    return out


def window_hash(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` words that start at the places ``at``."""
    return mix((sums[at + n] - sums[at]) * _power(_INVERSE, len(sums))[at] + _U(n * _STEP & (2**64 - 1)))


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive word hashes (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    c = seeds(n, 23) | _U(1)
    out = words[:m] * c[0]
    for j in range(1, n):
        out += words[j : j + m] * c[j]
    return mix(out)


class HashSet:
    """Membership of 64-bit hashes: a bit table refuses most, a sorted array decides the rest."""

    def __init__(self, values: np.ndarray):
        self.__setstate__(np.unique(np.asarray(values, _U)))

    def __getstate__(self) -> np.ndarray:
        return self.values  # the bit table is made again where it is used

    def __setstate__(self, values: np.ndarray) -> None:
        self.values = values
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.values)) * 64))))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.values >> _U(64 - self.bits)] = True

    def index(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` whose value is in the set, and the values' ranks."""
        at = np.flatnonzero(self.table[hashes >> _U(64 - self.bits)])
        if not len(self.values) or not len(at):
            return at[:0], at[:0]
        rank = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        ok = self.values[rank] == hashes[at]
        return at[ok], rank[ok]


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges [starts[i], starts[i] + lengths[i])."""
    if not len(starts) or not lengths.sum():
        return np.zeros(0, np.int64)
    out = np.ones(int(lengths.sum()), np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    ends = np.cumsum(n)
    out[0] = s[0]
    out[ends[:-1]] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


# --- Python workers ---


def _one_heap(largest: int) -> None:
    """Arrays up to ``largest`` bytes come from a heap that a task reuses (fresh pages cost more
    than the arithmetic on them) and that goes back to the system when the task ends: workers
    live on. Larger arrays come straight from the system, and leave no gaps in the heap."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, largest)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 * largest)  # M_TRIM_THRESHOLD


def tidy(fn, largest: int = 32 << 20):
    """``fn`` as a task's function that gives unused memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _one_heap(largest)
        try:
            yield from fn(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


# --- Spark side -----------------------------------------------------------------------


_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it. Only where that is unset and Spark runs
    in this one process, as in tests, a folder of this machine is set; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rankweave-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    _written.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end the paths, given as a list, that have been written to in the shared folder inside.

    For blocks that read their result elsewhere, or take its path (the last one written) off the list.
    """
    global _written
    outer, _written = _written, []
    try:
        yield _written
    finally:
        drop(spark, _written)
        _written = outer


def drop(spark: SparkSession, paths: list[str]) -> None:
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for p in map(hadoop.Path, paths):
        p.getFileSystem(conf).delete(p, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here.

    The write's shuffle files go as soon as it has ended.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(spark: SparkSession, n: int) -> int:
    """Tasks for ``n`` shares of work of bounded size: one each, as far as a scheduler bears it."""
    return max(1, min(n, max(partitions(spark), 20_000)))


#: Rows of a Parquet batch, and rows and bytes of an Arrow batch, where the session sets none.
BATCH = {"spark.sql.parquet.columnarReaderBatchSize": 256, "spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Keep batches of texts small, for texts may be long and workers share memory with the heap."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def apart(c: Column | str) -> Column:
    """A join key equal to ``c`` in what it matches, yet not known to be partitioned alike.

    Joining on it gives both sides an exchange of their own, so that adaptive execution
    may split a partition that one hot key fills.
    """
    return F.col(c).bitwiseXOR(F.lit(0x5DEECE66D)) if isinstance(c, str) else c.bitwiseXOR(F.lit(0x5DEECE66D))


def total_bytes(df: DataFrame, column: str) -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Groups of equal non-null integer ``key`` from batches in the key's order."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and k[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = k[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def fixed_binary(col: pa.Array | pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """Binary values of ``width`` items each as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]].view(dtype).reshape(len(col), width) if len(col) else np.zeros((0, width), dtype)
