"""Kernels and plumbing that the operators of this subpackage share.

Words are the maximal runs of bytes other than space and 0x09-0x0D.  All hashing is done by
numpy over the UTF-8 buffers that Arrow hands over, so no Python object is made per word.
"""

from __future__ import annotations

import atexit
import ctypes
import glob
import math
import os
import shutil
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The regular expression of a word, for SQL functions.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one group of documents should hold, so that a task stays small at any input size.
GROUP_BYTES = 8 << 20

_U = np.uint64
_BASE, _BASE_INV = _U(0x9E3779B97F4A7C13), _U(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_BASE2, _BASE2_INV = _U(0xC2B2AE3D27D4EB4B), _U(pow(0xC2B2AE3D27D4EB4B, -1, 1 << 64))


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x + _U(salt & (2**64 - 1))).astype(_U, copy=False)
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(1 << max(10, (n - 1).bit_length()), base, _U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if n > 1 << 22:
            return have[:n]
        _powers[int(base)] = have
    return have[:n]


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and len + 1 offsets; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = arr.cast(pa.large_string()).fill_null("")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = arr.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each word."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    is_word = _IS_WORD[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = is_word[cut]
    last[cut - 1] = is_word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets[1:], start, side="right")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, step: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial modulo 2**64."""
    out = np.empty(len(start), _U)
    i = 0
    table = _BYTE[_LOWER] if lower else _BYTE
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(start, base + step)))
        part = data[base : end[j - 1]]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(table[part] * _power(_BASE, len(part)), out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * _power(_BASE_INV, len(part))[s] + (e - s).astype(_U)
        i = j
    return mix64(out)


def window_hashes(words: np.ndarray, owner: np.ndarray, width: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window of ``width`` words that starts at each place, and whether it lies in one text."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, bool)
    base, inverse = (_BASE2, _BASE2_INV) if second else (_BASE, _BASE_INV)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * _power(base, len(words)), out=sums[1:])
    out = (sums[width:] - sums[:-width]) * _power(inverse, n)
    return mix64(out, width), owner[:n] == owner[width - 1 :]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the hash, so that sorted hashes lie bucket by bucket."""
    return ((h >> _U(32)) * _U(buckets)) >> _U(32)


def by_bucket(h: np.ndarray, buckets: int):
    """For sorted hashes: (bucket, slice) of each bucket that has any."""
    if not len(h):
        return
    b = bucket_of(h, buckets)
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    for lo, hi in zip(at, np.r_[at[1:], len(b)], strict=True):
        yield int(b[lo]), slice(int(lo), int(hi))


def planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array, equal places together, which the shuffle's compression likes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def settled(base: DataFrame, group_bytes: int) -> tuple[DataFrame, int]:
    """(id, text, ...) rows with a ``_salt`` that deals equal rows out, and the UTF-8 bytes of all texts.

    Rows are dealt into groups by id and text.  If equal rows would outgrow a group, they get different salts, and the
    table is written, so that a row has the same salt whenever it is read.
    """
    per = base.groupBy(F.xxhash64("id", "text").alias("k")).agg((F.count(F.lit(1)) * F.coalesce(F.max(F.octet_length("text")), F.lit(0))).alias("b"))
    row = per.agg(F.sum("b").alias("size"), F.max("b").alias("most")).first()
    if (row["most"] or 0) > group_bytes:
        return written(base.withColumn("_salt", F.monotonically_increasing_id())), row["size"]
    return base.withColumn("_salt", F.lit(0).cast("long")), row["size"] or 0


def group_count(size: int, group_bytes: int = GROUP_BYTES) -> int:
    return max(8, math.ceil(size / group_bytes))


@cache
def one_thread() -> None:
    """Keeps numpy's products of small matrices in one thread: a worker shares its machine with others, and more threads only wait for each other.

    Where the library can't be found, threads stay as they are.
    """
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def lanes(n: int) -> np.ndarray:
    """For each of n partitions, the least number that Spark's hash partitioning (Murmur3 of an int) sends there."""
    out, have, at, step = np.full(n, -1, np.int64), 0, 0, max(1024, 4 * n)
    while have < n:
        x = np.arange(at, at + step, dtype=np.uint32)
        k = x * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> np.uint32(shift)) * np.uint32(times)
        to = h.view(np.int32).astype(np.int64) % n
        first = np.unique(to, return_index=True)
        new = out[first[0]] < 0
        out[first[0][new]] = at + first[1][new]
        have, at = int((out >= 0).sum()), at + step
    return out


def grouped(docs: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Adds ``_group`` and deals rows out by it, each group to a partition of its own; the same plan twice in a query is one shuffle.

    Groups are named so that hash partitioning sends no two to one partition (up to 65,536 groups; beyond, by chance).
    """
    number = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")
    if groups <= 1 << 16:
        names = F.split(F.lit(",".join(map(str, lanes(groups).tolist()))), ",").cast("array<int>")
        number = F.get(names, number)
    return docs.withColumn("_group", number).repartition(groups, "_group")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; only where it is unset and all runs in one process (tests), one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quire-"))
    return _own_dir[0]


_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


@atexit.register
def _clean() -> None:
    while _written:
        _remove(*_written.pop())
    while _own_dir:
        shutil.rmtree(_own_dir.pop(), ignore_errors=True)


def written(df: DataFrame, *, spark: SparkSession | None = None) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: lineage ends here."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def drop_written(*tables: DataFrame | None) -> None:
    for t in tables:
        path = getattr(t, "_quire_path", None)
        if path:
            _remove(t.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def whole_ids(df: DataFrame, id_col: str) -> None:
    """Ids that are packed as 64-bit numbers have to be whole numbers."""
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be a whole number, not {df.schema[id_col].dataType.simpleString()}")


def crc_bucket(column: Column, n: int) -> Column:
    """crc32 of a number as text, modulo n; null stays null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def word_count(column: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
