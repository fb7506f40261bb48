"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers and shifts of the splitmix64 finaliser (fixed values).
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: ASCII lower-casing and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names, as a URI."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root if "://" in root else f"file://{root}").rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared spark.checkpoint.dir, as a URI."""
    return f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end(spark: SparkSession):
    """What a job shuffles within is taken off the disks when it ends: its result is stored, and nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to a new shared folder and read from there by all that follows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Takes tables that `stored` made off the shared folder, once nothing reads them any more."""
    for df in tables:
        for uri in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
            with suppress(OSError, ValueError, NotImplementedError):  # a store that only Spark reaches keeps them until the folder goes
                store, path = fs.FileSystem.from_uri(uri)
                store.delete_dir(path)


def rested() -> None:
    """Gives the memory that a task has freed back to the system: a Python worker lives on for later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns never clash with what an operator adds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def sieved(rows: DataFrame, name: str, ids: DataFrame, most: int = 1 << 26) -> DataFrame:
    """The rows whose `name` is one of ids (one column), and a few others: told by a broadcast bitmap of 32 bits an id, `most` bits (8 MB) at most, so that no row is shuffled."""
    bits = min(most, -(-(32 * ids.count() + 1) // 32768) * 32768)
    place = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(bits))
    maps = ids.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_map"))
    place = F.pmod(F.xxhash64(F.col(name)), F.lit(bits))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_page"))
    return met.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an array of uint64."""
    x = x + np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, made once a process and extended when a longer text comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 12)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


_BYTE = mix(np.arange(256, dtype=np.uint64))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """S with S[i] the polynomial hash of the first i values (uint64)."""
    up, _ = _Powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever those values stand."""
    _, down = _Powers.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = prefix_hash(values)
    _, down = _Powers.get(len(p))
    return mix((p[width:] - p[:n]) * down[:n])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+."""
    edge = np.diff(np.concatenate(([False], ~SPACE[data], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word, and the byte bounds of the words."""
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    return span_hash(prefix_hash(byte_values(data)), start, end), start, end


def as_bytes(text: str | None, lower: bool = False) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(raw.translate(LOWER) if lower else raw, np.uint8)
