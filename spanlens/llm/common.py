"""What the operators share: tables, the shared folder, and vectorised hashes of bytes."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise, shared_dir, small  # noqa: F401  for the operators

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null: empty) of each row; whatever else docs holds is not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def lower_ascii(c: Column) -> Column:
    """A-Z made a-z and nothing else; a text of ASCII only goes the short way."""
    exact = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(exact)


def filesystem(uri: str):
    """pyarrow's file system of a URI (file, hdfs, s3, gs, ...), and the path there."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def text_bytes(spark_df: DataFrame) -> int:
    """Bytes of all texts, by one aggregate over the whole table."""
    return int(spark_df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"])


# Vectorised hashes -------------------------------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits of the argument."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


_INVERSE = pow(_ODD, -1, 1 << 64)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash, modulo 2 ** 64, of data[:i]; bytes count from 1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with is_word[byte]."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    turns = np.flatnonzero(np.diff(inside))
    return turns[::2], turns[1::2]


def lower_bytes() -> np.ndarray:
    """A table that maps A-Z to a-z and every other byte to itself."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def joined(texts_: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each followed by gap, as bytes; and where each starts, with the end last."""
    starts = np.zeros(len(texts_) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts_], out=starts[1:])
    return np.frombuffer(gap.join([*texts_, b""]), np.uint8), starts


@lru_cache(maxsize=1)
def _trimmer():
    """glibc's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives memory that is free in this worker back, which workers that live on would keep."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _trimmer():
        _trimmer()(0)


def rows_of(batches: Iterator, text: int = 1) -> Iterator[tuple]:
    """The rows of Arrow batches, with the column text as bytes; some become Python objects at once."""
    for batch in batches:
        trim()
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            yield from zip(*[(c.cast("binary") if j == text else c).to_pylist() for j, c in enumerate(part.columns)], strict=True)
        part = None
        del batch
    trim()


def by_bytes(rows: Iterator[tuple], limit: int, size) -> Iterator[list[tuple]]:
    """Lists of consecutive rows of about limit bytes; a larger row makes a list of its own."""
    held, n = [], 0
    for row in rows:
        b = size(row)
        if held and n + b > limit:
            yield held
            held, n = [], 0
        held.append(row)
        n += b
    if held:
        yield held
