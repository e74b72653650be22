"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, on UTF-8 bytes.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of text that one step holds as Python objects.
STEP_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_slices(column: pa.Array, step: int = STEP_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """First row, row after the last, and texts of runs of rows of about ``step`` bytes; a null text is empty.

    Only one run at a time becomes Python objects.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + step, side="right")))
        yield start, end, [x or "" for x in column.slice(start, end - start).to_pylist()]
        start = end
    give_back()


def give_back() -> None:
    """Return to the machine what this worker's allocators hold unused: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Longer words are hashed anew each time, which bounds the bytes that the store keeps.
LONGEST_KEPT = 64


class WordHashes:
    """64-bit hashes of words, kept up to a bound of entries; past it the store starts anew."""

    def __init__(self, bound: int = 150_000):
        import xxhash

        self.hash, self.bound, self.known = xxhash.xxh3_64_intdigest, bound, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, self.hash
        if len(known) > self.bound:
            known.clear()
        passing = {}
        for w in set(words).difference(known):
            (known if len(w) <= LONGEST_KEPT else passing)[w] = digest(w)
        if passing:
            return np.fromiter((known[w] if w in known else passing[w] for w in words), np.uint64, len(words))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_hashes: WordHashes | None = None


def word_hashes() -> WordHashes:
    """This worker's store."""
    global _hashes
    if _hashes is None:
        _hashes = WordHashes()
    return _hashes


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra columns with any name do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Rows that a join may broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table of a few narrow columns, to be broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {n.lower() for n in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
