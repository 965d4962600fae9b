"""What the operators share: intermediate tables, checked broadcasts and word arrays."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.scratch import discard
from scriptorium.sources.scratch import written as table

__all__ = ["BROADCAST_ROWS", "ascii_lower", "crc_mod", "discard", "id_type", "mixed", "release", "released", "slices", "small", "small_batches", "table", "word_hashes"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a few fixed-width columns that may be broadcast (at most about 80 MB as a hashed relation); larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts takes in the JVM and in Python; for the session, so that only queries call it, not operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """df with a broadcast hint if it holds at most so many rows (items: and elements of that array column), else df for a shuffle join.

    df should be narrow and cheap to count, such as what table() returns (Parquet footers hold the counts).
    """
    held = df.count() if items is None else df.agg(F.sum(F.size(items) + F.lit(1))).first()[0] or 0
    return F.broadcast(df) if held <= rows else df


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    """The type of an id column as DDL; ids may be of any type that can be ordered."""
    return docs.schema[column].dataType.simpleString()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def slices(texts: pa.Array, most_bytes: int = 4 << 20, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Cuts an array of strings into runs of rows of about so many bytes and at most so many rows, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (total + n > most_bytes or i - start >= most_rows):
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers stay, and later stages use them again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that releases memory at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text): A-Z lower-cased, cut at [\\x20\\x09-\\x0D]; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    words, offsets = lists.values, lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    counts = np.diff(np.concatenate(([0], np.cumsum(full)))[offsets])
    coded = words.filter(pa.array(full)).dictionary_encode()
    of = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return of[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64), counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a well-spread function of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
