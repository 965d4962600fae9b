"""Vectors of whole numbers, and blocks of queries that meet blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 2.0**53


def scaled(vector: Column, by: int) -> Column:
    """floor(by * x) for each component x, as doubles; null for vectors that are null or hold a null or non-finite component."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  doubles above are whole already
    return F.when(finite, F.transform(x, lambda v: whole(v * F.lit(float(by)))))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    rows = vectors.combine_chunks()
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(rows), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = pc.list_flatten(rows).to_numpy(zero_copy_only=False)
    return out


def inner(rows: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of rows, whose components are at most `most` in size, with a query; in Python's integers where doubles can't hold them."""
    d = min(rows.shape[1], len(query))
    if d * most * float(np.abs(query[:d]).max(initial=0)) < EXACT:
        return rows[:, :d] @ query[:d]
    whole = [int(x) for x in query[:d]]
    return np.array([sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in rows[:, :d].tolist()], object)


def blocks_for(rows: DataFrame, block_rows: int) -> int:
    """How many blocks of about so many rows; rows should be cheap to count, such as a written table."""
    return max(1, -(-rows.count() // block_rows))


def dealt(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def meet(queries: DataFrame, key: str, held: DataFrame, blocks: int, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str, query_rows: int = 2000) -> DataFrame:
    """function(queries, held) for each block of queries, about so many, with each block of held (column block, 0 to blocks - 1).

    A task sees one block of each side: the sides are copied for every block of the other, and nothing goes through the driver.
    Pairs of blocks are dealt to some more partitions than there are pairs (up to 10,000, or to as many as there are
    pairs), as a pair is much work for its few bytes and should not share a task.
    """
    n = blocks_for(queries, query_rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("query_block", dealt(key, n)).withColumn("block", each(blocks))
    there = held.withColumn("query_block", each(n))
    keys, pairs = ["query_block", "block"], n * blocks
    parts = max(pairs, min(4 * pairs, 10_000))
    sides = (df.repartition(parts, *keys).groupBy(*keys) for df in (asked, there))
    return next(sides).cogroup(next(sides)).applyInArrow(function, schema)
