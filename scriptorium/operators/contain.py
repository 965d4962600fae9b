"""Joining texts with the texts that they contain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.scratch import written

GRAM = 4
#: A nested loop takes a right side of at most so many rows and characters, and so many characters of left in all, once for each
#: row of right: some seconds on a few cores. Beyond any of these the join goes through shared q-grams.
LOOP_ROWS, LOOP_CHARS, LOOP_WORK = 100_000, 32_000_000, 10_000_000_000
#: Rows of a few short columns that may be broadcast.
BROADCAST_ROWS = 1_000_000


def contained_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float | None = None, work: int = LOOP_WORK) -> DataFrame:
    """Pairs of rows where right's text b, not blank, is inside left's text a; with least only those whose lengths' ratio is above it.

    Small inputs, by rows, characters and their product, meet in a nested loop. Others take the q-gram join: see gram_pairs.
    """
    right = right.where(F.col(b) != "")
    size = lambda df, c: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(c)), F.lit(0))).first()
    (_, chars), (rows, own) = size(left, a), size(right, b)
    if rows <= LOOP_ROWS and own <= LOOP_CHARS and chars * rows <= work:
        near = F.col(a).contains(F.col(b))
        return left.join(F.broadcast(right), near if least is None else near & (F.length(b) > least * F.length(a)))
    met = gram_pairs(left.select(F.col(a).alias("text")), right.select(F.col(b).alias("text")), least).withColumnsRenamed({"left": "own left", "right": "own right"})
    return left.join(met, F.col(a) == F.col("own left")).join(right, F.col(b) == F.col("own right")).drop("own left", "own right")


def grams(text: Column, size: int) -> Column:
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint, if it holds few rows; it should be cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def gram_pairs(left: DataFrame, right: DataFrame, least: float | None = None) -> DataFrame:
    """(left, right): distinct texts of which the left one contains the right one, found through one q-gram of each right text.

    Of a right text's q-grams (a text shorter than a q-gram is its own) that one is taken which the fewest left texts of a
    fitting length hold, so that a common beginning or word makes no hot key; a right text with a q-gram that none holds
    is in none. Left texts send hashes of themselves, once for each chosen q-gram that they hold, and no text: those meet
    pairs of hashes at the end, where containment is checked. With least, texts are dealt to bands of lengths as well, as
    a text within another is at most one band shorter.
    """
    width = math.log(1 / least) if least else None
    band = (lambda n: F.floor(F.log(n) / width).cast("int")) if width else (lambda n: F.lit(0))
    named = lambda df: written(df.where("text <> ''").distinct().select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), F.length("text").alias("n"), "text"), "texts")
    holders, inside = named(left), named(right)
    own = F.when(F.length("text") <= GRAM, F.array("text")).otherwise(F.array_distinct(grams(F.col("text"), GRAM)))
    bands = lambda n: F.array(*(band(F.col(n)) + i for i in range(3))) if width else F.array(F.lit(0))  # noqa: E731  two suffice but for rounding
    asked = inside.select("k1", "k2", "n", F.explode(own).alias("gram"))
    sizes = sorted(r[0] for r in asked.select(F.length("gram").alias("size")).distinct().collect())  # at most GRAM numbers
    held = holders.select("k1", "k2", "n", band(F.col("n")).alias("band"), F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *(grams(F.col("text"), s) for s in sizes)))).alias("gram"))
    wanted = written(asked.select("gram").distinct(), "grams")
    seen = written(held.join(small(wanted), "gram", "left_semi").groupBy("gram", "band").agg(F.count(F.lit(1)).alias("seen")), "seen")
    banded = asked.withColumn("band", F.explode(bands("n"))).join(seen, ["gram", "band"], "left")
    counted = banded.groupBy("k1", "k2", "n", "gram").agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"))
    rarest = counted.groupBy("k1", "k2", "n").agg(F.min(F.struct("seen", "gram")).alias("r")).where("r.seen > 0")
    chosen = written(rarest.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("n").alias("m"), F.col("r.gram").alias("gram")), "chosen")
    fits = (F.col("m") <= F.col("n")) if least is None else (F.col("m") <= F.col("n")) & (F.col("m") > least * F.col("n"))
    sent = held.join(small(chosen.select("gram").distinct()), "gram", "left_semi")
    met = sent.join(chosen.withColumn("band", F.explode(bands("m"))), ["gram", "band"]).where(fits).select("k1", "k2", "r1", "r2").distinct()
    both = met.join(holders.select("k1", "k2", F.col("text").alias("left")), ["k1", "k2"]).join(inside.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("text").alias("right")), ["r1", "r2"])
    return both.where(F.col("left").contains(F.col("right"))).select("left", "right").distinct()

