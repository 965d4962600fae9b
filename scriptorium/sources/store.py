"""Tables that are changed in place, bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.scratch import written

BUCKET, LIVE = "store_bucket", "store_live"


class Store:
    """A Parquet table in folders by hash of its key, of which a change rewrites only the buckets that hold a key it names.

    Spark's dynamic partition overwrite does the writing: new files are staged and take the place of the touched buckets when
    the job commits, so that a lost executor or a failed job leaves the table as it was. Every bucket holds one row that
    stands for nothing (LIVE is false), which keeps a bucket there when its last row goes. One writer at a time; a change that
    is applied twice leaves what it left the first time, if its function does. Null keys share the bucket of their hash.
    """

    def __init__(self, spark: SparkSession, path: str, *key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def create(self, rows: DataFrame, buckets: int = 200) -> Store:
        """Writes rows as a new table; more rows take more buckets, so that one fits a task."""
        self._write(rows.withColumn(BUCKET, self._bucket(buckets)), list(range(buckets)), "errorifexists")
        return self

    def read(self) -> DataFrame:
        return self._held().where(LIVE).drop(BUCKET, LIVE)

    @property
    def buckets(self) -> int:
        return self._held().agg(F.max(BUCKET)).first()[0] + 1

    def apply(self, changes: DataFrame, function: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts function(rows, changes) in the place of the rows of all buckets that changes name by their keys; returns those.

        The function sees whole buckets, with rows of keys that changes don't name, and gives back all that is to stay.
        """
        n = self.buckets
        dealt = written(changes.withColumn(BUCKET, self._bucket(n)), "changes")
        touched = sorted(r[0] for r in dealt.select(BUCKET).distinct().collect())  # at most n numbers
        if touched:
            old = self._held().where(F.col(BUCKET).isin(touched) & F.col(LIVE)).drop(BUCKET, LIVE)
            made = function(old, dealt.drop(BUCKET)).select(*old.columns)
            self._write(made.withColumn(BUCKET, self._bucket(n)), touched, "overwrite")
        return touched

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _held(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _write(self, rows: DataFrame, touched: list[int], mode: str) -> None:
        marks = self.spark.createDataFrame([(b, False) for b in touched], f"{BUCKET} int, {LIVE} boolean")
        every = rows.withColumn(LIVE, F.lit(True)).unionByName(marks, allowMissingColumns=True)
        every.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
