"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs): the 128-bit hashes of the line keys that a batch was the first to have, and in how many
of the batch's documents each is. It is bucketed by hash into as many buckets as the session has shuffle partitions, each
bucket one sorted file. A new batch is dealt once into the same buckets and merge-anti-joined with the runs where they lie:
what no run holds becomes a run of its own at level 0, so that no key is in two runs; the counts of the others are noted
beside the runs. When a level holds `fanout` runs they are compacted into one of the next level, and the old ones deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import BROADCAST_ROWS, ascii_lower, discard, small, table
from scriptorium.sources.scratch import new_path

SPACE = " \t\n\x0b\f\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Within it Spark takes buckets of one file as sorted, as the runs are, and doesn't sort them again."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class LineRuns:
    """The runs of one corpus; batches go in by add() and are asked for by frequent() and unseen(); close() deletes them."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.again: list[DataFrame] = []  # (h1, h2, n_docs) of later batches' keys that a run held by then

    def _write(self, rows: DataFrame, dealt: bool = False) -> str:
        """rows as a run; dealt: they lie in the runs' buckets already."""
        name = f"line_run_{uuid4().hex}"
        rows = rows if dealt else rows.repartition(self.buckets, *HASH)
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", new_path(self.spark, "line_run")).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            held = self.spark.table(name)
            discard(held)
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, counts: DataFrame) -> DataFrame:
        """Adds one batch's (h1, h2, n_docs), each hash once; returns its new run, the keys that no earlier batch had.

        The run may give way to a compacted one at the next add(); write what it returns to keep it.
        """
        batch = self._write(counts)
        new = batch
        if self.runs():
            with sorted_buckets(self.spark):
                new = self._write(self.unseen(self.spark.table(batch)), dealt=True)
                fresh = self.spark.table(new).select(*HASH).hint("merge")
                self.again.append(table(self.spark.table(batch).join(fresh, HASH, "left_anti"), "line_again"))
            self._drop([batch])
        found = self.spark.table(new)
        self.levels[0].append(new)
        for i, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                if new in runs:
                    found = table(found, "line_run")
                self.levels[i + 1].append(self._write(union([self.spark.table(r) for r in runs])))
                self.levels[i] = []
                self._drop(runs)
        return found

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows with h1, h2 that no run holds: the runs are read where they lie, and only rows are dealt."""
        for run in self.runs():
            rows = rows.join(self.spark.table(run).select(*HASH).hint("merge"), HASH, "left_anti")
        return rows

    def frequent(self, min_docs: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """Hashes (h1, h2) found in at least min_docs documents of all batches; no batch, no hashes."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long")
        once = union([self.spark.table(run) for run in self.runs()])
        if self.again:
            more = table(union(self.again).groupBy(*HASH).agg(F.sum("n_docs").alias("more")), "line_again")
            once = once.join(small(more, broadcast_rows), HASH, "left").withColumn("n_docs", F.col("n_docs") + F.coalesce("more", F.lit(0)))
        return once.where(F.col("n_docs") >= min_docs).select(*HASH)

    def close(self) -> None:
        """Deletes the runs and what was noted beside them, once nothing reads them any more."""
        self._drop(self.runs())
        discard(*self.again)
        self.levels, self.again = [[]], []


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def key_counts(docs: DataFrame, min_points: int = 1, *by: str) -> DataFrame:
    """(by, h1, h2, n_docs) of the line keys of docs; a key counts once for each row of docs."""
    keys = F.array_distinct(F.transform(lines_of("text"), line_key))
    rows = docs.select(*by, F.explode(keys).alias("key")).where(F.char_length("key") >= min_points).select(*by, *hashes(F.col("key")))
    return rows.groupBy(*by, *HASH).agg(F.count(F.lit(1)).alias("n_docs"))


def first_seen(runs: LineRuns, batch: DataFrame, min_points: int = 1) -> DataFrame:
    """Incremental form: (h1, h2) of the batch's line keys that no earlier batch has; then adds the batch's own run."""
    return runs.add(key_counts(batch, min_points)).select(*HASH)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1, batches: int = 6, fanout: int = 4, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of docs (doc_id, text; other columns are ignored).

    Lines are what stands between \\n; null and empty texts are one empty line. Keys (line_key) of at least min_points
    code points in at least min_docs rows lose all their lines; the others stay, joined by \\n. A text that loses all its
    lines becomes empty. Rows that repeat one doc_id count and return as rows of their own; no rows give none. ids may be
    null and of any type.

    The rows go into the runs in `batches` batches. Then the places of frequent lines are told for each distinct text (by a
    128-bit hash); texts and lines themselves are not moved unless the texts that lose lines and the lines lost are more than broadcast_rows.
    """
    runs = LineRuns(docs.sparkSession, fanout)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"), "text")
    counted = table(key_counts(dealt, min_points, "batch"), "line_batches", "batch")
    for b in range(batches):
        runs.add(counted.where(F.col("batch") == b).drop("batch"))
    frequent = table(runs.frequent(min_docs, broadcast_rows), "frequent_lines")
    runs.close()
    discard(counted)

    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    lines = named.select("k1", "k2", F.posexplode(F.transform(lines_of("text"), line_key)).alias("pos", "key"))
    lines = lines.where(F.char_length("key") >= min_points).select("k1", "k2", "pos", *hashes(F.col("key")))
    hit = lines.join(small(frequent, broadcast_rows), HASH, "left_semi")
    dropped = table(hit.groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped")), "dropped_lines")
    out = named.join(small(dropped, broadcast_rows, "dropped"), ["k1", "k2"], "left").select("doc_id", "text", "dropped", lines_of("text").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    count = lambda c: F.size(c).cast("long")
    return out.select("doc_id", count("lines").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(count("dropped")).cast("long").alias("n_dropped"), F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))
