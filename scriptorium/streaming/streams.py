"""Growing folders and logs as streams; each gives what its batch form gives over all that has arrived."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from scriptorium.functions.text import norm_url
from scriptorium.operators.quiz import KEY
from scriptorium.sources.store import Store
from scriptorium.sources.tables import bundled, named


def new_transcripts(spark: SparkSession, folder: str, bundles: bool = False) -> DataFrame:
    """(document_name, title, kind, content) of files as they come, or of bundles (tables.write_bundles); each file once, by the checkpoint."""
    if bundles:
        return bundled(spark.readStream, folder)
    files = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("document_name"), F.col("value").alias("content"))
    return named(files)


def each_batch(stream: DataFrame, function, path: str, checkpoint: str) -> StreamingQuery:
    """Writes function(batch) of each micro-batch to its own folder, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, n: int) -> None:
        function(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_stats(attempts: DataFrame, late: str | None = None, every: str = "1 day") -> DataFrame:
    """Counts for each user and question, for update mode; late rows are simply added.

    With late (such as "2 days") counts are kept for each span of time (column span), to be added up where they are read.
    State then holds open spans only, and rows that come later than that are left out.
    """
    keys = [F.col(c) for c in KEY]
    if late:
        timed = attempts.withColumn("answered_at", F.col("answered_at").cast("timestamp"))  # watermarks take no other type
        attempts, keys = timed.withWatermark("answered_at", late), [*keys, F.window("answered_at", every).alias("span")]
    return attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempt_count"), F.sum("is_correct").alias("correct_count"), F.max("answered_at").alias("last_answered"))


def current_texts(edits: DataFrame) -> DataFrame:
    """The text of each chunk by its latest edit, for update mode; of equally late edits the first."""
    order = F.struct("ts", (-F.col("seq")).alias("seq"))
    return edits.groupBy("document_name", "chunk_id").agg(F.max_by("new_text", order).alias("new_text"))


def unseen_videos(listing: DataFrame, catalog: DataFrame, time: str = "polled_at", late: str | None = None) -> DataFrame:
    """Polled videos not in the catalog, each once; the state is one key for each video.

    With late (such as "2 days") keys are forgotten so long after their time, so a video polled again after that comes again.
    """
    known = catalog.select(norm_url(F.col("url")).alias("k")).distinct()
    polled = listing.withColumn("k", norm_url(F.col("url")))
    if late:
        polled = polled.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["k"])
    else:
        polled = polled.dropDuplicates(["k"])
    return polled.join(known, "k", "left_anti").drop("k")


#: What a session that runs the streams with transformWithState sets: their state lies in RocksDB, and as forgetting is left to the
#: batches that have rows, a run over what is available ends.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Newest(StatefulProcessor):
    """For each key the row with the greatest (at, -seq), no time before any, passed on whenever a batch brings a greater one; forgotten some time after its last change."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at long, seq long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        place = lambda at, seq: (at is not None, at or 0, -seq)
        best = max(rows, key=lambda r: place(r.at, r.seq))
        held = self.newest.get()
        if held is None or place(best.at, best.seq) > place(*held):
            self.newest.update((best.at, best.seq))
            yield Row(document_name=key[0], chunk_id=key[1], at=best.at, seq=best.seq, new_text=best.new_text)

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """Each key's first row, passed on once; a key is forgotten some time after it was first seen, and then new again."""

    def __init__(self, keep_ms: int, names: list[str]) -> None:
        self.keep_ms, self.names = keep_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        if not self.seen.exists():
            first = next(iter(rows))
            self.seen.update((True,))
            yield Row(**{n: first[n] for n in self.names})

    def close(self) -> None:
        pass


DAY = 24 * 3600 * 1000


def edit_changes(edits: DataFrame, keep_ms: int = 2 * DAY) -> DataFrame:
    """(document_name, chunk_id, ts, seq, new_text) of edits whenever a chunk's latest one changes, for update mode.

    State is one time and number for each chunk edited within keep_ms. An edit that comes after its chunk was forgotten is
    passed on again even if it is older; merging by time (store_edits) makes that harmless. Needs SETTINGS.
    """
    edits = edits.select("document_name", "chunk_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), "new_text")
    changes = edits.groupBy("document_name", "chunk_id").transformWithState(Newest(keep_ms), edits.schema, "Update", "ProcessingTime")
    return changes.select("document_name", "chunk_id", F.timestamp_micros("at").alias("ts"), "seq", "new_text")


def fresh_videos(listing: DataFrame, catalog: DataFrame, keep_ms: int = 2 * DAY) -> DataFrame:
    """Polled videos not in the catalog, each passed on once within keep_ms, for update mode. Needs SETTINGS."""
    known = catalog.select(norm_url(F.col("url")).alias("k")).distinct()
    polled = listing.withColumn("k", norm_url(F.col("url"))).join(known, "k", "left_anti").select("k", *listing.columns)
    return polled.groupBy("k").transformWithState(FirstSeen(keep_ms, listing.columns), listing.schema, "Update", "ProcessingTime")


def newer(held: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest of both for each chunk; of equally late edits the first."""
    order = F.struct(F.col("ts").isNotNull().alias("timed"), "ts", (-F.col("seq")).alias("first"))
    last = held.unionByName(changes).groupBy("document_name", "chunk_id").agg(F.max_by(F.struct("ts", "seq", "new_text"), order).alias("l"))
    return last.select("document_name", "chunk_id", "l.*")


def store_edits(changes: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Merges a stream of edit_changes into a store by (document_name, chunk_id); a batch that comes twice changes nothing."""
    return changes.writeStream.outputMode("update").foreachBatch(lambda batch, _: store.apply(batch, newer) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
