"""Streams give what the batch operators give over the same rows."""

import time

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import quiz
from scriptorium.operators import transcripts as tr
from scriptorium.plans.inputs import entity
from scriptorium.sources.store import Store
from scriptorium.streaming import streams

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def run(query):
    assert query.awaitTermination(120)


def test_new_transcripts(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/f{i}_combined.txt").write_text(f"=== Chunk 1 ===\nfirst {i}\n=== Chunk 2 ===\nsecond\n")
        run(streams.each_batch(streams.new_transcripts(spark, source), tr.parse_chunks, out, state))
    got = spark.read.parquet(out)
    assert got.count() == 6 and got.select("document_name").distinct().count() == 3


def update(spark, stream, name, path):
    run(stream.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start())
    return spark.table(name)


def parts(df, path, order):
    for i in range(3):
        df.where(F.pmod(F.col(order), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_running_stats(spark, tmp_path):
    attempts = entity(spark, SF, "attempts")
    stream = parts(attempts, str(tmp_path / "in"), "user_id")
    seen = update(spark, streams.running_stats(stream), "stats", str(tmp_path / "state"))
    last = seen.groupBy("user_id", "question_id").agg(F.max_by(F.struct("attempt_count", "correct_count", "last_answered"), "attempt_count").alias("l")).select("user_id", "question_id", "l.*")
    assert rows(last) == rows(quiz.attempts_to_stats(attempts))


def test_current_texts(spark, tmp_path):
    edits = entity(spark, SF, "edits")
    seen = update(spark, streams.current_texts(parts(edits, str(tmp_path / "in"), "seq")), "texts", str(tmp_path / "state"))
    want = {tuple(r) for r in tr.latest_edits(edits).collect()}
    assert want <= {tuple(r) for r in seen.collect()}


def test_unseen_videos(spark, tmp_path):
    catalog = entity(spark, SF, "catalog")
    listing = spark.createDataFrame([(1, "https://youtu.be/1?x"), (2, "https://youtu.be/new"), (3, "https://youtu.be/new?again")], "id int, url string")
    stream = parts(listing, str(tmp_path / "in"), "id")
    got = streams.unseen_videos(stream, catalog)
    run(got.writeStream.format("memory").queryName("videos").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    assert [r.url.split("?")[0] for r in spark.table("videos").collect()] == ["https://youtu.be/new"]


def test_bounded_state(spark, tmp_path):
    attempts = entity(spark, SF, "attempts").withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    stream = streams.running_stats(parts(attempts, str(tmp_path / "a"), "user_id"), "400 days")
    spans = update(spark, stream, "spans", str(tmp_path / "state_a"))
    last = spans.groupBy("user_id", "question_id", "span").agg(F.max("attempt_count").alias("attempt_count"), F.max("correct_count").alias("correct_count"), F.max("last_answered").alias("last_answered"))
    columns = ["user_id", "question_id", "attempt_count", "correct_count", "last_answered"]
    assert rows(quiz.add_stats(last.select(*columns).limit(0), last.select(*columns)).select(*columns)) == rows(quiz.attempts_to_stats(attempts).select(*columns))

    polled = spark.createDataFrame([(1, "https://youtu.be/a", "2024-01-01"), (2, "https://youtu.be/a", "2024-01-02"), (3, "https://youtu.be/b", "2024-01-02")], "n long, url string, at string").withColumn("polled_at", F.to_timestamp("at"))
    known = spark.createDataFrame([("https://youtu.be/b",)], "url string")
    polled.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = streams.unseen_videos(spark.readStream.schema(polled.schema).parquet(str(tmp_path / "p")), known, late="2 days")
    run(stream.writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "state_p")).trigger(availableNow=True).start())
    assert [r.url for r in spark.table("polled").collect()] == ["https://youtu.be/a"]


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in streams.SETTINGS}
    for k, v in streams.SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_edit_changes_merge_into_a_store(rocks, tmp_path):
    """Micro-batches in any order, and twice, leave what the batch form gives; only changes are passed on; state is one row a chunk."""
    edits = entity(rocks, SF, "edits").select("document_name", "chunk_id", "ts", "seq", "new_text")
    want = {tuple(r) for r in tr.latest_edits(edits).collect()}
    empty = edits.where("false").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seq", F.col("seq").cast("long"))
    store = Store(rocks, str(tmp_path / "store"), "document_name", "chunk_id").create(empty, 4)
    stream = parts(edits, str(tmp_path / "in"), "seq")
    query = streams.store_edits(streams.edit_changes(stream), store, str(tmp_path / "state"))
    run(query)
    assert {tuple(r) for r in store.read().select("document_name", "chunk_id", "new_text").collect()} == want
    state = query.recentProgress[-1]["stateOperators"][0]
    assert state["numRowsTotal"] <= len(want)
    again = streams.store_edits(streams.edit_changes(stream), store, str(tmp_path / "again"))
    run(again)
    assert {tuple(r) for r in store.read().select("document_name", "chunk_id", "new_text").collect()} == want
    passed = update(rocks, streams.edit_changes(parts(edits.where("seq % 2 = 0"), str(tmp_path / "half"), "seq")), "changes", str(tmp_path / "c"))
    assert passed.count() <= 3 * len(want)


def test_fresh_videos_come_once(rocks, tmp_path):
    listing = rocks.createDataFrame([(i, f"https://youtu.be/{i % 7}?t={i}") for i in range(40)], "n int, url string")
    known = rocks.createDataFrame([("https://www.youtube.com/watch?v=3",), ("https://youtu.be/5",)], "url string")
    got = update(rocks, streams.fresh_videos(parts(listing, str(tmp_path / "in"), "n"), known), "fresh", str(tmp_path / "state"))
    assert sorted(r.url.split("/")[-1].split("?")[0] for r in got.collect()) == ["0", "1", "2", "4", "6"]


def test_forgotten_videos_come_again(rocks, tmp_path):
    """Time to live: a key that was forgotten is new again."""
    listing = rocks.createDataFrame([(i, "https://youtu.be/a") for i in range(3)], "n int, url string")
    known = rocks.createDataFrame([("https://youtu.be/b",)], "url string")
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    counts = []
    for i in range(2):
        listing.where(f"n = {i}").coalesce(1).write.mode("append").parquet(path)
        stream = rocks.readStream.schema(listing.schema).parquet(path)
        out = str(tmp_path / f"out{i}")
        write = lambda batch, n, out=out: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        run(streams.fresh_videos(stream, known, keep_ms=1000).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start())
        counts.append(rocks.read.schema("n int, url string").parquet(out).count())
        time.sleep(1.5)
    assert counts == [1, 1]
