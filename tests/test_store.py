"""Stores: changes rewrite only the buckets that they touch, and again change nothing."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import graph
from scriptorium.operators import transcripts as tr
from scriptorium.sources.store import BUCKET, Store


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def bucket_of(name):
    return int(name.split(f"{BUCKET}=")[1].split("/")[0])


def rows(df):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


@pytest.fixture
def chunks(spark):
    data = [(f"d{i}", k, f"text {i} {k}", None) for i in range(40) for k in range(3)] + [(None, 0, "of no document", None)]
    return spark.createDataFrame(data, "document_name string, chunk_id int, text string, embedding array<float>")


def test_changes_touch_their_buckets_alone(spark, chunks, tmp_path):
    path = str(tmp_path / "chunks")
    store = Store(spark, path, "document_name").create(chunks, 12)
    assert rows(store.read()) == rows(chunks) and store.buckets == 12
    updates = spark.createDataFrame([("d3", 1, "new", [1.0]), ("d3", 9, "added", None), ("d7", 0, None, [2.0])], chunks.schema)
    fresh = spark.createDataFrame([("d5", 0, "again", None), ("d99", 0, "unheard of", None)], chunks.schema)
    gone = spark.createDataFrame([("d8", 2), ("d8", 77)], "document_name string, chunk_id int")
    for changes, function in ((updates, tr.update_chunks), (fresh, tr.reload_documents), (gone, lambda held, x: graph.delete_chunks(x, held)[0]), (gone.select("document_name"), lambda held, x: graph.delete_documents(x, held)[0])):
        want, before = rows(function(store.read(), changes)), files(path)
        touched = store.apply(changes, function)
        after = files(path)
        assert rows(store.read()) == want
        assert touched and {f: t for f, t in before.items() if bucket_of(f) not in touched} == {f: t for f, t in after.items() if bucket_of(f) not in touched}
        assert not any(f in after for f in before if bucket_of(f) in touched)
        store.apply(changes, function)
        assert rows(store.read()) == want  # a change that comes twice changes nothing
    assert store.apply(gone.where("false"), tr.reload_documents) == [] and store.buckets == 12


def test_a_bucket_may_lose_all_its_rows(spark, chunks, tmp_path):
    store = Store(spark, str(tmp_path / "chunks"), "document_name").create(chunks, 3)
    names = chunks.select("document_name").distinct()
    store.apply(names, lambda held, gone: graph.delete_documents(gone, held)[0])
    assert rows(store.read()) == rows(chunks.where("document_name is null")) and store.buckets == 3  # a null key names nothing
    store.apply(chunks, lambda held, new: new)
    assert rows(store.read()) == rows(chunks)


def test_an_empty_store_grows(spark, chunks, tmp_path):
    store = Store(spark, str(tmp_path / "chunks"), "document_name").create(chunks.where("false"), 5)
    assert rows(store.read()) == Counter() and store.buckets == 5
    store.apply(chunks, tr.reload_documents)
    assert rows(store.read()) == rows(chunks)


def test_concepts_in_batches_equal_one(spark, tmp_path):
    data = [("a", "t1", "x", "d1", "u1", 1), ("b", "t", None, "d1", "", 2), ("a", "t2", "y", "d2", "u1", 3), ("a", "t3", "z", "d1", None, 4), ("c", None, None, None, None, 5), ("b", "t9", "late", "d0", "u2", 6)]
    seen = spark.createDataFrame(data, "name string, type string, description string, document_name string, url string, seq int")
    whole = rows(graph.merge_concepts(seen))
    assert whole == Counter([("a", "t3", "z", "d1,d2", "u1", 2), ("b", "t9", "late", "d1,d0", "u2", 2), ("c", None, None, "", "", 0)])
    for cut in ("seq <= 3", "seq % 2 = 0", "false"):
        stores = [Store(spark, str(tmp_path / f"{cut}-{k}"), "name").create(f(seen.where(cut)), 4) for k, f in (("c", graph.concept_rows), ("s", graph.concept_sources))]
        for _ in range(2):  # a batch that comes twice changes nothing
            graph.store_concepts(*stores, seen.where(f"not ({cut})"))
            assert rows(graph.concept_view(*(s.read() for s in stores))) == whole


def test_concept_view_is_bounded(spark):
    """A name of very many documents has all of them as rows, the first ones in the view, and their number."""
    seen = spark.range(5000).select(F.lit("hot").alias("name"), F.lit("t").alias("type"), F.lit("").alias("description"), F.concat(F.lit("d"), "id").alias("document_name"), F.lit("u").alias("url"), F.col("id").alias("seq"))
    r = graph.merge_concepts(seen, 10).first()
    assert r.document_name == ",".join(f"d{i}" for i in range(10)) and r.n_documents == 5000 and r.url == "u"
    assert graph.concept_sources(seen).count() == 5001
