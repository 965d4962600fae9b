"""Golden cases of the operators, worked out by hand, and properties of them."""

import io
import json
import random
import re
import time
import wave
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as fn
from scriptorium.operators import catalog as cat
from scriptorium.operators import contain, graph, quiz, split
from scriptorium.operators import transcripts as tr
from scriptorium.plans import jobs
from scriptorium.sources import audio, tables

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return [tuple(r) for r in df.collect()]


def files(spark, content, name="d"):
    return spark.createDataFrame([(name, content)], "document_name string, content string")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_parse_chunks(spark):
    text = "intro\n=== Chunk 1 [0.00s - 30.00s] ===\r\nhello\n\n=== Chunk 2 ===\n　世界　\n\n=== Chunk 3 [60.00s - 90.00s] ===\n=== Chunk 9 [1.2.3s - 4s] ===\n41s] ===\n"
    got = rows(tr.parse_chunks(files(spark, text)).orderBy("pos"))
    assert got == [("d", 0, 0, "hello", 0.0, 30.0), ("d", 1, 1, "世界", None, None), ("d", 2, 8, "", None, 4.0)]


def test_parse_timed_takes_untimed_headers_as_text(spark):
    text = "x\n=== Chunk 1 [0s - 30.5s] ===\na\n\n b \n=== Chunk 2 ===\nc\n=== Chunk 3 [31s - 40s] ===\nCUDA gone\n"
    assert rows(tr.parse_timed(files(spark, text)).orderBy("pos")) == [("d", 0, 0.0, 30.5, "a b === Chunk 2 === c"), ("d", 1, 31.0, 40.0, "")]
    assert tr.parse_timed(files(spark, text), "\n", False).orderBy("pos").first().text == "a\nb\n=== Chunk 2 ===\nc"


def test_parse_quiz_keeps_long_blocks(spark):
    text = f"{'p' * 81}\n=== Chunk 1 ===\n{'a' * 80}\n=== Chunk 2 ===\n{'b' * 81}\n"
    assert rows(tr.parse_quiz(files(spark, text)).orderBy("idx")) == [("d", 0, "p" * 81), ("d", 1, "b" * 81)]


@pytest.mark.parametrize(("a", "b"), [("41s] === text", "text"), ("41s] ===", ""), ("=== x", "x"), ("== x", "x"), ("a == b", "a == b")])
def test_residue(spark, a, b):
    assert value(spark, tr.clean_residue(F.lit(a))) == b


@SLOW
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["C", "Z"], exclude_characters="="), min_size=1), min_size=1, max_size=6))
def test_serialise_then_parse(spark, texts):
    chunks = spark.createDataFrame([("d", i, i, t, float(i), float(i + 1)) for i, t in enumerate(texts)], "document_name string, pos int, chunk_id int, text string, start_time double, end_time double")
    assert rows(tr.parse_chunks(tr.serialize(chunks)).orderBy("pos")) == rows(chunks)


@SLOW
@given(st.lists(st.integers(0, 14), min_size=1, max_size=30), st.integers(1, 4))
def test_pack(spark, tokens, most_rows):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(tokens)], "document_name string, pos int, tokens int")
    for limit in (None, most_rows):
        got = [r.pack for r in tr.pack(df, 10, limit).orderBy("pos").collect()]
        want, total, n, pack = [], 0, 0, -1
        for t in tokens:
            if pack < 0 or total + t > 10 or (limit and n >= limit):
                pack, total, n = pack + 1, 0, 0
            total, n = total + t, n + 1
            want.append(pack)
        assert got == want


def test_pack_golden(spark):
    df = spark.createDataFrame([("d", i, n, t) for i, (n, t) in enumerate(zip([4, 4, 4, 9, 1, 1, 12, 3], "abcdefgh", strict=True))], "document_name string, pos int, tokens int, text string")
    packed = tr.pack(df, 10)
    assert [r.pack for r in packed.orderBy("pos").collect()] == [0, 0, 1, 2, 2, 3, 4, 5]
    assert tr.join_packs(packed).orderBy("pack").first()[:3] == ("d", 0, "a\n\nid 1: b")


def fold(tokens, most, limit):
    """Pack numbers, one chunk after the other."""
    want, total, n, pack = [], 0, 0, -1
    for t in tokens:
        t = most + 1 if t is None else t
        if pack < 0 or total + t > most or (limit and n >= limit):
            pack, total, n = pack + 1, 0, 0
        total, n = total + t, n + 1
        want.append(pack)
    return want


@pytest.mark.parametrize(("limit", "block_rows"), [(None, 7), (4, 7), (30, 1), (None, 1000)])
def test_pack_over_blocks(spark, limit, block_rows):
    r = np.random.default_rng(5)
    docs = {"a": r.integers(0, 15, 150).tolist(), "zeros": [0] * 60, "few": [0] * 40 + [1] * 40, None: [3, None, None, 0, 12, 0, 4], "one": [99]}
    df = spark.createDataFrame([(d, i, n, "x") for d, tokens in docs.items() for i, n in enumerate(tokens)], "document_name string, pos int, tokens int, text string")
    packed = tr.pack(df, 10, limit, block_rows)
    assert packed.columns == [*df.columns, "pack"]
    for d, tokens in docs.items():
        assert [x.pack for x in packed.where(F.col("document_name").eqNullSafe(F.lit(d))).orderBy("pos").collect()] == fold(tokens, 10, limit), d


def test_pack_gathers_no_document(spark):
    df = spark.range(60_000).selectExpr("'d' as document_name", "cast(id as int) as pos", "cast(id % 7 as int) as tokens")
    packed = tr.pack(df, 20, None, 5000)
    assert "collect_list" not in packed._jdf.queryExecution().toString()
    assert [x.pack for x in packed.orderBy("pos").collect()] == fold([i % 7 for i in range(60_000)], 20, None)


def test_effective_source_windows_no_texts(spark):
    from scriptorium.plans.queries import QUERIES

    assert "Window" not in QUERIES["effective_source"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_edits(spark):
    chunks = spark.createDataFrame([("d", i, 5 * i, f"t{i}", None, None) for i in range(3)], "document_name string, pos int, chunk_id int, text string, start_time double, end_time double")
    log = spark.createDataFrame([(1, "d", 0, "x", "2024-01-01 10:00:00"), (2, "d", 0, "y", "2024-01-01 11:00:00"), (3, "d", 0, "z", "2024-01-01 11:00:00"), (4, "d", 9, "far", "2024-01-01"), (5, "d", 1, "bad time", None)], "seq int, document_name string, chunk_id int, new_text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.text for r in tr.apply_edits(chunks, log).orderBy("pos").collect()] == ["y", "bad time", "t2"]


def test_parse_edit_records(spark):
    log = "=== EDIT 2024-01-02T03:04:05 ===\nUser: u\nDocument: a_combined.txt\nChunk ID: 3\nOld Text:\nold\nNew Text:\nnew\nline\n===\n\n=== EDIT nonsense ===\nDocument: b\nChunk ID: 4\nNew Text:\nn\n===\n"
    got = rows(tr.parse_edits(spark.createDataFrame([("l", log)], "log_name string, content string")).select("user", "document_name", "chunk_id", "old_text", "new_text", F.date_format("ts", "HH:mm")))
    assert got == [("u", "a_combined.txt", 3, "old", "new\nline", "03:04"), (None, "b", 4, None, "n", None)]


def test_scalars(spark):
    cases = [
        (fn.fmt_size(F.lit(0)), "0 B"), (fn.fmt_size(F.lit(1023)), "1023.0 B"), (fn.fmt_size(F.lit(1024)), "1.0 KB"), (fn.fmt_size(F.lit(1536)), "1.5 KB"),
        (fn.fmt_duration(F.lit(None).cast("double")), "Unknown"), (fn.fmt_duration(F.lit(-1)), "Unknown"), (fn.fmt_duration(F.lit(59.9)), "00:59"), (fn.fmt_duration(F.lit(3600)), "01:00:00"),
        (fn.fmt_date(F.lit("20260426")), "2026-04-26"), (fn.fmt_date(F.lit("2026")), "2026"),
        (fn.cheap_clean(F.lit("哈哈哈哈哈哈")), "哈哈"), (fn.cheap_clean(F.lit("哈哈哈")), "哈哈哈"), (fn.cheap_clean(F.lit("那個那個那個 [Error in chunk 1: a\nb]")), "那個那個"),
        (fn.norm_url(F.lit("https://youtu.be/V?t=1")), fn.WATCH + "V"), (fn.norm_url(F.lit("http://x/watch?v=V&list=1")), fn.WATCH + "V"), (fn.norm_url(F.lit("http://x")), "http://x"),
        (fn.norm_title_a(F.lit(" a⧸b\\c \t d　")), "a/b/c d"), (fn.base_title(F.lit("t_combined.txt")), "t"), (fn.csv_add(F.lit(""), F.lit("u")), "u"), (fn.csv_add(F.lit("a,u"), F.lit("u")), "a,u"),
        (fn.merge_choice(F.lit(" "), F.lit("b"), F.lit("m")), "b"), (fn.merge_choice(F.lit("a"), F.lit("b"), F.lit("<think>q</think>")), "a"), (fn.clean_json(F.lit("x {1} y {2} z")), "{1} y {2}"),
    ]
    got = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(got) == [w for _, w in cases]
    rules = [("pending", "downloaded", True), ("completed", "downloaded", False), ("failed", "pending", True), ("downloaded", "completed", True), (None, "pending", True), ("pending", "pending", False)]
    df = spark.createDataFrame(rules, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", fn.should_update_status(F.col("a"), F.col("b"))).collect())


def test_whole_texts_are_cleaned_and_sent(spark, tmp_path):
    from scriptorium.plans.queries import QUERIES

    head = "word " * 500
    texts = [None, "", "好好好好", f" {head}哈哈哈哈哈 end\n", f"{head}那個那個那個那個 ＡＡＡＡ", f"{head}[Error in chunk 12: a\nb] tail 好好好", f"[Error in chunk 1: x] {head}[Error in chunk 2: y]"]
    rows_in = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        text = re.sub("(那個){3,}", "那個那個", re.sub(r"([一-鿿\uFF00-\uFFEF])\1{3,}", r"\1\1", text or ""))
        return re.sub(r"(?s)\[Error in chunk [0-9]+:.*?\]", "", text).strip()

    assert dict(rows(QUERIES["cheap_clean_whole"](spark, str(tmp_path)))) == {i: brute(t) for i, t in enumerate(texts)}
    assert dict(rows(QUERIES["apply_text_fn_whole"](spark, str(tmp_path)))) == {i: (t or "") + "!" for i, t in enumerate(texts)}


def test_matching(spark):
    catalog = spark.createDataFrame([(0, "", "none"), (1, "a", "u1"), (2, "ab", "u2"), (3, "twice", "first"), (4, "twice", "last")], "row_no long, title string, url string").withColumn("upload_date", F.lit(None).cast("string"))
    names = spark.createDataFrame([("ab",), ("twice",), ("zz",), ("",)], "name string")
    assert dict(rows(cat.join_url(names, catalog))) == {"ab": "u1", "twice": "first", "zz": None, "": None}
    assert {r.title: r.url for r in cat.join_listing(names.withColumnRenamed("name", "title"), catalog).collect()} == {"ab": "u2", "twice": "last", "zz": "", "": "none"}
    lengths = spark.createDataFrame([(9, "x" * 9), (8, "x" * 8)], "row_no long, title string")
    assert dict(rows(cat.match_ratio(lengths, spark.createDataFrame([("x" * 10,)], "name string")))) == {9: True, 8: False}


def test_containment_join_is_the_same_when_shuffled(spark):
    left = spark.createDataFrame([("alpha beta",), ("ab",), ("b",), ("",), (None,)], "a string")
    right = spark.createDataFrame([("beta",), ("a",), ("ab",), ("alpha beta gamma",), ("",), (None,)], "b string")
    want = sorted(rows(contain.contained_pairs(left, right, "a", "b")))
    assert want == [("ab", "a"), ("ab", "ab"), ("alpha beta", "a"), ("alpha beta", "beta")] and sorted(rows(contain.contained_pairs(left, right, "a", "b", work=-1))) == want


@pytest.mark.parametrize("least", [None, 0.8, 0.5])
def test_gram_join_equals_the_nested_loop(spark, least):
    """Random titles with common beginnings, repeats, blanks, nulls and texts shorter than a q-gram."""
    r = random.Random(4)
    title = lambda: "".join(r.choice(["show ", "live", "12", "a", "é", "中文", " "]) for _ in range(r.randrange(9)))
    names = [title() for _ in range(250)]
    left = [*names, None, "", "abc", "show live"]
    right = [*(n[r.randrange(3) : len(n) - r.randrange(3)] for n in names[:150]), *(title() for _ in range(60)), None, "", "a", "live"]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(left)], "i int, a string")
    b = spark.createDataFrame([(j, x) for j, x in enumerate(right)], "j int, b string")
    want = sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x is not None and y and y in x and (least is None or len(y) > least * len(x)))
    looped = contain.contained_pairs(a, b, "a", "b", least)
    met = contain.contained_pairs(a, b, "a", "b", least, work=-1)
    assert len(want) > 50 and sorted(rows(looped.select("i", "j"))) == want == sorted(rows(met.select("i", "j")))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_gram_join_of_a_common_beginning_stays_narrow(spark, monkeypatch):
    """Texts that all begin alike meet through what tells them apart, and texts don't travel with their q-grams."""
    a = spark.range(3000).select(F.concat(F.lit("show number "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" of the season")).alias("a"))
    b = spark.range(0, 3000, 3).select(F.concat(F.lit("show number "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("b"))
    kept, write = {}, contain.written

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(contain, "written", keep)
    assert contain.contained_pairs(a, b, "a", "b", work=-1).count() == 1000
    assert kept["chosen"].join(kept["seen"], "gram").agg(F.sum("seen")).first()[0] < 40_000  # pairs to check; 3,000,000 in a loop


def test_catalog_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿title,url,status\nt1,u1,pending,20240101\n"t, 2",u2,completed\n', encoding="utf-8")
    got = rows(tables.catalog(spark, str(tmp_path / "c.csv")).orderBy("row_no"))
    assert [r[1:] for r in got] == [("t1", "u1", "pending", "20240101"), ("t, 2", "u2", "completed", None)]
    tables.write_catalog(tables.catalog(spark, str(tmp_path / "c.csv")), str(tmp_path / "out"))
    assert sorted(r[1:] for r in rows(tables.catalog(spark, str(tmp_path / "out")))) == sorted(r[1:] for r in got)


def test_transcript_files(spark, tmp_path):
    for name in ("a_combined.txt", "a_combined_edit.txt", "b_merged.txt", "plain.txt"):
        (tmp_path / name).write_text(f"=== Chunk 1 ===\n{name}\n")
    got = {(r.title, r.kind) for r in tables.transcripts(spark, str(tmp_path)).collect()}
    assert got == {("a", "combined"), ("a", "combined_edit"), ("b", "merged"), ("plain", None)}


def test_graph(spark):
    seen = spark.createDataFrame([("n", "t1", "d1", "d1", "", 1), ("n", "t2", "d2", "d2", "u", 2), ("n", "t0", "x", "d1", "u", 0)], "name string, type string, description string, document_name string, url string, seq int")
    assert rows(graph.merge_concepts(seen)) == [("n", "t2", "d2", "d1,d2", "u")]
    replies = spark.createDataFrame([("k", 'Sure ```json {"concepts":[{"name":"A"}],"relationships":[{"from":"A","to":"B","type":"is a"}]}``` ok'), ("bad", "no")], "key string, response string")
    concepts, relations = graph.extract_payload(replies, "key")
    assert [r.name for r in concepts.collect()] == ["A"] and relations.first()["to"] == "B"
    edges = spark.createDataFrame([("A", "B", "is a"), ("A", "C", "is a"), ("A", "B", "is a")], "from_name string, to_name string, relationship_type string")
    names = spark.createDataFrame([("A",), ("B",)], "name string")
    assert {(r.from_name, r.to_name, r.relationship_type) for r in graph.relation_edges(edges, names).collect()} == {("A", "B", "IS_A")}


@pytest.mark.parametrize(("block_queries", "block_vectors"), [(1000, 1000), (3, 1000), (1000, 7), (2, 4)])
def test_vector_topk(spark, block_queries, block_vectors):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).round(3)
    vectors[7] = vectors[8]
    vectors[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None), (None, vectors[1].tolist())], "id long, embedding array<float>")
    got = graph.vector_topk(df, df.where("id % 10 = 7 or id = 9"), 5, block_queries, block_vectors).orderBy("query_id", "rank").collect()
    x = np.float32(vectors).astype(float)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    assert {r.query_id for r in got} == set(range(7, 60, 10))
    for q in range(7, 60, 10):
        scores = unit @ unit[q]
        want = sorted((i for i in range(60) if i != 9), key=lambda i: (-round(scores[i], 9), i))[:5]
        assert [r.id for r in got if r.query_id == q] == want


def test_vector_topk_with_many_ties_and_empty_sides(spark):
    same = spark.range(3000).select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    got = graph.vector_topk(same, same.where("id < 2"), 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(q, i) for q in range(2) for i in range(4)]
    assert graph.vector_topk(same, same.where("id < 0"), 4).count() == 0
    assert graph.vector_topk(same.where("id < 0"), same, 4).count() == 0


def test_searches_logs_and_banks(spark):
    videos = spark.createDataFrame([(0, "A live show", "completed", ""), (1, "b", "completed", "20240102"), (2, "LIVE", "failed", None)], "row_no long, title string, status string, upload_date string")
    assert [r.row_no for r in cat.search(videos, "Live").orderBy("row_no").collect()] == [0, 2]
    assert [r.row_no for r in cat.search(videos, "live", "failed").collect()] == [2]
    assert [r.row_no for r in videos.orderBy(*cat.listing_order()).collect()] == [2, 0, 1]
    log = spark.createDataFrame([(1, "d", "", "x" * 9)], "id long, document_name string, old_text string, new_text string")
    assert [tuple(r) for r in cat.append_history(log.limit(0), log, 4).collect()] == [(1, "d", None, "xxxx")]
    assert [tuple(r) for r in tr.merge_edit_logs(log, log.drop("old_text")).orderBy("old_text").collect()] == [(1, "d", None, "x" * 9), (1, "d", "", "x" * 9)]
    rows = spark.createDataFrame([("d", 1, "x"), ("d", 0, "y"), ("e", 5, None)], "document_name string, pos int, a string")
    assert sorted(tuple(r) for r in tr.split_rows(rows, "pos", "a").collect()) == [("d", '{"pos":0,"a":"y"}', 0), ("d", '{"pos":1,"a":"x"}', 1), ("e", '{"pos":5}', 0)]
    fresh = spark.createDataFrame([(1, ["a", "b"])], "id long, options array<string>")
    bank = spark.createDataFrame([], "id long, options string, status string")
    assert [tuple(r) for r in quiz.add_questions(bank, fresh).collect()] == [(1, '["a","b"]', "pending")]


def test_models_are_called_in_batches_and_fail_by_row(spark):
    df = spark.createDataFrame([(1, "a b", 2), (2, "boom", 1), (3, None, 900)], "key long, text string, tokens int")
    got = {r.key: r.embedding for r in graph.embed(df, "text", most_tokens=800).collect()}
    assert got[3] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-5

    def model(text):
        if text == "boom":
            raise RuntimeError("no")
        return f"{text}!"

    assert sorted(rows(graph.apply_text_fn(df, "key", model, "text"))) == [(1, "a b!", None), (2, None, "no"), (3, "None!", None)]


def test_quiz(spark):
    raw = [("q", ["a", " b"], "b ", None), ("q", ["a"], "a", None), ("q", ["a", "c"], "b", None), ("q", ["a", "CUDA"], "a", None), (" ", ["a", "b"], "a", None)]
    df = spark.createDataFrame(raw, "question_text string, options array<string>, correct_answer string, explanation string")
    assert rows(quiz.valid_questions(df)) == [("q", ["a", "b"], "b", "")]
    attempts = spark.createDataFrame([(1, 1, c, t) for c, t in ((1, 5), (0, 9), (1, 7))] + [(2, 2, 0, 1), (3, 2, 0, 1)], "user_id int, question_id int, is_correct int, answered_at int")
    stats = quiz.attempts_to_stats(attempts)
    assert (1, 1, 3, 2, 9) in rows(stats)
    assert dict(rows(quiz.error_rates(stats))) == {1: 0.333333}
    questions = spark.createDataFrame([(i, "active", "A") for i in (1, 2, 3)], "id int, status string, correct_answer string")
    assert {r.id: r.error_rate for r in quiz.with_error_rate(questions, quiz.error_rates(stats)).collect()} == {1: 0.333333, 2: 0.5, 3: 0.5}
    answers = spark.createDataFrame([(1, 1, " A "), (1, 2, "B")], "user_id int, question_id int, answer string")
    assert {r.question_id: r.is_correct for r in quiz.score_answers(answers, questions).collect()} == {1: 1, 2: 0}
    assert quiz.hard_questions(questions, quiz.error_rates(stats), 0).count() == 1


@pytest.mark.parametrize(("reply", "want"), [("```json\n[1, 2]\n```", [1, 2]), ('so {"a": "]"} end', [{"a": "]"}]), ('{"options": ["x"]} [3]', [{"options": ["x"]}]), ("none", []), (None, []), ("<think>[9]</think>[[1], 2] x]", [[1], 2]), ("[1", []), ('I found [ two: {"a": 1} and {"a": 2}', [{"a": 1}]), ('[ {"a": {"b": 2}', [{"b": 2}]), ('{ so: [{"a": 1}, {"a": 2}] "', [{"a": 1}, {"a": 2}]), ("[[[[ [3]", [3]), ("] } [4]", [4])])
def test_balanced(reply, want):
    assert json.loads(split.balanced(reply)) == want


@given(st.text("ab .\n。", max_size=300), st.integers(1, 50))
@settings(deadline=None)
def test_cut_pieces_join_to_the_text(text, size):
    pieces = split.cut(text, size)
    assert "".join(pieces) == text and all(len(p) <= size for p in pieces)


def test_long_brackets_and_texts_take_linear_time():
    start = time.time()
    assert split.balanced("[" * 200_000 + "{}") == "[{}]"
    text = "word. " * 500_000
    assert "".join(split.cut(text, 1000)) == text
    assert time.time() - start < 5


def semantic_brute(text, tokens, size, overlap):
    """Cuts by what a piece may end with, found from its end; one break kind after the other."""
    k = tokens // size + 1
    most, pieces, rest = max(1, -(-len(text) // k)), [], text
    while k > 1 and len(rest) > most:
        ends = [[], [], []]
        for e in range(1, most + 1):
            head = rest[:e]
            if re.search(r"\n\s*\n\Z", head):
                ends[0].append(e)
            if head[-1] in ".!?。！？\n" or re.search(r"[.!?。！？]\s+\Z", head):
                ends[1].append(e)
            if head[-1].isspace():
                ends[2].append(e)
        at = next((x[-1] for x in ends if x), most)
        pieces.append(rest[:at])
        rest = rest[at:]
    pieces.append(rest)
    return pieces if overlap is None else split.overlapped(pieces, overlap)


def test_semantic_splitter_query_against_brute_force(spark):
    from scriptorium.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["semantic_splitter"](spark, folder).collect():
        got.setdefault(r.doc_id, {})[r.idx] = r.piece
    count = lambda t: len(re.findall(r"[一-鿿]|[A-Za-z0-9_]+|[^\s一-鿿A-Za-z0-9_]", t, re.ASCII))
    short = [i for i, t in texts.items() if len(t) < 20_000]
    assert len(short) > 150 and sum(len(got[i]) > 1 for i in short) > 20
    for i in short:
        assert [got[i][k] for k in range(len(got[i]))] == semantic_brute(texts[i], count(texts[i]), 400, 200), i


def test_overlap():
    assert split.overlapped(["One. Two. Three.", "Four."], 100) == ["One. Two. Three.", " Two. Three.Four."]
    assert split.overlapped(["One. Two. Three.", "Four."], 8) == ["One. Two. Three.", " Three.Four."]


def sound(*parts):
    return np.concatenate([np.full(int(n * 10), v, np.float32) for n, v in parts])


@pytest.mark.parametrize(("x", "want"), [(sound((12, 1), (2, 0), (5, 1)), [(0, 12)]), (sound((100, 1)), [(0, 100)]), (sound((40, 1), (1, 0), (20, 1)), [(0, 30), (30, 61)]), (sound((5, 1), (2, 0), (5, 1), (2, 0), (11, 1)), [(0, 12), (14, 25)]), (sound((12, 1), (3, 0)), [(0, 15)])])
def test_silence(x, want):
    assert audio.cut_at_silence(x, 10) == want


@pytest.mark.parametrize("seconds", [0.1, 0.7, 3.0, 1000.0])
def test_silences_over_frames(spark, seconds):
    """Frames of any size give the cut of the whole array: silences across borders, quiet frames, open ends, no samples."""
    r = np.random.default_rng(int(seconds * 10))
    signals = {"none": np.zeros(0, np.float32), "quiet": np.zeros(400, np.float32), "loud": np.ones(700, np.float32)}
    signals |= {f"s{i}": np.concatenate([np.full(r.integers(1, 160), v, np.float32) for v in ([1.0, 0.0] * 9)[: r.integers(2, 18)]]) * r.choice([1, -1]) for i in range(25)}
    df = spark.createDataFrame([(k, 10, x.tolist()) for k, x in signals.items()], "audio_id string, sample_rate int, samples array<float>").repartition(3)
    want = {(k, i, a, b) for k, x in signals.items() for i, (a, b) in enumerate(audio.cut_at_silence(x, 10))}
    got = rows(audio.split_silence(df, seconds))
    assert len(want) > 40 and len(got) == len(want) and set(got) == want


def test_audio_files(spark, tmp_path):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(32000)
        w.writeframes((np.ones((64000, 2)) * 16384).astype("<i2").tobytes())
    (tmp_path / "a.wav").write_bytes(buffer.getvalue())
    got = audio.read_audio(spark, str(tmp_path))
    assert got.select("audio_id", "sample_rate", F.size("samples"), F.col("samples")[0]).first() == ("a", 16000, 32000, 0.5)
    framed = audio.read_frames(spark, str(tmp_path), seconds=0.75)
    assert sorted(r["first"] for r in framed.collect()) == [0, 12000, 24000] and rows(audio.split_frames(framed, shortest=1.0)) == [("a", 0, 0.0, 2.0)]
    segments = audio.split_silence(got, shortest=1.0)
    assert rows(segments) == [("a", 0, 0.0, 2.0)] and audio.slice_samples(segments, got).select(F.size("samples")).first()[0] == 32000
    lengths = spark.createDataFrame([("x", 65.0), ("y", 0.0)], "audio_id string, duration double")
    assert rows(tr.fixed_windows(lengths)) == [("x", 0, 0.0, 30.0), ("x", 1, 30.0, 60.0), ("x", 2, 60.0, 65.0)]


def test_build_graph(spark):
    text = "=== Chunk 1 [0s - 30s] ===\nFoo meets Bar.\n=== Chunk 2 [30s - 60s] ===\nonly foo\n"
    videos = spark.createDataFrame([(0, "t", "u")], "row_no long, title string, url string")
    reply = json.dumps({"concepts": [{"name": "Foo", "type": "x", "description": "d", "origin_chunks": [0]}, {"name": "Baz", "type": "x", "description": "", "origin_chunks": []}], "relationships": [{"from": "Foo", "to": "Baz", "type": "near to", "description": ""}, {"from": "Foo", "to": "Nobody", "type": "x", "description": ""}]})
    made = jobs.build_graph(files(spark, text, "t_combined.txt").withColumn("title", F.lit("t")), videos, lambda prompt: reply)
    assert {(r.chunk_id, r.concept_name) for r in made["mentions"].collect()} == {(0, "Foo"), (1, "Foo")}
    assert {(r.name, r.document_name, r.url) for r in made["concepts"].collect()} == {("Foo", "t_combined.txt", "u"), ("Baz", "t_combined.txt", "u")}
    assert [r.to_name for r in made["concept_relation"].collect()] == ["Baz"]
    assert {r.url for r in made["chunks"].collect()} == {"u"} and made["documents"].count() == 1


def test_build_graph_asks_the_model_once(spark, tmp_path):
    text = "".join(f"=== Chunk {i} ===\nword{i} and more of it\n" for i in range(1, 40))
    videos = spark.createDataFrame([(0, "t", "u")], "row_no long, title string, url string")

    def model(prompt, folder=str(tmp_path)):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").write(prompt)
        return json.dumps({"concepts": [{"name": w, "type": "x", "description": "", "origin_chunks": []} for w in prompt.split() if w.startswith("word")], "relationships": []})

    made = jobs.build_graph(files(spark, text, "t_combined.txt").withColumn("title", F.lit("t")), videos, model, 40, 60)
    assert {r.name for r in made["concepts"].collect()} == {f"word{i}" for i in range(1, 40)}
    assert made["mentions"].count() >= 39 and made["concept_relation"].count() == 0
    asked = [p.read_text() for p in tmp_path.iterdir()]
    assert len(asked) == len(set(asked)) > 3


def test_token_counters(spark):
    df = spark.createDataFrame([("a bb ccc",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(split.count_tokens(F.col("t"))).collect()] == [3, 0, 0]
    assert [r[0] for r in df.select(split.count_tokens(F.col("t"), lambda texts: [len(t) for t in texts])).collect()] == [8, 0, 0]
    import base64

    ranks = b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"bb") + b" 256"
    assert [r[0] for r in df.select(split.count_tokens(F.col("t"), split.vocabulary_counter(ranks, r"\S+|\s+"))).collect()] == [7, 0, 0]


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "x", "it's  a b's\n\n c", ""])
def test_vocabulary_counter_of_long_white_space(text):
    from scriptorium.plans.queries import PATTERN, RANKS

    import base64

    import tiktoken

    data = open(RANKS, "rb").read()
    count = split.vocabulary_counter(data, PATTERN)
    got = count([text, text[:3000]])
    whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, special_tokens={})
    assert got[1] == len(whole.encode_ordinary(text[:3000])) and (got[0] > 0) == bool(text)


def test_vocabulary_queries_equal_direct_encoding(spark):
    import base64

    import tiktoken

    from scriptorium.plans.inputs import entity
    from scriptorium.plans.queries import PATTERN, QUERIES, RANKS

    folder = "/root/testdata/sf0.001"
    whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb").read().splitlines())}, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert dict(rows(QUERIES["token_count_by_vocabulary"](spark, folder))) == {i: len(whole.encode_ordinary(t)) for i, t in texts.items()}
    stats = {r.document_name: r.n_tokens for r in QUERIES["doc_stats_by_vocabulary"](spark, folder).collect()}
    want = {}
    for r in entity(spark, folder, "chunks").collect():
        want[r.document_name] = want.get(r.document_name, 0) + len(whole.encode_ordinary(r.text.strip()))
    assert stats == want


def test_build_graph_takes_a_counter(spark):
    """Packing follows the counter that it is given."""
    text = "".join(f"=== Chunk {i} ===\nword{i}\n" for i in range(1, 9))
    videos = spark.createDataFrame([(0, "t", "u")], "row_no long, title string, url string")
    for counter, asked in ((lambda texts: [10] * len(texts), 4), (lambda texts: [1] * len(texts), 1)):
        made = jobs.build_graph(files(spark, text, "t_combined.txt").withColumn("title", F.lit("t")), videos, lambda prompt: json.dumps({"concepts": [{"name": prompt, "type": "", "description": "", "origin_chunks": []}], "relationships": []}), 20, 19, counter)
        assert made["concepts"].count() == asked


def test_answers_carry_their_rows(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, None), ("k", 1, "bad"), ("k", 1, "bad")], "title string, pos int, prompt string")

    def model(text):
        if text == "bad":
            raise ValueError("no")
        return text + "!"

    assert sorted(rows(graph.answered(df, model)), key=str) == sorted([(None, 1, "a", "a!", None), (None, 2, None, None, None), ("k", 1, "bad", None, "no"), ("k", 1, "bad", None, "no")], key=str)


def test_embed_in_batches_calls_once_a_pack(spark):
    df = spark.createDataFrame([("d", i, i // 3, f"t{i}" if i else None) for i in range(8)] + [(None, 0, 0, "x")], "document_name string, pos int, pack int, text string")
    got = {(r.document_name, r.pos): r.embedding for r in graph.embed_in_batches(df, lambda texts: [[len(texts), i, len(t)] for i, t in enumerate(texts)]).collect()}
    assert got == {**{("d", i): [3 if i < 6 else 2, i % 3, 2 if i else 0] for i in range(8)}, (None, 0): [1, 0, 1]}


def test_make_questions_values(spark):
    """The registered job against a dictionary: long chunks' first blocks, all kinds, valid questions alone."""
    from scriptorium.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    want = set()
    for name, idx, text in rows(QUERIES["parse_quiz_chunks"](spark, folder)):
        question = text[:20].strip()
        if idx < 3 and question and not any(m in question for m in fn.ERROR_MARKS):
            want |= {(name, idx, kind, difficulty, question) for kind, difficulty in (("choice", "easy"), ("boolean", "hard"))}
    got = rows(QUERIES["job_make_questions"](spark, folder))
    assert len(got) == len(want) > 20 and set(got) == want


def test_make_questions_leaves_out_what_is_done(spark):
    text = "=== Chunk 1 ===\n" + "long words " * 20 + "\n=== Chunk 2 ===\nshort\n"
    ask = lambda prompt: 'Here [ are: [{"question_text": "Q?", "options": ["a", "b"], "correct_answer": "a", "explanation": ""}, {"question_text": "", "options": ["a", "b"], "correct_answer": "a"}]'
    done = spark.createDataFrame([("t", "choice", "easy")], "document_name string, type string, difficulty string")
    got = jobs.make_questions(files(spark, text, "t"), ask, done, [("choice", "easy"), ("boolean", "hard")])
    assert rows(got.select("document_name", "idx", "type", "difficulty", "question_text", "status")) == [("t", 0, "boolean", "hard", "Q?", "pending")]


@pytest.mark.parametrize("span", [1, 3, 7, 100_000])
def test_counts_in_spans(spark, span):
    """Headers counted in spans of any size give the same chunks, also for documents of one line and null names."""
    r = random.Random(span)
    head = lambda: r.choice(["=== Chunk 1 [0.0s - 1.5s] ===", "=== Chunk 2 ===", "=== Chunk x", "line", "", "  two words ", "=== Chunk 3 [1.5s - 2s]"])
    docs = [(n, "\n".join(head() for _ in range(k))) for n, k in (("a", 60), ("b", 1), ("", 0), (None, 25), ("long", 400))]
    df = spark.createDataFrame(docs, "document_name string, content string")
    for parse in (tr.parse_chunks, tr.parse_timed, lambda x, **k: tr.parse_quiz(x, 3, **k)):
        assert Counter(map(str, rows(parse(df, span=span)))) == Counter(map(str, rows(parse(df, span=1 << 30))))
    chunks = tr.parse_chunks(df, span=1 << 30).withColumn("pos", F.col("pos") * 5 - 20)
    want = {}
    for name, pos in sorted(((r.document_name, r.pos) for r in chunks.collect()), key=lambda x: (str(x[0]), x[1])):
        want[name, pos] = 1 + sum(n == name for n, _ in want)
    assert {(r.document_name, r.pos): r.n for r in tr.numbers(chunks, "n", span).collect()} == want


def test_no_task_holds_a_long_document(spark):
    lines = spark.range(50_000).select(F.lit("d").alias("document_name"), F.col("id").alias("line_no"), F.lit(True).alias("long"))
    got = tr.running(lines.repartition(4), "document_name", "line_no", F.col("line_no") % 10 == 0, F.col("long"), "n", 1000)
    assert got.where(F.col("n") != F.floor(F.col("line_no") / 10) + 1).isEmpty() and got.count() == 50_000
    spans = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(spans) > 1 and max(r["count"] for r in spans) < 50_000


def test_transcripts_are_read_in_splits(spark, tmp_path):
    """One giant file is parsed by several tasks, with what the whole text gives; small and odd files too."""
    r = random.Random(2)
    body = lambda i: f" {i} [{i}.0s - {i + 1}.5s] ===\n" + " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(60))) + r.choice(["\n", "\r\n", ""])
    giant = "before 12 the first\nmark\n" + "".join("=== Chunk" + body(i) for i in range(1, 4000))
    texts = {"giant_combined.txt": giant, "empty.txt": "", "none_merged.txt": "no mark 1\nat all", "starts.txt": "=== Chunk 1 ===\nx\n=== Chunk 2 ===\n", "two words.txt": "a 5\nb=== Chunk 7\ny"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64 << 10)
    try:
        got = rows(tables.transcript_chunks(spark, str(tmp_path)))
        read = spark.read.text(str(tmp_path), lineSep=tr.MARK)
        assert read.where("length(value) > 20").select(F.spark_partition_id()).distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = rows(tr.parse_chunks(tables.transcripts(spark, str(tmp_path)).select("document_name", "content")))
    assert Counter(got) == Counter(want) and len(got) > 3000


def test_archives_and_new_files(spark, tmp_path):
    names = [f"a_{k}.txt" for k in tables.KINDS] + ["plain.txt"]
    df = spark.createDataFrame([(n, f"=== Chunk 1 ===\n{n}") for n in names], "document_name string, content string")
    tables.archive(df, str(tmp_path / "archive"))
    assert {(r.document_name, r.title, r.kind) for r in tables.archived(spark, str(tmp_path / "archive")).collect()} == {*((f"a_{k}.txt", "a", k) for k in tables.KINDS), ("plain.txt", "plain", None)}
    tables.write_texts(df.repartition(1), str(tmp_path / "texts"))
    found = [p for p in (tmp_path / "texts").rglob("*.txt")]
    assert len(found) == 7 and {p.parent for p in found} == {tmp_path / "texts"}  # no folder for each
    assert {r.content.strip() for r in tables.transcripts(spark, str(tmp_path / "texts")).collect()} == {f"=== Chunk 1 ===\n{n}" for n in names}


@pytest.mark.parametrize("k", [1, 4, 50])
def test_unseen_for_all_against_sets(spark, k):
    r = random.Random(k)
    ids = sorted(r.sample(range(1_000_000), 60))
    bank = [(i, "active" if r.random() < 0.8 else "pending") for i in ids]
    seen = {(u, q) for u in range(12) for q in r.sample(ids, [0, 1, 30, 60][u % 4])}
    questions = spark.createDataFrame(bank, "id long, status string")
    stats = spark.createDataFrame([*seen, (3, 77_777_777), (99, ids[0])], "user_id long, question_id long")
    users = spark.createDataFrame([(u,) for u in [*range(13), 5]], "user_id long")
    out = quiz.unseen_for_all(questions, stats, users, k)
    active = [i for i, s in bank if s == "active"]
    want = {(u, n + 1, q) for u in range(13) for n, q in enumerate([q for q in active if (u, q) not in seen][:k])}
    got = rows(out)
    assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("clustered", [True, False])
def test_topk_by_cells_equals_all_pairs(spark, clustered):
    """Exact with ties, copies, null and zero vectors; in clusters most cells are skipped, without structure none need be."""
    r = np.random.default_rng(3)
    middles = r.normal(size=(12, 8))
    data = [(i, (middles[i % 12] + r.normal(size=8) * (0.02 if clustered else 9)).tolist()) for i in range(900)]
    data += [(900 + i, data[i][1]) for i in range(0, 60, 2)] + [(2000, None), (2001, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "id long, embedding array<double>")
    asked = df.where("id % 9 = 0 or id >= 1990")
    want = rows(graph.vector_topk(df, asked, 7))
    found, visits = graph.vector_topk_by_cells(df, asked, 7, cells=24, sample=300, block_queries=40, block_vectors=30)
    assert sorted(rows(found)) == sorted(want) and len(want) > 600
    share = sum(v.visited for v in visits.collect()) / sum(v["cells"] for v in visits.collect())
    assert share < 0.4 if clustered else share <= 1
    assert graph.vector_topk_by_cells(df.where("false"), asked, 7)[0].count() == 0
    assert graph.vector_topk_by_cells(df, asked.where("false"), 7)[0].count() == 0
    assert sorted(rows(graph.vector_topk_by_cells(df.limit(3), asked, 7, cells=2)[0])) == sorted(rows(graph.vector_topk(df.limit(3), asked, 7)))


@pytest.mark.parametrize("span", [1, 4, 100_000])
def test_split_rows_numbers_over_spans(spark, span):
    r = random.Random(span)
    held = [(name, pos, f"t{pos}") for name in ("d", "e", None) for pos in sorted(r.sample(range(60), 25))]
    df = spark.createDataFrame(r.sample(held, len(held)), "document_name string, pos int, text string")
    want = [(name, json.dumps({"text": text}, separators=(",", ":")), sum(n == name and p < pos for n, p, _ in held)) for name, pos, text in held]
    assert Counter(rows(tr.split_rows(df, "text", span=span))) == Counter(want)


def test_random_questions_against_a_dictionary(spark):
    import hashlib

    from scriptorium.plans.inputs import entity

    questions = entity(spark, "/root/testdata/sf0.001", "questions")
    active = [r.id for r in questions.collect() if r.status == "active"]
    want = sorted(active, key=lambda i: (hashlib.md5(f"{i}:7".encode()).hexdigest(), i))[:30]
    assert [r.id for r in quiz.random_questions(questions, 30, 7).collect()] == want


def test_write_and_read_graph(spark, tmp_path):
    nodes = spark.createDataFrame([("a",)], "name string")
    tables.write_graph(str(tmp_path), nodes=nodes)
    tables.write_graph(str(tmp_path), append=True, nodes=nodes)
    assert tables.read_graph(spark, str(tmp_path), "nodes")["nodes"].count() == 2
    assert {r.property for r in graph.schema(nodes=nodes).collect()} == {"name"}


def test_deletes_sort_a_bounded_number_of_rows_in_a_task(spark):
    """Partitions are cut by rows, whatever they compress to."""
    n = 4_000_000
    jobs_table = spark.range(n).select("id", (F.col("id") % 1000).alias("file_id"))
    many, few = spark.range(n), spark.range(0, 1000)
    kept_files, links, kept_jobs = cat.delete_files(many, jobs_table.where("id < 3000"), jobs_table.where("id < 3000"), few.where("id % 2 = 0"))
    assert kept_files.count() == n - 500 and kept_jobs.count() == 1500 and links.where("file_id is null").count() == 1500
    files_left, _, _ = cat.delete_files(many, jobs_table.limit(1), jobs_table.limit(1), many.where("id % 2 = 0"))
    sizes = [r["count"] for r in files_left.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n // 2 and max(sizes) <= cat.TASK_ROWS


def test_counting_a_text_does_not_walk_all_known_pieces():
    from scriptorium.plans.queries import PATTERN, RANKS

    count = split.vocabulary_counter(open(RANKS, "rb").read(), PATTERN)
    short = ["a b"] * 3000
    count(short[:1])
    begun = time.process_time()
    few = count(short)
    alone = time.process_time() - begun
    count([" ".join(f"{chr(97 + i % 26)}{i}" for i in range(180_000))])
    begun = time.process_time()
    assert count(short) == few and time.process_time() - begun < 10 * alone + 0.5


def test_vocabulary_counter_cuts_as_the_encoder_does():
    """White space of all kinds, also what only Python takes for it; new words cost no more than known ones by much."""
    import base64
    import random

    import tiktoken

    from scriptorium.plans.queries import PATTERN, RANKS

    data = open(RANKS, "rb").read()
    whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, special_tokens={})
    rng = random.Random(3)
    signs = ["a", "B", "é", "7", ".", "'s", "中", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u200b", "\u3000"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(5000)] + ["", " ", "x  ", "  x", " \x1c ", "  \x1cx", "ab  cd" * 30_000]
    count = split.vocabulary_counter(data, PATTERN)
    assert count(texts) == [len(whole.encode_ordinary(t)) for t in texts]
    assert split.vocabulary_counter(data, r"\S+|\s+")(["a  b c"]) == [len(tiktoken.Encoding("w", pat_str=r"\S+|\s+", mergeable_ranks=whole._mergeable_ranks, special_tokens={}).encode_ordinary("a  b c"))]
    words = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(300)) for _ in range(300)]
    begun = time.process_time()
    got = count(words)
    took = time.process_time() - begun
    begun = time.process_time()
    assert got == [len(whole.encode_ordinary(t)) for t in words] and took < (time.process_time() - begun) * 1.3


def test_semantic_splitter_takes_small_batches(spark):
    """What a task holds in Python does not grow with its rows."""
    from pyspark.sql.functions import pandas_udf

    from scriptorium.plans.queries import QUERIES

    @pandas_udf("long")
    def told(texts):
        return texts.str.len() * 0 + len(texts)

    rows_and_bytes = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(c) for c in rows_and_bytes]
    try:
        spark.conf.set(rows_and_bytes[0], "10000")
        QUERIES["semantic_splitter"](spark, "/root/testdata/sf0.001")
        narrow = spark.range(0, 5000, 1, 1).select(told(F.col("id").cast("string")).alias("n"))
        wide = spark.range(0, 400, 1, 1).select(told(F.repeat(F.lit("x"), 100_000)).alias("n"))
        assert max(r.n for r in narrow.collect()) <= 500 and max(r.n for r in wide.collect()) <= 60
    finally:
        for c, v in zip(rows_and_bytes, before, strict=True):
            spark.conf.set(c, v)


def test_bundles_give_back_every_transcript(spark, tmp_path):
    """Few files whatever their texts are, and the same rows as of one file each."""
    texts = {f"show {i}_combined.txt": f"=== Chunk 1 ===\ntext {i}" + ("\n" * (i % 3)) for i in range(50)}
    texts |= {"a_merged.txt": "x\x1e=== File y\n\x1e~\x1e\n\n", "b.txt": "", "c.txt": "\n"}
    df = spark.createDataFrame(list(texts.items()), "document_name string, content string").repartition(3)
    tables.write_bundles(df, str(tmp_path / "b"), per_file=10)
    got = {r.document_name: (r.kind, r.content) for r in tables.bundled(spark.read, str(tmp_path / "b")).collect()}
    assert {n: c for n, (_, c) in got.items()} == texts and got["a_merged.txt"][0] == "merged"
    assert len(list((tmp_path / "b").glob("*.txt"))) <= 8


def test_transcript_queries_write_few_files(spark, monkeypatch):
    from pathlib import Path

    from scriptorium.plans import queries as q

    made = []
    monkeypatch.setattr(q, "scratch", lambda s, name, new=q.scratch: made.append(new(s, name)) or made[-1])
    whole = sorted(rows(q.QUERIES["parse_chunks"](spark, "/root/testdata/sf0.01")), key=str)
    for name in ("src_transcripts", "stream_transcripts"):
        made.clear()
        assert sorted(rows(q.QUERIES[name](spark, "/root/testdata/sf0.01").select("document_name", "pos", "chunk_id", "text", "start_time", "end_time")), key=str) == whole
        assert sum(1 for p in made for _ in Path(p.removeprefix("file://")).glob("*.txt")) <= 8
    monkeypatch.setattr(q, "OWN_FILE", 1500)  # long transcripts come in splits of files of their own
    assert sorted(rows(q.QUERIES["src_transcripts"](spark, "/root/testdata/sf0.01").select("document_name", "pos", "chunk_id", "text", "start_time", "end_time")), key=str) == whole


def test_build_graph_reads_its_transcripts_a_few_times(spark):
    """For the chunks and for the titles, not again for each table that is made of them."""
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    plain = spark.createDataFrame([("t_combined.txt", "t", "=== Chunk 1 ===\nalpha\n=== Chunk 2 ===\nbeta\n")], "document_name string, title string, content string")
    videos = spark.createDataFrame([(0, "t", "u")], "row_no long, title string, url string")
    reply = json.dumps({"concepts": [{"name": "beta", "type": "", "description": "", "origin_chunks": []}], "relationships": []})
    made = jobs.build_graph(plain.mapInArrow(told, plain.schema), videos, lambda prompt: reply)
    assert {r.label: r.n for r in graph.counts(**made).collect()} == {"documents": 1, "chunks": 2, "has_chunk": 2, "concepts": 1, "mentions": 1, "concept_relation": 0}
    assert rows(made["mentions"]) == [("t_combined.txt", 1, "beta")] and read.value <= 8
