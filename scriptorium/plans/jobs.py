"""Whole jobs, composed of the operators; models come in as functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import blank_errors, build_prompt, clean_choice, concept_text, merge_choice
from scriptorium.operators import catalog as cat
from scriptorium.operators import graph, quiz, split, transcripts
from scriptorium.sources.scratch import written

TextFn = Callable[[str], str]
Counter = Callable[[list[str]], list[int]]


def build_graph(files: DataFrame, videos: DataFrame, extract: TextFn, joined: int = 10_000, grouped: int = 40_000, counter: Counter | None = None) -> dict[str, DataFrame]:
    """Documents, chunks, concepts, mentions and relations of transcripts (document_name, title, content).

    counter: a counting function of batches of texts, such as that of a vocabulary (split.read_counter); else a count without one.
    """
    tokens = lambda c: split.count_tokens(F.col(c), counter)
    chunks = transcripts.parse_chunks(files).withColumn("tokens", tokens("text"))
    titles = files.select(F.col("title").alias("name"), "document_name")
    # Both are written once, as most of what follows is made of them: transcripts are parsed once, not for each table.
    urls = written(cat.join_url(titles.select("name"), videos).join(titles, "name").select("document_name", "url"), "urls")
    chunks = written(chunks.join(urls, "document_name", "left"), "parsed")
    packs = transcripts.pack(chunks, joined)
    texts = transcripts.join_packs(packs).withColumns({"tokens": tokens("text"), "pos": F.col("pack")})
    groups = written(transcripts.pack(texts.drop("pack"), grouped).withColumnRenamed("pack", "grp"), "groups")
    prompts = transcripts.join_groups(groups).withColumnRenamed("text", "prompt")
    # Written once, as several tables are made of them: the model is asked once for each prompt.
    replies = written(graph.answered(prompts.select("document_name", "grp", "prompt"), extract).drop("prompt"), "replies")
    concepts, relations = graph.extract_payload(replies, "document_name", "grp")
    # Positions of the original chunks that a group holds, for concepts that don't say where they come from.
    members = groups.select("document_name", "grp", F.explode("members").alias("pos")).join(chunks.select("document_name", "pos", "text"), ["document_name", "pos"])
    origins = graph.detect_origin(concepts.select("document_name", "grp", "name").distinct(), members)
    concepts = written(concepts.drop("origin_chunks").join(origins, ["document_name", "grp", "name"]), "concepts")
    merged = graph.merge_concepts(concepts.join(urls, "document_name", "left").withColumn("seq", F.struct("document_name", "grp")))
    relations = relations.select(F.col("from").alias("from_name"), F.col("to").alias("to_name"), F.col("type").alias("relationship_type"), "description", "document_name")
    return {
        "documents": chunks.select(F.col("document_name").alias("name")).distinct(),
        "chunks": graph.embed(chunks, "text"),
        "has_chunk": chunks.select("document_name", "chunk_id").distinct(),
        "concepts": graph.embed(merged.withColumn("_t", concept_text(F.col("name"), F.col("description"))), "_t").drop("_t"),
        "mentions": graph.mention_edges(concepts, chunks),
        "concept_relation": graph.relation_edges(relations, merged),
    }


def edited_transcript(files: DataFrame, log: DataFrame, new_edits: DataFrame) -> DataFrame:
    """(document_name, content) after the edits of a log table and new ones, which have the same columns."""
    return transcripts.serialize(transcripts.apply_edits(transcripts.parse_chunks(files), log.unionByName(new_edits)))


def merge_asr(first: DataFrame, second: DataFrame, merge: TextFn, template: str = "") -> DataFrame:
    """(title, pos, start_time, end_time, text) of two recognitions (title, pos, start_time, end_time, text)."""
    blank = lambda df: df.withColumn("text", blank_errors(F.col("text")))
    both = transcripts.align(blank(first), blank(second))
    prompt = F.when((F.col("text") != "") & (F.col("second") != ""), F.concat(build_prompt(template, F.col("text"), 2000), F.lit("\n"), F.substring("second", 1, 2000)))
    out = graph.answered(both.withColumn("prompt", prompt), merge)
    return out.select("title", "pos", "start_time", "end_time", merge_choice(F.col("text"), F.col("second"), F.col("response")).alias("text"))


def postprocess(chunks: DataFrame, clean: TextFn, template: str = "") -> DataFrame:
    """chunks with cleaned text: rules first, then the model's reply where it gives one."""
    asked = chunks.withColumn("prompt", F.when(F.col("text") != "", build_prompt(template, F.col("text"), 3000)))
    return graph.answered(asked, clean).withColumn("text", clean_choice(F.col("text"), F.col("response"))).select(*chunks.columns)


def make_questions(files: DataFrame, ask: TextFn, done: DataFrame, kinds: list[tuple[str, str]], chunks: int = 10, template: str = "") -> DataFrame:
    """Validated questions of the first long chunks of each document, for the (type, difficulty) pairs that it lacks."""
    spark = files.sparkSession
    wanted = spark.createDataFrame(kinds, "type string, difficulty string")  # a handful of pairs
    todo = transcripts.parse_quiz(files).where(F.col("idx") < chunks).crossJoin(F.broadcast(wanted)).join(done, ["document_name", "type", "difficulty"], "left_anti")
    replies = graph.answered(todo.withColumn("prompt", build_prompt(template, F.col("text"), 2500)), ask).select("document_name", "idx", "type", "difficulty", "response")
    return quiz.valid_questions(split.parse_llm_json(replies)).withColumn("status", F.lit("pending"))


def rerun_list(files: DataFrame, videos: DataFrame) -> DataFrame:
    """(filename, title, url) of transcripts (document_name, title, content) without any timecode."""
    bare = files.where(~F.col("content").rlike(r"\[[0-9]+\.?[0-9]*s - [0-9]+\.?[0-9]*s\]"))
    found = cat.match_four_level(bare.select(F.col("title").alias("name")), videos).where("url is not null")
    return bare.join(found.withColumnRenamed("name", "title"), "title").select(F.col("document_name").alias("filename"), "title", "url")
