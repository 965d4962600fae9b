"""Readers and writers of transcripts, catalogs, tables and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamReader
from pyspark.sql.window import Window

from scriptorium.operators.transcripts import MARK, PARSED, parsed_blocks, serialize, unified
from scriptorium.sources.scratch import written

CATALOG = "title string, url string, status string, upload_date string"
#: Suffixes of the kinds of transcript files.
KINDS = ("combined_edit", "combined", "merged", "cohere_raw", "postprocessed", "edit_history")
NAME = rf"^(.*)_({'|'.join(KINDS)})\.txt$"


def transcripts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(document_name, title, kind, content), one row for each file; kind is null for names without a known suffix."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("document_name"), F.col("value").alias("content"))
    return named(files)


def transcript_chunks(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """parse_chunks of the files of a folder (document_name: the file's name), read in splits: many tasks share one giant file.

    Records are what stands between two marks, told apart by file, split and place in the split. They are counted within
    their split, of bounded size, and the counts of a file's splits (one row each) are added up.
    """
    read = spark.read.text(folder, lineSep=MARK, pathGlobFilter=pattern)
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    records = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("document_name"), at.alias("at"), unified(F.col("value")).alias("raw"))
    split = Window.partitionBy("path", "at.start").orderBy("at.place")
    # The first record of a file is what stands before its first mark.
    blocks = records.withColumn("row", F.row_number().over(split)).where((F.col("at.start") > 0) | (F.col("row") > 1))
    kept = parsed_blocks(blocks, "path", "document_name", "at")
    counted = written(kept.withColumn("row", F.row_number().over(split)), "chunks")
    sizes = counted.groupBy("path", F.col("at.start").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("path", "start", (F.sum("n").over(Window.partitionBy("path").orderBy("start")) - F.col("n")).alias("before"))
    placed = counted.withColumn("start", F.col("at.start")).join(before, ["path", "start"])
    name = F.coalesce(F.try_url_decode("document_name"), "document_name")
    return placed.select(name.alias("document_name"), (F.col("before") + F.col("row") - 1).cast("int").alias("pos"), *PARSED)


def archive(files: DataFrame, path: str, append: bool = False) -> None:
    """Files (document_name, content) as one Parquet table, so that many small ones are read as few large ones."""
    files.select("document_name", "content").write.mode("append" if append else "overwrite").parquet(path)


def archived(spark: SparkSession, path: str) -> DataFrame:
    """(document_name, title, kind, content) of an archive, as transcripts() gives them of a folder."""
    return named(spark.read.schema("document_name string, content string").parquet(path))


def write_texts(files: DataFrame, path: str, append: bool = False) -> None:
    """The contents of files as text files of names that Spark gives, one for each row, in one folder."""
    files.select("content").write.mode("append" if append else "overwrite").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


#: What stands before each transcript of a bundle; a line with its name follows. Texts have RECORD escaped, so that none holds it.
RECORD, ESCAPED = "\x1e", "\x1e~"
BUNDLED = f"{RECORD}=== File "


def write_bundles(files: DataFrame, path: str, append: bool = False, per_file: int = 10_000) -> None:
    """Files (document_name, content) as text files of up to so many transcripts each, so that many transcripts are few files."""
    record = F.concat(F.lit(BUNDLED), "document_name", F.lit("\n"), F.replace("content", F.lit(RECORD), F.lit(ESCAPED)))
    files.select(record.alias("content")).write.mode("append" if append else "overwrite").option("maxRecordsPerFile", per_file).option("lineSep", "\n").text(path)


def bundled(reader: DataFrameReader | DataStreamReader, folder: str) -> DataFrame:
    """(document_name, title, kind, content) of a folder of bundles, one row for each transcript, read in splits by spark.read or spark.readStream."""
    records = reader.text(folder, lineSep=BUNDLED).where("value <> ''")  # nothing stands before a file's first name
    at = F.locate("\n", F.col("value"))
    text = F.regexp_replace(F.substr("value", at + 1), r"\n\z", "")  # the last line end is the writer's
    return named(records.select(F.substr("value", F.lit(1), at - 1).alias("document_name"), F.replace(text, F.lit(ESCAPED), F.lit(RECORD)).alias("content")))


def named(files: DataFrame) -> DataFrame:
    decoded = F.try_url_decode("document_name")
    name = F.coalesce(decoded, "document_name")
    kind = F.nullif(F.regexp_extract(name, NAME, 2), F.lit(""))
    title = F.when(kind.isNull(), F.regexp_replace(name, r"\.txt$", "")).otherwise(F.regexp_extract(name, NAME, 1))
    return files.select(name.alias("document_name"), title.alias("title"), kind.alias("kind"), "content")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, title, url, status, upload_date) of a CSV with header, perhaps a BOM, and three or four columns; row_no follows the file."""
    rows = spark.read.schema(CATALOG).csv(path, header=True, multiLine=True, enforceSchema=True, mode="PERMISSIVE", escape='"')
    return rows.select(F.monotonically_increasing_id().alias("row_no"), *rows.columns)  # a multi-line file is one partition, in order


#: The tables of the pipeline, the history and the quiz.
TABLES = {
    "files": "id long, filename string, file_path string, file_type string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, file_size long, duration double, transcription_path string, error_message string",
    "downloads": "id long, url string, title string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, file_id long, error_message string",
    "processing_jobs": "id long, file_id long, job_type string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, error_message string",
    "edit_history": "id long, user string, document_name string, chunk_id int, old_text string, new_text string, created_at timestamp_ntz",
    "query_history": "id long, user_id long, query_type string, query_text string, result_count long, created_at timestamp_ntz",
    "questions": "id long, type string, difficulty string, question_text string, options string, correct_answer string, explanation string, source_doc string, source_chunk int, status string, created_by long, created_at timestamp_ntz",
    "user_question_stats": "user_id long, question_id long, attempt_count long, correct_count long, last_answered timestamp_ntz",
    "question_attempts": "id long, user_id long, question_id long, is_correct int, answered_at timestamp_ntz",
}


def write_table(rows: DataFrame, path: str, name: str, append: bool = False) -> None:
    """rows as one of TABLES; columns that they lack are null, others are left out."""
    columns = [x.strip().split(" ") for x in TABLES[name].split(",")]
    made = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns))
    made.write.mode("append" if append else "overwrite").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of TABLES, by its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def write_catalog(rows: DataFrame, path: str) -> None:
    rows.select("title", "url", "status", "upload_date").write.mode("overwrite").csv(path, header=True, escape='"')


def write_rerun_list(rows: DataFrame, path: str) -> None:
    rows.select("filename", "title", "url").write.mode("overwrite").csv(path, header=True, escape='"')


def write_transcripts(chunks: DataFrame, path: str) -> None:
    """Chunks as transcript text, one Parquet row (document_name, content) for each document."""
    serialize(chunks).write.mode("overwrite").parquet(path)


def write_graph(path: str, append: bool = False, **tables: DataFrame) -> None:
    for name, table in tables.items():
        table.write.mode("append" if append else "overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
