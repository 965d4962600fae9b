"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import dart_minhash, decontaminate, exact_dedup, lang_id, pieces
from scriptorium.llm.common import small, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
MIN_SCORE = 0.5
#: Deviations by which a text may fit its language worse than the training texts of its length do; foreign scripts and noise lie
#: at 18 and more, and of 10,000 documents of the given tables the strangest lies below 10.
MAX_STRANGE = 12.0
#: Columns beside those of documents, within a stage.
KEY, PATH, PLACE = "row_key of stage", "file_path of stage", "row_index of stage"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language of the table's labels.

    Rejects those without a letter, with a posterior below MIN_SCORE, or that fit the best language by more than MAX_STRANGE
    deviations worse than its training texts of about the same length (texts in other languages or scripts, noise). Each row
    is judged by its own text, whether its doc_id is null, repeated or not. Without labels nothing is kept.
    """
    small_batches(spark)
    model = lang_id.train(docs)
    fitted = lang_id.fit(docs, model)
    own = [F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(docs.columns)]  # names of their own, as docs may have a score
    judged = lang_id.strangeness(docs, model, fitted, *own)
    kept = judged.where((F.col("lang_pred") != lang_id.UND) & (F.col("score") >= MIN_SCORE) & (F.col("strange") <= MAX_STRANGE))
    return kept.select(*(F.col(f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY (decimal), unique to each row and the same at each reading.

    docs are rows of Parquet tables, told apart by a 64-bit hash of the file's path and the place in it; rows that don't come
    from files are written first. Rows made of one stored row several times (by explode or a join) must be written by the caller.
    """
    try:
        at = docs.select(*docs.columns, F.col("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:
        return keyed(table(docs, "stage_input"))
    row_key = F.xxhash64(PATH).cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(13,0)") + F.col(PLACE).cast("decimal(13,0)")
    return at.select(*docs.columns, row_key.cast("decimal(38,0)").alias(KEY))


def by_key(keys: DataFrame) -> DataFrame:
    """(doc_id, text) for an operator, with the row key as doc_id."""
    return keys.select(F.col(KEY).alias("doc_id"), "text")


def only(keys: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of keys whose key is in kept (KEY), without the key."""
    return keys.join(small(kept), KEY, "left_semi").drop(KEY)


def firsts(keys: DataFrame, judged: DataFrame, group: str, size: str, *before: Column) -> DataFrame:
    """(KEY): of each group of judged (doc_id: the row key) the row that is least by before, doc_id (null first) and row key."""
    several = judged.where(F.col(size) > 1).withColumnRenamed("doc_id", KEY)
    order = F.struct(*(c.alias(f"before_{i}") for i, c in enumerate(before)), F.col("own_id"), F.col(KEY).alias("least"))
    ids = keys.select(KEY, F.col("doc_id").alias("own_id"))
    chosen = several.join(ids, KEY).groupBy(group).agg(F.min(order).alias("first")).select(F.col("first.least").alias(KEY))
    return chosen.unionByName(judged.where(F.col(size) == 1).select(F.col("doc_id").alias(KEY)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the one with the most code points, then the least doc_id.

    A null doc_id comes before all others. Rows that repeat a doc_id are rows of their own: of equal ones the first stays.
    """
    small_batches(spark)
    keys = keyed(docs)
    judged = table(exact_dedup.exact_dedup(by_key(keys)).select("doc_id", "keep_id", "group_size", "n_points"), "judged")
    return only(keys, table(firsts(keys, judged, "keep_id", "group_size", -F.col("n_points")), "kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least doc_id of each near-duplicate class.

    A null doc_id comes before all others, and its text is compared as any other. Rows that repeat a doc_id are rows of
    their own: those with unlike texts all stay, of those in one class the first does.
    """
    small_batches(spark)
    keys = keyed(docs)
    judged = table(dart_minhash.near_classes(by_key(keys)).drop("class_key"), "judged")
    return only(keys, table(firsts(keys, judged, "class_id", "class_size"), "kept"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by the benchmark. Each row is judged by its own text, whether its doc_id is null, repeated or not."""
    small_batches(spark)
    keys = keyed(docs)
    found = decontaminate.contamination(by_key(keys), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return only(keys, table(found.where("not contaminated").select(F.col("doc_id").alias(KEY)), "kept"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_ids, parity and round_trip to each row; null and empty texts get no ids, repeated rows each stay, no rows give none."""
    small_batches(spark)
    return pieces.encode(docs, threads=1)


STAGES: list[tuple[str, Stage]] = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean), ("pieces", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of documents that all stages keep, with the last stage's columns.

    Each stage's result is written to the shared folder and read again. Null and empty texts go in the first stage, with all
    others without a letter; null ids, repeated ids and repeated rows are as the stages say; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
