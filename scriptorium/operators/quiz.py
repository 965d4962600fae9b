"""The question bank, answers and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.text import is_error, strip
from scriptorium.operators.transcripts import running
from scriptorium.sources.scratch import written

KEY = ["user_id", "question_id"]


def valid_questions(raw: DataFrame) -> DataFrame:
    """raw (question_text, options, correct_answer, explanation, ..) trimmed, those that can be asked: text, two options or more, an answer among them, no error marks."""
    text, answer = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("question_text", "correct_answer"))
    tidy = raw.withColumns({"question_text": text, "correct_answer": answer, "options": F.transform("options", strip), "explanation": strip(F.coalesce("explanation", F.lit("")))})
    ok = (F.col("question_text") != "") & (F.col("correct_answer") != "") & (F.size("options") >= 2) & F.array_contains("options", F.col("correct_answer"))
    return tidy.where(ok & ~is_error(F.col("question_text")) & ~is_error(F.col("correct_answer")) & ~F.exists("options", lambda x: is_error(x)))


def attempts_to_stats(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("attempt_count"), F.sum("is_correct").alias("correct_count"), F.max("answered_at").alias("last_answered"))


def add_stats(stats: DataFrame, more: DataFrame) -> DataFrame:
    """Statistics after another batch's: one row for each user and question."""
    return stats.unionByName(more).groupBy(*KEY).agg(F.sum("attempt_count").alias("attempt_count"), F.sum("correct_count").alias("correct_count"), F.max("last_answered").alias("last_answered"))


def error_rates(stats: DataFrame, least: int = 3) -> DataFrame:
    sums = stats.groupBy("question_id").agg(F.sum("attempt_count").alias("attempts"), F.sum("correct_count").alias("correct")).where(F.col("attempts") >= least)
    return sums.select("question_id", F.round(1 - F.col("correct") / F.col("attempts"), 6).alias("error_rate"))


def with_error_rate(questions: DataFrame, rates: DataFrame) -> DataFrame:
    """Active questions with their error rate, 0.5 where too few have answered."""
    return questions.where("status = 'active'").join(rates.withColumnRenamed("question_id", "id"), "id", "left").withColumn("error_rate", F.coalesce("error_rate", F.lit(0.5)))


def hard_questions(questions: DataFrame, rates: DataFrame, k: int, tie: Column | None = None) -> DataFrame:
    """The k (1 to 100) questions with the highest error rate; ties in a repeatable shuffled order."""
    order = F.crc32(F.col("id").cast("string").cast("binary")) if tie is None else tie
    return with_error_rate(questions, rates).orderBy(F.desc("error_rate"), order, "id").limit(max(1, min(100, k)))


def random_questions(questions: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k (1 to 100) active questions in a shuffled order that the seed repeats."""
    order = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    return questions.where("status = 'active'").orderBy(order, "id").limit(max(1, min(100, k)))


def unseen_questions(questions: DataFrame, stats: DataFrame, user: int, kind: str, difficulty: str) -> DataFrame:
    mine = stats.where(F.col("user_id") == user).select(F.col("question_id").alias("id"))
    return questions.where((F.col("status") == "active") & (F.col("type") == kind) & (F.col("difficulty") == difficulty)).join(mine, "id", "left_anti")


def unseen_for_all(questions: DataFrame, stats: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, rank, id): for each user of users (user_id) the first k active questions by id that stats has no answer of.

    Questions are numbered by id. Of a user's answered numbers in order, the i-th one (from 0) has number less i unanswered
    ones before it; so the j-th unanswered number is j and the answered ones with at most j unanswered before them, a sum
    over at most k counts a user. Users don't meet questions, and neither numbering gathers a user or the bank in one task.
    """
    bank = running(questions.where("status = 'active'").select(F.lit(0).alias("bank"), "id").distinct(), "bank", "id", F.lit(True), F.lit(True), "number")
    numbered = written(bank.select("id", (F.col("number") - 1).alias("number")), "numbered")
    answered = stats.select("user_id", F.col("question_id").alias("id")).distinct().join(numbered, "id").join(users.select("user_id").distinct(), "user_id", "left_semi")
    before = running(answered.select("user_id", "number"), "user_id", "number", F.lit(True), F.lit(True), "seen").select("user_id", (F.col("number") - F.col("seen") + 1).alias("j"))
    counts = before.where(F.col("j") < k).groupBy("user_id", "j").agg(F.count(F.lit(1)).alias("n"))
    wanted = users.select("user_id").distinct().withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    placed = wanted.join(counts, ["user_id", "j"], "left").withColumn("number", F.col("j") + F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("user_id").orderBy("j")))
    return placed.join(numbered, "number").select("user_id", (F.col("j") + 1).cast("int").alias("rank"), "id")


def score_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answers (user_id, question_id, answer) to active questions with is_correct by trimmed equality."""
    bank = questions.where("status = 'active'").select(F.col("id").alias("question_id"), "correct_answer")
    return answers.join(bank, "question_id").withColumn("is_correct", (strip(F.col("answer")) == strip(F.col("correct_answer"))).cast("int")).drop("correct_answer")


def user_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("user_id").agg(F.sum("attempt_count").alias("attempts"), F.sum("correct_count").alias("correct"), F.count(F.lit(1)).alias("questions"))


def user_breakdown(stats: DataFrame, questions: DataFrame) -> DataFrame:
    """For each user the sums by type and difficulty, by type, and over all (nulls), in one pass."""
    bank = questions.select(F.col("id").alias("question_id"), "type", "difficulty")
    return stats.join(bank, "question_id").rollup("user_id", "type", "difficulty").agg(F.sum("attempt_count").alias("attempts"), F.sum("correct_count").alias("correct")).where("user_id is not null")


def add_questions(bank: DataFrame, fresh: DataFrame) -> DataFrame:
    """The bank with fresh questions, whose options (an array) are stored as JSON and which wait for review."""
    rows = fresh.withColumns({"options": F.to_json("options"), "status": F.lit("pending")})
    return bank.unionByName(rows.select(*bank.columns))


def review(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Questions with decisions (id, action): approve makes active, reject rejected, anything else nothing."""
    state = F.when(F.col("action") == "approve", "active").when(F.col("action") == "reject", "rejected")
    return questions.join(decisions.select("id", state.alias("_new")), "id", "left").withColumn("status", F.coalesce("_new", "status")).select(*questions.columns)
