"""Benchmark decontamination as a prefix-filtered join, with DataFrame operations only.

Each benchmark item is cut into windows of consecutive words. A document holds a window only if it holds all of its
words, so it is enough to join one necessary word of each window: the rarest over all documents. The word's offset gives
the only place where the window can start (positional bound), which must leave room for the window's length (length
bound); there the window is compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import ascii_lower, small, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows (about 150 bytes each) that may be broadcast.
BROADCAST_WINDOWS = 200_000
ROW = ["k1", "k2"]


def words_of(text: str) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id string, win, n): the windows of each item; an item of fewer words than size, but not none, is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words")).where(F.size("words") > 0)
    cut = F.when(F.size("words") <= size, F.array("words")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1)), lambda i: F.slice("words", i, size)))
    return items.select("item_id", F.explode(cut).alias("w")).select("item_id", F.array_join("w", " ").alias("win"), F.size("w").alias("n")).distinct()


def prefixes(docs: DataFrame, wins: DataFrame, broadcast_windows: int) -> DataFrame:
    """(word, off, win, n): for each distinct window its rarest word over all documents and the word's first offset."""
    each = wins.select("win", "n").distinct().select("win", "n", F.posexplode(F.split("win", " ")).alias("off", "word"))
    vocabulary = table(each.select("word").distinct(), "benchmark_words")
    seen = docs.select(F.explode(words_of("text")).alias("word")).join(small(vocabulary, broadcast_windows), "word", "left_semi")
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    rarest = each.join(counts, "word").groupBy("win", "n").agg(F.min(F.struct("seen", "word", "off")).alias("r"), F.count(F.lit(1)).alias("present"))
    # A word that no document has rules its window out.
    return rarest.where("present = n").select("r.word", "r.off", "win", "n")


def occurrences(docs: DataFrame, prefix: DataFrame, broadcast_windows: int) -> DataFrame:
    """(k1, k2, doc_id, n_words, start, n, win): one row with null win for each row of docs, and one for each occurrence."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*(F.xxhash64(F.lit(i), "doc_id", text).alias(k) for i, k in enumerate(ROW)), "doc_id", words_of("text").alias("words"))
    tokens = base.withColumn("n_words", F.size("words").cast("long"))
    # The last row of each text has no word, so texts without a match stay.
    each = tokens.select("*", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    sides = prefix.withColumnRenamed("word", "rare")
    start = F.col("pos") - F.col("off")
    fits = (F.col("word") == F.col("rare")) & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("n")), " ") == F.col("win")
    columns = [*ROW, "doc_id", "n_words", start.alias("start"), "n", "win"]
    if prefix.count() <= broadcast_windows:
        return each.join(F.broadcast(sides), fits & same, "left").where("win is not null or word is null").select(*columns)
    # Many windows: narrow rows meet by word, and only texts with a candidate are read again.
    found = each.where("word is not null").drop("words", "doc_id").join(sides, fits).select(*ROW, "n_words", "pos", "off", "n", "win").distinct()
    checked = tokens.drop("n_words").join(found, ROW).where(same).select(*columns)
    none = F.lit(None)
    return checked.unionByName(tokens.select(*ROW, "doc_id", "n_words", none.cast("int").alias("start"), none.cast("int").alias("n"), none.cast("string").alias("win")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated for each row of docs (doc_id, text) against benchmark (item_id, text).

    Words are WORD after lower-casing A-Z; null and empty texts have none. A word is hit inside any occurrence of a
    window; a document is contaminated if it has hits and share * n_hit >= n_words. Items without words match nothing;
    with an empty benchmark nothing is contaminated. item_ids holds the items with occurring windows, sorted as strings.
    Repeated items count once by item_id; an item without id makes words hit but is not among the items that are counted and
    named. Repeated rows of docs each give a row. Words may be of any length (all beyond ASCII is one), so what is
    broadcast is bounded by windows, of which a usual one is some 100 bytes.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    wins = table(windows(benchmark, size), "windows")
    prefix = table(prefixes(docs, wins, broadcast_windows), "prefixes")
    found = table(occurrences(docs, prefix, broadcast_windows), "occurrences")
    hits = found.where("win is not null")
    end = F.col("start") + F.col("n")
    before = F.max(end).over(Window.partitionBy(*ROW).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select(*ROW, "start", "n").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    covered = spans.groupBy(*ROW).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "before"))).alias("n_hit"))
    items = hits.select(*ROW, "win").distinct().join(small(wins.select("win", "item_id"), broadcast_windows), "win").select(*ROW, "item_id").distinct()
    listed = items.groupBy(*ROW).agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    out = found.where("win is null").select(*ROW, "doc_id", "n_words").join(covered.join(listed, ROW, "left"), ROW, "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
