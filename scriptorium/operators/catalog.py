"""The video catalog, file matching, and the tables of the processing pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.text import HIGHLIGHT, norm_title_a, norm_title_b, norm_url, should_update_status
from scriptorium.operators.contain import contained_pairs


#: Rows that a task sorts of two tables that are joined.
TASK_ROWS = 500_000


def first_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def join_url(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, url): of the catalog's rows whose title is the file's name or its beginning, the first; blank titles fit nothing."""
    names = files.select("name")
    titles = catalog.where(F.coalesce(F.col("title"), F.lit("")) != "").groupBy("title").agg(F.min_by(F.struct("row_no", "url"), "row_no").alias("c"))
    # A title that a name begins with is one of the name's prefixes: an equi-join for catalogs of any size.
    prefixes = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.col("name"), F.lit(1), i))).alias("title"))
    hits = prefixes.join(titles, "title").groupBy("name").agg(F.min_by("c.url", "c.row_no").alias("url"))
    return names.join(hits, "name", "left")


def join_listing(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """files with url and upload_date of the last catalog row of their title; blanks where there is none."""
    last = catalog.groupBy("title").agg(F.max_by(F.struct("url", "upload_date"), "row_no").alias("c"))
    out = files.join(last, "title", "left")
    return out.select(*files.columns, *(F.coalesce(F.col(f"c.{x}"), F.lit("")).alias(x) for x in ("url", "upload_date")))


def match_four_level(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, url, level): exact title, normalised title, exact without a bracketed tag, normalised without it; first row within a level."""
    base = lambda c: F.regexp_replace(c, r"\s*\[[^\]]*\]\s*$", "")
    forms = [lambda c: c, norm_title_b, base, lambda c: norm_title_b(base(c))]
    found = None
    for level, form in enumerate(forms):
        best = catalog.groupBy(form(F.col("title")).alias("k")).agg(F.min("row_no").alias("row_no"), F.min_by("url", "row_no").alias("url"))
        part = files.select("name", form(F.col("name")).alias("k")).join(best, "k").select("name", "url", F.lit(level).alias("level"), "row_no")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("name").agg(F.min_by(F.struct("url", "level"), F.struct("level", "row_no")).alias("b"))
    return files.select("name").join(best, "name", "left").select("name", "b.url", "b.level")


def match_contains(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, url): exact title (the last such row), else the first row whose title holds the name or is held by it."""
    exact = files.select("name").join(catalog.groupBy(F.col("title").alias("name")).agg(F.max_by("url", "row_no").alias("url")), "name")
    rest = files.select("name").join(exact, "name", "left_anti")
    rows = catalog.select("title", "url", "row_no")
    both = contained_pairs(rest, rows, "name", "title").unionByName(contained_pairs(rows, rest, "title", "name"))
    best = both.groupBy("name").agg(F.min_by("url", "row_no").alias("url"))
    return exact.unionByName(rest.join(best, "name", "left").select("name", "url"))


def match_audio(titles: DataFrame, audio: DataFrame) -> DataFrame:
    """(name, file): the audio file (file) of a title by equal base name, else the first by name that holds the title or is held by it."""
    rows = audio.select(F.regexp_replace("file", r"\.wav$", "").alias("title"), F.col("file").alias("url"), F.col("file").alias("row_no"))
    return match_contains(titles, rows).withColumnRenamed("url", "file")


def match_ratio(catalog: DataFrame, files: DataFrame, least: float = 0.8) -> DataFrame:
    """(row_no, matched): whether some file has the title, its normal form, or one inside the other with a length ratio above `least`."""
    tidy = lambda c: F.regexp_replace(norm_title_a(c), r"\s*\[[^\]]*\]", "")
    titles = catalog.select("row_no", norm_title_a(F.col("title")).alias("t"), tidy(F.col("title")).alias("tt"))
    names = files.select(norm_title_a(F.col("name")).alias("f"), tidy(F.col("name")).alias("ff")).distinct()
    equal = titles.join(names, F.col("t") == F.col("f"), "left_semi").select("row_no")
    rest = titles.join(equal, "row_no", "left_anti").select("row_no", "tt")
    pairs = contained_pairs(rest, names.select("ff"), "tt", "ff", least).unionByName(contained_pairs(names.select("ff"), rest, "ff", "tt", least))
    hits = equal.unionByName(pairs.select("row_no")).distinct().withColumn("hit", F.lit(True))
    return catalog.select("row_no").join(hits, "row_no", "left").select("row_no", F.coalesce("hit", F.lit(False)).alias("matched"))


def catalog_status(catalog: DataFrame, transcripts: DataFrame, audio: DataFrame) -> DataFrame:
    """The catalog with has_transcript and has_audio by title; a transcript makes its row completed."""
    flag = lambda df, name: df.select(F.col("name").alias("title")).distinct().withColumn(name, F.lit(True))
    out = catalog.join(flag(transcripts, "t"), "title", "left").join(flag(audio, "a"), "title", "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    status = F.when(has(F.col("t")), "completed").otherwise(F.col("status"))
    return out.select(*(c for c in catalog.columns if c != "status"), status.alias("status"), has(F.col("t")).alias("has_transcript"), has(F.col("a")).alias("has_audio"))


def catalog_counts(marked: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return marked.agg(F.count(F.lit(1)).alias("total"), n("completed"), n("pending"), n("failed"), n("skipped"), F.count_if("has_transcript").alias("with_transcript"), F.count_if("has_audio").alias("with_audio"))


def reconcile(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """The catalog with status raised to completed where a file matches, as the status rule allows."""
    matched = match_ratio(catalog, files)
    out = catalog.join(matched, "row_no")
    new = F.when(F.col("matched"), "completed").otherwise("pending")
    return out.withColumn("status", F.when(F.col("matched") & should_update_status(F.col("status"), new), new).otherwise(F.col("status"))).select(*catalog.columns)


def new_videos(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    known = catalog.select(norm_url(F.col("url")).alias("k")).distinct()
    return listing.withColumn("k", norm_url(F.col("url"))).join(known, "k", "left_anti").drop("k")


def union_listings(*listings: DataFrame) -> DataFrame:
    """Rows (id, title, ..) of listings in order, the first of each id, without null ids and without highlights."""
    every = None
    for i, listing in enumerate(listings):
        part = listing.withColumn("src", F.lit(i))
        every = part if every is None else every.unionByName(part)
    columns = [c for c in every.columns if c != "id"]
    best = every.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("src", "pos")).alias("b"))
    return best.select("id", "b.*").where(~F.col("title").contains(HIGHLIGHT))


def upsert_videos(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """(url, title, status, upload_date) by normal url: fresh values win where they are not null."""
    key = norm_url(F.col("url")).alias("k")
    last = fresh.groupBy(key).agg(F.max_by(F.struct("title", "status", "upload_date"), "row_no").alias("n"))
    now = catalog.groupBy(key).agg(F.min_by(F.struct("title", "status", "upload_date"), "row_no").alias("o"))
    out = now.join(last, "k", "full_outer")
    return out.select(F.col("k").alias("url"), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("title", "status", "upload_date")))


def set_status(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    new = changes.select(key, F.col("status").alias("_new"))
    return table.join(new, key, "left").withColumn("status", F.coalesce("_new", "status")).select(*table.columns)


def pending_work(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    return inputs.join(outputs.select(*keys).distinct(), keys, "left_anti")


def best_source(variants: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(title, kind): of each title's variants (title, kind) the first in order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    return variants.where(rank > 0).groupBy("title").agg(F.min_by("kind", rank).alias("kind"))


def match_summary(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("url").isNotNull()).alias("matched"), F.count_if(F.col("url").isNull()).alias("unmatched"))


def files_with_downloads(files: DataFrame, downloads: DataFrame) -> DataFrame:
    joined = files.join(downloads.select(F.col("id").alias("download_id"), F.col("file_id"), "url"), F.col("id") == F.col("file_id"), "left").drop("file_id")
    return joined


def jobs_with_files(jobs: DataFrame, files: DataFrame, status: str | None = None) -> DataFrame:
    picked = jobs if status is None else jobs.where(F.col("status") == status)
    return picked.join(files.select(F.col("id").alias("file_id"), "filename"), "file_id")


def pipeline_stats(files: DataFrame, downloads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Seven totals in one row; one scan of each table."""
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    f = files.agg(F.count(F.lit(1)).alias("files"), n("completed", "files_completed"), n("pending", "files_pending"))
    d = downloads.agg(F.count(F.lit(1)).alias("downloads"), n("completed", "downloads_completed"))
    j = jobs.agg(F.count(F.lit(1)).alias("jobs"), n("failed", "jobs_failed"))
    return f.crossJoin(d).crossJoin(j)  # one row each


def cleanup_interrupted(jobs: DataFrame, note: str = "Interrupted by restart") -> DataFrame:
    """Jobs with those under way (processing, or pending with a start) failed and noted; changed marks them."""
    hit = (F.col("status") == "processing") | ((F.col("status") == "pending") & F.col("started_at").isNotNull())
    return jobs.withColumns({"changed": F.coalesce(hit, F.lit(False)), "status": F.when(hit, "failed").otherwise(F.col("status")), "error_message": F.when(hit, note).otherwise(F.col("error_message"))})


def reset_interrupted(files: DataFrame, downloads: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after a restart: files under way and downloads under way wait again, jobs under way have failed; error_message says so."""

    def waiting(table: DataFrame, status: str, note: str) -> DataFrame:
        hit = F.coalesce(F.col("status") == status, F.lit(False))
        return table.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "error_message": F.when(hit, note).otherwise(F.col("error_message"))})

    return waiting(files, "processing", "Interrupted while processing"), waiting(downloads, "downloading", "Interrupted while downloading"), cleanup_interrupted(jobs).drop("changed")


def interrupted_counts(files: DataFrame, downloads: DataFrame, jobs: DataFrame) -> DataFrame:
    """(label, n): rows that carry the note of an interruption, now or from before."""
    out = None
    for label, table, status in (("files", files, "pending"), ("downloads", downloads, "pending"), ("jobs", jobs, "failed")):
        noted = F.count_if((F.col("status") == status) & F.lower("error_message").contains("interrupted"))
        part = table.agg(noted.alias("n")).select(F.lit(label).alias("label"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def delete_files(files: DataFrame, downloads: DataFrame, jobs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files gone (id): their jobs go, their downloads lose the link."""
    ids = gone.select(F.col("id").alias("file_id"))
    links, linked = dealt_alike(downloads, ids, "file_id")
    marked = linked.distinct().withColumn("_gone", F.lit(True))
    kept = links.join(marked, "file_id", "left").withColumn("file_id", F.when(F.col("_gone"), None).otherwise(F.col("file_id"))).select(*downloads.columns)
    return without(files, gone.select("id"), "id"), kept, without(jobs, ids, "file_id")


def dealt_alike(left: DataFrame, right: DataFrame, key: str, rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by the key to as many partitions as hold about so many rows each; as they are, if one would do.

    Keys that compress well make partitions that are small in bytes and long in rows: joined after a size in bytes, as is
    done where no number is given, a task would sort tens of millions of them.
    """
    n = -(-(left.count() + right.count()) // rows)
    return (left.repartition(n, key), right.repartition(n, key)) if n > 1 else (left, right)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """table without the rows whose key is among those gone (key)."""
    rows, keys = dealt_alike(table, gone, key)
    return rows.join(keys.distinct(), key, "left_anti").select(*table.columns)


def search(videos: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    """Videos whose title holds the text in any case, of one status if it is given."""
    hit = F.lower("title").contains(text.lower())
    return videos.where(hit if status is None else hit & (F.col("status") == status))


def listing_order() -> list[Column]:
    """Latest upload date first, the title in its place where there is none; of equal ones the catalog's order."""
    return [F.coalesce(F.nullif("upload_date", F.lit("")), "title").desc(), F.col("row_no")]


def append_history(history: DataFrame, fresh: DataFrame, most: int = 65_535) -> DataFrame:
    """History with fresh edits: empty old texts become null, texts are cut to what a history column holds."""
    cut = lambda c: F.substring(c, 1, most)
    rows = fresh.withColumns({"old_text": cut(F.nullif("old_text", F.lit(""))), "new_text": cut("new_text")})
    return history.unionByName(rows.select(*history.columns))


def newest(table: DataFrame, time: str, n: int, key: str | None = None, tie: str = "id", cap: int = 500) -> DataFrame:
    """The newest n rows (at most cap), or the newest n of each key."""
    n = min(n, cap)
    order = [F.col(time).desc(), F.col(tie).desc()]
    if key is None:
        return table.orderBy(*order).limit(n)
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)
