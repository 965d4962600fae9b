"""Scalar functions on columns: titles, urls, formats, cleaning and model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of failed recognition, the marker word of highlight videos, the filler word and its kin.
ERROR_MARKS = ("CUDA", "Error:", "Traceback", "RuntimeError", "assert", "LAUNCH_BLOCKING", "stderr", "ImportError", "Exception")
HIGHLIGHT = "精華"
FILLER = "那個"
WATCH, SHORT = "https://www.youtube.com/watch?v=", "youtu.be/"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
STATUS_ORDER = {"pending": 0, "downloaded": 1, "completed": 2}


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_url(url: Column) -> Column:
    """The canonical watch url of short links and watch urls; other urls as they are."""
    short = strip(F.split_part(F.split_part(url, F.lit(SHORT), F.lit(2)), F.lit("?"), F.lit(1)))
    watch = strip(F.split_part(F.split_part(F.split_part(url, F.lit("watch?v="), F.lit(2)), F.lit("&"), F.lit(1)), F.lit("?"), F.lit(1)))
    return F.when(url.contains(SHORT), F.concat(F.lit(WATCH), short)).when(url.contains("watch?v="), F.concat(F.lit(WATCH), watch)).otherwise(url)


def norm_title_a(title: Column) -> Column:
    return squeeze(F.translate(F.coalesce(title, F.lit("")), "⧸\\", "//"))


def norm_title_b(title: Column) -> Column:
    return squeeze(F.translate(title, "⧸／", "//"))


def base_title(name: Column) -> Column:
    return F.regexp_replace(name, r"(_combined)?(\.txt)?$", "")


def fmt_date(day: Column) -> Column:
    return F.when(F.length(day) == 8, F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))).otherwise(day)


def fmt_size(size: Column) -> Column:
    out = F.when(size == 0, F.lit("0 B"))
    for i, unit in enumerate(SIZE_UNITS):
        fits = size < 1024 ** (i + 1) if i + 1 < len(SIZE_UNITS) else F.lit(True)
        out = out.when(fits, F.concat(F.format_string("%.1f", F.bround(size.cast("double") / float(1024**i), 1)), F.lit(f" {unit}")))
    return out


def fmt_duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("int")
    hours, minutes, rest = F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"), whole % 60
    long = F.format_string("%02d:%02d:%02d", hours, minutes, rest)
    return F.when(seconds.isNull() | (seconds < 0), "Unknown").when(hours > 0, long).otherwise(F.format_string("%02d:%02d", minutes, rest))


def fmt_header(number: Column, start: Column, end: Column) -> Column:
    """The block header with times of two decimals (half away from zero), or without times."""
    time = lambda c: c.cast("decimal(12,2)").cast("string")
    timed = F.concat(F.lit("=== Chunk "), number.cast("string"), F.lit(" ["), time(start), F.lit("s - "), time(end), F.lit("s] ==="))
    return F.when(start.isNotNull() & end.isNotNull(), timed).otherwise(F.concat(F.lit("=== Chunk "), number.cast("string"), F.lit(" ===")))


def is_error(text: Column, marks: tuple[str, ...] = ERROR_MARKS) -> Column:
    return F.coalesce(F.greatest(*(text.contains(m) for m in marks)), F.lit(False))


def blank_errors(text: Column) -> Column:
    return F.when(is_error(text), "").otherwise(text)


def cheap_clean(text: Column) -> Column:
    """Runs of four or more of one CJK or full-width character, or three or more fillers, become two; error notes go."""
    once = F.regexp_replace(text, "([一-鿿＀-￯])\\1{3,}", "$1$1")
    twice = F.regexp_replace(once, f"({FILLER}){{3,}}", FILLER * 2)
    return strip(F.regexp_replace(twice, r"(?s)\[Error in chunk [0-9]+:.*?\]", ""))


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))


def clean_json(text: Column) -> Column:
    """From the first { to the last }, code fences gone; the stripped text where there is no such pair."""
    bare = strip(F.regexp_replace(text, "```(json)?", ""))
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found == "", bare).otherwise(found)


def rel_type(kind: Column) -> Column:
    return F.replace(F.upper(kind), F.lit(" "), F.lit("_"))


def concept_text(name: Column, description: Column) -> Column:
    return F.concat(name, F.lit(": "), F.coalesce(description, F.lit("")))


def token_count(text: Column) -> Column:
    """A vocabulary-free count: each CJK character, ASCII word, and other visible character is one."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[一-鿿]|[A-Za-z0-9_]+|[^\\s一-鿿A-Za-z0-9_]"), F.lit(0)))


def csv_add(existing: Column, value: Column) -> Column:
    """A comma-joined set with one more member, blanks left out."""
    parts = F.filter(F.split(F.coalesce(existing, F.lit("")), ","), lambda x: x != "")
    more = F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(value))
    return F.array_join(F.array_distinct(F.concat(parts, more)), ",")


def fmt_edit(user: Column, document: Column, chunk_id: Column, old: Column, new: Column, at: Column) -> Column:
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    lines = [F.concat(F.lit("=== EDIT "), at, F.lit(" ===")), F.concat(F.lit("User: "), F.coalesce(F.nullif(user, F.lit("")), F.lit("anonymous"))), F.concat(F.lit("Document: "), document), F.concat(F.lit("Chunk ID: "), chunk_id.cast("string")), F.lit("Old Text:"), text(old), F.lit("New Text:"), text(new), F.lit("===\n\n")]
    return F.concat_ws("\n", *lines)


def merge_choice(first: Column, second: Column, merged: Column) -> Column:
    """Of two recognitions: the other if one is blank, else the model's merge, else the first."""
    a, b = (F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit("")) for c in (first, second))
    both = F.coalesce(F.nullif(strip_think(F.coalesce(merged, F.lit(""))), F.lit("")), a)
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), both), a, b, F.lit(""))


def clean_choice(text: Column, reply: Column) -> Column:
    plain = cheap_clean(F.coalesce(text, F.lit("")))
    return F.when(plain == "", "").otherwise(F.coalesce(F.nullif(strip_think(F.coalesce(reply, F.lit(""))), F.lit("")), plain))


def should_update_status(now: Column, new: Column) -> Column:
    """Unknown states give way, completed always comes in, else only upward."""
    order = F.create_map(*(F.lit(x) for pair in STATUS_ORDER.items() for x in pair))
    rank = lambda c: F.try_element_at(order, F.coalesce(c, F.lit("")))
    return F.when(rank(now).isNull(), True).when(now == new, False).when(new == "completed", True).otherwise(F.coalesce(rank(new) > rank(now), F.lit(False)))


def build_prompt(template: str, text: Column, most: int) -> Column:
    return F.concat(F.lit(template), F.substring(F.coalesce(text, F.lit("")), 1, most))
