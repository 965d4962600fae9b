"""Parsing transcript text into chunk tables, writing them back, and overlaying edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.text import blank_errors, fmt_header, strip
from scriptorium.sources.scratch import written

MARK = "=== Chunk"
TIMED = r"^=== Chunk [0-9]+ \[([0-9]+\.?[0-9]*)s - ([0-9]+\.?[0-9]*)s\]"
#: What str.splitlines() of other languages breaks at, after CRLF has become LF.
LINES = "\n|\x0b|\x0c|\x1c|\x1d|\x1e|\x85| | "


def unified(content: Column) -> Column:
    return F.regexp_replace(content, "\r\n?", "\n")


def clean_residue(text: Column) -> Column:
    """Without left-over header fragments such as `41s] ===` and leading == or ===."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"^[0-9.]+s\]\s*===\s*", ""), "^={2,3}\\s*", ""))


#: Places of one document that may meet in a task when they are counted or numbered.
SPAN = 100_000


def running(rows: DataFrame, key: str, at: str, hit: Column, long: Column, name: str = "count", span: int = SPAN) -> DataFrame:
    """rows with `name`: how many hits a key has up to this row in order of at, a whole number from 0 on.

    Two levels: each span of places of a key is counted by itself, the counts of a key's spans are added up (one row each), and
    a span's rows go on from there. So no task holds more than a span's places of one key. Only keys that are long (a
    column of rows, true wherever a key may have places beyond a span) take part in the first two steps.
    """
    start = F.coalesce(F.floor(F.col(at) / span), F.lit(-(1 << 62)))  # places that are null come first
    rows = rows.withColumns({"own hit": F.when(hit, 1).otherwise(0), "own span": start, "own carried": F.lit(False)})
    counts = rows.where(long).groupBy(key, "own span").agg(F.sum("own hit").alias("own hit"))
    before = F.sum("own hit").over(Window.partitionBy(key).orderBy("own span").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.select(key, "own span", F.coalesce(before, F.lit(0)).alias("own hit"), F.lit(True).alias("own carried"))
    order = Window.partitionBy(key, "own span").orderBy(F.col("own carried").desc(), at)
    every = rows.unionByName(carried, allowMissingColumns=True).withColumn(name, F.sum("own hit").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return every.where(~F.col("own carried")).drop("own hit", "own span", "own carried")


def parse_chunks(files: DataFrame, span: int = SPAN) -> DataFrame:
    """(document_name, pos, chunk_id, text, start_time, end_time) of files (document_name, content).

    Blocks without a header line and a body are dropped; chunk_id is the header's number less one, pos counts what is left.
    """
    blocks = files.select("document_name", (F.length("content") > span).alias("long"), F.posexplode(F.slice(F.split(unified(F.col("content")), MARK), 2, 1 << 30)).alias("block", "raw"))
    kept = parsed_blocks(blocks, "document_name", "block", "long")
    return running(kept, "document_name", "block", F.lit(True), F.col("long"), "pos", span).select("document_name", (F.col("pos") - 1).cast("int").alias("pos"), *PARSED)


PARSED = ("chunk_id", "text", "start_time", "end_time")


def parsed_blocks(blocks: DataFrame, *carry: str) -> DataFrame:
    """(carry.., chunk_id, text, start_time, end_time) of blocks (raw: what stands after a mark) that have a numbered header line and a body."""
    stripped = blocks.select(*carry, strip(F.col("raw")).alias("own block"))
    cut = F.locate("\n", F.col("own block"))
    ruled = stripped.select(*carry, "own block", F.when(cut > 0, F.substr("own block", cut + 1)).otherwise("").alias("own rest"))
    edges = F.concat(F.substring("own rest", 1, 1), F.substring("own rest", -1, 1))
    body = F.when(edges.rlike(r"(?U)[\s\x1c-\x1f]"), strip(F.col("own rest"))).otherwise(F.col("own rest"))
    # A generator, so that what is filtered by header and body does not make both a second time.
    parts = ruled.select(*carry, F.inline(F.array(F.struct(F.substring_index("own block", "\n", 1).alias("header"), body.alias("body")))))
    number = F.regexp_extract("header", r"([0-9]+)", 1).try_cast("int")
    time = lambda i: F.nullif(F.regexp_extract("header", r"\[([0-9.]+)s - ([0-9.]+)s\]", i), F.lit("")).try_cast("double")
    kept = parts.where((F.col("body") != "") & number.isNotNull())
    text = F.when(F.substring("body", 1, 1).rlike("[0-9.=]"), clean_residue(F.col("body"))).otherwise(F.col("body"))  # nothing else is left over
    return kept.select(*carry, (number - 1).alias("chunk_id"), text.alias("text"), time(1).alias("start_time"), time(2).alias("end_time"))


def _line_blocks(files: DataFrame, is_header: Column, span: int) -> DataFrame:
    """Lines of files with the running number of their block; 0 is what stands before the first header."""
    lines = files.select("document_name", (F.length("content") > span).alias("long"), F.posexplode(F.split(unified(F.col("content")), LINES)).alias("line_no", "line"))
    return running(lines, "document_name", "line_no", is_header, F.col("long"), "block", span)


def parse_timed(files: DataFrame, joiner: str = " ", blank: bool = True, span: int = SPAN) -> DataFrame:
    """(document_name, pos, start_time, end_time, text): only timed headers open a block; other header lines are text.

    Body lines are stripped and blank ones dropped; texts that look like errors become empty if `blank`. Headers are counted
    in spans of lines, so that no task holds all lines of a long document.
    """
    timed = F.col("line").rlike(TIMED)
    lines = _line_blocks(files, timed, span).where("block > 0")
    line = F.when(~timed & (strip(F.col("line")) != ""), F.struct("line_no", strip(F.col("line")).alias("line")))
    time = lambda i: F.max(F.when(timed, F.regexp_extract("line", TIMED, i).try_cast("double")))
    blocks = lines.groupBy("document_name", "block").agg(F.sort_array(F.collect_list(line)).alias("ls"), time(1).alias("start_time"), time(2).alias("end_time"))
    text = F.array_join("ls.line", joiner)
    return blocks.select("document_name", (F.col("block") - 1).cast("int").alias("pos"), "start_time", "end_time", (blank_errors(text) if blank else text).alias("text"))


def parse_quiz(files: DataFrame, longer_than: int = 80, span: int = SPAN) -> DataFrame:
    """(document_name, idx, text): blocks under any chunk header, also what stands before the first, longer than so many characters."""
    header = F.col("line").rlike("^=== Chunk [0-9]+")
    line = F.when(~header & (strip(F.col("line")) != ""), F.struct("line_no", strip(F.col("line")).alias("line")))
    texts = _line_blocks(files, header, span).groupBy("document_name", "block").agg(F.array_join(F.sort_array(F.collect_list(line))["line"], " ").alias("text"), F.first("long").alias("long"))
    kept = texts.where(F.length("text") > longer_than)
    return running(kept, "document_name", "block", F.lit(True), F.col("long"), "idx", span).select("document_name", (F.col("idx") - 1).cast("int").alias("idx"), "text")


def first_chunks(files: DataFrame, chunks: int = 10, documents: int | None = None) -> DataFrame:
    """parse_quiz of the first `documents` files by name (all without a number): the first `chunks` kept blocks of each."""
    picked = files if documents is None else files.orderBy("document_name").limit(documents)
    return parse_quiz(picked).where(F.col("idx") < chunks)


def numbers(chunks: DataFrame, name: str, span: int = SPAN) -> DataFrame:
    """chunks with `name`: 1, 2, .. within a document in order of pos, counted in spans of pos."""
    return running(chunks, "document_name", "pos", F.lit(True), F.lit(True), name, span)


def renumber(chunks: DataFrame) -> DataFrame:
    """chunks with number: 1, 2, .. within a document in order of pos."""
    return numbers(chunks, "number").withColumn("number", F.col("number").cast("int"))


def parse_numbered(files: DataFrame) -> DataFrame:
    """(document_name, number, text): the number is the header's first word, the text is the rest of the block."""
    blocks = files.select("document_name", F.explode(F.slice(F.split(unified(F.col("content")), MARK), 2, 1 << 30)).alias("raw"))
    body = strip(F.col("raw"))
    number = F.regexp_extract(body, r"^(\S+)", 1).try_cast("int")
    return blocks.select("document_name", number.alias("number"), strip(F.regexp_extract(body, r"(?s)^[^\n]*\n(.*)$", 1)).alias("text")).where("number is not null")


def serialize(chunks: DataFrame, renumber: bool = True) -> DataFrame:
    """(document_name, content): blocks in order of pos, numbered from 1, or by chunk_id + 1."""
    chunks = numbers(chunks, "number") if renumber else chunks.withColumn("number", F.col("chunk_id") + 1)
    block = F.concat(fmt_header(F.col("number"), F.col("start_time"), F.col("end_time")), F.lit("\n"), "text", F.lit("\n"))
    blocks = chunks.select("document_name", "pos", block.alias("block"))
    return blocks.groupBy("document_name").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "block")))["block"], "\n").alias("content"))


def remove_block(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Transcripts without the removed (document_name, chunk_id); the others keep their numbers."""
    return serialize(chunks.join(removed, ["document_name", "chunk_id"], "left_anti"), renumber=False)


EDIT = r"(?s)^([^=]+) ===\s*\n(?:User: ([^\n]*)\n)?Document: ([^\n]+)\nChunk ID: ([0-9]+)\n(?:Old Text:\n(.*?)\n)?New Text:\n(.*?)\n==="


def parse_edits(logs: DataFrame) -> DataFrame:
    """(seq, user, document_name, chunk_id, old_text, new_text, ts) of edit logs (log_name, content), seq within a log."""
    records = logs.select("log_name", F.posexplode(F.split(unified(F.col("content")), "=== EDIT ")).alias("seq", "record"))
    group = lambda i: F.regexp_extract("record", EDIT, i)
    fields = records.where(F.col("record").rlike(EDIT))
    return fields.select("log_name", "seq", F.nullif(group(2), F.lit("")).alias("user"), group(3).alias("document_name"), group(4).cast("int").alias("chunk_id"), F.nullif(group(5), F.lit("")).alias("old_text"), group(6).alias("new_text"), F.try_to_timestamp(strip(group(1))).alias("ts"))


def latest_edits(edits: DataFrame) -> DataFrame:
    """(document_name, chunk_id, new_text): the latest edit of each chunk, the first of equally late ones, unreadable times last."""
    order = F.struct(F.col("ts").isNotNull().alias("ok"), "ts", (-F.col("seq")).alias("seq"))
    return edits.groupBy("document_name", "chunk_id").agg(F.max_by("new_text", order).alias("new_text"))


def apply_edits(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """Chunks with the text of the latest edit, which names a position; edits of other positions are ignored."""
    latest = latest_edits(edits).withColumnRenamed("chunk_id", "pos")
    return chunks.join(latest, ["document_name", "pos"], "left").withColumn("text", F.coalesce("new_text", "text")).select(*chunks.columns)


def merge_edit_logs(log: DataFrame, *more: DataFrame) -> DataFrame:
    """All edits of logs in the columns of the first; a column that another log lacks is null there."""
    for other in more:
        log = log.unionByName(other.select(*(c for c in log.columns if c in other.columns)), allowMissingColumns=True)
    return log


def split_rows(rows: DataFrame, *columns: str, span: int = SPAN) -> DataFrame:
    """(document_name, text, index): each row's columns as JSON, numbered from 0 within its document in order of pos, counted in spans of pos."""
    made = numbers(rows.select("document_name", "pos", F.to_json(F.struct(*columns)).alias("text")), "number", span)
    return made.select("document_name", "text", (F.col("number") - 1).cast("int").alias("index"))


def effective_source(files: DataFrame, order: tuple[str, ...] = ("edit", "combined")) -> DataFrame:
    """(title, kind, content): of each title (title, kind, content) the kind that stands first in order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    best = files.where(rank > 0).groupBy("title").agg(F.min_by(F.struct("kind", "content"), rank).alias("b"))
    return best.select("title", "b.kind", "b.content")


def update_chunks(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert of text and embedding on (document_name, chunk_id); a null in an update keeps what was there."""
    key = ["document_name", "chunk_id"]
    new = updates.select(*key, F.col("text").alias("new_text"), F.col("embedding").alias("new_embedding"))
    out = chunks.join(new, key, "full_outer")
    return out.withColumns({"text": F.coalesce("new_text", "text"), "embedding": F.coalesce("new_embedding", "embedding")}).select(*chunks.columns)


def reload_documents(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """All chunks of the documents in fresh give way to those in fresh."""
    return chunks.join(fresh.select("document_name").distinct(), "document_name", "left_anti").unionByName(fresh)


def align(first: DataFrame, second: DataFrame) -> DataFrame:
    """(title, pos, start_time, end_time, text, second): recognitions that share their times; the last of repeated ones counts."""
    key = ["title", "start_time", "end_time"]
    other = second.groupBy(*key).agg(F.max_by("text", "pos").alias("second"))
    return first.join(other, key, "left").withColumn("second", F.coalesce("second", F.lit(""))).select("title", "pos", "start_time", "end_time", "text", "second")


def retime(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Texts (title, pos, text) with the times of segments (title, seg_no, start_time, end_time) at the same place, as far as both go."""
    return texts.join(segments.withColumnRenamed("seg_no", "pos"), ["title", "pos"]).select("title", (F.col("pos") + 1).alias("number"), "start_time", "end_time", "text")


def next_starts(sums: np.ndarray, most: int, rows: int) -> np.ndarray:
    """For a pack that starts at each row of a block, the row where the next pack starts; the block's length if it ends open."""
    at = np.arange(len(sums) - 1)
    fits = np.searchsorted(sums, sums[:-1] + most, "right") - 1
    return np.minimum(np.maximum(np.minimum(fits, at + rows), at + 1), len(at))


def block_exits(tokens: np.ndarray, most: int, rows: int) -> tuple[np.ndarray, list[int], list[int]]:
    """(sums, last, packs): for each row at which a pack from before the block may end, the last start after it and how many starts."""
    sums = np.r_[0, np.cumsum(tokens)]
    n = len(tokens)
    after, last, packs = next_starts(sums, most, rows).tolist(), list(range(n)), [1] * n
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i], packs[i] = last[after[i]], packs[after[i]] + 1
    entries = min(int(np.searchsorted(sums, most, "right")), rows + 1, n)
    return sums, last[:entries], packs[:entries]


def runs_of(values: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    codes = values.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.r_[np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]), len(codes)] if len(codes) else np.zeros(1, np.int64)


def numbered(block: pa.Table, begun: dict, most: int, rows: int) -> pa.Table:
    """(document_name, pos, pack) of a block in order. begun: document that goes on from before -> (row of its first start here, number of the pack that is open)."""
    edges, weight = runs_of(block["document_name"]), block["weight"].to_numpy()
    sums, at = np.r_[0, np.cumsum(weight)], np.arange(len(weight))
    ends = np.repeat(edges[1:], np.diff(edges))
    after = np.minimum(np.maximum(np.minimum(np.searchsorted(sums, sums[:-1] + most, "right") - 1, at + rows), at + 1), ends).tolist()
    starts, base = np.zeros(len(weight), np.int64), np.full(len(edges) - 1, -1)
    for i, (first, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        row = first
        if begun and i in (0, len(edges) - 2):  # no other document crosses the block's border
            skipped, base[i] = begun.get(block["document_name"][first].as_py(), (0, -1))
            row += skipped
        while row < end:
            starts[row], row = 1, after[row]
    count = np.cumsum(starts)
    before = (count - starts)[edges[:-1]] if len(weight) else count
    pack = count - np.repeat(before - base, np.diff(edges))
    return pa.table([block["document_name"], block["pos"], pa.array(pack.astype(np.int32))], ["document_name", "pos", "pack"])


def pack(chunks: DataFrame, most: int, rows: int | None = None, block_rows: int = 200_000) -> DataFrame:
    """chunks (document_name, pos, tokens, ..) with pack: consecutive chunks together as long as they stay within the limits.

    A chunk that is too large, or whose tokens are null, stands alone. Tokens are not negative, pos tells the chunks of a
    document apart, and a null document_name is a document of its own. Narrow rows are dealt in order to blocks of about
    block_rows, whatever documents they hold, and each block numbers the packs of its documents at once. Where there are
    several blocks, only their first and last documents can cross a border: for these, each block tells where packing would
    leave it for each row at which a pack from before may end (no more than one pack's rows), and one step for each
    block of such a document then gives the block's first start. So no task holds more than a block's rows, or one row for
    each block of a document with the entries of that block.
    """
    limit = 1 << 60 if rows is None else rows
    weight = F.coalesce(F.col("tokens").cast("long"), F.lit(most + 1).cast("long"))
    narrow = chunks.select("document_name", "pos", weight.alias("weight"))
    n = max(1, -(-narrow.count() // block_rows))
    name, pos = (f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("document_name", "pos"))
    out = f"{name}, {pos}, pack int"
    if n == 1:
        packed = narrow.repartition(1).sortWithinPartitions("document_name", "pos").mapInArrow(lambda batches: _one_block(batches, most, limit), out)
    else:
        packed = _over_blocks(narrow, n, most, limit, name).applyInArrow(lambda block, begun: numbered(block.sort_by("row"), _begun(begun), most, limit), out)
    packed = packed.withColumnsRenamed({"document_name": "of", "pos": "at"})
    return chunks.join(packed, F.col("document_name").eqNullSafe(F.col("of")) & F.col("pos").eqNullSafe(F.col("at"))).drop("of", "at")


def _one_block(batches: Iterator[pa.RecordBatch], most: int, rows: int) -> Iterator[pa.RecordBatch]:
    if held := [b for b in batches if b.num_rows]:
        yield from numbered(pa.Table.from_batches(held), {}, most, rows).to_batches(max_chunksize=10_000)


def _begun(rows: pa.Table) -> dict:
    return {n: (f, b) for n, f, b in zip(*(rows[c].to_pylist() for c in ("document_name", "first", "base")), strict=True)}


def _over_blocks(narrow: DataFrame, n: int, most: int, limit: int, name: str):
    """Blocks (document_name, pos, weight, row) cogrouped with the starts of documents that cross their borders."""
    ordered = narrow.repartitionByRange(n, "document_name", "pos").sortWithinPartitions("document_name", "pos")
    dealt = written(ordered.withColumns({"block": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "blocks")

    def exits(block: pa.Table) -> pa.Table:
        """A row for the first and the last document of a block."""
        block = block.sort_by("row")
        edges, out = runs_of(block["document_name"]), []
        for i in sorted({0, len(edges) - 2}):
            part = block.slice(edges[i], edges[i + 1] - edges[i])
            sums, last, packs = block_exits(part["weight"].to_numpy(), most, limit)
            size = len(part)
            listed = [pa.array([x], pa.list_(pa.int64())) for x in (sums[: len(last)], sums[size] - sums[last], size - np.array(last), packs)]
            out.append(pa.table([part["document_name"].slice(0, 1), part["block"].slice(0, 1), pa.array([int(sums[size])]), pa.array([size]), *listed], ["document_name", "block", "total", "size", "before", "open_sum", "open_rows", "packs"]))
        return pa.concat_tables(out)

    def walk(blocks: pa.Table) -> pa.Table:
        total = held = 0
        no, first, base = -1, [], []
        blocks = blocks.sort_by("block")
        for i in range(len(blocks)):
            size, before = blocks["size"][i].as_py(), blocks["before"][i].values.to_numpy()
            start = 0 if no < 0 else min(max(int(np.searchsorted(before, most - total, "right")) - 1, 0), limit - held)
            # The last entry of a block stands for its end as well, where the open pack takes in all of the block.
            if no >= 0 and total + blocks["total"][i].as_py() <= most and held + size <= limit:
                start, total, held = size, total + blocks["total"][i].as_py(), held + size
            first.append(start)
            base.append(no)
            if start < size:
                total, held = blocks["open_sum"][i].values[start].as_py(), blocks["open_rows"][i].values[start].as_py()
                no += blocks["packs"][i].values[start].as_py()
        return pa.table([blocks["document_name"], blocks["block"], pa.array(first, pa.int64()), pa.array(base, pa.int64())], ["document_name", "block", "first", "base"])

    lists = ", ".join(f"{c} array<long>" for c in ("before", "open_sum", "open_rows", "packs"))
    told = written(dealt.groupBy("block").applyInArrow(exits, f"{name}, block int, total long, size long, {lists}"), "exits")
    begun = told.groupBy("document_name").applyInArrow(walk, f"{name}, block int, first long, base long")
    return dealt.groupBy("block").cogroup(begun.groupBy("block"))


def join_packs(packed: DataFrame, separator: str = "\n\n", prefix: str = "id ") -> DataFrame:
    """(document_name, pack, text, members, tokens): the first piece bare, later ones after `id {i}: `, i counting within the pack.

    members are the positions of a pack's pieces in order, tokens their sum (of a column tokens, if there is one).
    """
    tokens = F.sum("tokens") if "tokens" in packed.columns else F.lit(None).cast("long")
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    joined = F.array_join(F.transform("parts", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.concat(F.lit(prefix), i.cast("string"), F.lit(": "), x["text"]))), separator)
    return packed.groupBy("document_name", "pack").agg(parts.alias("parts"), tokens.alias("tokens")).select("document_name", "pack", strip(joined).alias("text"), F.col("parts.pos").alias("members"), "tokens")


def join_groups(groups: DataFrame, separator: str = "\n---\n") -> DataFrame:
    """(document_name, grp, text, packs, members, tokens) of groups (document_name, grp, pos: the pack, text, members, tokens): packs in order."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "text", "members")))
    held = groups.groupBy("document_name", "grp").agg(parts.alias("parts"), F.sum("tokens").alias("tokens"))
    return held.select("document_name", "grp", F.array_join("parts.text", separator).alias("text"), F.col("parts.pos").alias("packs"), F.flatten("parts.members").alias("members"), "tokens")


def fixed_windows(audio: DataFrame, seconds: int = 30) -> DataFrame:
    """(audio_id, seg_no, start_time, end_time) over durations (audio_id, duration); the last window is shorter."""
    n = F.ceil(F.col("duration") / seconds).cast("int")
    windows = audio.where("duration > 0").select("audio_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("seg_no"))
    return windows.select("audio_id", "seg_no", (F.col("seg_no") * float(seconds)).alias("start_time"), F.least((F.col("seg_no") + 1) * float(seconds), F.col("duration").cast("double")).alias("end_time"))
