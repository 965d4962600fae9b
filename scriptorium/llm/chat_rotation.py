"""Multi-party perspective rotation of dialogues, with DataFrame operations only.

Each participant in turn is the assistant; the others are users who are named in front of what they say. The result has
one row for each segment (a turn as one participant sees it) with its place in the rendered dialogue, so a dialogue of any
length is spread over rows and tasks. Places are told from sizes: sums over blocks of turns, which are narrow rows, say
where each block begins for each participant; the texts are dealt once, by block, meet those rows, and are placed by running
sums within their block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SYSTEM = ("system",)
NAMELESS = "unknown"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
BLOCK = 256


def rotate(conversations: DataFrame, system_roles: tuple[str, ...] = SYSTEM, block: int = BLOCK) -> DataFrame:
    """conv_id, speaker, turn, seq, role, name, segment, char_start, char_end, train_start, train_end.

    For each conversation and each participant (a distinct role outside system_roles) the turns in order of (turn, name,
    text), nulls first: seq counts them from 0. role is assistant for the speaker's own turns, system for system roles,
    else user; a user's text begins with its name and a colon. train_start and train_end bound, in code points of the
    rendered dialogue, what is trained on: the speaker's texts and their end markers; of other segments both are char_end,
    so the span is empty. Null or empty roles are called NAMELESS, null texts count as empty, a null conv_id is a conversation. One without participants is rendered
    once, with null speaker. Repeated rows are turns of their own. The dialogue is the segments joined in order of seq.
    Places are told by blocks of turn numbers: rows of one conversation whose turns are equal, or null, are one block, and its
    narrow rows of sizes meet in one task.
    """
    name = F.coalesce(F.nullif("role", F.lit("")), F.lit(NAMELESS))
    is_system = F.col("name").isin(*system_roles)
    text = F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", name.alias("name"), text.alias("text"))
    # Keys without nulls, so that joins and windows over them share one deal of the rows.
    keys = [F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(1 << 62))).alias("block")]
    turns = turns.select("*", *keys)
    chars = F.length("text").cast("long")
    size = chars + F.when(is_system, len(framed("system"))).otherwise(len(framed("user")) + F.length("name") + 2)  # as others see the turn
    less = F.when(is_system, F.lit(0)).otherwise(len(framed("user")) + F.length("name") + 2 - len(framed("assistant")))  # as its speaker does

    sums = turns.groupBy("conv", "block", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.sum(less).alias("less"))
    by_block = sums.groupBy("conv", "block").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    speakers = sums.where(~is_system).select("conv", F.col("name").alias("speaker")).distinct()
    own = sums.where(~is_system).select("conv", "block", F.col("name").alias("speaker"), "less")
    grid = by_block.join(speakers, "conv", "left").join(own, ["conv", "block", "speaker"], "left")
    earlier = Window.partitionBy("conv", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    begins = grid.select("conv", "block", "speaker", before("n").alias("n_before"), before(F.col("size") - F.coalesce("less", F.lit(0))).alias("chars_before"))

    seen = turns.join(begins, ["conv", "block"])
    mine = F.coalesce(F.col("name") == F.col("speaker"), F.lit(False))
    inner = Window.partitionBy("conv", "block", "speaker").orderBy("turn", "name", "text").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumns({"role": F.when(is_system, "system").when(mine, "assistant").otherwise("user"), "size": size - F.when(mine, less).otherwise(0)})
    placed = seen.withColumns({"seq": F.count(F.lit(1)).over(inner) + F.col("n_before"), "char_start": F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("chars_before")})
    body = F.when(F.col("role") == "user", F.concat("name", F.lit(": "), "text")).otherwise(F.col("text"))
    end = F.col("char_start") + F.col("size")
    trained = F.when(F.col("role") == "assistant", F.col("char_start") + len(OPEN + "assistant" + CLOSE)).otherwise(end)
    segment = F.concat(F.lit(OPEN), "role", F.lit(CLOSE), body, F.lit(END))
    return placed.select("conv_id", "speaker", "turn", "seq", "role", "name", segment.alias("segment"), "char_start", end.alias("char_end"), trained.alias("train_start"), end.alias("train_end"))


def framed(role: str) -> str:
    """What stands around a text of the role."""
    return OPEN + role + CLOSE + END


def dialogues(rotated: DataFrame, most_chars: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """(conv_id, speaker, dialogue, trained) with one row for each dialogue of up to most_chars, and the segments of longer ones."""
    ends = rotated.groupBy("conv_id", "speaker").agg(F.max("char_end").alias("chars"))
    sized = rotated.join(ends.withColumnsRenamed({"conv_id": "c", "speaker": "s"}), F.col("conv_id").eqNullSafe(F.col("c")) & F.col("speaker").eqNullSafe(F.col("s"))).drop("c", "s")
    parts = F.sort_array(F.collect_list(F.struct("seq", "segment", "train_start", "train_end")))
    short = sized.where(F.col("chars") <= most_chars).groupBy("conv_id", "speaker").agg(parts.alias("p"))
    spans = F.filter(F.transform("p", lambda x: F.struct(x["train_start"].alias("start"), x["train_end"].alias("end"))), lambda x: x["start"] < x["end"])
    return short.select("conv_id", "speaker", F.array_join("p.segment", "").alias("dialogue"), spans.alias("trained")), sized.where(F.col("chars") > most_chars).drop("chars")
