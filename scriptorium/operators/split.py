"""Small vectorised helpers: the semantic splitter and the bracket scan of model replies."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import token_count

#: Where a text may be cut, best first: after a paragraph, a sentence, white space.
BREAKS = (re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?。！？])\s*|\n"), re.compile(r"\s+"))
SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？]|\n|[^.!?。！？\n]+")


def cut(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters, each the longest that ends at the best kind of break; they join to the text."""
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        for kind in BREAKS:
            ends = [m.end() for m in kind.finditer(text, start, start + size) if m.end() > start]
            if ends:
                at = ends[-1]
                break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]] if start < len(text) else out


def overlapped(pieces: list[str], overlap: int) -> list[str]:
    """Each later piece after the last two sentences of the one before, or the last alone if both are longer than the overlap."""
    out = pieces[:1]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        last = [s for s in SENTENCE.findall(before) if s.strip("\n")][-2:]
        out.append("".join(last if len("".join(last)) <= overlap else last[-1:]) + piece)
    return out


def semantic_split(rows: DataFrame, tokens: Column, text: str = "text", size: int = 4000, overlap: int = 200) -> DataFrame:
    """rows with idx and piece in place of text: tokens // size + 1 pieces of about equal length."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series, counts: pd.Series) -> pd.Series:
        made = []
        for t, n in zip(texts, counts, strict=True):
            k = int(n) // size + 1
            made.append(overlapped(cut(t, max(1, -(-len(t) // k))), overlap) if k > 1 else [t])
        return pd.Series(made)

    parts = rows.withColumn("_p", pieces(F.coalesce(F.col(text), F.lit("")), tokens))
    return parts.select(*(c for c in rows.columns if c != text), F.posexplode("_p").alias("idx", "piece"))


def balanced(reply: str | None) -> str:
    """The first balanced array of a reply, or its first balanced object in an array, whichever bracket comes first; else an empty array.

    A bracket that never closes is passed over: of what closes after it, the first that is in nothing else that closes counts.
    """
    text = re.sub(r"(?s)<think>.*?</think>|```(json)?", "", reply or "")
    opened: list[int] = []
    closed: list[tuple[int, int]] = []
    quoted = escaped = False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c in "[{":
            opened.append(i)
        elif opened and c == '"':
            quoted = True
        elif opened and c in "]}":
            start = opened.pop()
            while closed and closed[-1][0] > start:
                closed.pop()
            closed.append((start, i + 1))
            if not opened:
                break
    if not closed:
        return "[]"
    found = text[slice(*closed[0])]
    return found if found[0] == "[" else f"[{found}]"


def count_tokens(text: Column, counter: Callable[[list[str]], list[int]] | None = None) -> Column:
    """Tokens of texts by a counting function of batches, or by the vocabulary-free count; null counts as empty."""
    if counter is None:
        return token_count(text)

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(texts.tolist()), dtype="int32")

    return counted(F.coalesce(text, F.lit("")))


#: The end of a pattern that leaves the last white space of a run to the word after it, and the same without looking ahead.
TAIL, PLAIN_TAIL = r"|\s+(?!\S)|\s+", r"|\s+"
#: What \s is to the encoder, and two of it before something else: only there the two ends cut a text in different ways.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f"[{SPACE}][{SPACE}][^{SPACE}]")
#: Characters up to which the encoder's own pattern takes any run of white space; it breaks somewhere above 400,000.
LOOKED_AHEAD = 100_000


def vocabulary_counter(ranks: bytes, pattern: str, most: int = 200_000) -> Callable[[list[str]], list[int]]:
    """A counting function for a byte-pair vocabulary: lines of a base64 token and its rank, and the pattern that cuts texts.

    Texts without two white spaces before a word are cut by the pattern without looking ahead, where it has the usual end: the
    pieces are the same, and it takes a third of the time. Others go through the pattern itself. That can't take very long
    runs of white space: longer texts are cut outside the encoder and counted by pre-token, which the encoder never joins, each
    distinct one merged once and remembered, up to `most` of them.
    """
    made: list = []

    def count(texts: list[str]) -> list[int]:
        if not made:  # built in the task
            import base64

            import regex
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
            cuts = [pattern, pattern.removesuffix(TAIL) + PLAIN_TAIL] if pattern.endswith(TAIL) else [pattern]
            encodings = [tiktoken.Encoding("counter", pat_str=x, mergeable_ranks=merges, special_tokens={}) for x in cuts]
            made.extend((encodings[0], encodings[1] if len(cuts) > 1 else None, regex.compile(pattern), {}))
        encoding, plain, cutter, known = made
        out = []
        for text in texts:
            if plain and not RUN.search(text):
                out.append(len(plain.encode_ordinary(text)))
            elif len(text) <= LOOKED_AHEAD:
                out.append(len(encoding.encode_ordinary(text)))
            else:
                if len(known) > most:
                    known.clear()
                pieces = cutter.findall(text)
                for piece in set(pieces).difference(known):  # looks pieces up; a difference from keys() would walk all that is known
                    known[piece] = len(encoding._encode_single_piece(piece))
                out.append(sum(map(known.__getitem__, pieces)))
        return out

    return count


def read_counter(spark: SparkSession, path: str, pattern: str) -> Callable[[list[str]], list[int]]:
    """vocabulary_counter of a file of ranks that Spark can read."""
    data = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first()[0]
    return vocabulary_counter(bytes(data), pattern)


QUESTION = "array<struct<question_text:string,options:array<string>,correct_answer:string,explanation:string>>"


def parse_llm_json(replies: DataFrame, schema: str = QUESTION, response: str = "response") -> DataFrame:
    """replies with one row for each item of the JSON in their response, its fields as columns; none for replies without."""

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(balanced)

    items = replies.withColumn("_i", F.explode(F.from_json(scan(F.col(response)), schema)))
    return items.select(*(c for c in replies.columns if c != response), "_i.*")
