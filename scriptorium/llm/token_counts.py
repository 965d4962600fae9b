"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A byte-pair encoder never joins bytes of two pre-tokens, so a text's count is the sum over its pre-tokens. The leaves of a
document's tree are runs of about LEAF pre-tokens with their lengths and counts; inner nodes hold the characters and the
tokens below. An edit finds its place by the tree, re-encodes from a few pre-tokens before it until the cut agrees with
the old one again, and updates the sums on the way up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import id_type, slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
CACHE = 300_000
EDIT = "struct<at:int,removed:int,added:string>"


class Encoder:
    """Token counts of pre-tokens, remembered for up to CACHE of them.

    A pre-token is merged by the ranks as it stands, without the pattern, which can't take very long runs of white space.
    """

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for piece in pieces:
            n = known.get(piece)
            if n is None:
                n = len(self.encoding._encode_single_piece(piece))
                if len(piece) < 64:
                    known[piece] = n
            out.append(n)
        return out


@lru_cache(2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


class Tree(NamedTuple):
    """sizes and counts: per leaf, lengths and tokens of its pre-tokens; chars and tokens: heap-ordered sums, leaves at the end."""

    sizes: list[list[int]]
    counts: list[list[int]]
    chars: list[int]
    tokens: list[int]

    @property
    def width(self) -> int:
        return len(self.chars) // 2


def grow(sizes: list[int], counts: list[int], leaf: int = LEAF) -> Tree:
    cuts = range(0, max(1, len(sizes)), leaf)
    leaves = [sizes[i : i + leaf] for i in cuts], [counts[i : i + leaf] for i in cuts]
    width = 1 << (len(leaves[0]) - 1).bit_length()
    for x in leaves:
        x.extend([] for _ in range(width - len(x)))
    sums = []
    for x in leaves:
        heap = [0] * width + [sum(y) for y in x]
        for i in range(width - 1, 0, -1):
            heap[i] = heap[2 * i] + heap[2 * i + 1]
        sums.append(heap)
    return Tree(*leaves, *sums)


def flat(tree: Tree) -> tuple[list[int], list[int]]:
    return [x for leaf in tree.sizes for x in leaf], [x for leaf in tree.counts for x in leaf]


def leaf_at(tree: Tree, at: int) -> tuple[int, int]:
    """(leaf that holds the character `at`, characters before the leaf); the end of the text belongs to its last full leaf."""
    at = min(at, tree.chars[1] - 1) if tree.chars[1] else 0
    node, before = 1, 0
    while node < tree.width:
        node *= 2
        if at - before >= tree.chars[node]:
            before += tree.chars[node]
            node += 1
    return node - tree.width, before


def update(tree: Tree, leaf: int, sizes: list[int], counts: list[int]) -> None:
    tree.sizes[leaf], tree.counts[leaf] = sizes, counts
    node = leaf + tree.width
    for sums, value in ((tree.chars, sum(sizes)), (tree.tokens, sum(counts))):
        step, change = node, value - sums[node]
        while step:
            sums[step] += change
            step //= 2


def edit(tree: Tree, text: str, at: int, removed: int, added: str, encode: Encoder) -> tuple[Tree, str, int]:
    """The tree and text after `removed` characters at `at` give way to `added`, and how many pre-tokens were encoded anew.

    Out-of-range places are moved to the nearest end. Re-encoding starts two pre-tokens before the one that holds the
    place (no pattern of this kind looks back further), and stops at the first old boundary after the edit that the new
    cut hits too, one pre-token later: what follows is cut from the same characters as before.
    """
    at = min(max(0, at), len(text))
    removed = min(max(0, removed), len(text) - at)
    new = text[:at] + added + text[at + removed :]
    if not text:
        pieces = encode.pattern.findall(new)
        return grow([len(p) for p in pieces], encode.counts(pieces)), new, len(pieces)
    first, before = leaf_at(tree, at)
    start, k, back = before, 0, 2
    for size in tree.sizes[first]:
        if start + size > at or start + size >= len(text):
            break
        start += size
        k += 1
    while back:  # step back over pre-tokens, through earlier leaves if need be
        if k == 0:
            earlier = next((i for i in range(first - 1, -1, -1) if tree.sizes[i]), None)
            if earlier is None:
                break
            first, k = earlier, len(tree.sizes[earlier])
        k -= 1
        start -= tree.sizes[first][k]
        back -= 1
    shift = len(added) - removed
    last, j, old_end = first, k, start
    sizes, made, pieces, end = [], 0, [], start
    for match in encode.pattern.finditer(new, start):
        pieces.append(match.group())
        sizes.append(len(pieces[-1]))
        end = match.end()
        agreed = False
        while old_end + shift < end or old_end < at + removed:
            while last < tree.width and j >= len(tree.sizes[last]):
                last, j = last + 1, 0
            if last == tree.width:
                break
            old_end += tree.sizes[last][j]
            j += 1
        if old_end + shift == end and end >= at + len(added) and old_end >= at + removed:
            made += 1
            agreed = made > 1
        else:
            made = 0
        if agreed:
            break
    if end >= len(new):
        last, j = tree.width - 1, len(tree.sizes[tree.width - 1])
    counts = encode.counts(pieces)
    head = tree.sizes[first][:k], tree.counts[first][:k]
    tail = (tree.sizes[last][j:], tree.counts[last][j:]) if last < tree.width else ([], [])
    update(tree, first, [*head[0], *sizes, *(tail[0])], [*head[1], *counts, *(tail[1])])
    for i in range(first + 1, min(last, tree.width - 1) + 1):
        update(tree, i, [], [])
    if len(tree.sizes[first]) > 8 * LEAF:
        tree = grow(*flat(tree))
    return tree, new, len(pieces)


def read_ranks(spark: SparkSession, path: str) -> bytes:
    return spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first()[0]


STATE = "doc_id {}, text string, sizes array<int>, counts array<int>, n_tokens long"


def build(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """STATE and edits (null where docs has none) of each row of docs (doc_id, text and perhaps edits, an array of EDIT).

    sizes and counts hold the leaves of the document's tree one after the other. Null counts as empty: no pre-tokens. A
    column edits of another type is not read. Repeated rows each give a row, no rows give none; ids may be null and of any
    type. A text is cut and encoded whole within a task, with about 20 bytes for each of its pre-tokens.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, path))
    given = "edits" in docs.columns and docs.schema["edits"].dataType.simpleString() == f"array<{EDIT}>"
    edits = F.col("edits") if given else F.lit(None).cast(f"array<{EDIT}>")

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value, pattern)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                sizes, counts = [], []
                for text in part.column(1).to_pylist():
                    pieces = encode.pattern.findall(text)
                    sizes.append(np.fromiter(map(len, pieces), np.int32, len(pieces)))
                    counts.append(np.array(encode.counts(pieces), np.int32))
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sizes, kind), pa.array(counts, kind), pa.array([int(c.sum()) for c in counts], pa.int64()), part.column(2)], ["doc_id", "text", "sizes", "counts", "n_tokens", "edits"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), edits.alias("edits"))
    return rows.mapInArrow(built, f"{STATE.format(id_type(docs))}, edits array<{EDIT}>")


def apply_edits(state: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """STATE after each row's edits, in order, with n_before, n_edits and n_encoded (pre-tokens encoded anew).

    Null or empty edits leave a row as it is; of an edit, null places count as 0 and null text as empty. Repeated rows are
    edited each for itself, no rows give none; a text of any length is edited within one task.
    """
    data = state.sparkSession.sparkContext.broadcast(read_ranks(state.sparkSession, path))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value, pattern)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                out = []
                for text, sizes, counts, n, edits in zip(*(part.column(c) for c in ("text", "sizes", "counts", "n_tokens", "edits")), strict=True):
                    text, n, edits = text.as_py(), n.as_py(), edits.as_py() or []
                    if not edits:
                        out.append((text, sizes.as_py(), counts.as_py(), n, n, 0, 0))
                        continue
                    tree, again = grow(sizes.values.tolist(), counts.values.tolist()), 0
                    for e in edits:
                        tree, text, k = edit(tree, text, e["at"] or 0, e["removed"] or 0, e["added"] or "", encode)
                        again += k
                    out.append((text, *flat(tree), tree.tokens[1], n, len(edits), again))
                kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.int64()] * 4
                names = ["doc_id", "text", "sizes", "counts", "n_tokens", "n_before", "n_edits", "n_encoded"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return state.mapInArrow(applied, f"{STATE.format(id_type(state))}, n_before long, n_edits long, n_encoded long")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """state with the edits (doc_id, seq, at, removed, added) of each document in order of seq; documents without any keep none."""
    one = F.struct("seq", F.struct(F.col("at").cast("int"), F.col("removed").cast("int"), F.col("added")).alias("e"))
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("s")).select("doc_id", F.col("s.e").cast(f"array<{EDIT}>").alias("edits"))
    return state.drop("edits").join(listed, "doc_id", "left")


def derived_edits(doc_id: Column, text: Column) -> Column:
    """Three edits of each text, told by its id and length: words typed twice, a span cut out, a span put in from elsewhere in the text."""
    n = F.length(text)
    place = lambda i: F.pmod(F.xxhash64(doc_id, F.lit(i)), F.greatest(n, F.lit(1))).cast("int")
    made = lambda at, removed, added: F.struct(at.alias("at"), F.lit(removed).alias("removed"), added.alias("added"))
    return F.array(made(place(1), 0, F.substring(text, place(1) + 1, F.lit(12))), made(place(2), 30, F.lit("")), made(place(3), 5, F.concat(F.lit(" "), F.substring(text, place(4) + 1, F.lit(20)))))
