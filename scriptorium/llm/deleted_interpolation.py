"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by context-frequency buckets.

P_k(w | h) = L_k(bucket of c(h)) * c(h w) / c(h) + (1 - L_k) * P_{k-1}(w | shorter h), down to P_0 = 1 / (V + 1). The weights
L are learned by expectation-maximisation on the counts of a held-out tenth of the training texts, with estimates from
the other nine; the final model takes its counts from all training texts.

Texts are held as chunks: word hashes of about CHUNK_TOKENS tokens of whole texts. Each chunk sends every distinct n-gram
once, with its counts, to the n-gram's shard (a range of hashes); a shard adds up what all chunks sent and replies to each
chunk, in the chunk's own order, with the totals. So one exchange both counts the corpus and looks the counts up, each n-gram
counts as one entry for each chunk however frequent it is, and no model is broadcast or held whole anywhere.

A sender cuts its n-grams into FAN ranges, however large the corpus is. Where that isn't enough shards, senders are grouped:
a group adds up one range of about FAN senders and sends the sums on, again cut into FAN ranges, and hands the replies down
the same way. So the rows exchanged grow with the chunks, times the number of levels (FAN ** levels shards).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import id_type, mixed, slices, table, word_hashes

CHUNK_TOKENS = 1_000_000
SHARD_TOKENS = 1_000_000
#: A power of two.
FAN = 256
BUCKETS = 24
#: No word holds white space, so these are no words' hashes.
END, START = (xxhash.xxh64_intdigest(x) for x in (b" ", b"\n"))
KEPT, HELD, OTHER = 0, 1, 2
CHUNK = "chunk long, n_train long, doc_ids array<{}>, lengths array<int>, folds array<int>, n_units long, units binary, tokens binary"


def packed(x: np.ndarray) -> bytes:
    """Integers as zstd-compressed bytes, byte planes apart; unpacked() reverses it."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    planes = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def uniques(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, index of each element's value among them)."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.r_[np.ones(min(1, len(x)), bool), ranked[1:] != ranked[:-1]]
    index = np.empty(len(x), np.int32)
    index[order] = np.cumsum(new) - 1
    return ranked[new], index


def chunks(docs: DataFrame, training: Column) -> DataFrame:
    """CHUNK rows of docs (doc_id, text), written to the shared folder; training says which rows may be learned from."""
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(10)) == 0
    fold = F.when(~training, OTHER).when(held, HELD).otherwise(KEPT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, folds, hashes, total = [], [], [], [], 0

        def made() -> pa.RecordBatch:
            found, index = uniques(np.concatenate([*hashes, np.array([START, END], np.uint64)]))
            sizes = np.concatenate(lengths)
            of = np.concatenate(folds)
            n_train = int((sizes + 1)[of != OTHER].sum())
            chunk = int.from_bytes(os.urandom(7))  # the table is written once and then read, so this is stable
            row = [[chunk], [n_train], [pa.concat_arrays(ids).to_pylist()], [sizes], [of], [len(found)], [packed(found)], [packed(index[:-2].astype(np.int32))]]
            kinds = [pa.int64(), pa.int64(), pa.list_(ids[0].type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], [x.split(" ")[0] for x in CHUNK.split(", ")])

        for batch in batches:
            for a, b in slices(batch.column(2), 4 * CHUNK_TOKENS):
                part = batch.slice(a, b - a)
                words, counts = word_hashes(part.column(2))
                ids.append(part.column(0))
                folds.append(np.array(part.column(1)))
                hashes.append(words)
                lengths.append(counts.astype(np.int32))
                total += len(words) + len(counts)
                if total >= CHUNK_TOKENS:
                    yield made()
                    ids, lengths, folds, hashes, total = [], [], [], [], 0
        if ids:
            yield made()

    return table(docs.select("doc_id", fold.alias("fold"), "text").mapInArrow(cut, CHUNK.format(id_type(docs))), "chunks")


class Grams(NamedTuple):
    """Of a chunk: for k = 1.. the distinct k-grams and, at each position, which it is. Positions: START, words and END of each text."""

    ids: pa.Array
    folds: np.ndarray  # of each text
    text: np.ndarray  # of each position
    real: np.ndarray  # positions that are tokens
    distinct: list[np.ndarray]
    index: list[np.ndarray]


def grams(row: dict, order: int) -> Grams:
    lengths = np.array(row["lengths"], np.int64)
    units = unpacked(row["units"], np.uint64, row["n_units"])
    tokens = unpacked(row["tokens"], np.int32, int(lengths.sum()))
    pad = max(1, order - 1)
    sizes = lengths + pad + 1
    ends = np.cumsum(sizes)
    ids = np.full(int(ends[-1]) if len(ends) else 0, np.searchsorted(units, np.uint64(START)), np.int32)
    ids[ends - 1] = np.searchsorted(units, np.uint64(END))
    word = np.ones(len(ids), bool)
    word[ends - 1] = False
    for i in range(pad):
        word[ends - sizes + i] = False
    ids[word] = tokens
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    real = word.copy()
    real[ends - 1] = True
    at = real.copy()
    at[ends - sizes + pad - 1] = True
    first = units[ids]
    distinct, index, h = [units], [ids[at]], first
    for k in range(2, order + 1):
        with np.errstate(over="ignore"):
            h = np.r_[h[:1], mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + first[1:] + np.uint64(k))]
        found, of = uniques(h[at])
        distinct.append(found)
        index.append(of)
    del first, h, word
    return Grams(row["doc_ids"], np.array(row["folds"]), text[at], real[at], distinct, index)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() if n != "doc_ids" else batch.column(j)[i].values for j, n in enumerate(batch.schema.names)}


ASK = "group long, part long, child long, k int, n long, grams binary, kept binary, held binary"
REPLY = "child long, part long, k int, n long, kept binary, held binary, types long"
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, KINDS[t]) for v, t in zip(columns, kinds, strict=True)], list(names))


def asked_of(found: np.ndarray, counts: list[np.ndarray], group: int, part: int, level: int, child: int, k: int, bits: int) -> list[tuple]:
    """ASK rows of a sender's sorted k-grams, all within the range `part` of the level above, cut into ranges of this level."""
    first = part << bits
    edges = np.array([(first + i) << (64 - bits * level) for i in range(1, 1 << bits)], np.uint64)
    cuts = np.r_[0, np.searchsorted(found, edges), len(found)]
    return [(group, first + i, child, k, int(b - a), packed(np.diff(found[a:b], prepend=np.uint64(0))), *(packed(c[a:b]) for c in counts)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def requests(made: DataFrame, order: int, groups: int, bits: int) -> DataFrame:
    """ASK: each chunk's distinct k-grams and their counts in both folds, by range."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = grams(row, order)
            fold = g.folds[g.text]
            for k, (found, of) in enumerate(zip(g.distinct, g.index, strict=True), 1):
                counts = [np.bincount(of[fold == f], minlength=len(found)).astype(np.uint64) for f in (KEPT, HELD)]
                yield batch_of(asked_of(found, counts, row["chunk"] % groups, 0, 1, row["chunk"], k, bits), ASK)

    return made.mapInArrow(sent, ASK)


def added(group: pa.Table) -> Iterator[tuple[int, list[dict], np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of ASK rows that are one group's and range's, for each k: (k, rows, distinct k-grams, which of them the rows hold, one after the other, their counts added up)."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["k"], r["child"]))
    for k in sorted({r["k"] for r in rows}):
        mine = [r for r in rows if r["k"] == k]
        found, of = uniques(np.concatenate([np.cumsum(unpacked(r["grams"], np.uint64, r["n"]), dtype=np.uint64) for r in mine]))
        yield k, mine, found, of, [np.bincount(of, np.concatenate([unpacked(r[f], np.uint64, r["n"]) for r in mine]), len(found)).astype(np.uint64) for f in ("kept", "held")]


def answered(mine: list[dict], of: np.ndarray, counts: list[np.ndarray], types: int) -> list[tuple]:
    """REPLY rows to all senders of a k."""
    out, at = [], 0
    for i, r in enumerate(mine):
        span = of[at : at + r["n"]]
        at += r["n"]
        out.append((r["child"], r["part"], r["k"], r["n"], *(packed(c[span]) for c in counts), 0 if i else types))
    return out


def passed_on(asked: DataFrame, groups: int, level: int, bits: int) -> DataFrame:
    """ASK rows of the next level: each group's sums of a range."""

    def sums(key: tuple, group: pa.Table) -> pa.Table:
        own, part = (x.as_py() for x in key)
        return pa.Table.from_batches([batch_of(asked_of(found, counts, own % groups, part, level, own, k, bits), ASK) for k, _, found, _, counts in added(group)])

    return asked.groupBy("group", "part").applyInArrow(sums, ASK)


def replies(asked: DataFrame) -> DataFrame:
    """REPLY rows of the last level: the totals of what each sender asked for; types: distinct k-grams of the range that training texts have, on one row of each range and k."""

    def totals(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([batch_of(answered(mine, of, counts, int(((counts[0] + counts[1] > 0) & (found != START)).sum())), REPLY) for _, mine, found, of, counts in added(group)])

    return asked.groupBy("group", "part").applyInArrow(totals, REPLY)


def handed_down(asked: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """REPLY rows to the senders of `asked` from the replies that their groups got from the level above."""

    def totals(group: pa.Table, got: pa.Table) -> pa.Table:
        said = sorted(got.to_pylist(), key=lambda r: r["part"])
        out = []
        for k, mine, _, of, _ in added(group):
            counts = [np.concatenate([unpacked(r[f], np.uint64, r["n"]) for r in said if r["k"] == k]) for f in ("kept", "held")]
            out.append(batch_of(answered(mine, of, counts, 0), REPLY))
        return pa.Table.from_batches(out)

    keyed = above.withColumns({"group": F.col("child"), "range": F.shiftright("part", bits)})
    return asked.groupBy("group", "part").cogroup(keyed.groupBy("group", "range")).applyInArrow(totals, REPLY)


def exchange(made: DataFrame, order: int, chunks: int, tokens: int, fan: int) -> tuple[DataFrame, int]:
    """(REPLY rows to each chunk, number of distinct words of the training texts)."""
    bits = fan.bit_length() - 1
    levels = 1
    while fan**levels * SHARD_TOKENS < tokens:
        levels += 1
    groups = [-(-chunks // fan**level) for level in range(1, levels)] + [1]
    asked = [requests(made, order, groups[0], bits)]
    for level in range(1, levels):
        asked[-1] = table(asked[-1], "requests")
        asked.append(passed_on(asked[-1], groups[level], level + 1, bits))
    out = last = table(replies(asked[-1]), "replies")
    for rows in reversed(asked[:-1]):
        out = table(handed_down(rows, out, bits), "replies")
    return out, int(last.where("k = 1").agg(F.sum("types").alias("v")).first()["v"] or 0)


def totals(row: dict, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each k, counts of the chunk's distinct k-grams in the kept and the held-out fold."""
    out: tuple[list, list] = ([], [])
    for k in range(1, order + 1):
        mine = sorted((r for r in row["replies"] if r["k"] == k), key=lambda r: r["part"])
        for x, name in zip(out, ("kept", "held"), strict=True):
            x.append(np.concatenate([unpacked(r[name], np.uint64, r["n"]) for r in mine]).astype(np.float64))
    return out


def estimates(g: Grams, counts: list[np.ndarray], n: int, order: int, of: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(f_k, context bucket) for k = 1.. at the positions `of`, which are tokens."""
    fs, buckets = [counts[0][g.index[0][of]] / max(1, n)], [np.zeros(len(of), np.int8)]
    for k in range(1, order):
        context = counts[k - 1][g.index[k - 1][of - 1]]
        fs.append(counts[k][g.index[k][of]] / np.maximum(1, context))
        buckets.append(np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1))).astype(np.int8))
    return fs, buckets


def mixture(fs: list[np.ndarray], buckets: list[np.ndarray], weights: np.ndarray, floor: float) -> list[np.ndarray]:
    """P_0, P_1, .. at each position."""
    out = [np.full(len(fs[0]), floor)]
    for f, b, w in zip(fs, buckets, weights, strict=True):
        out.append(w[b] * f + (1 - w[b]) * out[-1])
    return out


def learn(known: DataFrame, order: int, n_kept: int, floor: float, rounds: int) -> np.ndarray:
    """The weights (order x BUCKETS) by expectation-maximisation over the held-out fold's tokens."""
    names = [f"{x}{k}" for k in range(order) for x in "fb"]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = grams(row, order)
            of = np.flatnonzero(g.real & (g.folds[g.text] == HELD))
            fs, buckets = estimates(g, totals(row, order)[0], n_kept, order, of)
            columns = [pa.array(x) for pair in zip((f.astype(np.float32) for f in fs), buckets, strict=True) for x in pair]
            for a in range(0, len(of), 200_000):
                yield pa.RecordBatch.from_arrays([c.slice(a, 200_000) for c in columns], names)

    tokens = table(known.mapInArrow(held, ", ".join(f"f{k} float, b{k} byte" for k in range(order))), "held_out")
    weights = np.full((order, BUCKETS), 0.5)
    weights[1:, 0] = 0  # contexts that were not seen have no estimate
    weights[0, 0] *= n_kept > 0
    for _ in range(rounds):

        def expected(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            got, of = np.zeros((order, BUCKETS)), np.zeros((order, BUCKETS))
            for batch in batches:
                x = [c.to_numpy() for c in batch.columns]
                fs, buckets = x[::2], x[1::2]
                p = mixture(fs, buckets, weights, floor)
                reach = np.ones(batch.num_rows)
                for k in range(order - 1, -1, -1):
                    b = buckets[k]
                    post = reach * weights[k][b] * fs[k] / p[k + 1]
                    got[k] += np.bincount(b, post, BUCKETS)
                    of[k] += np.bincount(b, reach, BUCKETS)
                    reach -= post
            k, b = np.indices(got.shape)
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (k, b, got, of)], ["k", "b", "got", "of"])

        sums = tokens.mapInArrow(expected, "k long, b long, got double, of double").groupBy("k", "b").agg(F.sum("got").alias("got"), F.sum("of").alias("of")).collect()
        new = weights.copy()
        for r in sums:  # order x BUCKETS rows
            if r["of"] > 0:
                new[r["k"], r["b"]] = min(r["got"] / r["of"], 1 - 1e-6)
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-3:
            break
    return weights


def score(docs: DataFrame, training: Column, order: int = 2, rounds: int = 12, fan: int = FAN) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text), learned from its rows where training holds.

    Tokens are words ([^\\x20\\x09-\\x0D]+ after lower-casing A-Z) and one end for each text; null counts as empty, which
    has the end alone. score: the model's log10 probability of the text; base_score: that of add-one unigrams with V + 1
    classes; n_known: tokens that training has. Other columns are ignored, repeated rows count and return as rows of their
    own, a null doc_id returns as null. Without any training text N and V are 0 and both scores are those of one class. A text
    stays in one chunk, that is in one task. EM runs for `rounds` steps, settled or not: each step can only raise the
    likelihood of the held-out part, so fewer make weights that are less good, not wrong ones.
    """
    made = chunks(docs, training)
    sized = made.selectExpr("sum(n_train) n", "coalesce(sum(aggregate(lengths, 0L, (a, x) -> a + x) + size(lengths)), 0) total", "count(*) chunks").first()
    n = int(sized["n"] or 0)
    replied, v = exchange(made, order, sized["chunks"], sized["total"], fan)
    floor = 1 / (v + 1)
    by_chunk = replied.groupBy(F.col("child").alias("chunk")).agg(F.collect_list(F.struct("k", "part", "n", "kept", "held")).alias("replies"))  # FAN * order rows each
    known = table(made.join(by_chunk, "chunk"), "known")
    n_kept = n - int(made.selectExpr(f"sum(aggregate(arrays_zip(lengths, folds), 0L, (a, x) -> a + if(x.folds = {HELD}, x.lengths + 1, 0))) h").first()["h"] or 0)
    weights = learn(known, order, n_kept, floor, rounds)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = grams(row, order)
            counts = [a + b for a, b in zip(*totals(row, order), strict=True)]
            of = np.flatnonzero(g.real)
            text, single = g.text[of], counts[0][g.index[0][of]]
            total = lambda x, of=text, m=len(g.ids): np.bincount(of, x, m)
            fs, buckets = estimates(g, counts, n, order, of)
            p = mixture(fs, buckets, weights, floor)[-1]
            columns = [g.ids, pa.array(total(None)), pa.array(total(single > 0).astype(np.int64)), pa.array(np.full(len(g.ids), n)), pa.array(total(np.log10((single + 1) / (n + v + 1)))), pa.array(total(np.log10(p)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return known.mapInArrow(scored, f"doc_id {id_type(docs)}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
