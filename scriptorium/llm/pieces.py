"""SentencePiece encoding and decoding by the tokenizers library.

The model file's protobuf is parsed here, and its parts are rebuilt: normaliser, metaspace marker, unigram scores or BPE
merges, byte fallback. Ids always come from the rebuilt tokenizer. The sentencepiece library checks them: parity tells
whether its ids are the same.

Where a model allows cutting texts before any run of spaces, a text is a row of runs (a word after its spaces) which are
encoded one by one. Each distinct run is then encoded, checked and decoded when it is first met in a task, and remembered;
as no piece crosses a cut, a text has parity and a round trip if all its runs do.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from scriptorium.llm.common import release, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: the marker for a space, kinds of pieces and kinds of models.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PIECE_CHARS = 1 << 18
BATCH_BYTES = 1 << 20
#: Bytes that the remembered runs of one task may take, about.
CACHE_BYTES = 32 << 20
ENTRY_BYTES = 220
#: Runs that are encoded as one text.
BLOCK = 64


class Spec(NamedTuple):
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    suffix: bool = False


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def parse(data: bytes) -> Spec:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    return Spec(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)), bool(trainer.get(24, 0)))


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first, then as the pieces stand in the model."""
    scores = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER)}
    found = [(-score, i, p[:k], p[k:]) for i, (p, score) in enumerate(scores.items()) for k in range(1, len(p)) if p[:k] in scores and p[k:] in scores]
    return [(a, b) for *_, a, b in sorted(found, key=lambda x: x[:2])]


def splits_words(spec: Spec) -> bool:
    """No piece holds the marker after another character, so that texts may be cut before any run of markers."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in spec.pieces if kind in (NORMAL, USER))


def by_word(spec: Spec) -> bool:
    """Texts are only escaped, so that each run of spaces and what follows it is encoded by itself."""
    return spec.dummy_prefix and spec.escape and not spec.squeeze and not spec.charsmap and splits_words(spec)


def runs_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct runs, which of them stands at each place, number of places of each text).

    A run is a word after all but one of the spaces before it, as its own dummy prefix makes up for that one; spaces at
    the end of a text belong to its last run. The runs of a text joined by one space each are the text; an empty text is one
    empty run.
    """
    split = pc.split_pattern(texts, " ")
    words, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    at, full = np.arange(len(words)), pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    last = offsets[1:] - 1
    ends = full.copy()
    trailing = ~full[last]
    if trailing.any():
        before = np.maximum.accumulate(np.where(full, at, -1))[last][trailing]
        ends[before[before >= offsets[:-1][trailing]]] = False
        ends[last] = True
    end = np.flatnonzero(ends)
    start = np.r_[0, end[:-1] + 1]
    plain = start == end
    coded = words.take(pa.array(end[plain])).dictionary_encode()
    which = np.empty(len(end), np.int64)
    which[plain] = coded.indices.to_numpy()
    spaced = pa.array([" ".join(words.slice(a, b - a + 1).to_pylist()) for a, b in zip(start[~plain].tolist(), end[~plain].tolist(), strict=True)], texts.type).dictionary_encode()
    which[~plain] = spaced.indices.to_numpy() + len(coded.dictionary)
    places = np.diff(np.r_[0, np.cumsum(ends)[last]])
    return pa.concat_arrays([coded.dictionary, spaced.dictionary]), which, places


class Runs:
    """Ids of runs, remembered up to about CACHE_BYTES: flat ids and, for each run, where its ids end and what the checks said."""

    def __init__(self, spec: Spec, fast: Tokenizer, plain: sentencepiece.SentencePieceProcessor):
        self.fast, self.plain = fast, plain
        self.begins = np.array([p.startswith(MARK) for p, *_ in spec.pieces])
        self.clear()

    def clear(self) -> None:
        self.hold([], np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, bool), np.empty(0, bool))

    def hold(self, runs: list[str], ids: np.ndarray, ends: np.ndarray, same: np.ndarray, back: np.ndarray) -> None:
        self.known = dict(zip(runs, range(len(runs)), strict=True))
        self.ids, self.ends, self.same, self.back = ids, ends, same, back
        self.used = np.zeros(len(runs), np.uint8)
        self.bytes = ENTRY_BYTES * len(runs) + 4 * len(ids) + sum(map(len, runs))

    def forget(self) -> None:
        """Keeps the runs that were met again since they were learned, if they take less than half of the room."""
        keep = np.flatnonzero(self.used)
        sizes = np.diff(self.ends)[keep]
        if ENTRY_BYTES * len(keep) + 4 * sizes.sum() > CACHE_BYTES // 2:
            keep, sizes = keep[:0], sizes[:0]
        again = set(keep.tolist())
        self.hold([r for r, i in self.known.items() if i in again], self.ids[spread(self.ends[keep], sizes)], np.r_[0, np.cumsum(sizes)], self.same[keep], self.back[keep])

    def learn(self, new: list[str], threads: int) -> None:
        """Encodes new runs, many in one text where none has a space of its own, and checks them; by themselves where a check fails."""
        alone = [r for r in new if not r or " " in r]
        rest = [r for r in new if r and " " not in r] if alone else new
        blocks = [rest[i : i + BLOCK] for i in range(0, len(rest), BLOCK)]
        made = []
        for block, ids, same, back in zip(blocks, *self.checked([" ".join(b) for b in blocks], threads), strict=True):
            first = np.flatnonzero(self.begins[ids])
            if same and back and len(first) == len(block):
                made.append((block, ids, np.diff(np.r_[first, len(ids)]), True, True))
            else:
                alone += block
        made += [([r], ids, np.array([len(ids)]), same, back) for r, ids, same, back in zip(alone, *self.checked(alone, threads), strict=True)]
        runs, ids, sizes, same, back = zip(*made, strict=True)
        names, n = list(chain.from_iterable(runs)), np.array([len(r) for r in runs])
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))]
        self.same, self.back = (np.r_[x, np.repeat(np.array(y, bool), n)] for x, y in ((self.same, same), (self.back, back)))
        self.used = np.r_[self.used, np.zeros(len(names), np.uint8)]
        self.bytes += ENTRY_BYTES * len(names) + 4 * sum(map(len, ids)) + sum(map(len, names))

    def checked(self, texts: list[str], threads: int) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """(ids, whether sentencepiece gives the same, whether decoding gives the text back) of each text."""
        ids = [e.ids for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.plain.encode(texts, num_threads=threads) if texts else []
        decoded = self.fast.decode_batch(ids, skip_special_tokens=False)
        return [np.array(x, np.int32) for x in ids], [a == b for a, b in zip(ids, theirs, strict=True)], [a == b for a, b in zip(decoded, texts, strict=True)]

    def encode(self, texts: pa.Array, threads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each, parity of each, round trip of each)."""
        if self.bytes > CACHE_BYTES:
            self.forget()
        runs, which, places = runs_of(texts)
        runs, before = runs.to_pylist(), len(self.known)
        if new := [r for r in runs if r not in self.known]:
            self.learn(new, threads)
        slot = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        self.used[slot[slot < before]] = 1
        slot = slot[which]
        sizes = self.ends[slot + 1] - self.ends[slot]
        first = np.cumsum(places) - places
        return self.ids[spread(self.ends[slot], sizes)], np.add.reduceat(sizes, first), np.logical_and.reduceat(self.same[slot], first), np.logical_and.reduceat(self.back[slot], first)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers from each start on, as many as its size says."""
    stop = np.cumsum(sizes)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts - stop + sizes, sizes)


def build(spec: Spec) -> Tokenizer:
    """The tokenizer of a model; a ValueError for models that the library can't rebuild with the same ids.

    Those are models with user-defined pieces, which sentencepiece takes out of a text before anything else, and models
    whose marker stands after a word.
    """
    if any(kind == USER for *_, kind in spec.pieces):
        raise ValueError("models with user-defined pieces are not supported")
    if spec.suffix:
        raise ValueError("models that treat white space as a suffix are not supported")
    unknown = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), None)
    if spec.kind == UNIGRAM:
        out = Tokenizer(models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unknown, byte_fallback=spec.byte_fallback))
    elif spec.kind == BPE:
        vocabulary = {p: i for i, (p, *_) in enumerate(spec.pieces)}
        out = Tokenizer(models.BPE(vocabulary, merges(spec), unk_token=None if unknown is None else spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback))
    else:
        raise ValueError(f"models of kind {spec.kind} are not supported")
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if splits_words(spec):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    return out


def cut(text: str, spec: Spec, most: int = PIECE_CHARS) -> list[str]:
    """Pieces of a long text that encode to the same ids one after the other; the whole text where the model doesn't allow that.

    A cut stands before a run of spaces; the piece drops one of them, as its own dummy prefix makes up for it.
    """
    if len(text) <= most or not by_word(spec):
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while at > start and text[at - 1] in (" ", MARK):
            at -= 1
        if at <= start:
            break
        out.append(text[start:at])
        start = at + 1
    return [*out, text[start:]]


@lru_cache(2)
def loaded(data: bytes) -> tuple[Spec, Tokenizer, sentencepiece.SentencePieceProcessor, Runs | None]:
    spec = parse(data)
    fast, plain = build(spec), sentencepiece.SentencePieceProcessor(model_proto=data)
    return spec, fast, plain, Runs(spec, fast, plain) if by_word(spec) else None


def encode_texts(texts: pa.Array, data: bytes, threads: int) -> pa.StructArray:
    """OWN of each text (no nulls)."""
    spec, fast, plain, runs = loaded(data)
    if runs:
        texts = pc.replace_substring(texts, MARK, " ")
        parts = [cut(t, spec) for t in texts.to_pylist()] if pc.max(pc.binary_length(texts)).as_py() > PIECE_CHARS else None
        n = np.fromiter(map(len, parts), np.int64) if parts else np.ones(len(texts), np.int64)
        ids, sizes, same, back = runs.encode(pa.array(chain.from_iterable(parts), pa.string()) if parts else texts, threads)
        first = np.cumsum(n) - n
        sizes, same, back = np.add.reduceat(sizes, first), np.logical_and.reduceat(same, first), np.logical_and.reduceat(back, first)
    else:
        whole = texts.to_pylist()
        mine = [e.ids for e in fast.encode_batch_fast(whole, add_special_tokens=False)]
        same = np.array([a == b for a, b in zip(mine, plain.encode(whole, num_threads=threads), strict=True)])
        back = np.array([a == b.replace(MARK, " ") for a, b in zip(fast.decode_batch(mine, skip_special_tokens=False), whole, strict=True)])
        ids, sizes = np.fromiter(chain.from_iterable(mine), np.int32), np.fromiter(map(len, mine), np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.StructArray.from_arrays([lists, pa.array(sizes.astype(np.int64)), pa.array(same), pa.array(back)], list(OWN))


def read_model(spark: SparkSession, path: str) -> bytes:
    return spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first()[0]


OWN = {"ids": "array<int>", "n_ids": "bigint", "parity": "boolean", "round_trip": "boolean"}
OWN_TYPE = pa.struct([("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("parity", pa.bool_()), ("round_trip", pa.bool_())])


def encode(docs: DataFrame, path: str = MODEL, threads: int = 2) -> DataFrame:
    """The columns of docs (which have text), then ids, n_ids, parity, round_trip; of clashing names ours win.

    ids are those of the rebuilt tokenizer; null and empty texts have none. parity: the sentencepiece library gives the same
    ids. round_trip: decoding gives the text back (the marker itself reads as a space, and a normaliser may change texts).
    Whole texts are encoded, very long ones in pieces that give the same ids. Repeated rows each give a row, no rows give
    none. `threads` encode a batch within a task. Models that can't be rebuilt are a ValueError at once.
    """
    model = read_model(docs.sparkSession, path)
    build(parse(model))
    data = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{','.join(f'{n}:{t}' for n, t in OWN.items())}>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ |= {"TOKENIZERS_PARALLELISM": "true", "RAYON_NUM_THREADS": str(threads)}
        try:
            for texts in batches:
                texts = pc.fill_null(texts, "")
                yield pa.concat_arrays([pa.array([], OWN_TYPE), *(encode_texts(texts.slice(a, b - a), data.value, threads) for a, b in slices(texts, BATCH_BYTES))])
        finally:  # workers are used again, by other stages too
            if runs := loaded(data.value)[3]:
                runs.clear()
            release()

    rows = docs.drop(*OWN)
    out = rows.select("*", encoded(F.col("text")).alias("own columns of encode"))
    return out.select(*(f"`{c}`" for c in rows.columns), "`own columns of encode`.*")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """The columns of encoded (which have ids, an array of int) and decoded, the text; null ids give null.

    Repeated rows each give a row, no rows give none; a column decoded that is there gives way.
    """
    data = encoded.sparkSession.sparkContext.broadcast(read_model(encoded.sparkSession, path))
    rows = encoded.drop("decoded")
    at = rows.columns.index("ids")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fast = loaded(data.value)[1]
            found = [None if ids is None else fast.decode(ids, skip_special_tokens=False) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(texts, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", decoded string")
