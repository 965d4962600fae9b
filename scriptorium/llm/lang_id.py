"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts come from all training rows: each task adds up one vector a language, Spark sums them. The log-probability
matrix holds at most MAX_CELLS numbers (the number of buckets is chosen for that), so the driver and the broadcast have
a bound whatever the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import release, released

MAX_CELLS = 1 << 21
MAX_BUCKETS = 1 << 16
PIECE = 1 << 17
ORDERS = 3
UND = "und"


class Model(NamedTuple):
    langs: list[str]
    log_probs: np.ndarray  # buckets x langs
    priors: np.ndarray


def blocks(texts: Iterable[str | None], piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, starts of n-grams, row of each start) of about `piece` code points; longer texts come in pieces.

    Texts are lower-cased and stand between spaces; each piece is followed by the two code points that its last n-grams reach into.
    """
    parts: list[str] = []
    rows: list[int] = []
    total = 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        starts = np.ones(len(points), bool)
        starts[ends - 1] = starts[ends - 2] = False
        return points, np.flatnonzero(starts), np.repeat(np.array(rows), lengths - 2)

    for row, text in enumerate(texts):
        text = f" {(text or '').lower()}   "
        for a in range(0, len(text) - 2, piece):
            parts.append(text[a : a + piece + 2] if a + piece < len(text) - 2 else text[a:])
            rows.append(row)
            total += len(parts[-1])
            if total >= piece:
                yield made()
                parts, rows, total = [], [], 0
    if parts:
        yield made()


def grams(points: np.ndarray, starts: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the n-grams of 1 to ORDERS code points at each start: ORDERS x starts."""
    out = np.empty((ORDERS, len(starts)), np.int32)
    h = np.zeros(len(starts), np.uint64)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    with np.errstate(over="ignore"):
        for n in range(ORDERS):
            h = (h + points[starts + n] + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            out[n] = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
    return out


def train(labelled: DataFrame, max_cells: int = MAX_CELLS, alpha: float = 0.5) -> Model:
    """Learns from all rows of labelled (text, lang) whose lang is not null; null texts count as empty. No rows give a model without languages."""
    rows = labelled.select("text", "lang").where(F.col("lang").isNotNull())
    langs = sorted(r.lang for r in rows.groupBy("lang").count().select("lang").limit(max_cells // 64 + 1).collect())
    if len(langs) > max_cells // 64:
        raise ValueError(f"more than {max_cells // 64} languages")
    buckets = min(MAX_BUCKETS, 1 << (max_cells // max(1, len(langs))).bit_length() - 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            of = np.array(batch[1].to_pylist(), object)
            for lang in set(of.tolist()):
                mine = np.flatnonzero(of == lang)
                total = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                total[buckets] += len(mine)
                for points, starts, _ in blocks(batch[0][i].as_py() for i in mine.tolist()):
                    total[:buckets] += np.bincount(grams(points, starts, buckets).ravel(), minlength=buckets)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(released(counted), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((buckets + 1, len(langs)))
    counts[sums["bucket"], sums["lang"].map({x: i for i, x in enumerate(langs)}).astype(int)] = sums["n"]
    docs, counts = counts[buckets], counts[:buckets] + alpha
    return Model(langs, np.log(counts / counts.sum(0)).astype(np.float32), np.log(docs / max(1, docs.sum())) if langs else docs)


def judge(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[int], list[float]]:
    """(the most probable language, its posterior, the number of places of n-grams, its mean log-probability for each place) of each text.

    UND, 0 and a mean of 0 for texts without a letter, or without a model.
    """
    scores = np.tile(model.priors, (len(texts), 1))
    places = np.zeros(len(texts), np.int64)
    for points, starts, rows in blocks(texts):
        found = grams(points, starts, len(model.log_probs))
        at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        places[rows[at]] += np.diff(np.r_[at, len(rows)])
        for k in range(len(model.langs)):
            column = model.log_probs[:, k]
            scores[rows[at], k] += sum(np.add.reduceat(column[g], at, dtype=np.float64) for g in found)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for text, row, n in zip(texts, scores, places.tolist(), strict=True):
        if not model.langs or not any(map(str.isalpha, text or "")):
            found = (UND, 0.0, n, 0.0)
        else:
            best = int(row.argmax())
            found = (model.langs[best], float(1 / np.exp(row - row[best]).sum()), n, float((row[best] - model.priors[best]) / n))
        for column, x in zip(out, found, strict=True):
            column.append(x)
    return out


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """The most probable language and its posterior; UND and 0 for texts without a letter, or without a model."""
    return judge(texts, model)[:2]


#: Texts are held against others of about their length: by the power of two of their n-gram places, up to this one.
LENGTHS = 14


class Fit(NamedTuple):
    """How well the training texts of each language fit it: mean and deviation of their mean log-probability, by length."""

    mean: np.ndarray  # langs x LENGTHS + 1
    deviation: np.ndarray


def length_of(places: int) -> int:
    return min(LENGTHS, max(1, places).bit_length() - 1)


def fit(labelled: DataFrame, model: Model, least: int = 100) -> Fit:
    """Fit of all rows of labelled (text, lang): each task adds up counts, sums and squares, so that what is gathered has a bound.

    A length with fewer than `least` texts of a language takes in the next shorter and longer ones until there are as many,
    or all of the language; a language without any has no deviation.
    """
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(sent.value.langs), LENGTHS + 1, 3))
        for batch in batches:
            for lang, _, n, mean in zip(*judge(batch.column(0).to_pylist(), sent.value), strict=True):
                if lang != UND:
                    sums[sent.value.langs.index(lang), length_of(n)] += (1, mean, mean * mean)
        at = np.nonzero(sums[:, :, 0])
        columns = [pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), *(pa.array(sums[(*at, i)]) for i in range(3))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "length", "n", "sum", "squares"])

    rows = labelled.where(F.col("lang").isNotNull()).select("text").mapInArrow(released(summed), "lang int, length int, n double, sum double, squares double")
    held = np.zeros((len(model.langs), LENGTHS + 1, 3))
    for lang, length, *sums in rows.groupBy("lang", "length").agg(*(F.sum(c) for c in ("n", "sum", "squares"))).collect():
        held[lang, length] = sums
    mean, deviation = (np.zeros(held.shape[:2]) for _ in range(2))
    for i in range(len(model.langs)):
        for j in range(LENGTHS + 1):
            wide = next((w for w in range(LENGTHS + 1) if held[i, max(0, j - w) : j + w + 1, 0].sum() >= least), LENGTHS)
            n, total, squares = held[i, max(0, j - wide) : j + wide + 1].sum(0)
            mean[i, j] = total / max(n, 1)
            deviation[i, j] = np.sqrt(max(0.0, squares / max(n, 1) - mean[i, j] ** 2))
    return Fit(mean, deviation)


def strangeness(docs: DataFrame, model: Model, fitted: Fit, *carry: Column) -> DataFrame:
    """identify() with strange: by how many deviations a text fits its language worse than training texts of its length do; null for UND."""
    sent = docs.sparkSession.sparkContext.broadcast((model, fitted))

    @F.arrow_udf("struct<lang_pred:string,score:double,strange:double>")
    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, fitted = sent.value
        try:
            for part in parts:
                langs, sure, places, means = judge(part.to_pylist(), model)
                strange = []
                for lang, n, mean in zip(langs, places, means, strict=True):
                    at = None if lang == UND else (model.langs.index(lang), length_of(n))
                    strange.append(None if at is None else float((fitted.mean[at] - mean) / max(fitted.deviation[at], 1e-3)))
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(strange, pa.float64())], ["lang_pred", "score", "strange"])
        finally:
            release()

    rows = docs.select(F.col("doc_id"), *carry, judged(F.col("text")).alias("judged"))
    return rows.select(*rows.columns[:-1], "judged.lang_pred", "judged.score", "judged.strange")


def identify(docs: DataFrame, model: Model, *carry: Column) -> DataFrame:
    """doc_id, carried columns, lang_pred, score for each row of docs (doc_id, text).

    lang_pred is a learned language, or `und` with score 0 where the text is null, empty or has no letter. Ties go to the
    language that sorts first. Whole texts are read, in pieces. Repeated rows each give a row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for part in parts:
                langs, sure = predict(part.to_pylist(), sent.value)
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])
        finally:
            release()

    rows = docs.select(F.col("doc_id"), *carry, judged(F.col("text")).alias("judged"))
    return rows.select(*rows.columns[:-1], "judged.lang_pred", "judged.score")
