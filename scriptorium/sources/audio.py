"""WAV files as sample arrays, and their cut at silences."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RATE = 16_000


def samples_of(data: bytes, rate: int = RATE) -> np.ndarray:
    """Mono floats in -1..1 of 16-bit PCM; channels are averaged, whole multiples of the rate are thinned."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("16-bit PCM only")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
        if w.getframerate() % rate:
            raise ValueError(f"{w.getframerate()} Hz is no multiple of {rate} Hz")
        return x[:: w.getframerate() // rate].astype(np.float32)


def read_audio(spark: SparkSession, folder: str, rate: int = RATE) -> DataFrame:
    """(audio_id, sample_rate, samples) of the WAV files of a folder."""
    files = spark.read.format("binaryFile").load(folder, pathGlobFilter="*.wav")
    return decode(files.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("name"), "content"), rate)


def decode(files: DataFrame, rate: int = RATE) -> DataFrame:
    """(audio_id, sample_rate, samples) of WAV files (name, content)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = pa.array([samples_of(data.as_py(), rate)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), values], ["audio_id", "sample_rate", "samples"])

    return files.select("name", "content").mapInArrow(rows, "audio_id string, sample_rate int, samples array<float>")


def read_frames(spark: SparkSession, folder: str, rate: int = RATE, seconds: float = 60.0) -> DataFrame:
    """frames() of the WAV files of a folder, made as a file is decoded, so that no row holds a whole file's samples."""
    size = max(1, int(rate * seconds))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = samples_of(data.as_py(), rate)
                for a in range(0, max(1, len(x)), size):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), pa.array([a], pa.int64()), pa.array([x[a : a + size]], pa.list_(pa.float32()))], ["audio_id", "sample_rate", "first", "samples"])

    files = spark.read.format("binaryFile").load(folder, pathGlobFilter="*.wav")
    return files.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("name"), "content").mapInArrow(rows, "audio_id string, sample_rate int, first long, samples array<float>")


def quiet_runs(x: np.ndarray, threshold: float) -> np.ndarray:
    """(start, end) of each run of samples below the threshold."""
    edges = np.flatnonzero(np.diff(np.r_[False, np.abs(x) < threshold, False].astype(np.int8)))
    return edges.reshape(-1, 2)


def segments(silences: list[tuple[float, float]], total: float, shortest: float = 10, longest: float = 30) -> list[tuple[float, float]]:
    """Segments of so many seconds: each silence ends one if it is long enough by then; one too long is first cut once at `longest`; a tail shorter than `shortest` goes."""
    out, start = [], 0.0
    for a, b in silences:
        if a - start < shortest:
            continue
        if a - start > longest:
            out.append((start, start + longest))
            start += longest
            continue
        out.append((start, a))
        start = b
    if total - start >= shortest:
        out.append((start, total))
    return out


def cut_at_silence(x: np.ndarray, rate: int, shortest: float = 10, longest: float = 30, threshold: float = 0.01, least: float = 1.0) -> list[tuple[float, float]]:
    """segments() of one array at its silences of at least so many seconds; one that is open at the end is none."""
    found = [(a / rate, b / rate) for a, b in quiet_runs(x, threshold).tolist() if b < len(x) and (b - a) / rate >= least]
    return segments(found, len(x) / rate, shortest, longest)


def frames(audio: DataFrame, seconds: float = 60.0) -> DataFrame:
    """(audio_id, sample_rate, first, samples): audio (audio_id, sample_rate, samples) in rows of so many seconds; first counts samples."""
    size = F.greatest(F.lit(1), (F.col("sample_rate") * seconds).cast("int"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("samples") - 1), size))
    cut = audio.select("audio_id", "sample_rate", "samples", starts.alias("start"))
    return cut.select("audio_id", "sample_rate", F.col("start").cast("long").alias("first"), F.slice("samples", F.col("start") + 1, size).alias("samples"))


def silences_of(framed: DataFrame, threshold: float = 0.01, least: float = 1.0) -> DataFrame:
    """(audio_id, sample_rate, total, silences: array of (start, end)), in samples, of frames; runs are joined over the borders of frames.

    Of a frame only its length goes on, the runs that are long enough, and those at its borders. Frames of an audio meet
    where one ends and the next begins; a run that is open at the end of the audio is no silence.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, rate, first, x in zip(*(batch.column(c) for c in ("audio_id", "sample_rate", "first", "samples")), strict=True):
                rate, first, x = rate.as_py(), first.as_py(), np.asarray(x.values)
                found = quiet_runs(x, threshold)
                keep = (found[:, 0] == 0) | (found[:, 1] == len(x)) | ((found[:, 1] - found[:, 0]) / rate >= least)
                out += [(name.as_py(), rate, first + len(x), None, None), *((name.as_py(), rate, first + len(x), first + a, first + b) for a, b in found[keep].tolist())]
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], ["audio_id", "sample_rate", "last", "start", "end"])

    found = framed.mapInArrow(runs, "audio_id string, sample_rate int, last long, start long, end long")
    order = Window.partitionBy("audio_id").orderBy("start")
    opened = found.where("start is not null").withColumn("new", (F.coalesce(F.lag("end").over(order), F.lit(-1)) != F.col("start")).cast("int"))
    joined = opened.withColumn("run", F.sum("new").over(order)).groupBy("audio_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = found.groupBy("audio_id").agg(F.first("sample_rate").alias("sample_rate"), F.max("last").alias("total"))
    listed = joined.join(whole, "audio_id").where((F.col("end") < F.col("total")) & ((F.col("end") - F.col("start")) / F.col("sample_rate") >= least))
    held = listed.groupBy("audio_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("silences"))
    return whole.join(held, "audio_id", "left").select("audio_id", "sample_rate", "total", F.coalesce("silences", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("silences"))


def split_frames(framed: DataFrame, shortest: float = 10, longest: float = 30, threshold: float = 0.01, least: float = 1.0) -> DataFrame:
    """(audio_id, seg_no, start_time, end_time) of frames, as cut_at_silence gives them of the whole array."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rate = r["sample_rate"]
                cut = segments([(x["start"] / rate, x["end"] / rate) for x in r["silences"]], r["total"] / rate, shortest, longest)
                out += [(r["audio_id"], i, a, b) for i, (a, b) in enumerate(cut)]
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], ["audio_id", "seg_no", "start_time", "end_time"])

    return silences_of(framed, threshold, least).mapInArrow(rows, "audio_id string, seg_no int, start_time double, end_time double")


def split_silence(audio: DataFrame, seconds: float = 60.0, **limits: float) -> DataFrame:
    """(audio_id, seg_no, start_time, end_time) of audio (audio_id, sample_rate, samples), frame by frame; audio without samples has none."""
    return split_frames(frames(audio, seconds), **limits)


def slice_samples(audio: DataFrame, segments: DataFrame) -> DataFrame:
    """segments with the samples between their times."""
    first = (F.col("start_time") * F.col("sample_rate")).cast("int")
    return segments.join(audio, "audio_id").withColumn("samples", F.slice("samples", first + 1, (F.col("end_time") * F.col("sample_rate")).cast("int") - first))
