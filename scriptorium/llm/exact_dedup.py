"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its normalised UTF-8 bytes modulo two primes. Chunks are hashed alone and
combined by H(ab) = H(a) * B^len(b) + H(b), so that the chunks of a huge text can be hashed by many tasks. Texts of
equal length and fingerprint are then compared chunk by chunk: for each chunk number the least and the greatest chunk
of a group are kept as the rows stream by, and the group is equal if these agree everywhere. A group that fails (a
collision) is split by SHA-256, so the result is exact whatever the hashes do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import BROADCAST_ROWS, id_type, released, small, table

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_812_433_253)
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNK_BYTES = 1 << 16
HUGE_BYTES = 8 << 20
SCHEMA = "doc_id {}, n_points long, n_bytes long, f1 long, f2 long, text_sha256 string, huge boolean"
CHUNKS = "part int, n_bytes long, h1 long, h2 long, p1 long, p2 long"
KEY = ["n_bytes", "f1", "f2"]


@cache
def powers(k: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * BASES[k] % PRIMES[k]
    return out[::-1].copy()


def chunk_hash(chunk: bytes, k: int, most: int) -> int:
    """Polynomial hash of at most `most` <= 2^24 bytes; sums stay below 2^63."""
    return int(np.dot(np.frombuffer(chunk, np.uint8).astype(np.int64) + 1, powers(k, most)[most - len(chunk) :])) % PRIMES[k]


def fingerprint(data: bytes, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int]:
    out = []
    for k in (0, 1):
        h = 0
        for i in range(0, len(data), chunk_bytes):
            chunk = data[i : i + chunk_bytes]
            h = (h * pow(BASES[k], len(chunk), PRIMES[k]) + chunk_hash(chunk, k, chunk_bytes)) % PRIMES[k]
        out.append(h)
    return out[0], out[1]


def fingerprints(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text), written to the shared folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch[1]:
                text = text.as_py() or ""
                data = text.encode().translate(None, SPACE)
                huge = len(data) > huge_bytes
                out.append((len(text), len(data), *((None, None) if huge else fingerprint(data, chunk_bytes)), hashlib.sha256(data).hexdigest(), huge))
            names = ["doc_id", "n_points", "n_bytes", "f1", "f2", "text_sha256", "huge"]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names)

    base = docs.select("doc_id", "text")
    found = table(base.mapInArrow(released(rows), SCHEMA.format(id_type(docs))), "fingerprints")
    if found.where("huge").isEmpty():
        return found
    huge = base.select("text", normalised("text").alias("data")).where(F.octet_length("data") > huge_bytes)
    return table(found.where("not huge").unionByName(with_prints(found.where("huge"), huge, chunk_bytes)), "fingerprints")


def normalised(text: str) -> F.Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACE.decode(), "").cast("binary")


def with_chunks(df: DataFrame, chunk_bytes: int) -> DataFrame:
    """Explodes the binary column data into (part, chunk); an empty text has one empty chunk."""
    parts = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / chunk_bytes)).cast("int")
    return df.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).withColumn("chunk", F.expr(f"substring(data, part * {chunk_bytes} + 1, {chunk_bytes})")).drop("data")


def with_prints(found: DataFrame, huge: DataFrame, chunk_bytes: int) -> DataFrame:
    """Fingerprints of huge texts: their chunks are dealt to all tasks, hashed there, and combined by text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            made = [pa.array([chunk_hash(c, k, chunk_bytes) for c in chunks], pa.int64()) for k in (0, 1)]
            made += [pa.array([pow(BASES[k], len(c), PRIMES[k]) for c in chunks], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("text_sha256"), batch.column("part"), *made], ["text_sha256", "part", "h1", "h2", "p1", "p2"])

    chunks = with_chunks(huge.select(F.sha2("data", 256).alias("text_sha256"), "data"), chunk_bytes)
    hashed = chunks.repartition("text_sha256", "part").mapInArrow(released(rows), "text_sha256 string, part int, h1 long, h2 long, p1 long, p2 long")
    ordered = F.sort_array(F.collect_set(F.struct("part", "h1", "h2", "p1", "p2")))  # narrow: 40 bytes for each 64 KB of a text
    fold = lambda k: F.aggregate("parts", F.lit(0).cast("long"), lambda h, x: (h * x[f"p{k}"] + x[f"h{k}"]) % PRIMES[k - 1])
    prints = hashed.groupBy("text_sha256").agg(ordered.alias("parts")).select("text_sha256", fold(1).alias("f1"), fold(2).alias("f2"))
    return found.drop("f1", "f2").join(prints, "text_sha256").select(*found.columns)


def unequal_keys(docs: DataFrame, members: DataFrame, chunk_bytes: int = CHUNK_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Keys of members (text_sha256, *KEY) whose texts are not all equal. Texts meet their key by SHA-256, so that null and repeated ids count."""
    texts = docs.select(normalised("text").alias("data")).withColumn("text_sha256", F.sha2("data", 256))
    texts = texts.join(small(members, broadcast_rows), "text_sha256")
    chunks = with_chunks(texts.drop("text_sha256"), chunk_bytes)
    return chunks.groupBy(*KEY, "part").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("least <> most").select(*KEY).distinct()


def exact_dedup(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, huge_bytes: int = HUGE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points for each row of docs (doc_id, text; other columns are ignored).

    Texts are equal if they are after all of [\\x20\\x09-\\x0D] is deleted; null counts as empty. The row with the most
    code points stays, then the one with the smallest doc_id (a null id comes before all others). Rows that repeat one
    doc_id each give a row; if they tie for a group, each of them counts as kept. No rows in, no rows out.
    """
    prints = fingerprints(docs, chunk_bytes, huge_bytes)
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").alias("id")))
    groups = lambda df, key: df.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    several = table(groups(prints, KEY), "groups")
    members = table(prints.join(small(several.select(*KEY), broadcast_rows), KEY, "left_semi").select("text_sha256", *KEY).distinct(), "members")
    unequal = table(unequal_keys(docs, members, chunk_bytes, broadcast_rows), "unequal")
    key = KEY
    if not unequal.isEmpty():
        prints = prints.join(unequal.withColumn("split", F.lit(True)), KEY, "left").withColumn("split", F.when(F.col("split"), F.col("text_sha256")).otherwise(""))
        key = [*KEY, "split"]
        several = table(groups(prints, key), "groups")
    out = prints.join(small(several, broadcast_rows), key, "left")
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", "n_points")
