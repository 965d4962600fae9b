"""The knowledge graph as tables: chunks, concepts, mentions and relations, counts, and vector search."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scriptorium.functions.text import clean_json, rel_type
from scriptorium.sources.scratch import written
from scriptorium.sources.store import Store

PAYLOAD = "struct<concepts:array<struct<name:string,type:string,description:string,origin_chunks:array<int>>>,relationships:array<struct<`from`:string,`to`:string,type:string,description:string>>>"


def extract_payload(replies: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and relationships of model replies (key columns, response); replies that aren't the JSON asked for give none."""
    parsed = replies.select(*key, F.from_json(clean_json(F.col("response")), PAYLOAD).alias("p"))
    concepts = parsed.select(*key, F.explode("p.concepts").alias("c")).select(*key, "c.*").where("name is not null")
    return concepts, parsed.select(*key, F.explode("p.relationships").alias("r")).select(*key, "r.*")


def concept_rows(seen: DataFrame) -> DataFrame:
    """(name, type, description, latest): the last values of each name of seen (name, type, description, .., seq)."""
    return seen.groupBy("name").agg(F.max_by(F.struct("type", "description"), "seq").alias("l"), F.max("seq").alias("latest")).select("name", "l.type", "l.description", "latest")


def concept_sources(seen: DataFrame) -> DataFrame:
    """(name, kind, value, first): each document and url in which a name was seen, and when first; blank ones are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("document", "document_name"), ("url", "url")))))
    rows = seen.select("name", "seq", each.alias("s")).select("name", "s.kind", "s.value", "seq").where(F.coalesce("value", F.lit("")) != "")
    return rows.groupBy("name", "kind", "value").agg(F.min("seq").alias("first"))


def add_concepts(concepts: DataFrame, more: DataFrame) -> DataFrame:
    """concept_rows of all that both have seen."""
    last = F.max_by(F.struct("type", "description", "latest"), "latest")
    return concepts.unionByName(more).groupBy("name").agg(last.alias("l")).select("name", "l.*")


def add_sources(sources: DataFrame, more: DataFrame) -> DataFrame:
    """concept_sources of all that both have seen."""
    return sources.unionByName(more).groupBy("name", "kind", "value").agg(F.min("first").alias("first"))


def concept_view(concepts: DataFrame, sources: DataFrame, most: int = 1000) -> DataFrame:
    """(name, type, description, document_name, url, n_documents): with the first `most` documents and urls, comma-joined in first-seen order.

    What a name was seen in stays one row each in sources; only `most` of them meet in a row here, and the count tells of all.
    """
    rank = F.row_number().over(Window.partitionBy("name", "kind").orderBy("first", "value"))
    head = sources.withColumn("rank", rank).where(F.col("rank") <= most)
    listed = lambda k: F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "value"))))["value"], ",")
    joined = head.groupBy("name").agg(listed("document").alias("document_name"), listed("url").alias("url"))
    counted = sources.groupBy("name").agg(F.count_if(F.col("kind") == "document").alias("n_documents"))
    out = concepts.join(joined, "name", "left").join(counted, "name", "left")
    return out.select("name", "type", "description", F.coalesce("document_name", F.lit("")).alias("document_name"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def merge_concepts(seen: DataFrame, most: int = 1000) -> DataFrame:
    """concept_view of one batch of (name, type, description, document_name, url, seq): last values win, sets grow in first-seen order."""
    return concept_view(concept_rows(seen), concept_sources(seen), most)


def store_concepts(concepts: Store, sources: Store, seen: DataFrame) -> None:
    """Merges a batch into two stores by name (concept_rows and concept_sources); a batch that comes twice changes nothing."""
    concepts.apply(concept_rows(seen), add_concepts)
    sources.apply(concept_sources(seen), add_sources)


def relation_edges(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distinct relations whose both ends are concepts."""
    names = concepts.select("name").distinct()
    known = relations.join(names.withColumnRenamed("name", "from_name"), "from_name", "left_semi").join(names.withColumnRenamed("name", "to_name"), "to_name", "left_semi")
    return known.withColumn("relationship_type", rel_type(F.col("relationship_type"))).distinct()


def mention_edges(concepts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_name, chunk_id, concept_name): concepts (document_name, name, origin_chunks) in those of their chunks, by position, that hold the name in any case."""
    placed = concepts.select("document_name", "name", F.explode("origin_chunks").alias("pos"))
    hit = placed.join(chunks.select("document_name", "pos", "chunk_id", "text"), ["document_name", "pos"]).where(F.lower("text").contains(F.lower("name")))
    return hit.select("document_name", "chunk_id", F.col("name").alias("concept_name")).distinct()


def detect_origin(concepts: DataFrame, grouped: DataFrame) -> DataFrame:
    """concepts (document_name, grp, name) with origin_chunks: the positions of their group whose text holds the name, else the group's first."""
    both = concepts.join(grouped.select("document_name", "grp", "pos", "text"), ["document_name", "grp"])
    found = both.groupBy("document_name", "grp", "name").agg(F.sort_array(F.collect_list(F.when(F.lower("text").contains(F.lower("name")), F.col("pos")))).alias("hits"), F.min("pos").alias("first"))
    return found.select("document_name", "grp", "name", F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array("first")).alias("origin_chunks"))


def delete_documents(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Tables with a document_name, without the documents gone."""
    return [t.join(gone.select("document_name").distinct(), "document_name", "left_anti") for t in tables]


def delete_chunks(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    key = ["document_name", "chunk_id"]
    return [t.join(gone.select(*key).distinct(), key, "left_anti") for t in tables]


def counts(**tables: DataFrame) -> DataFrame:
    """(label, n) of each table."""
    out = None
    for label, table in tables.items():
        part = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def removed(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(label, removed): how many rows each table has lost."""
    lost = counts(**before).join(counts(**after).withColumnRenamed("n", "left"), "label")
    return lost.select("label", (F.col("n") - F.col("left")).alias("removed"))


def chunks_of_concept(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that mention a concept: mentions (document_name, chunk_id, concept_name) with the chunk's text."""
    return mentions.join(chunks.select("document_name", "chunk_id", "text"), ["document_name", "chunk_id"]).select("document_name", "chunk_id", "concept_name", "text")


def related_concepts(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relations between two concepts (name, document_name) with both ends' documents."""
    end = lambda side: concepts.select(F.col("name").alias(f"{side}_name"), F.col("document_name").alias(f"{side}_document"))
    return relations.join(end("from"), "from_name").join(end("to"), "to_name").select("from_name", "relationship_type", "to_name", "from_document", "to_document")


def chunk_concept_context(mentions: DataFrame, chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """Chunk, mention and concept (name, type, description) rows for a question's context."""
    return chunks_of_concept(mentions, chunks).join(concepts.select(F.col("name").alias("concept_name"), "type", "description"), "concept_name")


def schema(**tables: DataFrame) -> DataFrame:
    """(label, property, type, n): the tables' columns and how many rows have a value; one scan of each table."""
    out = None
    for label, t in tables.items():
        sums = t.agg(*(F.count(F.col(f"`{f.name}`")).alias(str(i)) for i, f in enumerate(t.schema.fields)))
        rows = F.array(*(F.struct(F.lit(f.name).alias("property"), F.lit(f.dataType.simpleString()).alias("type"), F.col(str(i)).alias("n")) for i, f in enumerate(t.schema.fields)))
        part = sums.select(F.lit(label).alias("label"), F.explode(rows).alias("p")).select("label", "p.*")
        out = part if out is None else out.unionByName(part)
    return out


def doc_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_name").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("start_time").isNotNull()).alias("n_timed"), F.sum("tokens").alias("n_tokens"))


def question_context(records: DataFrame, key: str, order: str, rows: int = 50, text: int = 500) -> DataFrame:
    """(key, context): the first records of each key, their text cut, joined line by line."""
    line = F.concat(F.substring("text", 1, text), F.lit(" | "), F.substring("meta", 1, 300))
    records = records.select(key, order, line.alias("line"))  # cut before they are dealt and ranked
    ranked = records.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rn") <= rows)
    return ranked.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("rn", "line")))["line"], "\n").alias("context"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, block_queries: int = 5000, block_vectors: int = 50_000) -> DataFrame:
    """(query_id, rank, id, score): for each query (id, embedding) the k nearest vectors (id, embedding) by cosine, ties to the smaller id.

    Both sides are dealt to blocks of about so many rows; a task compares one block of queries with one of vectors and sends on
    at most k rows for each query. Rows without an id, and null or zero vectors, which have no direction, are left out.
    """

    def dealt(df: DataFrame, column: str, rows: int) -> tuple[DataFrame, int]:
        df = df.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null")
        blocks = max(1, -(-df.count() // rows))
        return df.withColumn(column, F.pmod(F.xxhash64("id", "embedding"), F.lit(blocks))), blocks

    asked, n_asked = dealt(queries, "query_block", block_queries)
    held, n_held = dealt(vectors, "vector_block", block_vectors)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    keys = ["query_block", "vector_block"]
    pairs = asked.withColumn("vector_block", each(n_held)).groupBy(*keys).cogroup(held.withColumn("query_block", each(n_asked)).groupBy(*keys))
    found = pairs.applyInArrow(lambda q, v: _nearest(q, v, k), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _directions(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a vector with a direction, their unit vectors)."""
    rows = table.column("embedding").combine_chunks()
    matrix = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    ok = norms[:, 0] > 0
    return ok, matrix[ok] / norms[ok]


def _units(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the rows whose vector has a direction."""
    ok, units = _directions(table)
    return table.column("id").to_numpy()[ok], units


def _nearest(queries: pa.Table, vectors: pa.Table, k: int, step: int = 1024) -> pa.Table:
    """(query_id, id, score): the k nearest vectors of each query within one block of each."""
    (asked, of), (ids, units) = _units(queries), _units(vectors)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # row of the query, id, score
    for a in range(0, len(ids) if len(asked) else 0, step):
        scores = np.round(of @ units[a : a + step].T, 9)
        least = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else -np.inf
        row, at = np.nonzero(scores >= least)
        row, near, score = (np.concatenate(x) for x in zip(best, (row, ids[a + at], scores[row, at]), strict=True))
        order = np.lexsort((near, -score, row))
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
        best = row[keep], near[order][keep], score[order][keep]
    return pa.table({"query_id": asked[best[0]], "id": best[1], "score": best[2]})


def vector_topk_by_cells(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 64, sample: int = 4096, block_queries: int = 5000, block_vectors: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(vector_topk's rows, visits (query_id, visited, cells)): as vector_topk, but a query skips cells that can't hold a nearer vector.

    Every vector is dealt to the nearest of at most `cells` centres, which are fitted to the `sample` vectors with the least hashes
    of their ids; a cell's radius is its greatest angle to the centre. A query first searches the cell of its own
    nearest centre. Its k-th score then rules out, by the triangle inequality on angles, each cell whose centre is further
    away than its radius and that score allow; all others are searched. So results are exact whatever the centres are, and
    vectors without structure merely lead to all cells. Cells of more than block_vectors are dealt to several blocks.
    """
    spark = vectors.sparkSession
    rows = lambda df: df.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null")
    held, asked = written(rows(vectors), "vectors"), rows(queries)
    some = held.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # at most `sample` vectors
    centres = _centres(_units(some)[1], cells)
    if not len(centres):
        none = spark.createDataFrame([], "query_id long, visited long, cells long")
        return vector_topk(vectors, queries, k), none
    sent = spark.sparkContext.broadcast(centres)

    def nearest_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, units = _directions(pa.Table.from_batches([batch]))
            if ok.any():
                near = units @ sent.value.T
                kept = batch.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near.argmax(1).astype(np.int32)), pa.array(np.arccos(np.clip(near.max(1), -1, 1)))], ["id", "embedding", "cell", "angle"])

    kind = f"id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, cell int, angle double"
    celled = written(held.mapInArrow(nearest_cell, kind), "celled")
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()  # a row for each cell
    parts = {r.cell: -(-r.n // block_vectors) for r in sizes}
    radii = {r.cell: r.radius for r in sizes}
    pieces = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("cell")), F.lit(0))
    there = celled.select("id", "embedding", "cell", F.pmod(F.xxhash64("id", "embedding"), pieces).cast("int").alias("piece"))
    homes = written(asked.mapInArrow(nearest_cell, kind), "homes")
    n = max(1, -(-homes.count() // block_queries))

    def searched(wanted: DataFrame) -> DataFrame:
        """Queries (id, embedding, cell) in the pieces of their cells."""
        each = wanted.withColumn("piece", F.explode(F.when(pieces > 0, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array().cast("array<int>"))))
        dealt = each.withColumn("query_block", F.pmod(F.xxhash64("id", "embedding"), F.lit(n)).cast("int"))
        copies = there.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        keys = ["query_block", "cell", "piece"]
        return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(lambda q, v: _nearest(q, v, k), "query_id long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    at_home = written(searched(homes), "at_home")
    kth = best(at_home).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    known = homes.join(kth, "id", "left").select("id", "embedding", "cell", F.coalesce("kth", F.lit(-2.0)).alias("kth"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.array(sorted(radii))
        for batch in batches:
            units = _units(pa.Table.from_batches([batch]))[1]
            angle = np.arccos(np.clip(units @ sent.value[cells].T, -1, 1)) - np.array([radii[c] for c in cells])
            most = np.cos(np.clip(angle, 0, np.pi)) + 1e-7  # for rounding
            row, at = np.nonzero((most >= batch.column("kth").to_numpy()[:, None]) & (cells != batch.column("cell").to_numpy()[:, None]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("id", "embedding")), pa.array(cells[at].astype(np.int32))], ["id", "embedding", "cell"])

    near = written(known.mapInArrow(others, kind.rsplit(",", 1)[0]), "near")
    found = best(at_home.unionByName(searched(near))).select("query_id", "rank", "id", "score")
    visits = homes.select("id").unionByName(near.select("id")).groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("visited")).withColumn("cells", F.lit(len(radii)).cast("long"))
    return found, visits


def _centres(units: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """At most `cells` unit vectors: the first ones, moved to the mean of what is nearest to them a few times."""
    centres = units[:cells]
    for _ in range(rounds if len(units) > cells else 0):
        near = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def hash_embed(texts: list[str], size: int = 64) -> list[list[float]]:
    """The default embedder, deterministic: signed counts of hashed words, of unit length."""
    out = []
    for text in texts:
        v = np.zeros(size)
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            v[h % size] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


def embed(rows: DataFrame, text: str, column: str = "embedding", model: Callable[[list[str]], list[list[float]]] = hash_embed, batch: int = 100, most_tokens: int | None = None, tokens: str = "tokens") -> DataFrame:
    """rows with the model's vector of their text; texts above most_tokens get null. The model is called with up to `batch` texts."""
    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = []
            for a in range(0, len(part), batch):
                out += model(part.iloc[a : a + batch].tolist())
            yield pd.Series(out)

    made = vectors(F.coalesce(F.col(text), F.lit("")))
    return rows.withColumn(column, made if most_tokens is None else F.when(F.col(tokens) <= most_tokens, made))


def embed_in_batches(packed: DataFrame, model: Callable[[list[str]], list[list[float]]] = hash_embed, text: str = "text") -> DataFrame:
    """packed (document_name, pos, pack, ..) with embedding: the model is called once for each pack, with its texts in order of pos."""
    schema = T.StructType([*packed.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def embedded(pack: pa.Table) -> pa.Table:
        pack = pack.sort_by("pos")
        made = model([x or "" for x in pack[text].to_pylist()])
        return pack.append_column("embedding", pa.array(made, pa.list_(pa.float32())))

    return packed.groupBy("document_name", "pack").applyInArrow(embedded, schema)


def answered(rows: DataFrame, function: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """rows with the function's response to each prompt, and error; all other columns are carried, so that nothing is joined back.

    A null prompt is not asked and gives nulls; an exception gives null and its message.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    at = rows.columns.index(prompt)

    def replied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for text in batch.column(at).to_pylist():
                reply = error = None
                if text is not None:
                    try:
                        reply = function(text)
                    except Exception as e:  # a model's failure is data here
                        error = str(e)
                out.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, "response", "error"])

    return rows.mapInArrow(replied, schema)


def apply_text_fn(prompts: DataFrame, key: str, function: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """(key, response, error): the function's reply to each prompt, as in answered()."""
    return answered(prompts.select(key, prompt), function, prompt).drop(prompt)
