"""The library's entities, derived from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"

#: Name -> (table, select list), in words that Spark and DuckDB both know.
ENTITIES: dict[str, tuple[str, str]] = {
    "chunks": ("conversations", "concat('conv_', conv_id, '_combined.txt') as document_name, cast(turn as int) as pos, cast(turn as int) as chunk_id, text, cast(turn * 30 as double) as start_time, cast(turn * 30 + 30 as double) as end_time"),
    "catalog": ("pages", "page_id as row_no, concat('show ', cast(floor(page_id / 3) as bigint), case when page_id % 3 = 0 then ' [live]' else '' end) as title, concat('https://www.youtube.com/watch?v=', cast(floor(page_id / 2) as bigint), '&t=', page_id) as url, case page_id % 5 when 0 then 'pending' when 1 then 'downloaded' when 2 then 'completed' when 3 then 'failed' else 'skipped' end as status, concat('202401', lpad(cast(page_id % 28 + 1 as varchar(9)), 2, '0')) as upload_date"),
    "edits": ("events", f"event_id as seq, concat('u', user_id) as user, event_type as document_name, {K} % 10 as chunk_id, cast(null as varchar(9)) as old_text, concat('v', event_id) as new_text, ts"),
    "attempts": ("events", f"user_id, {K} as question_id, case when event_type in ('purchase', 'click') then 1 else 0 end as is_correct, ts as answered_at"),
    "questions": ("labels", "doc_id as id, case quality when 1 then 'choice' else 'boolean' end as type, case when toxic = 1 then 'hard' when doc_id % 2 = 0 then 'easy' else 'normal' end as difficulty, case doc_id % 5 when 0 then 'pending' else 'active' end as status, concat('doc', doc_id % 20) as source_doc, concat('a', doc_id % 4) as correct_answer"),
    "files": ("orders", "o_orderkey as id, concat('f', o_orderkey) as filename, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'processing' end as status, o_orderdate as created_at"),
    "downloads": ("customer", "c_custkey as id, c_custkey * 3 as file_id, concat('http://x/', c_custkey) as url, case when c_mktsegment in ('BUILDING', 'HOUSEHOLD') then 'completed' else 'pending' end as status"),
    "jobs": ("lineitem", "l_orderkey * 8 + l_linenumber as id, l_orderkey as file_id, case l_returnflag when 'A' then 'failed' when 'N' then 'pending' else 'processing' end as status, case when l_linestatus = 'O' then l_shipdate end as started_at, case when l_linenumber = 1 then 'INTERRUPTED before' end as error_message"),
    "seen_concepts": ("part", "p_brand as name, p_type as type, p_name as description, concat('d', p_size) as document_name, concat('u', p_size % 7) as url, p_partkey as seq"),
    "relations": ("lineitem", "concat('Brand#', l_partkey % 60) as from_name, concat('Brand#', l_suppkey % 60) as to_name, concat(lower(l_returnflag), ' to ', lower(l_linestatus)) as relationship_type"),
    "vectors": ("embeddings", "vec_id as id, embedding, label"),
}


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = ENTITIES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*split_list(columns))


def split_list(columns: str) -> list[str]:
    """The items of a select list; commas within brackets or quotes don't part them."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


def sql(name: str) -> str:
    table, columns = ENTITIES[name]
    return f"{name} AS (SELECT {columns.replace(' as user,', ' as "user",')} FROM {table})"


def with_entities(query: str, *names: str) -> str:
    """query after the entities it names; a query may begin with further common table expressions."""
    head = ("WITH RECURSIVE " if " UNION ALL SELECT p.document_name" in query else "WITH ") + ", ".join(map(sql, names))
    return f"{head}, {query[5:]}" if query.startswith("WITH ") else f"{head} {query}"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct transcript titles, some with the catalog's spelling and some beyond it."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(NAMES).distinct()


NAMES = "concat('show ', s_suppkey, case s_suppkey % 4 when 1 then ' [live]' when 2 then ' part 2' when 3 then '  [LIVE]' else '' end) as name"
NAMES_SQL = f"names AS (SELECT DISTINCT {NAMES} FROM supplier)"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_name, title, kind, content) of the conversations as transcript text."""
    from scriptorium.operators.transcripts import serialize
    from scriptorium.sources.tables import named

    return named(serialize(entity(spark, sf_dir, "chunks")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")


#: Lines of the documents as chunks, the same in SQL.
LINES_SQL = "lines AS (SELECT *, length(text)::INT AS tokens FROM (SELECT concat('doc', doc_id) AS document_name, (generate_subscripts(parts, 1) - 1)::INT AS pos, unnest(parts) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_name, pos, text, tokens): the lines of each document; tokens are characters here."""
    docs = documents(spark, sf_dir).select(F.concat(F.lit("doc"), "doc_id").alias("document_name"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return docs.withColumn("tokens", F.length("text"))
