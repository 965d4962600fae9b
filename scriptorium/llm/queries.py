"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import chat_rotation, dart_minhash, decontaminate, deleted_interpolation, divergence, exact_dedup, hard_negatives, lang_id, line_dedup, maxscore, pieces, token_counts, url_filter
from scriptorium.llm.common import crc_mod, small_batches
from scriptorium.llm.vectors import scaled

RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    out = deleted_interpolation.score(read(spark, sf_dir, "documents"), ~held_out, order=2)
    return out.withColumn("held_out", held_out)


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(read(spark, sf_dir, "conversations"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=13, share=20)
    return out.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).drop("item_ids")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), RULES)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    state = token_counts.build(docs.withColumn("edits", token_counts.derived_edits(F.col("doc_id"), F.col("text"))))
    return token_counts.apply_edits(state).select("doc_id", "n_before", "n_tokens", "n_edits", "n_encoded", F.size("sizes").cast("long").alias("n_pieces"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).drop("n_points")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_classes(read(spark, sf_dir, "documents"), threshold=0.8, words=5)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(read(spark, sf_dir, "documents"), min_docs=10, min_points=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = lang_id.train(docs.where(~held_out))
    return lang_id.identify(docs, model, held_out.alias("held_out"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), scaled(F.col("embedding"), 256).alias("v"))
    return hard_negatives.mine(rows, vec_id % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op12_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=10, top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_deleted_interpolation, op2_chat_rotation, op3_decontaminate, op4_url_filter, op5_token_counts, op6_pieces, op7_exact_dedup, op8_dart_minhash, op9_line_dedup, op10_lang_id, op11_hard_negatives, op12_maxscore, op13_source_divergence)}

ORACLES: dict[str, str] = {
    "op2_chat_rotation": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS name, coalesce(text, '') AS text FROM conversations),
             s AS (SELECT DISTINCT conv_id AS cid, name AS speaker FROM t WHERE name <> 'system'),
             r AS (SELECT t.*, speaker, CASE WHEN name = 'system' THEN 'system' WHEN name = speaker THEN 'assistant' ELSE 'user' END AS role FROM t LEFT JOIN s ON conv_id IS NOT DISTINCT FROM cid),
             g AS (SELECT *, '<|' || role || '|>' || chr(10) || CASE WHEN role = 'user' THEN name || ': ' ELSE '' END || text || '<|end|>' || chr(10) AS segment FROM r),
             p AS (SELECT *, row_number() OVER w - 1 AS seq, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS char_end FROM g WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, text))
        SELECT conv_id, speaker, turn, seq, role, name, segment, char_end - length(segment) AS char_start, char_end,
          CASE WHEN role = 'assistant' THEN char_end - length(segment) + 14 ELSE char_end END AS train_start, char_end AS train_end
        FROM p""",
    "op3_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
             w AS (SELECT DISTINCT item_id, n, words[i:i + n - 1] AS win
                   FROM (SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
             sizes AS (SELECT DISTINCT n FROM w),
             p AS (SELECT doc_id, n, i, words[i:i + n - 1] AS win FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)),
             h AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.win = w.win),
             hit AS (SELECT doc_id, count(DISTINCT hit_pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS hit_pos FROM h) GROUP BY doc_id),
             items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_url_filter": r"""
        WITH parts AS (SELECT page_id,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
               FROM pages),
             fits AS (SELECT *, ('.' || host) LIKE '%.net' AND path LIKE '/%' AS net, ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' AS net_en,
                 ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' AS com_de, ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' AS org_fr FROM parts)
        SELECT page_id, host, path,
          CASE WHEN net_en THEN 'example.net/en/' WHEN net THEN 'net/' WHEN com_de THEN 'example.com/de/' WHEN org_fr THEN 'org/fr/' END AS rule,
          CASE WHEN net_en THEN 'allow' WHEN net OR com_de THEN 'block' ELSE 'allow' END AS verdict
        FROM fits""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
             k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
    "op9_line_dedup": r"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
             rows AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
             keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM rows),
             often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
             judged AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op11_hard_negatives": r"""
        WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
                   FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_maxscore": r"""
        WITH e AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
             t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
             kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 10),
             c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
             v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
             g AS (SELECT DISTINCT lang, source FROM d),
             gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
             p AS (SELECT kept.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v) AS p
                   FROM kept JOIN v USING (lang) JOIN gn USING (lang) LEFT JOIN c ON c.lang = kept.lang AND c.source = gn.source AND c.term = kept.term),
             q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS q
                   FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM gn GROUP BY 1) USING (lang) GROUP BY 1, 2),
             sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
             both_parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
                     FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                     UNION ALL SELECT p.lang, p.source, 'term', p.term, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts QUALIFY part = 'pair' OR rank <= 10""",
}
