"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalytics.llm.chat_format import format_trees, linear_trees, read_back
from pedalytics.llm.common import table
from pedalytics.llm.divergence import audit_sources
from pedalytics.llm.exact_dedup import exact_groups
from pedalytics.llm.language_id import identify
from pedalytics.llm.language_model import score_documents
from pedalytics.llm.mixing import mix_spans, taken_words
from pedalytics.llm.near_dedup import near_groups
from pedalytics.llm.packing import pack
from pedalytics.llm.quality import score_quality
from pedalytics.llm.sharding import shard_rows
from pedalytics.llm.token_files import read_documents, write_token_files
from pedalytics.llm.vector_dedup import near_vectors
from pedalytics.llm.whitening import whiten


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), shards=24)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return rows.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=3, threshold=Fraction(85, 100))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    told = read_back(format_trees(linear_trees(rows)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return told.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = taken_words(*mix_spans(table(spark, sf_dir, "documents")))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"), min_df=30, smooth=5, top=50)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_token_files(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_minhash": op2_minhash,
    "op3_packing": op3_packing,
    "op4_language_model": op4_language_model,
    "op5_language_id": op5_language_id,
    "op6_chat_format": op6_chat_format,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_quality": op10_quality,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_files": op13_token_files,
}

# smallest id reachable from each node along ``links`` (x, y), both directions given
_REACH = """
        reach(x, r) AS (SELECT id, id FROM nodes UNION SELECT reach.x, y FROM reach JOIN links ON links.x = reach.r),
        component AS (SELECT x, min(r) AS component_id FROM reach GROUP BY x)"""

ORACLE = {
    "op2_minhash": rf"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS s
          FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(i) WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
                   FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM common JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id
                  WHERE 100 * c >= 85 * (a.n + b.n - c)),
        nodes AS (SELECT doc_id AS id FROM documents),{_REACH}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents LEFT JOIN sizes USING (doc_id) JOIN component ON x = doc_id""",
    "op9_embedding_dedup": f"""
        WITH RECURSIVE v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
            AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
                  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        nodes AS (SELECT vec_id AS id FROM embeddings),{_REACH},
        degree AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings LEFT JOIN degree USING (vec_id) JOIN component ON x = vec_id""",
    "op6_chat_format": r"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        told AS (
          SELECT conv_id, count(*) AS n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
                 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
                 CAST(sum(length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g'))
                     + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) + 16) AS BIGINT) AS formatted_chars
          FROM rows GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(learned) AS loss_chars,
               sha256(learned) AS loss_sha256, formatted_chars FROM told""",
    "op8_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS len,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
          FROM documents),
        g AS (
          SELECT norm, count(*) AS group_size, arg_min(doc_id, {'a': -len, 'b': doc_id}) AS keep_id
          FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
    "op11_source_divergence": r"""
        WITH d AS (
          SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d)
                 GROUP BY ALL HAVING count(*) >= 30),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        found AS (SELECT lang, source, term, count(*) AS c
                  FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
        cells AS (SELECT lang, source, term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) AS n
                  FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
        p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS p
              FROM cells JOIN sizes USING (lang)),
        whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS q
                  FROM (SELECT lang, term, sum(c) AS c FROM found GROUP BY lang, term)
                  JOIN (SELECT lang, sum(c) AS n FROM found GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value
                  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                  UNION ALL
                  SELECT a.lang, a.source, 'pair', b.source, abs(a.p - b.p)
                  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value
                  FROM p JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
        both_parts AS (SELECT lang, source, part, item, sum(value) AS value FROM pairs GROUP BY ALL
                       UNION ALL SELECT * FROM terms),
        ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (
                     PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
