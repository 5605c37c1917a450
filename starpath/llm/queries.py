"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starpath.llm.decontamination import overlaps
from starpath.llm.divergence import source_divergence
from starpath.llm.exact_dedup import exact_dedup
from starpath.llm.language_id import language_id
from starpath.llm.language_model import language_model_scores
from starpath.llm.line_dedup import line_dedup
from starpath.llm.merkle import fold, leaf_of, merkle_manifest, siblings
from starpath.llm.near_dedup import near_dedup
from starpath.llm.packing import pack
from starpath.llm.sharding import shard
from starpath.llm.simhash_dedup import simhash_dedup
from starpath.llm.token_files import token_files
from starpath.llm.toxicity import toxicity


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(_documents(spark, folder)).drop("shuffled")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_documents(spark, folder)).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(_documents(spark, folder)).drop("text_hash")


def op6_spaced_seed_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    tests = spark.read.parquet(f"{folder}/benchmark.parquet")
    return overlaps(_documents(spark, folder), tests).drop("text_hash")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(_documents(spark, folder))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(_documents(spark, folder)).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_template_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(_documents(spark, folder)).select("doc_id", "text", "n_lines", "n_dropped")


def op10_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard(_documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_context_mixing_score(spark: SparkSession, folder: str) -> DataFrame:
    return language_model_scores(_documents(spark, folder))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Each row's proof is checked against a leaf made anew; one row in seven was tampered with."""
    changed = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    rows = merkle_manifest(_documents(spark, folder), also=tampered)
    folded = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        fold(F.coalesce("also", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup(_documents(spark, folder))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(_documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_context_mixing_score": op4_context_mixing_score,
    "op5_toxicity": op5_toxicity,
    "op6_spaced_seed_decontamination": op6_spaced_seed_decontamination,
    "op7_language_id": op7_language_id,
    "op8_token_files": op8_token_files,
    "op9_template_line_dedup": op9_template_line_dedup,
    "op10_histogram_shards": op10_histogram_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_source_divergence": op13_source_divergence,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32 of the decimal doc_id: per byte one step that takes it in and eight that shift.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
            string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, x: CASE WHEN x < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, x) END))"""

CHECKS: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE l AS (
            SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS claimed,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                   count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (ORDER BY lang, doc_id, leaf) AS r
            FROM (SELECT doc_id, lang, sha256(head || size || tail) AS leaf, sha256(head || more || tail) AS changed, crc
                  FROM (SELECT doc_id, lang,
                               coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                               || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                               coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size,
                               coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
                               coalesce(strlen(text) || ':' || text, '-') AS tail,
                               {_CRC} AS crc
                        FROM documents))),
        t(level, lang, i, n, node) AS (
            SELECT 0, lang, i, n, leaf FROM l
            UNION ALL
            SELECT level + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i))
            FROM t WHERE n > 1 GROUP BY level, lang, i // 2, n),
        s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
              FROM t WHERE n = 1),
        u(level, i, n, node) AS (
            SELECT 0, i, n, subroot FROM s
            UNION ALL
            SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2, n),
        steps AS (
            SELECT l.r, v.level, (l.i >> v.level) & 1 AS side, coalesce(t.node, '') AS other
            FROM l JOIN (SELECT DISTINCT lang, level FROM t WHERE n > 1) v ON l.lang IS NOT DISTINCT FROM v.lang
            LEFT JOIN t ON t.lang IS NOT DISTINCT FROM v.lang AND t.level = v.level AND t.i = xor(l.i >> v.level, 1)
            UNION ALL
            SELECT l.r, 1000 + v.level, (s.i >> v.level) & 1, coalesce(u.node, '')
            FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT DISTINCT level FROM u WHERE n > 1) v
            LEFT JOIN u ON u.level = v.level AND u.i = xor(s.i >> v.level, 1)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM steps),
        f(r, k, node) AS (
            SELECT r, 0, claimed FROM l
            UNION ALL
            SELECT f.r, f.k + 1, sha256(CASE WHEN side = 1 THEN other || node ELSE node || other END)
            FROM f JOIN numbered ON numbered.r = f.r AND numbered.k = f.k + 1),
        folded AS (SELECT r, arg_max(node, k) AS folded_root FROM f GROUP BY r),
        proofs AS (SELECT r, string_agg(other, '' ORDER BY level) AS proof FROM steps GROUP BY r)
        SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
               folded_root, folded_root = (SELECT node FROM u WHERE n = 1) AS verified
        FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN folded USING (r) LEFT JOIN proofs USING (r)""",
    "op13_source_divergence": f"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
                          row_number() OVER () AS r
                   FROM documents),
        w AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        v AS (SELECT lang, count(*) AS vocabulary, sum(n) AS total FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        own AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
        shares AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
                          1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(own.total, 0) + vocabulary)::HUGEINT AS p,
                          1 + 1000000000::HUGEINT * (kept.n + 1) // (v.total + vocabulary)::HUGEINT AS lang_p
                   FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
                   LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                 FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - lang_p) * (p - lang_p) // lang_p)::BIGINT FROM shares WHERE n > 0 AND p > lang_p)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM found QUALIFY part = 'pair' OR rank <= 200""",
}
