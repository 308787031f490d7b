"""The registered queries over the operators of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from horocycle.llm import bpe, decontam, jaccard, langid, licenses, linededup, packing, quality, sharding, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir), words=4, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(w, k, k + 3) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT x, y, c = p.n AND c = q.n AS same FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
), copies AS (SELECT x AS doc_id, count(*) AS k FROM l WHERE same GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, 1 + coalesce(k, 0) AS n_copies FROM m LEFT JOIN n USING (doc_id) LEFT JOIN copies USING (doc_id)
"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file; workers read it from the same installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(_documents(spark, sf_dir), tokenizer_path(), limit=512)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (document, item) with at least 0.8 of the item's 5-word shingles in the document."""
    return decontam.find_items(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=5, percent=80)


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, list_slice(w, k, k + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)
), s AS (
  SELECT DISTINCT item_id, list_slice(w, k, k + 4) AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM i WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found
FROM ds JOIN s USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT r, source, text, x, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l,
         len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS words
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS x FROM d)
), dup AS (
  SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM l WHERE l <> '' GROUP BY r
), often AS (
  SELECT source, l, count(DISTINCT text) AS n FROM l WHERE l <> '' GROUP BY source, l HAVING count(DISTINCT text) >= 10
), hosts AS (
  SELECT source, count(DISTINCT text) AS docs FROM documents GROUP BY source
), above AS (
  SELECT o.source, l FROM often o JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source WHERE 100 * n >= 5 * docs
), cut AS (
  SELECT r, count(*) AS n_removed_lines, sum(words)::BIGINT AS n_removed_words
  FROM l JOIN above a ON l.source IS NOT DISTINCT FROM a.source AND l.l = a.l GROUP BY r
), g AS (
  SELECT r, k, list_slice(w, k, k + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY r
), b AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_words, 0) AS n_removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN cut USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, n_removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 80 * n_words AS kept
FROM b
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Bytes of a shard in the registered query.
SHARD_BYTES = 1 << 20


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), SHARD_BYTES)


OP4_SQL = f"""
WITH r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT depth, h >> (60 - depth) AS q, sum(n_bytes) AS b FROM r CROSS JOIN (SELECT unnest(range(0, 61))::INTEGER AS depth) GROUP BY ALL
), d AS (
  SELECT doc_id, n_bytes, h, min(depth) AS depth FROM r JOIN s ON (r.h >> (60 - s.depth)) = s.q AND s.b <= {SHARD_BYTES} GROUP BY doc_id, n_bytes, h
)
SELECT doc_id, n_bytes, substr(to_base(h, 2, 60), 1, depth) AS shard_id, depth FROM d
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path(), capacity=1024, end_id=2)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "removed")


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, k - 1 AS pos, lower(trim(regexp_replace(xs[k], '[\x20\x09-\x0D]+', ' ', 'g'))) AS l
  FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents))
), o AS (SELECT *, length(l) AS n FROM l WHERE length(l) >= 40
), f AS (SELECT l, n, min((doc_id, pos)) AS first FROM o GROUP BY l, n
), near AS (
  SELECT b.l, min(a.first) AS other FROM f a JOIN f b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.first < b.first AND levenshtein(a.l, b.l) <= 2 GROUP BY b.l
), gone AS (
  SELECT o.doc_id, o.pos FROM o JOIN f USING (l) LEFT JOIN near USING (l) WHERE (o.doc_id, o.pos) <> f.first OR near.other IS NOT NULL
), r AS (SELECT doc_id, count(*) AS n_removed, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN r USING (doc_id)
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_toxicity": op3_toxicity,
        "op4_extendible_sharding": op4_extendible_sharding,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_token_counts": op6_token_counts,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_line_dedup": op8_line_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op4_extendible_sharding": OP4_SQL, "op7_benchmark_decontamination": OP7_SQL, "op8_line_dedup": OP8_SQL}
