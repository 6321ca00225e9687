"""The queries of this subpackage, by name, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_bpe import digests, encode_decode

    return digests(encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .storage import fresh_path
    from .token_file import digests, read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), fresh_path(spark, "token-files"), tokenizer("word_bpe_49k.json"), end_id=2)
    return digests(read_token_files(files))


#: Words as the shingle operators take them, for RE2: neither ASCII other than letters and digits, nor punctuation, symbols, separators.
SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F\p{P}\p{S}\p{Z}]+"


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op7_decontamination"] = rf"""
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '{SQL_WORD}') AS w FROM benchmark),
     item_grams AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
                    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
     sizes AS (SELECT item_id, k, count(*) AS n FROM item_grams GROUP BY ALL),
     doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '{SQL_WORD}') AS w FROM documents),
     doc_grams AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
                   FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                         FROM doc_words, (SELECT DISTINCT k FROM sizes) WHERE len(w) >= k))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared
FROM doc_grams JOIN item_grams USING (k, g) JOIN sizes USING (item_id, k)
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
"""


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the declared language is their ``lang``, the host their ``source``."""
    from pyspark.sql import functions as F

    from .language_id import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = identify(docs, "text", F.col("lang"), F.col("source"))
    return found.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "accepted")


@query
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: declared by the markup, with host and suffix from the address."""
    from pyspark.sql import functions as F

    from .language_id import address_parts, declared_in_markup, identify, visible_text

    pages = table(spark, sf_dir, "pages")
    pages = pages.select("page_id", "url", declared_in_markup(F.col("html")).alias("declared"), visible_text(F.col("html")).alias("text"))
    found = identify(pages, "text", F.col("declared"), *address_parts(F.col("url")))
    return found.select("page_id", "language", F.round("posterior", 6).alias("posterior"), "accepted")


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(table(spark, sf_dir, "documents"), shards=24)


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digests, fill_in_middle

    return digests(fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50))


ORACLE_SQL["op12_fill_in_middle"] = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id) AS h FROM documents),
     drawn AS (SELECT *, len(units) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
                      ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS c2, ('0x' || h[25:32])::BIGINT % 100 AS f FROM hashed),
     cut AS (SELECT *, array_to_string(units[1:least(c1, c2)], '') AS p, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
                    array_to_string(units[greatest(c1, c2) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN f < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN f < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_source_divergence"] = r"""
WITH rows AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     terms AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows),
     kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
     langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
     found AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
     sized AS (SELECT DISTINCT lang, source, coalesce(total, 0)::HUGEINT AS total FROM rows LEFT JOIN (SELECT lang, source, sum(n) AS total FROM found GROUP BY ALL) USING (lang, source)),
     shares AS (SELECT s.lang, s.source, k.term, coalesce(f.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(f.n, 0) + 5) // (s.total + 5 * l.v) AS p,
                       1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
                FROM sized s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN found f ON f.lang = s.lang AND f.source = s.source AND f.term = k.term),
     far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     found_rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
                    FROM sized a JOIN sized b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
                    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found_rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
