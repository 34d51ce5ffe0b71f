"""The numbered queries over the test tables and their SQL; every one runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.llm import (
    alignment,
    decontaminate,
    fingerprint,
    html,
    licenses,
    minhash,
    mixing,
    packing,
    quality,
    tokenfiles,
    tokens,
    toxicity,
    urls,
    whitening,
)
from postlens.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.train(docs, read(spark, sf_dir, "labels")))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the model never sees the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())


@query("op7_minhash_dedup")
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_classes(read(spark, sf_dir, "documents"))


@query("op8_source_mixing")
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents with their place in the mixture; no source is repeated over twice as often as another."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("tokens"))
    return mixing.mix(docs, tokens="tokens")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids as pieces of sequences."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokens.vocabulary_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


@query("op3_license_scan", licenses.oracle())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, licence and notices of every document."""
    return licenses.scan(read(spark, sf_dir, "documents"))


URL_ORACLE = """
WITH parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
addressed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(
    regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(index\\.html?|default\\.aspx?)$', ''), '/$', '') END AS address FROM parts),
fits AS (
  SELECT p.page_id, p.host, p.path, r.verdict, r.rule,
    row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(r.rule) DESC, r.rule) AS place
  FROM parts p JOIN (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
    ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'),
    ('block', 'net/fr/', 'net', '/fr/')) r(verdict, rule, name, start)
  ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.start)),
listed AS (SELECT address FROM addressed WHERE address IS NOT NULL GROUP BY address HAVING count(*) > 1)
SELECT a.page_id, a.host, a.path, f.rule,
  CASE WHEN f.rule IS NOT NULL THEN f.verdict WHEN l.address IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  f.rule IS NULL AND l.address IS NOT NULL AS listed
FROM addressed a LEFT JOIN fits f ON f.page_id = a.page_id AND f.place = 1 LEFT JOIN listed l ON l.address = a.address
"""


@query("op6_url_filter", URL_ORACLE)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; listed are the addresses that more than one page claims."""
    pages = read(spark, sf_dir, "pages")
    return urls.judge(pages, urls.shared_addresses(pages))


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back from them."""
    files = tokenfiles.write(read(spark, sf_dir, "documents"), tokens.vocabulary_path())
    rows = tokenfiles.read(files)
    return rows.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


LEAK_ORACLE = """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
items AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
cuts AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM cuts),
places AS (
  SELECT row, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM words, (SELECT DISTINCT n FROM windows)),
hits AS (
  SELECT p.row, p.i, p.n, x.item FROM (SELECT row, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM places) p
  JOIN windows x ON x.n = p.n AND x.gram = p.gram),
covered AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS place FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""


@query("op11_benchmark_decontamination", LEAK_ORACLE)
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside benchmark windows, and the items they come from."""
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).drop("spans")


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable embedding on up to 16 components."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query("op12_cross_tokenizer_alignment")
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' ids in every document, with the corpus-wide counts of the linked pairs."""
    paths = tokens.vocabulary_path(alignment.A_FILE), tokens.vocabulary_path(alignment.B_FILE)
    return alignment.align(read(spark, sf_dir, "documents"), *paths)
