"""One registered query for each operator of this subpackage."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.llm import (
    classifier,
    conversation_repair,
    decontamination,
    html_text,
    length_histogram,
    line_rules,
    link_trust,
    packing,
    prefix_trie,
    secret_ledger,
    sharding,
    simhash,
    warc,
)
from contentloom.session import stage_folder

QUERIES = {}
ORACLES = {
    "op1_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d,
                          strlen(coalesce(html, '')) AS n FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
        FROM f""",
    "op12_link_trust": r"""
        WITH RECURSIVE p AS (
          SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        j AS (SELECT *, CASE
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
            CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
              WHEN 'org/fr/' THEN 'allow' END AS ruled FROM p),
        s AS (SELECT host, CASE WHEN 2 * count(*) FILTER (ruled = 'allow') > count(*) THEN 'allow'
            WHEN 2 * count(*) FILTER (ruled = 'block') > count(*) THEN 'block' END AS walk
          FROM j WHERE host <> '' GROUP BY host),
        l AS (SELECT host AS source, target, count(*) AS n FROM (
            SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(html,
              '(?i)<a\s[^>]*?\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''>\s]+)', 1),
              lambda h: translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS target FROM p)
          WHERE host <> '' AND host <> target GROUP BY ALL),
        e AS (SELECT 'allow' AS walk, source AS host, target AS goal, n / sum(n) OVER (PARTITION BY source) AS share FROM l
          UNION ALL SELECT 'block', target, source, n / sum(n) OVER (PARTITION BY target) FROM l),
        m AS (SELECT 0 AS step, walk, host,
            CAST(floor(150000000000000 / count(*) OVER (PARTITION BY walk)) AS BIGINT) AS mass FROM s WHERE walk IS NOT NULL
          UNION ALL SELECT step + 1, walk, goal, CAST(sum(CAST(floor(mass * 0.85::DOUBLE * share) AS BIGINT)) AS BIGINT)
          FROM m JOIN e USING (walk, host) WHERE step < 29 AND mass > 0 GROUP BY step, walk, goal),
        t AS (SELECT host, coalesce(sum(mass) FILTER (walk = 'allow'), 0) AS trust,
            coalesce(sum(mass) FILTER (walk = 'block'), 0) AS distrust FROM m GROUP BY host)
        SELECT page_id, j.host, path, rule,
          coalesce(ruled, CASE WHEN distrust > (trust + distrust) * 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM j LEFT JOIN t ON j.host = t.host""",
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.Archive(spark, fresh_folder(spark, "warc"))
    warc.write_archive(table(spark, sf_dir, "pages"), archive)
    return warc.read_records(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_ledger.Ledger(spark, fresh_folder(spark, "ledger"))
    found = secret_ledger.scan(table(spark, sf_dir, "documents"), ledger)
    base = [r.name for r in secret_ledger.BASE_RULES]

    def count(rule: str):
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")

    base_spans = F.filter("spans", lambda s: s["rule"].isin(base))
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(rule) for rule in base),
        F.sha2(secret_ledger.spans_text(base_spans).cast("binary"), 256).alias("base_sha256"),
        secret_ledger.spans_text(F.col("spans")).alias("spans"),
    )


#: Bytes of text in a shard at most.
SHARD_BYTES = 32 << 20


@query
def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES).withColumnRenamed("id", "doc_id")


@query
def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: Vocabulary file of the public tokenizer, of an installed library on every machine.
TOKENIZER = "word_bpe_49k.json"


@query
def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(spark, docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("id", "doc_id")


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontamination.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


@query
def op7_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = line_rules.fit(docs, table(spark, sf_dir, "labels"))
    ruled = line_rules.apply_rules(spark, docs, field)
    return ruled.select(F.col("id").alias("doc_id"), *line_rules.NAMES, "base_failed", "kept", "content_share")


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.length_answers(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(spark, docs, model).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id",
        classifier.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"),
    )


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


# The rules of the contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op12_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = link_trust.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audit_conversations(table(spark, sf_dir, "conversations"))
