"""Registered queries of the llm operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import session
from threatlake.llm import (bpe, embedding_dedup, exact_dedup, filter_audit, importance, language_model, minhash, mixing, quality, secret_scan,
                            substring_dedup, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(session.prepare(spark), sf_dir)
        return function
    return add


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op6_compression_bands")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@_query("op9_circulant_minhash")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op4_trigram_secrets")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans, kinds = F.col("secrets"), [r.kind for r in secret_scan.BASE_RULES]
    counts = [(F.size(spans) - F.size(F.array_remove(spans["kind"], k))).cast("bigint").alias(f"n_{k}") for k in kinds]
    base = secret_scan.joined(F.filter(spans, lambda s: s["kind"].isin(kinds)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


@_query("op8_forced_boundaries")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary_path(), decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op10_block_mix")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@_query("op3_backoff_automaton")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


@_query("op1_cross_polytope")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query("op5_content_addressed")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.new_archive(spark)
    warc.write(table(spark, sf_dir, "pages"), archive)
    return warc.index(spark, archive).withColumnRenamed("page", "page_id")


#: Python's own base 32 is out of reach of SQL, so the digest is spelt out five hex digits at a time.
ORACLES["op5_content_addressed"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS hexed FROM p),
b AS (SELECT d.*, list_aggregate([
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || substr(hexed, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31)]
    FOR i IN range(32)], 'string_agg', '') AS payload_digest, max(page_id) OVER (PARTITION BY hexed) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b"""


@_query("op7_sentence_spans")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, counts=("n_sentences", "n_removed"))


@_query("op2_convolutional_toxicity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model, limits = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=toxicity.fold(F.col("id"), 4) != 2)
    return toxicity.score(docs, model, limits).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "lang", "threshold", "flagged")


@_query("op13_heavy_hitters")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


ORACLES["op13_heavy_hitters"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)"""


@_query("op11_radix_resampling")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 is spelt out byte by byte, once for each distinct word.
ORACLES["op11_radix_resampling"] = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
        lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS tab),
texts AS (SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark),
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
per_word AS (SELECT word, count(doc_id) AS s, count(*) - count(doc_id) AS t FROM words GROUP BY word),
hashed AS (SELECT word, s, t, xor(list_reduce([4294967295] || list_transform(range(length(hex(word)) // 2),
        lambda i: CAST('0x' || substr(hex(word), 2 * i + 1, 2) AS BIGINT)),
        lambda v, b: xor(v // 256, tab[xor(v, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM per_word, crc),
buckets AS (SELECT bucket, CAST(floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * (sum(sum(s)) OVER () + 10000)
    / ((CAST(sum(s) AS DOUBLE) + 1) * (sum(sum(t)) OVER () + 10000)))) AS BIGINT) AS gain FROM hashed GROUP BY bucket),
weighed AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM words JOIN hashed USING (word) JOIN buckets USING (bucket)
    WHERE doc_id IS NOT NULL GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
    CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) AS h FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
numbered AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM numbered"""


@_query("op12_retraction_audit")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


ORACLES["op12_retraction_audit"] = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
fails AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f FROM w),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
    FROM fails LEFT JOIN labels USING (doc_id) GROUP BY part, f),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT list_aggregate(list_transform(o, lambda i: 'ABCDE'[i]), 'string_agg', '') AS filter_order, i AS step, o[i] AS letter, o[1:i - 1] AS before
    FROM orders, letters),
met AS (SELECT *, f[letter] AS fails, len(list_filter(before, lambda j: f[j])) > 0 AS earlier, len(list_filter(f, lambda x: x)) AS all_fails
    FROM cells, steps),
sums AS (SELECT part, filter_order, step, letter, sum(n) FILTER (NOT fails AND NOT earlier) AS kept, sum(n) FILTER (fails AND NOT earlier) AS removed,
    sum(n) FILTER (fails AND earlier) AS redundant, sum(n) FILTER (fails AND all_fails = 1) AS unique_fails,
    sum(good) FILTER (fails AND NOT earlier) AS good_lost, sum(toxic) FILTER (fails AND NOT earlier) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM sums"""
