"""One query per operator, over whole tables with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, language_model, merkle, near_dedup, oracles, page_text, quality, secret_scan, sharding, substring_dedup, top_k, url_rules
from .common import table
from .registry import query

#: The rules of the URL contract.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op1_co_training")
def co_training(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op2_url_rules")
def url_verdicts(spark, sf_dir):
    """Labels reach a page through the document number in its path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract("url", r"://[^/?#]*/[a-z]+/([0-9]{1,18})(?:[^0-9]|$)", 1)
    labelled = pages.withColumn("doc_id", F.when(number != "", number.cast("long"))).join(labels, "doc_id").select("url", "bad")
    return url_rules.judge(pages, labelled, URL_RULES)


@query("op3_qgram_bands")
def qgram_bands(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_byte_bpe")
def byte_bpe(spark, sf_dir):
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_tensored_minhash", oracle=oracles.NEAR_DUPLICATES)
def tensored_minhash(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query("op6_karmarkar_karp")
def karmarkar_karp(spark, sf_dir):
    dealt = sharding.even_shards(table(spark, sf_dir, "documents"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_max_score", oracle="""
WITH v AS (SELECT vec_id, row_number() OVER () AS row_, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, q.row_, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row_ ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY row_ ORDER BY score DESC, vec_id) <= 5""")
def max_score(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query("op8_multipart_secrets", oracle=oracles.SECRETS)
def multipart_secrets(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["order"] < len(secret_scan.BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(p.kind) for p in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op9_de_bruijn", oracle=oracles.REPEATED_SPANS)
def de_bruijn(spark, sf_dir):
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), k=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_gated_recurrent")
def gated_recurrent(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query("op11_slot_pivot", oracle=oracles.MANIFEST)
def slot_pivot(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
                           altered={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return rows.drop("path")


@query("op12_collocations", oracle=oracles.COLLOCATIONS)
def phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_wrapper_induction", oracle=oracles.PAGE_TEXT)
def wrapper_induction(spark, sf_dir):
    return page_text.extract(table(spark, sf_dir, "pages"))
