"""Registered queries of the numbered operators: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import centroids, divergence, exact_dedup, html_text, line_dedup, mixing, ngram_join, phrases, pii, sentencepiece_codec, topk, toxicity, warc
from .common import table


def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    cleaned = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r.start, r.end)), ",")
    return cleaned.select(
        "doc_id",
        F.size("removed").cast("bigint").alias("n_removed"),
        spans.alias("removed"),
        F.char_length("clean_text").cast("bigint").alias("clean_chars"),
        F.sha2("clean_text", 256).alias("clean_sha256"),
    )


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.report(pii.sanitise_spans(table(spark, sf_dir, "documents")))


def op6_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op7_warc(spark, sf_dir):
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_mix_sources(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_sentencepiece(spark, sf_dir):
    coded = sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "exact",
    )


def op11_phrases(spark, sf_dir):
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op12_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark, sf_dir):
    judged = divergence.quality(table(spark, sf_dir, "documents"))
    return judged.drop("class_distance", "word_distance")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_join, op3_line_dedup, op4_exact_dedup, op5_pii, op6_html_text, op7_warc, op8_top_k, op9_mix_sources, op10_sentencepiece, op11_phrases, op12_centroids, op13_divergence)}
ORACLE = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_top_k": topk.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
