"""The registered query of each operator, over whole tables, with the settings meant for production."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import collocations, divergence, entropy, fingerprints, jaccard, language, line_templates, merge_dropout, mixing, packing, quality, shards, warc
from .common import table

QUERIES = {}


def register(work):
    QUERIES[work.__name__] = work
    return work


@register
def op2_quality_rules(spark, folder):
    return quality.measures(table(spark, folder, "documents"))


@register
def op3_byte_shards(spark, folder):
    return shards.shard_by_bytes(table(spark, folder, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register
def op8_warc_revisits(spark, folder):
    path = warc.fresh_folder(spark)
    warc.write_archives(table(spark, folder, "pages"), path)
    records = warc.resolve_revisits(warc.read_archives(spark, path))
    return records.select(
        F.col("source_key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_key").cast("bigint").alias("refers_to"), "digest_fits",
    )


@register
def op10_secret_scan(spark, folder):
    return entropy.scan_documents(table(spark, folder, "documents"))


@register
def op5_prefix_fingerprints(spark, folder):
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


@register
def op9_string_kernel_language(spark, folder):
    docs = table(spark, folder, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    found = language.identify(docs, third != 1)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register
def op7_best_fit_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), 2048)


@register
def op4_ngram_jaccard(spark, folder):
    found, _ = jaccard.groups(table(spark, folder, "documents"), jaccard.Join(words=3, percent=90))
    return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@register
def op1_line_templates(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs, counts=True)


@register
def op6_merge_dropout(spark, folder):
    return merge_dropout.encode_documents(table(spark, folder, "documents"), rate=0.1, seed=20240101)


@register
def op11_source_divergence(spark, folder):
    return divergence.divergences(table(spark, folder, "documents"))


@register
def op12_phrase_collocations(spark, folder):
    return collocations.phrases(table(spark, folder, "documents"))


@register
def op13_source_mix(spark, folder):
    mixed = mixing.mix_blocks(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken(mixed).alias("taken"))
