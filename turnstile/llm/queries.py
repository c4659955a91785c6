"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstile.llm import align, boosting, chat, decontaminate, fim, htmltext, pieces, pii, quality, setjoin, sharding, sql, urls, warczip
from turnstile.llm.common import table

#: Bytes of a shard. Small, so that the test tables fill several; a large corpus would take some hundred megabytes.
SHARD_BYTES = 1 << 20


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_model(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return quality.judge(docs, model).select(*columns)


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warczip.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warczip.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, SHARD_BYTES).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.link_documents(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.summaries(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(c, 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (fim.restored(F.col("form"), F.col("output")), "restored_sha256"))]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_QUERIES = (op1_pii, op2_decontamination, op3_quality_rules, op4_warc_zip, op5_tag_path_text, op6_merge_dropout, op7_extendible_shards, op8_url_filter, op9_perspectives, op10_jaccard_join, op11_quality_classifier, op12_lockstep_alignment, op13_fill_in_middle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": sql.DECONTAMINATION,
        "op4_warc_zip": sql.WARC,
        "op7_extendible_shards": sql.shards(SHARD_BYTES),
        "op9_perspectives": sql.perspectives(chat.PART_TURNS),
        "op10_jaccard_join": sql.jaccard(3, 90),
        "op13_fill_in_middle": sql.FILL_IN_MIDDLE,
    }
