"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import decontam, html, infill, langid, licenses, minhash, packing, quality, rules, tokencount, tokenids, trie, urls
from chronopanel.llm.common import bare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_byte_convolution_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bare(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bare(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return html.main_text(pages).select("page_id", "url", "text", "n_chars")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bare(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return quality.select(docs, _table(spark, sf_dir, "labels")).drop("text")


def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bare(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(docs, payload=False).drop("ids")


def op6_url_language_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bare(_table(spark, sf_dir, "pages"), "page_id", "url")
    return urls.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bare(_table(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontam.find_items(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("matches"))


def op8_feistel_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = tokenids.write_shards(_table(spark, sf_dir, "documents"))
    return tokenids.read_shards(spark, shards, digest=True)


def op9_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bare(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return tokencount.count_tokens(docs).drop("text")


def op10_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bare(_table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return rules.apply_rules(docs, with_text=False).select("doc_id", *rules.MEASURES, "base_failed", "soft_failed", "kept")


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bare(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return licenses.scan(docs).drop("text", "wordings")


def op12_rank_select_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bare(_table(spark, sf_dir, "documents"), "doc_id", "text")
    out = infill.transform(docs).drop("text")
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(infill.restored(), 256)}
    return out.withColumns(digests).drop("output")


def op13_patricia_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_setsketch_near_dedup,
        op2_byte_convolution_language,
        op3_wrapper_induction,
        op4_ordinal_quality,
        op5_concatenate_and_cut,
        op6_url_language_model_ratio,
        op7_pigeonhole_decontamination,
        op8_feistel_token_shards,
        op9_rank_synchronous_counts,
        op10_host_quality_rules,
        op11_license_templates,
        op12_rank_select_infill,
        op13_patricia_conversations,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_language_model_ratio": urls.oracle(),
        "op10_host_quality_rules": rules.oracle(),
        "op11_license_templates": licenses.oracle(),
        "op12_rank_select_infill": infill.oracle(),
        "op13_patricia_conversations": trie.oracle(),
    }
