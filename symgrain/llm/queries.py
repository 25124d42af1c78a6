"""One query per training-data operator, and SQL for those that SQL can express."""

from __future__ import annotations

from symgrain.llm import bpe, decontam, embed_dedup, licenses, maxent_lm, packing, quality, resampling, simhash, token_store, url_filter, warc
from symgrain.llm.common import fresh_path, table


def op1_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.captures(spark, path)


def op3_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_token_store(spark, sf_dir):
    path = fresh_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.index_store(spark, path)


def op6_maxent_lm(spark, sf_dir):
    return maxent_lm.train_and_score(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_packing(spark, sf_dir):
    return packing.digests(table(spark, sf_dir, "documents"))


def op12_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    from symgrain.llm.oracles import ORACLES

    return dict(ORACLES)
