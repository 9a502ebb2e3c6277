"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import best_fit_packing, block_dedup, decontaminate, hard_negatives, host_rules, lang_ppm, license_digest, merkle_manifest, mixing, ngram_join, pii_surrogate, quality_rank, suffix_dedup
from ._common import table


def op1_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_quality_rank(spark, sf_dir):
    return quality_rank.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lang_ppm(spark, sf_dir):
    return lang_ppm.identify(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_host_rules(spark, sf_dir):
    return host_rules.judge(table(spark, sf_dir, "documents"))


def op5_pii_surrogate(spark, sf_dir):
    return pii_surrogate.report(table(spark, sf_dir, "documents"))


def op10_license_digest(spark, sf_dir):
    return license_digest.scan(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_block_dedup(spark, sf_dir):
    return block_dedup.report(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle_manifest.verified(table(spark, sf_dir, "documents"), tampered=tampered)


def op13_best_fit_packing(spark, sf_dir):
    return best_fit_packing.pack(table(spark, sf_dir, "documents"))


_ALL = (op1_ngram_join, op2_quality_rank, op3_lang_ppm, op4_host_rules, op5_pii_surrogate, op6_decontaminate, op7_block_dedup, op8_mixing, op9_suffix_dedup, op10_license_digest, op11_hard_negatives, op12_merkle_manifest, op13_best_fit_packing)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op4_host_rules": host_rules.ORACLE, "op6_decontaminate": decontaminate.ORACLE, "op10_license_digest": license_digest.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_merkle_manifest": merkle_manifest.ORACLE}
