"""Queries of this package with production parameters, each over its whole table."""

from pyspark.sql import functions as F

from foldspark.llm import decontaminate, embed_dedup, langid, license_scan, lm, minhash, mix, pii, tokencount, url_filter
from foldspark.llm.common import fold
from foldspark.sources.tables import table


def op1_url_filter(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"))


def op2_embedding_dedup(spark, sf):
    return embed_dedup.near_duplicates(table(spark, sf, "embeddings"))


def op3_license_scan(spark, sf):
    return license_scan.digest(license_scan.scan(table(spark, sf, "documents")))


def op4_language_id(spark, sf):
    found = langid.predict(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark, sf):
    return tokencount.count(table(spark, sf, "documents"))


def op6_mix_sources(spark, sf):
    weights = mix.label_weights(table(spark, sf, "labels"))
    return mix.mix(table(spark, sf, "documents"), weights).select("doc_id", "size", "source_size", "target", "taken")


def op7_pii(spark, sf):
    return pii.digest(pii.find(table(spark, sf, "documents")))


def op8_minhash(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), percent=85)


def op9_lm_score(spark, sf):
    return lm.score(table(spark, sf, "documents"))


def op10_decontaminate(spark, sf):
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_embedding_dedup, op3_license_scan, op4_language_id, op5_token_counts, op6_mix_sources, op7_pii, op8_minhash, op9_lm_score, op10_decontaminate)}
SQL = {"op2_embedding_dedup": embed_dedup.SQL, "op8_minhash": minhash.SQL, "op6_mix_sources": mix.SQL, "op10_decontaminate": decontaminate.SQL}
