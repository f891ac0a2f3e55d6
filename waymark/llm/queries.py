"""One query per corpus operator over its whole table, with production parameters."""

from __future__ import annotations

from waymark.llm.common import documents, table


def op1_toxicity(spark, d):
    from pyspark.sql import functions as F

    from waymark.llm.toxicity import HELD_FOLD, classify, expr_crc_fold

    out = classify(documents(spark, d), table(spark, d, "labels"))
    held = expr_crc_fold(F.col("doc_id")) == HELD_FOLD
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def op2_fingerprint(spark, d):
    from waymark.llm.fingerprint import fingerprint

    return fingerprint(documents(spark, d))


def op3_pii(spark, d):
    from waymark.llm.pii import summary

    return summary(documents(spark, d))


def op4_bpe(spark, d):
    import public_tokenizers

    from waymark.llm.bpe import encode

    return encode(documents(spark, d).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op5_quality(spark, d):
    from waymark.llm.quality import quality_rules

    return quality_rules(documents(spark, d), table(spark, d, "labels"))


def op6_sharding(spark, d):
    from waymark.llm.sharding import shard_table

    return shard_table(documents(spark, d))


def op7_katz(spark, d):
    from waymark.llm.katz import katz_scores

    return katz_scores(documents(spark, d))


def op8_warc(spark, d):
    from waymark.llm.warc import round_trip

    return round_trip(table(spark, d, "pages"))


def op9_mixing(spark, d):
    from pyspark.sql import functions as F

    from waymark.llm.mixing import poisson_mix

    return poisson_mix(documents(spark, d)).withColumn("rate", F.round("rate", 6))


def op10_simhash(spark, d):
    from waymark.llm.simhash import near_components

    return near_components(documents(spark, d))


def op11_url_filters(spark, d):
    from waymark.llm.urls import judged_pages

    return judged_pages(table(spark, d, "pages"), table(spark, d, "labels"))


def op12_negatives(spark, d):
    from waymark.llm.negatives import hard_negatives

    return hard_negatives(table(spark, d, "embeddings"))


def op13_codes(spark, d):
    from waymark.llm.codes import code_table

    return code_table(table(spark, d, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_fingerprint, op3_pii, op4_bpe, op5_quality, op6_sharding, op7_katz, op8_warc, op9_mixing, op10_simhash, op11_url_filters, op12_negatives, op13_codes)}


def _oracles() -> dict[str, str]:
    from waymark.llm import codes, mixing, negatives

    return {"op9_mixing": mixing.ORACLE, "op12_negatives": negatives.ORACLE, "op13_codes": codes.ORACLE}


ORACLES = _oracles()
