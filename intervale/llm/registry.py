"""Queries of the text operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from intervale.llm import jaccard, langid, lm, media, mixing, pieces, quality, secrets, toxicity, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1,
        "op2_ngram_jaccard_join": jaccard.op2,
        "op3_toxicity": toxicity.op3,
        "op4_language_id": langid.op4,
        "op5_mixing_sources": mixing.op5,
        "op6_lm_scoring": lm.op6,
        "op7_warc": warc.op7,
        "op8_secret_scans": secrets.op8,
        "op9_sentencepiece": pieces.op9,
        "op10_media_columns": media.op10,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.OP1_SQL,
        "op5_mixing_sources": mixing.OP5_SQL,
        "op7_warc": warc.OP7_SQL,
        "op8_secret_scans": secrets.OP8_SQL,
    }
