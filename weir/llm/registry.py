"""The queries of the training-data operators and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from weir.llm import embeddings, language_model, mixing, quality, sentencepiece, sharding, simhash, tiff, tokenfile, toxicity

    return {
        "op1_simhash_near_dedup": simhash.query,
        "op2_mixing": mixing.query,
        "op3_sentencepiece": sentencepiece.query,
        "op4_token_files": tokenfile.query,
        "op5_tiff_media": tiff.query,
        "op6_sharding": sharding.query,
        "op7_toxicity": toxicity.query,
        "op8_quality_classifier": quality.query,
        "op9_embedding_near_dedup": embeddings.query,
        "op10_lm_scoring": language_model.query,
    }


def oracle_sql() -> dict[str, str]:
    from weir.llm import embeddings

    return {"op9_embedding_near_dedup": embeddings.ORACLE}
