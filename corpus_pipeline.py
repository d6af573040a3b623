"""A corpus pipeline: quality, toxicity, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last
return the columns of documents. ``run`` writes each result as Parquet to the shared folder and reads it again; a stage's table is
removed once the next one is written.

Defined results, in every stage: a null text counts as empty. An empty text is judged by its score like any other, is a group of
its own with other empty texts, has no words to mix (so the mix drops it) and no ids. A null id keeps its row: it is scored,
stands in its group after all ids, and is mixed and encoded. A null source is a source of its own; a null in any other column passes through.
Repeated rows score alike and leave one row; unrelated texts that share an id each stay. Equal scores at a threshold are kept by quality and rejected by
toxicity. Very long texts are one row and are treated whole. Other columns pass through all stages but the last, whatever their names. An empty table gives an
empty table in each stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from weir.llm import mixing, quality, sentencepiece, simhash, toxicity
from weir.llm._shared import give_back_driver, remove_folder, scratch_path
from weir.session import ship, table


def _lean(stage):
    """A stage with the packages shipped; the driver hands back what the stages before left, then what fitting or rounds left before the result is computed."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_driver(ship(spark))
        out = stage(spark, docs, sf_dir)
        give_back_driver(spark)
        return out

    return run


@_lean
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_lean
def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


@_lean
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that of the least id."""
    return simhash.dedup(docs, size=5, similarity=0.8)


@_lean
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, all of them whole."""
    return mixing.mixed_documents(docs, whole=True)


@_lean
def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row of the mix."""
    return sentencepiece.encode_texts(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("sentencepiece", to_pieces),
]

#: No SQL: neither the fitted models nor fingerprints and ids can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        out = scratch_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove_folder(spark, before)
        before = out
    return STAGES[-1][1](spark, docs, sf_dir)
