"""A corpus cleaned and packed: each stage works on all that the one before kept.

All stages but the last return the columns of docs, whatever extra ones these have and whatever their names; an empty table
gives an empty result. What else each does with odd rows is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm.debruijn import without_copies
from veilwork.llm.exchange import dropped, written
from veilwork.llm.ngram_join import one_of_each_group
from veilwork.llm.packing import packed
from veilwork.llm.pii import without_pii
from veilwork.llm.toxicity import train, without_toxic
from veilwork.session import shipped


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on those with a label.

    Null and empty texts stay, rows without doc_id are judged like others, and long texts as a whole. Repeated rows stay or
    go together; for the fit they count once. A score that is the threshold is toxic.
    """
    labels = shipped(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id.

    Null and empty texts, texts without words and rows without doc_id all stay. Repeated rows of a document that stays all
    stay. Texts are compared as a whole, however long; a similarity that is the threshold is a near copy.
    """
    shipped(spark)
    return one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans of 50 words or more stay at their first place only, by doc_id, then by word.

    Rows without doc_id or text stay as they are; repeated rows are one document and each is cut alike. Long texts are
    searched as a whole. n_chars is counted again where a text is cut.
    """
    shipped(spark)
    return without_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind in brackets.

    Null and empty texts stay as they are; rows without doc_id and repeated rows are masked like others. Time is in
    proportion to a text's length. Of spans that overlap the best score stays, then the longest, then the first.
    """
    shipped(spark)
    return without_pii(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All words that are left, in bins of 2,048.

    Texts without words, null ones too, and rows without doc_id are in no bin; repeated rows are packed each time; a text
    longer than a bin is cut. Of bins with equal space the one that came to it last is used.
    """
    shipped(spark)
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no trained classifier, De Bruijn compaction or bounded-space packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
