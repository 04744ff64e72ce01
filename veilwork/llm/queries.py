"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm.bpe import encoded
from veilwork.llm.debruijn import repeated_spans
from veilwork.llm.fingerprints import ORACLE as FINGERPRINTS
from veilwork.llm.fingerprints import fingerprints
from veilwork.llm.hash_forest import nearest
from veilwork.llm.html_extract import extract_text
from veilwork.llm.ngram_join import classes_sql, jaccard_classes
from veilwork.llm.packing import packed
from veilwork.llm.pii import find_pii
from veilwork.llm.suffix_dedup import passages_sql, repeated_passages
from veilwork.llm.toxicity import scored, train
from veilwork.session import shipped


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and main text of each page."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document, and whether it is toxic, by a classifier fitted on the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    return scored(docs, train(docs, _table(spark, sf_dir, "labels")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class by a Jaccard similarity of 0.6 or more of sets of word 3-grams, and its number of links."""
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur at two places or more of the documents."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by a public vocabulary, and whether they decode to its text."""
    return encoded(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the documents."""
    return find_pii(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that repeat, with the unitigs of the documents' De Bruijn graph that they run through."""
    return repeated_spans(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words filled with the documents."""
    return packed(_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings, by cosine, of those whose id is divisible by 50."""
    return nearest(_table(spark, sf_dir, "embeddings"), asked="vec_id % 50 = 0")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document, the first with the same text, and how far it is equal to the first with its opening."""
    return fingerprints(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_toxicity,
        op3_ngram_jaccard_join,
        op4_suffix_array_dedup,
        op5_bpe,
        op6_pii,
        op7_substring_dedup,
        op8_best_fit_packing,
        op9_nearest_neighbours,
        op10_fingerprints,
    )
}

ORACLES: dict[str, str] = {"op3_ngram_jaccard_join": classes_sql(), "op4_suffix_array_dedup": passages_sql(), "op10_fingerprints": FINGERPRINTS}
