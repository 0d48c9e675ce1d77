"""The training-data pipeline: language, near duplicates, benchmark passages, mixture, token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import containment, language_id, mixing, simhash_pivots, token_tables
from grainmill.llm.common import settled
from grainmill.llm.queries import table, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject, with all their columns.

    It learns from the learnable rows of these documents. Null, empty and letterless texts go. Repeated rows are judged one by one and alike; texts of any length are judged whole;
    of equally near centroids the first language counts. An empty table, or one without labels, gives an empty one. Columns of any name stay.
    """
    return language_id.known_language(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id: five-word shingles, similarity of 0.8 or more, as several fingerprints tell it.

    Rows that repeat an id are one document and one of them stays, by the hash of its columns. Rows without an id stay. Null, empty and wordless texts are one class. Texts of any
    length are compared whole. An empty table gives an empty one. Columns of any name stay.
    """
    return simhash_pivots.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null, empty and wordless texts hold none and stay; repeated rows are judged alike; whole texts count, however long. Empty documents give an empty table, an
    empty benchmark keeps all. Columns of any name stay.
    """
    return containment.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it takes them.

    Texts without words, null ones too, have no size and go. A null source is one of its own. Rows are taken in the order of a hash of id and text: ties are equal rows and
    interchangeable. An empty table gives an empty one. Columns of any name stay.
    """
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token tables, written and read back: id, start, n_tokens and ids_crc32 of each row.

    Null and empty texts hold the end id only; null ids come first; rows that repeat an id follow each other. An empty table gives an empty one. Other columns are left out.
    """
    return token_tables.tokens_on_disk(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: Fitted centroids, fingerprints and library tokens are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written and read again before the next, and what a stage wrote on its way is removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
