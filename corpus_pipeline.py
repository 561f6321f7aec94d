"""The corpus pipeline: five operators in a row over the documents, each written and reread before the next."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talespark.llm import bpe, mixing, nearcopies, ordinal, repeats, simhash
from talespark.llm.common import bound_batches, checkpoint_dir, remove, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labelled ones among them, takes for good.

    Null and empty texts have no features: the thresholds alone decide on them, all alike. Of rows that repeat an id each
    is judged by its own text. Without labels, or with one grade of them, all rows stay or go as that grade says (no
    grade: stay). Null ids are judged as others. Columns of any names stay. An empty table gives an empty one.
    """
    bound_batches(spark)
    return ordinal.keep_good(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose SimHash fingerprints differ in 4 bits or less, texts whose
    five-word shingles are 0.8 or more alike, which SimHash alone mostly misses, and what these link.

    The least id of a group stays, with every row that bears it. Texts without words, or null, are one group. Rows with a
    null id stay. Columns of any names stay. An empty table gives an empty one.
    """
    bound_batches(spark)
    return simhash.one_per_group(docs, more=nearcopies.fingerprint_links)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that repeat.

    Every row stays, with its other columns of any names; n_chars is counted anew where a text has changed. Null texts
    stay null; empty and shorter ones stay as they are; of equal longer texts all lose all. Null ids do not matter. An
    empty table gives an empty one.
    """
    bound_batches(spark)
    return repeats.strip_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture of their sources draws them.

    A null source is one named ''. Null and empty texts have no tokens and are drawn with their source's blocks; a source
    without any tokens is drawn once. Repeated rows are drawn alike; ids do not matter otherwise. Columns of any names
    stay. An empty table gives an empty one.
    """
    bound_batches(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, encoded and decoded.

    Null texts are empty; empty ones have no tokens and the digest of no bytes. Each row, repeated or not, gives a row; a
    null id stays null; other columns are not read. An empty table gives an empty one.
    """
    bound_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("mixture", mixture), ("tokens", tokens)]

#: Iterated grouping, suffix sorting and tokenising have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents; what passes between two stages is Parquet in the shared checkpoint folder.

    A stage's input is deleted when its output is written; the last stage's, which the result reads, when the session ends.
    """
    docs = table(spark, sf_dir, "documents")
    shared, last = f"{checkpoint_dir(spark)}/pipeline-{uuid4()}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{shared}/{k}-{name}")
            docs = spark.read.parquet(path)
            remove(spark, last or shared, at_exit=not last)
            last = path
    return docs
