"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage works on all rows its predecessor kept, written as Parquet and read
again.  All stages but the last return the columns of ``documents``; the last returns the
packed pieces with their token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from berthwise.llm import exact, langid, mixing, packing, simhash
from berthwise.llm.common import saved, table
from berthwise.llm.queries import word_bpe

ARROW_ROWS = 1000                # rows that JVM and Python hold of a task at once in the stages that send whole texts
CACHED_WORDS = 120_000           # Python workers outlive a stage, so the packing stage remembers fewer words than the query


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(int(spark.conf.get(name)), ARROW_ROWS)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: null texts, texts without a letter, and texts of whose words less than half are made
    of what the training languages are made of (other scripts, random letters).  Mixtures of languages stay, however even.

    Rows that repeat another are judged like it; extra columns stay; an empty table, and one without any labelled
    training row, gives an empty table.  Texts are read whole."""
    _small_batches(spark)
    return langid.filtered(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside; null is empty) the row with the smallest id stays, a null id before all; of rows
    with one id and text the smallest in column order.  Extra columns stay; an empty table stays empty; texts are read whole."""
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays, a null id before all; texts without a word are one
    component; of rows with one id and text the smallest in column order stays.  Extra columns stay; an empty table stays
    empty; texts are read whole."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them; those without a word are taken no time.  A null source is a
    source, the last one; extra columns stay; an empty table stays empty; texts are counted whole."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents; a null or empty text is its end id alone, repeated rows are packed each, extra columns are
    left out, an empty table gives no pieces, and texts are packed whole."""
    _small_batches(spark)
    return packing.digest(packing.packed(docs, word_bpe(), cached=CACHED_WORDS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

# Models, hashes and random rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
