"""From raw documents to a training mix: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
for the next. All but the last return the columns of ``documents``, and others that are there, whatever their names.
An empty table, or one that a stage empties, gives an empty one; texts of any length are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontamination, language, mixing, near_duplicates, pii
from brindle.llm._tables import table
from brindle.session import dropped, mark, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the rank-order profiles can tell; und ones go.

    So null and empty texts and those without a letter go. Repeated rows are each judged; a null doc_id teaches nothing."""
    return language.accepted(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that near-duplicate links connect: that of the least doc_id.

    A null doc_id counts as larger than all others; of rows with one doc_id and text one stays; texts without words
    link with nothing, and all stay."""
    return near_duplicates.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or a passage like it. Null and empty texts hold none, and stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; every document stays, null texts as they are. n_chars follows the text."""
    return pii.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with copy_no (which replaces a column of that name) from 1.

    A null source is one of its own, the last; null texts have size 0; repeated rows are documents of their own."""
    return mixing.emitted(docs)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontaminate", decontaminate), ("mask_pii", mask_pii), ("mix", mix)]

#: Language profiles, SimHash windows and the tagger are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. Tables that a stage made go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    start = mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            dropped(spark, start, 1)
    return docs
