"""A training corpus from ``documents``: five stages, each one operator of haplospark.llm over all rows that its predecessor kept.

1. language_id: texts without an identified language go: those without a letter, those that no learned language is likelier for
   than all others, and those that are unlike the language they are nearest to (foreign scripts, random letters).
2. jaccard_join: of the documents that word shingles link, the one with the smallest doc_id stays.
3. decontamination: documents that hold a passage of a benchmark item, within its budget of edits, go.
4. personal_data: personal data in texts is masked; all rows stay.
5. pieces: each text gets a sampled segmentation, and whether decoding gives the text back.

All stages but the last return the columns of documents.  Rows with nulls pass as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haplospark.llm import _common
from haplospark.llm.decontamination import keep_uncontaminated
from haplospark.llm.jaccard_join import one_of_each
from haplospark.llm.language_id import keep_identified
from haplospark.llm.personal_data import masked
from haplospark.llm.piece_sampling import with_pieces
from haplospark.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_uncontaminated(docs, _common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("personal_data", personal_data), ("pieces", pieces)]

#: Edit distances, a random field and sampled segmentations have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of *sf_dir*, each one's result written before the next reads it."""
    docs = _common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
