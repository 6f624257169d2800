"""From raw documents to token files: toxicity, near duplicates, benchmark passages, mixing, token ids.

Each stage is a function of (spark, docs, sf_dir). ``docs`` is what the stage before it kept, written as Parquet and
read again, so a stage can be run anew by itself. All stages but the last return the columns of documents. What a stage
writes for itself is removed when the next one begins, as its own result is written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from touchline.llm.common import read_table
from touchline.llm.decontamination import remove_contaminated
from touchline.llm.mixing import mixed_documents
from touchline.llm.near_duplicates import drop_near_duplicates
from touchline.llm.token_files import token_output
from touchline.llm.toxicity import remove_toxic, train_on_labels
from touchline.session import SETTLED, remove_settled, settle

_OWN: list[str] = []


def stage(function: Callable) -> Callable:
    """Remove the tables of the stage before, and note those of this one."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_settled(spark, [p for p in _OWN if p in SETTLED])
        held = len(SETTLED)
        out = function(spark, docs, sf_dir)
        _OWN[:] = SETTLED[held:]
        return out

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, scores below its threshold."""
    return remove_toxic(docs, train_on_labels(spark, sf_dir))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more."""
    return drop_near_duplicates(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


@stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the mixed documents, read back from their token files."""
    return token_output(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token_files", token_files)]

#: The classifier has no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = settle(function(spark, docs, sf_dir))
    return docs
