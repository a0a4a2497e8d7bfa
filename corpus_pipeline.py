"""Corpus pipeline: quality rules, near-duplicate removal, secret removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Its result is written as Parquet and read again as the next stage's docs.

Defined cases: a null text is the empty one, which the quality rules reject; null ids, languages and other columns are kept
as they are; texts are read whole, however long; of rows that repeat an id and its text one stays; ties between copies
go to the row read first; an empty table gives no rows; further columns are kept up to packing, whatever their names.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomery.llm import near_dedup, packing, quality, secrets
from loomery.llm.common import cut, cuts_of, release_paths, table


#: Cuts of the last stage run by a thread over some tables; its result is written before the next begins, which deletes them.
_DONE: dict[tuple[int, str], list[str]] = {}


def _stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(make)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = threading.get_ident(), sf_dir
        # what ``docs`` itself still reads stays
        release_paths(_DONE.pop(own, []), docs)
        with cuts_of() as made:
            out = make(spark, docs, sf_dir)
        _DONE[own] = made
        return out

    return run_one


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.keep(docs)


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced by a mark."""
    return secrets.clean(docs)


@_stage
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), None, 1024, 0)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("sequence_packing", sequence_packing)]

#: Near-duplicate classes and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
