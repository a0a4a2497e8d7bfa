"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_scoring

    return lm_scoring.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprints

    return fingerprints.compare_successors(table(spark, sf_dir, "documents"))


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digests(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), None, 1024, 0)


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op8_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    return licences.scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.read_back(chat.examples(chat.probe(table(spark, sf_dir, "conversations"))))


def op11_loser_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.histories(table(spark, sf_dir, "pages"))


def op12_divergence_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periods

    return periods.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pseudo_likelihood, op2_hash_tree, op3_spot_signatures, op4_blob_ledger, op5_byte_bpe, op6_packing, op7_weighted_minhash, op8_licence_digests, op9_quality_rules, op10_prefix_targets, op11_loser_tree, op12_divergence_tiles, op13_lyndon_runs)
}
