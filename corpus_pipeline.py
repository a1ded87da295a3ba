"""From raw documents to token shards: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each stage's rows and reads them
back as the next one's input.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, minhash_dedup, mixing, quality, wavelet
from tessella.llm.queries import tokenizer_path
from tessella.llm.scratch import Scratch
from tessella.session import ship, table


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, run after this package has been sent to the executors."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return minhash_dedup.keep_one_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or cut to their target weights; a repeated document is a row each time."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards are written and read back: doc_id, start, n_tokens, ids_crc32."""
    path = f"{Scratch(spark, 'tokens').path}/shards"
    wavelet.write_shards(docs, path, tokenizer_path())
    return wavelet.read_documents(wavelet.read_shards(spark, path))


STAGES = [
    ("quality classifier", _shipped(quality_stage)),
    ("MinHash near-dedup", _shipped(near_dedup_stage)),
    ("benchmark decontamination", _shipped(decontamination_stage)),
    ("mixing sources", _shipped(mixing_stage)),
    ("token-ID output", _shipped(token_stage)),
]

#: A learned model, signatures and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
