"""From raw documents to token ids: a pipeline of five stages.

Each stage takes what its predecessor kept, and is written as Parquet and read
again before the next: ``run`` puts these tables into the shared folder of
``spark.checkpoint.dir``, so no stage is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from galena.llm.bpe import encode_documents, read_ranks
from galena.llm.decontaminate import clean
from galena.llm.exact_dedup import drop_copies
from galena.llm.near_dedup import drop_near_copies
from galena.llm.quality import keep_good
from galena.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and digests of ids and of their decoded bytes."""
    tokens = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_documents(docs, tokens, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express the classifier or the signatures.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table: doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256.

    An empty table gives no rows. A null text counts as empty; of all texts that are
    empty one stays. Of repeated rows one stays, nulls in other columns change nothing,
    and columns that a stage doesn't know come through as far as the last one.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(f"stage{i}", stage(spark, docs, sf_dir))
    return docs
