"""A corpus pipeline: toxic documents go, near copies go, personal data is hidden, sources are
mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import bpe, mixing, pii, simhash, toxicity
from waymark.llm.common import documents, table, written
from waymark.session import let_go

TOKENIZER = "word_bpe_49k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject at their language's threshold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order."""
    return mixing.replicate(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and of the decoded text."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(TOKENIZER)).drop("text")


def fresh(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, begun once the driver has let go of what the one before it left."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_go(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [(k, fresh(f)) for k, f in (("toxicity", toxicity_stage), ("simhash_near_dedup", near_dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe", bpe_stage))]

#: SQL can express neither the classifier nor the tokenizer; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
