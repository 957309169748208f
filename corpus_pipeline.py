"""A corpus preparation pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of `documents`. Between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, jaccard, mixing, quality, secret_scan, shared

#: Near duplicates: words a shingle and least similarity in per cent.
WIDTH, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the rules or lose too much text. Null and empty texts go; repeated rows, an empty table and very long texts as in `quality.clean`."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the least doc_id.

    Null and empty texts are linked with nothing and stay, as do rows with null doc_id; of rows with one doc_id and text one stays. An empty table and very long texts as in `jaccard.similar_components`.
    """
    return jaccard.keep_one(docs, WIDTH, PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind. Null text stays null; repeated rows and an empty table as in `secret_scan.mask_secrets`."""
    return secret_scan.mask_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near their target weights. Null texts, sources and an empty table as in `mixing.repeated`."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and token ids of every row of the mix. Null or empty text: no tokens; repeated rows and an empty table as in `bpe.encode`."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, keep=("doc_id", "source"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

#: The mix depends on a seeded hash and the tokens on a vocabulary, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`."""
    docs = shared.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.written(docs, f"stage-{i + 1}")
    return docs
