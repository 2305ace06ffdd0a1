"""A training-data pipeline over documents: stages that read and return the columns of documents, each written as Parquet between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from heapsift.llm import bpe, decontaminate, lines, simhash, toxicity
from heapsift.llm.common import table


def without_toxic(spark, docs, sf_dir):
    """Documents that the classifier of weak supervision rejects go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark, docs, sf_dir):
    """Lines that another document holds, or an earlier place, go, in fuzzy forms too. n_chars follows the text."""
    return lines.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def without_benchmark(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark, docs, sf_dir):
    """Token ids, their number, and digests of them and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE encoding and decoding", encoded),
]

#: SQL can't express the classifier of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
