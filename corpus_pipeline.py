"""The corpus pipeline: five stages, each written and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.

1. toxicity: documents with a score of 0.5 or more go.
2. near_duplicates: of each group of linked fingerprints one document stays.
   Links are op2_simhash's (3-word shingles, 3 bits); see the README for what that misses.
3. repeated_strings: bytes in 200-byte strings that start elsewhere too are cut
   out of the texts (and n_chars counted anew); no document goes.
4. benchmark: documents that hold a window of a benchmark item go.
5. tokens: what is left is encoded and decoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from quillgrid.llm.queries import TOKENIZER
from quillgrid.session import checkpoint_root
from quillgrid.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeated_strings),
    ("benchmark", drop_benchmark),
    ("tokens", encode),
]

#: SQL has neither the dictionaries, the hash nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. Each result but the last is written as
    Parquet to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}")
    return docs
