"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import catalog, decontaminate, ngram_join, packing, pii, quality
from barloom.llm.components import lean, saved


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    lean(spark)
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the n-gram join, five words and a similarity of 0.8, the one of the smallest id stays."""
    lean(spark)
    return ngram_join.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    lean(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text becomes pseudonyms."""
    lean(spark)
    return pii.pseudonymise(docs, catalog.TRIAL_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of every document with their token ids."""
    lean(spark)
    return packing.pack(docs, catalog.default_tokenizer())


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("PII", pseudonymised),
    ("packing", packed),
]

# tokens, the latent space and the keyed permutation have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
