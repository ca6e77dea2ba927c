"""The corpus pipeline: documents through five operators of ``loanroll.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and reads it again as the next one's documents. All but the last
return the columns of ``documents``.

1. ``quality_classifier``: documents with a score below 0.7 go.
2. ``quality_rules``: documents that fail the base rules or the divergences go.
3. ``simhash_near_dedup``: one document of each component stays.
4. ``benchmark_decontamination``: benchmark passages are cut out of the texts
   (``n_chars`` follows); no document goes.
5. ``bpe_encoding``: doc_id, ids and n_tokens of every remaining text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanroll.llm import bpe, classifier, decontaminate, quality_rules, simhash
from loanroll.llm.common import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_well_formed(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=4, radius=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"), window=10)
    return cut.withColumn("n_chars", F.length("text").cast("bigint"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("bpe_encoding", bpe_encoding)]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
