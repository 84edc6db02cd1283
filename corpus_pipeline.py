"""Corpus pipeline: five stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
documents:

* ``toxicity`` drops documents that score 0.5 and more;
* ``near_duplicates`` keeps the document of the least doc_id of every group of
  equal and near-equal texts (five-word shingles, similarity 0.8);
* ``decontamination`` drops documents that hold a passage of the benchmark;
* ``mixing`` keeps every document and puts them in the order of a Pfair mix by
  tempered weights: file by file and row by row, the stage's table is the mix;
* ``token_files`` encodes the documents in that order and returns what the
  files give back: doc_id, start, n_tokens, ids_crc32.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quakeloom.llm import toxicity
from quakeloom.llm.decontaminate import drop_contaminated
from quakeloom.llm.jaccard_join import one_of_each
from quakeloom.llm.mixing import mixed_documents
from quakeloom.llm.tables import table
from quakeloom.llm.token_files import in_file_order
from quakeloom.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, toxicity.toxic_labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_file_order(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_files", encode),
]

# A trained classifier and a tokenizer cannot be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    folder = f"{checkpoint_dir(spark)}/quakeloom/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
