"""A training-data pipeline over ``documents``: five stages, each a table in the shared folder.

quality      documents that importance resampling rejects go
lines        recurring line templates go, and documents of which nothing is left
near_copies  one document of each near-duplicate class stays
benchmark    documents that hold a benchmark window go
tokens       the rest is encoded: doc_id, n_tokens, ids

Every stage keeps the columns of its input, whatever their names, and the last returns
its own three. A null text has no lines, n-grams, words or ids and passes to the end
with no ids; its null ``n_chars`` stays null where its text does. Documents without an
id pass as others do. Of repeated rows (equal id and text) near_copies keeps one, unless
they have no words. Empty ``documents`` give no rows; without usable ``labels`` all
documents pass the first stage, without ``benchmark`` all pass the fourth. Texts of any
length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallybook.llm import decontaminate, importance, line_templates, ngram_join, pieces
from tallybook.llm._common import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.keep_selected(docs, importance.good_labels(labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays if no line of it went or some text is left; ``n_chars`` follows the text."""
    out = line_templates.drop_recurring_lines(docs)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]
#: Learned weights, MinHash and Viterbi are beyond SQL; tests hold the stages against plain loops over their own inputs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
