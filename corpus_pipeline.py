"""A corpus pipeline of five stages: each gets documents, and all but the last give documents back.

A stage's result is written as Parquet and read again as the next stage's input. Columns of documents are kept by name;
extra ones pass through, whatever their names. Each stage takes null ids, null, empty and very long texts, repeated rows and
empty tables: null and empty texts score as any text without words in `toxicity`, are in no language, and so go in `language`; copies and
repeated rows leave one row in `near_dedup`, of equal ids the first read; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm import near_copies, op1_toxicity, op4_packing, op6_langid, op7_mixing
from skillcube.llm.common import delete, scratch_dir, scratch_scope, short_batches, table

#: Runs of letters whose ids a packing task keeps: fewer than where packing has the executors to itself.
RUNS_KEPT = 150_000

#: Rows of an Arrow batch from the first stage on (a setting of the session): a batch of 10,000 texts is held by the executor, twice while it grows, and by the worker.
BATCH = 500


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic."""
    short_batches(spark, BATCH)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    names = [F.col(f"`{c}`") for c in docs.columns]
    scored = op1_toxicity.classify(docs.select(F.struct(*names).alias("doc"), "doc_id", "text"), labels, docs)
    return scored.where("predicted = 0").select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a learned language knows as many n-grams as its labelled rows, all of them, let expect."""
    short_batches(spark, BATCH)
    model, rows = op6_langid.learn(docs.select("doc_id", "text", "lang"), per_language=None)
    return op6_langid.in_language(docs, model, op6_langid.bars(rows, model))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word similarity of 0.8 or more that with the smallest doc_id."""
    short_batches(spark, BATCH)
    return near_copies.one_per_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: a row per document and epoch."""
    return op7_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    import public_tokenizers

    short_batches(spark, BATCH)
    return op4_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), runs=RUNS_KEPT)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: No SQL expresses the fitted classifiers, the fingerprints' hash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves in the scratch folder goes when its result is written, that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"stage-{name}")
        with scratch_scope(spark, name):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
