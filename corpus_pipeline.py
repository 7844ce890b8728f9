"""Corpus pipeline: toxicity, line deduplication, SimHash near-deduplication, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.bpe import digests, vocabulary
from sieveline.llm.common import Scratch, free_names
from sieveline.llm.lines import STAGE_RULES, drop_boilerplate
from sieveline.llm.mixing import take_mix
from sieveline.llm.simhash import keep_one_of_each
from sieveline.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels outside the held-out rows, does not call toxic.

    Columns stay as they are, whatever their names. Null and empty texts are scored as a window without words, very
    long ones in all their windows; repeated rows share their fate; an empty table gives an empty one. Without labels
    of both kinds nothing is told apart, so all documents stay unless toxic labels alone are known.
    """
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source, by STAGE_RULES; no document goes.

    Texts of a source with the same lines count once; very long ones count whole. A text that loses no line stays as it is, null too; one that
    loses all is ''. n_chars follows the text where there is such a column; all other columns stay, whatever their
    names. A null source is a source; repeated rows stay; an empty table gives an empty one.
    """
    whole, host, lines, dropped = free_names(docs, "_whole", "_host", "_lines", "_dropped")
    found = drop_boilerplate(docs.withColumn(whole, F.col("text")), F.col("source"), F.col("text"), *STAGE_RULES[0], more_rules=STAGE_RULES[1:], copies_once=True, added=(host, lines, dropped))
    found = found.withColumn("text", F.when(F.col(dropped) > 0, F.col("text")).otherwise(F.col(whole)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates: Jaccard similarity of 0.8 on five words.

    Null and repeated ids, texts without words, very long texts, clashing columns and empty tables are treated as
    ``keep_one_of_each`` says.
    """
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them, repeated where their source has several epochs.

    Documents without words go, as they fill no target. Null sources, repeated rows, clashing columns and empty
    tables are treated as ``take_mix`` says.
    """
    return take_mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, and digests of each document's ids and of the text decoded from them, row by row.

    Null and empty texts have no ids; very long ones are encoded whole; repeated rows stay; other columns go.
    """
    return digests(docs.select("doc_id", "source", "text"), vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
