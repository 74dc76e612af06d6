"""The corpus pipeline: each stage is one operator, written out as Parquet and read again by the next.

Every stage works on all documents that its predecessor kept, and returns their columns; the last returns
the pieces of the packed sequences.  Stages that judge a row by its own text filter the rows as they pass,
so rows with null or repeated ids are judged like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm import decontamination, fertility, minhash, packing, toxicity
from epochal.llm.work import Work


def _where(docs: DataFrame, keeps: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keeps(batch), pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine, trained on the labelled ones, calls toxic go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sent = spark.sparkContext.broadcast(model)
    return _where(docs, lambda batch: sent.value.probability(toxicity.highest_words(batch.column("text"), sent.value.table)) < toxicity.THRESHOLD)


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return fertility.keep(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.  Null ids form no group.

    Rows are told apart by id and text, so rows with one id and different texts are not taken for copies.
    """
    kept = minhash.near_duplicates(docs, width=5).where("first and doc_id is not null").select("doc_id", "text_key").distinct()
    key = [F.col("doc_id").cast("long").alias("_i"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_t")]
    named = docs.where("doc_id is not null").select(F.struct("*").alias("_d"), *key)
    named = named.join(kept.select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_t")), ["_i", "_t"], "left_semi").dropDuplicates(["_i", "_t"])
    return named.select("_d.*").unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or most of one, go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_junk), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]

ORACLE_SQL = None
"""Tokens, learned scores and sketches are not expressible in SQL; tests/llm compares with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Work(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
