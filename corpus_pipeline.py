"""The corpus pipeline: grade, near-dedup, repeats, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame; run() writes each as Parquet in the shared folder and rereads it as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.llm import decontam, near_dup, packing, quality, suffix
from reelgraph.llm import _common
from reelgraph.llm._common import drop_dir, on_workers, shared_dir, stored
from reelgraph.llm.queries import vocabulary


class _Spent(threading.local):
    def __init__(self):
        self.paths: list[str] = []


#: Working folders of the stage before, in this thread.
_spent = _Spent()


def stage(f):
    """When a stage begins, the one before has been written, and its working folders can go."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _spent.paths:
            drop_dir(spark, _spent.paths.pop())
        before = len(_common.MADE.paths)
        out = f(spark, docs, sf_dir)
        _spent.paths.extend(_common.MADE.paths[before:])
        del _common.MADE.paths[before:]
        return out

    return run_stage


def back(rows: DataFrame, docs: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """The columns of docs: own ones are the operator's, the others were carried along."""
    return rows.select(*[F.col(f"`{c}`") if c in own else F.col("carried").getField(c).alias(c) for c in docs.columns])


@stage
def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    on_workers(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    carry = tuple(c for c in docs.columns if c != "doc_id")
    return back(quality.grade_documents(docs, model, carry=carry).where("kept"), docs, ("doc_id",))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the least doc_id. Five words to a shingle.

    Rows of one doc_id are told apart by their texts; where they repeat both, one is left. Rows without a doc_id, and
    empty texts, resemble nothing and stay.
    """
    judged = near_dup.near_duplicates(docs)
    keys = judged.groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).agg(F.max("stays").alias("stays"), F.count_if(~F.col("stays")).alias("more"))
    keys = stored(keys.where("more > 0"), shared_dir(spark, "near-keys"))
    of = F.col("doc_id").eqNullSafe(F.col("_id")) & (near_dup.version(F.col("text").cast("string")) == F.col("_version"))
    whole = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.join(keys.where("NOT stays").drop("stays", "more"), of, "left_anti")
    twice = keys.where("stays").drop("stays", "more")
    if not twice.isEmpty():
        once = left.join(twice, of, "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(twice, of, "left_anti").unionByName(once)
    return left.select(*whole)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents are cut out; a document left without text goes. A null text becomes an
    empty one."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix.remove_repeats(docs, carry=carry)
    left = cut.where("n_removed = 0 OR trim(text) <> ''").withColumn("n_chars", F.length("text").cast("long"))
    return back(left, docs, ("doc_id", "text", "n_chars"))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    judged = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    gone = judged.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    of = F.col("doc_id").eqNullSafe(F.col("_id")) & (decontam.version(F.col("text").cast("string")) == F.col("_version"))
    return docs.join(gone, of, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality classifier", grade), ("minhash near-dedup", near_dedup), ("suffix-array dedup", repeats), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]

#: Training, minhash and tokenizing can't be said in SQL; tests/llm/test_pipeline.py holds run() and the stages against brute
#: force, grading against planted grades.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for i, (_, apply) in enumerate(STAGES):
        out = stored(apply(spark, docs, sf_dir), to := shared_dir(spark, f"stage-{i}"))
        if path:
            drop_dir(spark, path)
        docs, path = out, to
    return docs
