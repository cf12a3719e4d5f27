"""Command line: questions about videos whose frame vectors are in a table.

python -m reelgraph.app --frames DIR --questions FILE.tsv --output_dir DIR
python -m reelgraph.app --frames DIR --video_id 3 --question "..." --options "A. x, B. y"
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.models import StandIn
from reelgraph.operators.solve import accuracy, solve
from reelgraph.settings import settings
from reelgraph.sources import video


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--frames", required=True, help="Parquet of (video_id, frame_idx, v)")
    p.add_argument("--transcript", help="Parquet of (video_id, frame, said)")
    p.add_argument("--questions", help="tab separated file: video, question, candidates, answer")
    p.add_argument("--index", type=int, help="only this row of the file")
    p.add_argument("--video_id", type=int)
    p.add_argument("--question")
    p.add_argument("--options", default="")
    p.add_argument("--ground_truth", default="")
    p.add_argument("--max_steps", type=int, default=10)
    p.add_argument("--total_budget", type=int, default=32)
    p.add_argument("--output_dir", default="results")
    p.add_argument("--models", help="module:factory, a function without arguments that makes the models (see reelgraph.models.Models); a stand-in if not given")
    out = p.parse_args(given)
    if out.questions is None and (out.video_id is None or out.question is None):
        p.error("either --questions, or --video_id and --question")
    return out


def factory(name: str | None):
    """The function that makes models, by module:name. Workers import it by that name, too."""
    if not name:
        return StandIn
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def asked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(question_id, video_id, question, letter)"""
    if a.questions is None:
        return spark.createDataFrame([(0, a.video_id, f"{a.question} Options: {a.options}", a.ground_truth)], "question_id long, video_id long, question string, letter string")
    rows = video.questions_file(spark, a.questions)
    rows = rows if a.index is None else rows.where(F.col("row") == a.index)
    return rows.select(F.col("row").cast("long").alias("question_id"), F.col("video").try_cast("long").alias("video_id"), F.col("query").alias("question"), F.col("truth").alias("letter"))


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = arguments(given)
    spark = spark or SparkSession.builder.getOrCreate()
    questions = asked(spark, a)
    said = spark.read.parquet(a.transcript) if a.transcript else None
    answers = solve(spark.read.parquet(a.frames), questions, factory(a.models), said, settings(), a.max_steps, a.total_budget)
    video.write_answers(answers, a.output_dir)
    answers = spark.read.schema(answers.schema).json(f"{a.output_dir}/answers")
    accuracy(answers, questions.where("letter <> ''")).show()
    return answers


if __name__ == "__main__":
    main()
