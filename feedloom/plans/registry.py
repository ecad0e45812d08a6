"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.plans import core_problems, feedback, review

QUERIES = {**core_problems.QUERIES, **feedback.QUERIES, **review.QUERIES}
SQL = {**core_problems.SQL, **feedback.SQL, **review.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.rank_clusters(spark, sf_dir)
