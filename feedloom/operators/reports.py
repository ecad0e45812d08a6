"""Reports over ranked issues and clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import metrics


def funnel(submissions: DataFrame, clusters: DataFrame, issues: DataFrame, top: int = 10) -> DataFrame:
    """(submissions, clusters, issues, top): how far each step condenses."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(submissions, "submissions").crossJoin(n(clusters, "clusters")).crossJoin(n(issues, "issues")).withColumn("top", F.least("issues", F.lit(top)))  # one row each


def movement(weighted: DataFrame, flat: DataFrame, top: int | None = 10) -> DataFrame:
    """(cluster_id, weighted, flat, movement) of the weighted list's first rows; a cluster the flat list lacks counts as behind its end."""
    w = weighted.select("cluster_id", F.col("position").alias("weighted"))
    if top:
        w = w.filter(F.col("weighted") <= top)
    end = flat.agg((F.count("*") + 1).cast("int").alias("end_"))
    j = w.join(flat.select("cluster_id", F.col("position").alias("flat")), "cluster_id", "left").crossJoin(F.broadcast(end))  # one row
    return j.select("cluster_id", "weighted", F.coalesce("flat", "end_").alias("flat"), (F.coalesce("flat", "end_") - F.col("weighted")).alias("movement"))


def fragmentation(table: DataFrame, positions: DataFrame, top: int = 10) -> DataFrame:
    """(topic, rows): topics that hold most of more than one of the first rows of a ranked list. table: contingency; positions: (label, position)."""
    named = metrics.plurality(table, "predicted", "truth").join(positions.filter(F.col("position") <= top).select(F.col("label").alias("predicted")), "predicted", "left_semi")
    return named.groupBy(F.col("truth").alias("topic")).agg(F.count("*").alias("rows")).filter("rows > 1").orderBy(F.desc("rows"), "topic")


def on_off(before: DataFrame, after: DataFrame) -> DataFrame:
    """(consolidation, issues, largest) of two labellings (id, cluster_id)."""
    def said(labels: DataFrame, name: str) -> DataFrame:
        size = labels.groupBy("cluster_id").agg(F.count("*").alias("n"))
        return size.agg(F.lit(name).alias("consolidation"), F.count("*").alias("issues"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))

    return said(before, "off").unionByName(said(after, "on"))


def as_text(df: DataFrame, columns: list[str], widths: list[int]) -> DataFrame:
    """(line): every row in columns of fixed width, the last one as long as it is; numbers stand right."""
    kinds = dict(df.dtypes)
    cells = []
    for k, (c, w) in enumerate(zip(columns, widths)):
        t = F.coalesce(F.col(c).cast("string"), F.lit("-"))
        number = kinds[c] in ("int", "bigint", "double", "float", "smallint")
        cells.append(t if k == len(columns) - 1 and not number else F.lpad(t, w, " ") if number else F.rpad(t, w, " "))
    return df.select(F.concat_ws("  ", *cells).alias("line"))


def ranked_lines(issues: DataFrame, limit: int) -> DataFrame:
    """(position, line) of a ranked list (position, title, score, explanation): the first rows as a reader sees them."""
    line = F.format_string("%2d. %s (%.2f): %s", "position", F.coalesce("title", F.lit("")), "score", "explanation")
    return issues.filter(F.col("position") <= limit).select("position", line.alias("line"))
