"""Taking rows out of a wide table without shuffling it, where the list of rows allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.plans.scratch import materialise

#: Most rows of (id, mark) that are broadcast; longer lists go through a shuffle join.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def drop_rows(df: DataFrame, id_col: str, mark: Column, gone: DataFrame, once: DataFrame) -> DataFrame:
    """df without the rows listed in gone, and with one copy of those listed in once; all columns stay.

    mark: a non-null hash of a row's text. gone, once: (id, mark), without repeats.
    """
    tagged = df.withColumn("__mark", mark)

    def matched(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        listed = listed.select(F.col("id").alias("__id"), F.col("mark").alias("__m"))
        return rows.join(small(listed), (F.col("__mark") == F.col("__m")) & F.col(id_col).eqNullSafe(F.col("__id")), how)

    left = matched(tagged, materialise(gone, "gone"), "left_anti")
    once = materialise(once, "once")
    if not once.isEmpty():
        copy = F.row_number().over(Window.partitionBy("__mark", id_col).orderBy(F.lit(0)))
        first = matched(left, once, "left_semi").withColumn("__copy", copy).where("__copy = 1").drop("__copy")
        left = matched(left, once, "left_anti").unionByName(first)
    return left.select(*df.columns)
