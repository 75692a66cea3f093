"""Ranks over a whole relation without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import materialise


def hash_rank(ids: DataFrame, column: str, seed: int | str) -> DataFrame:
    """``ids`` with ``draw`` (1, 2, ...): the place of each id in the order of md5(id|seed).

    The first three hex digits deal the ids to 4096 even groups; each group numbers its own ids and adds
    the count of the groups before it.  Draws of n ids are ``draw <= n``: the next draw never disturbs them.
    """
    keyed = ids.withColumn("_h", F.md5(F.concat(F.col(column).cast("string"), F.lit(f"|{seed}")))).withColumn("_g", F.substring("_h", 1, 3))
    groups = keyed.groupBy("_g").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # over at most 4096 rows
    before = groups.select("_g", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_g").orderBy("_h", column))
    return keyed.join(F.broadcast(before), "_g").withColumn("draw", within + F.col("_before")).drop("_h", "_g", "_before")


def running(rows: DataFrame, order: list, by: list[str] = [], weight: str | None = None) -> DataFrame:
    """``rows`` with ``before`` (the sum of ``weight``, or the number, of the rows that come earlier in the total ``order`` of their group ``by``) and
    ``total`` (of the whole group).  No group is one task's work: rows are dealt by range, each range adds up its own and takes on the sums
    of those before it, one small row a range and group.  For few groups of many rows."""
    one = F.col(weight) if weight else F.lit(1).cast("long")
    ranged = materialise(rows.withColumn("_w", one).repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_p").agg(F.sum("_w").alias("_s"))
    ahead = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_p", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_s").over(Window.partitionBy(*by)).alias("total"))
    inside = F.sum("_w").over(Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_in", F.coalesce(inside, F.lit(0))).join(sums, [*by, "_p"])
    return placed.withColumn("before", F.col("_ahead") + F.col("_in")).drop("_w", "_p", "_ahead", "_in")


def head(rows: DataFrame, order: list, n: int | None = None) -> DataFrame:
    """The first n rows of a report in a total order; all of them without n.  Only n rows a task travel."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def hash_sample(ids: DataFrame, column: str, n: int, seed: int | str) -> DataFrame:
    """The first n ids in hash order: a sample that any engine with md5 can repeat."""
    return ids.orderBy(F.md5(F.concat(F.col(column).cast("string"), F.lit(f"|{seed}"))), column).limit(n)


def top_per_key(rows: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """At most n rows a key in a total order, numbered from 1.  Spark prunes each task to n rows a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, rank).where(F.col(name) <= n)
