"""Selection over a metrics table: objectives, constrained argmax, best points, rank agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import DEFAULT_WEIGHTS


def objective(curve: DataFrame, by: list[str]) -> DataFrame:
    """Mean over the k levels and the ceiling."""
    return curve.groupBy(*by).agg(F.avg("value").alias("objective"))


def field_weights(prose: float, reviews: float) -> dict[str, float]:
    """Weights of the roles from the weight of the prose as a whole: title and blurb share it so that their squares add up to its square."""
    return DEFAULT_WEIGHTS | {"title": prose / 2**0.5, "blurb": prose / 2**0.5, "reviews": reviews}


def constrained_argmax(points: DataFrame, by: list[str], tolerance: float = 0.02) -> DataFrame:
    """Per group the point of the greatest objective among those whose ``warm`` is within ``tolerance`` of the
    group's best; among all of them where warm is undefined."""
    floor = (1 - tolerance) * F.max("warm").over(Window.partitionBy(*by))
    ok = points.withColumn("feasible", F.coalesce(F.col("warm") >= floor, F.lit(False)))
    any_ok = F.max(F.col("feasible").cast("int")).over(Window.partitionBy(*by))
    kept = ok.withColumn("any_ok", any_ok).where((F.col("feasible")) | (F.col("any_ok") == 0))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("objective"), "point"))
    return kept.withColumn("place", place).where("place = 1").select(*by, "point", "objective", "warm")


def best_points(points: DataFrame, by: list[str], n: int = 2) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("objective"), "point"))
    return points.withColumn("place", place).where(F.col("place") <= n).select(*by, "place", "point", "objective")


def rank_agreement(points: DataFrame, a: str, b: str) -> DataFrame:
    """(point, rank by a, rank by b, whether they agree)."""
    ranks = points.select("point", F.rank().over(Window.orderBy(F.desc(a))).alias("rank_a"), F.rank().over(Window.orderBy(F.desc(b))).alias("rank_b"))
    return ranks.withColumn("agree", F.col("rank_a") == F.col("rank_b"))
