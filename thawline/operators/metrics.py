"""Accuracy: NDCG, precision, recall, hit rate at K in both directions; ceilings, buckets, curves, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running

METRICS = ("NDCG", "Precision", "Recall", "HitRate")


def ideal(k_len: int) -> Column:
    """array of the ideal DCG with 1, 2, ... relevant items."""
    import math

    out, total = [], 0.0
    for r in range(1, k_len + 1):
        total += 1 / math.log2(r + 1)
        out.append(F.lit(total))
    return F.array(*out)


def gains(recs: DataFrame, held: DataFrame, by: list[str], who: str, what: str, k_len: int, keys: DataFrame | None = None) -> DataFrame:
    """(by..., who, hits, rel, shown, NDCG, Precision, Recall, HitRate) for every ``who`` with a held-out row; who has
    no hit counts 0.  ``keys`` holds the combinations of ``by`` to report."""
    rel = held.groupBy(who).agg(F.count("*").alias("rel"))
    found = recs.join(held.select(who, what).withColumn("hit", F.lit(1)), [who, what], "left")
    hit = F.col("hit").isNotNull()
    per = found.groupBy(*by, who).agg(F.count_if(hit).alias("hits"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count("*").alias("shown"))
    keys = recs.select(*by).distinct() if keys is None else keys
    out = (rel.join(keys) if by else rel).join(per, [*by, who], "left").fillna(0, ["hits", "dcg", "shown"])
    idcg = F.element_at(ideal(k_len), F.least("rel", F.lit(k_len)).cast("int"))
    return out.select(
        *by, who, "hits", "rel", "shown", (F.col("dcg") / idcg).alias("NDCG"), (F.col("hits") / F.lit(k_len)).alias("Precision"),
        (F.col("hits") / F.col("rel")).alias("Recall"), (F.col("hits") > 0).cast("double").alias("HitRate"),
    )


def by_list_length(gained: DataFrame) -> DataFrame:
    """Precision over the actual list, not over K (the item-to-user convention)."""
    return gained.withColumn("Precision", F.coalesce(F.col("hits") / F.nullif(F.col("shown"), F.lit(0)), F.lit(0.0)))


def macro(gained: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """(by..., metric, value, n_eval): means over all evaluated rows, long form."""
    one = gained.groupBy(*by).agg(*(F.avg(m).alias(m) for m in METRICS), F.count("*").alias("n_eval"))
    return one.unpivot([*by, "n_eval"], list(METRICS), "metric", "value").select(*by, "metric", F.round("value", digits).alias("value"), "n_eval")


def degree_buckets(degrees: DataFrame, n: int = 3) -> DataFrame:
    """(item_id, degree, bucket from 0): equal counts by (degree, item_id); the first buckets take what is left over."""
    placed = running(degrees.select("item_id", "degree"), ["degree", "item_id"])
    bucket = f"CASE WHEN before < (total % {n}) * (total div {n} + 1) THEN before div (total div {n} + 1) ELSE total % {n} + (before - (total % {n}) * (total div {n} + 1)) div greatest(total div {n}, 1) END"
    return placed.select("item_id", "degree", F.expr(bucket).cast("int").alias("bucket"))


def bucket_hits(recs: DataFrame, held: DataFrame, buckets: DataFrame) -> DataFrame:
    """Hit rate and discounted gain per held-out row and bucket; a row's ideal gain is 1."""
    rows = held.join(buckets, "item_id").join(recs.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left")
    hit = F.col("rank").isNotNull()
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n_interactions"), F.round(F.avg(hit.cast("double")), 6).alias("hitrate"),
        F.round(F.avg(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias("ndcg"),
    )


def item_to_user_ceiling(held: DataFrame, k_len: int) -> DataFrame:
    """Best precision and recall that K places allow an item with r held-out users."""
    r = held.groupBy("item_id").agg(F.count("*").alias("r"))
    return r.select("item_id", "r", (F.least("r", F.lit(k_len)) / F.lit(k_len)).alias("precision_max"), (F.least("r", F.lit(k_len)) / F.col("r")).alias("recall_max"))


def across_seeds(curve: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation over seeds; undefined values don't count."""
    return curve.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def paired_t(a: DataFrame, b: DataFrame, by: list[str], pair: list[str]) -> DataFrame:
    """Paired t statistic of a.value - b.value over ``pair``."""
    d = a.select(*by, *pair, F.col("value").alias("x")).join(b.select(*by, *pair, F.col("value").alias("y")), [*by, *pair]).withColumn("d", F.col("x") - F.col("y"))
    out = d.groupBy(*by).agg(F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.count("d").alias("n"))
    return out.select(*by, "mean_diff", "n", (F.col("mean_diff") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).alias("t"))


def difference_curve(curve: DataFrame, arm: str, base: str, t_value: float) -> DataFrame:
    """Per k: the paired difference of two arms over seeds, its interval, and whether that clears zero."""
    a, b = (curve.where(F.col("arm") == x).select("k", "seed", F.col("value").alias(n)) for x, n in ((arm, "x"), (base, "y")))
    d = a.join(b, ["k", "seed"]).groupBy("k").agg(F.avg(F.col("x") - F.col("y")).alias("diff"), F.stddev_samp(F.col("x") - F.col("y")).alias("sd"), F.count("*").alias("n"))
    half = t_value * F.col("sd") / F.sqrt("n")
    return d.select("k", "diff", (F.col("diff") - half).alias("low"), (F.col("diff") + half).alias("high"), (F.abs("diff") > half).alias("clear"))


def unpaired_difference(curve: DataFrame, base: str, t_value: float) -> DataFrame:
    """Per arm and k: the mean over seeds less the base arm's mean, and the interval of the arm's own mean (population deviation)."""
    one = across_seeds(curve, ["arm", "k"])
    ref = one.where(F.col("arm") == base).select("k", F.col("mean").alias("base_mean"))
    half = t_value * F.col("std") / F.sqrt("n")
    return one.where(F.col("arm") != base).join(ref, "k").select("arm", "k", (F.col("mean") - F.col("base_mean")).alias("diff"), half.alias("half"))


def clear_levels(differences: DataFrame) -> DataFrame:
    """One row: at how many levels the paired interval clears zero, of how many."""
    return differences.agg(F.count_if("clear").alias("n_clear"), F.count("*").alias("n_levels"))


def relative_delta(curve: DataFrame, base: str, by: list[str]) -> DataFrame:
    """Percent difference of every arm from ``base``; null where that is 0."""
    ref = curve.where(F.col("arm") == base).select(*by, F.col("value").alias("base_value"))
    return curve.where(F.col("arm") != base).join(ref, by).select("arm", *by, "value", ((F.col("value") / F.nullif("base_value", F.lit(0.0)) - 1) * 100).alias("delta_pct"))
