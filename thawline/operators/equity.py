"""Provider exposure: discounted exposure, shares, Gini, merit, ratios and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DISCOUNTS, discount
from .ranking import head, running

VERSION = 1


def weights(spark, names: tuple[str, ...] = DISCOUNTS, k_len: int = 100) -> DataFrame:
    """(discount, rank, w): one row per named discount and rank."""
    ranks = spark.range(1, k_len + 1).select(F.col("id").cast("int").alias("rank"))
    rows = F.array(*(F.struct(F.lit(n).alias("discount"), discount(n, F.col("rank")).alias("w")) for n in names))
    return ranks.select("rank", F.inline(rows)).select("discount", "rank", "w")


def exposure_by_rank(recs: DataFrame, providers: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rank, provider, cold, n): how often a provider stands at a rank.  Items without a provider are out of sight."""
    return recs.join(providers, "item_id").groupBy(*by, "rank", "provider", "cold").agg(F.count("*").alias("n"))


def exposure(counts: DataFrame, w: DataFrame, by: list[str]) -> DataFrame:
    """(by..., discount, provider, exposure, cold_exposure) under every discount, from the counts alone."""
    return counts.join(F.broadcast(w), "rank").groupBy(*by, "discount", "provider").agg(
        F.sum(F.col("n") * F.col("w")).alias("exposure"), F.sum(F.when(F.col("cold"), F.col("n") * F.col("w")).otherwise(0.0)).alias("cold_exposure"))


def universe(exposed: DataFrame, providers: DataFrame, by: list[str]) -> DataFrame:
    """Every provider for every combination, with 0 where it got nothing: shares and Gini are over all of them."""
    names = providers.select("provider").distinct()
    keys = exposed.select(*by).distinct()
    return keys.join(names).join(exposed, [*by, "provider"], "left").fillna(0.0, ["exposure", "cold_exposure"])


def with_share(rows: DataFrame, c: str, by: list[str], name: str = "share") -> DataFrame:
    """``rows`` with each one's share of its group's total, 0 where that is 0.  Totals are added up before the shuffle, one row a group."""
    totals = rows.groupBy(*by).agg(F.sum(c).alias("_total"))
    return rows.join(totals, by).withColumn(name, F.coalesce(F.col(c) / F.nullif("_total", F.lit(0.0)), F.lit(0.0))).drop("_total")


def gini(values: DataFrame, by: list[str], c: str) -> DataFrame:
    """(by..., gini) over non-negative values; 0 where they add up to 0.

    Equal values need no order among themselves, so they are counted first: the ranks of n equal values
    from position b on add up to n * (2 b + n + 1) / 2.
    """
    tied = values.groupBy(*by, F.col(c).alias("v")).agg(F.count("*").alias("n"))
    placed = running(tied, ["v"], by, "n").withColumn("place_sum", F.col("n") * (2 * F.col("before") + F.col("n") + 1) / 2.0)
    out = placed.groupBy(*by).agg(F.sum("n").alias("count"), F.sum(F.col("v") * F.col("n")).alias("total"), F.sum(F.col("v") * F.col("place_sum")).alias("ranked"))
    value = (2 * F.col("ranked") - (F.col("count") + 1) * F.col("total")) / F.nullif(F.col("count") * F.col("total"), F.lit(0.0))
    return out.select(*by, F.coalesce(F.when(F.col("total") > 0, value), F.lit(0.0)).alias("gini"))


def top_share(values: DataFrame, by: list[str], c: str, frac: float = 0.01) -> DataFrame:
    """Share of the top ceil(n * frac) providers, at least one."""
    kept = running(values.select(*by, "provider", c), [F.desc(c), "provider"], by).where(F.col("before") < F.greatest(F.lit(1), F.ceil(F.col("total") * frac)))
    return kept.groupBy(*by).agg(F.sum(c).alias("top_share"))


def catalog_share(providers: DataFrame, cold_only: bool = False) -> DataFrame:
    """(provider, ref): share of the pool's items, all of them or the cold ones."""
    rows = providers.groupBy("provider").agg((F.count_if("cold") if cold_only else F.count("*")).cast("double").alias("ref"))
    return rows.join(rows.agg(F.sum("ref").alias("t"))).select("provider", F.coalesce(F.col("ref") / F.nullif("t", F.lit(0.0)), F.lit(0.0)).alias("ref"))


def merit_share(held: DataFrame, providers: DataFrame, name: str = "log", k_len: int = 100, cold_only: bool = True) -> DataFrame:
    """(provider, ref): exposure that relevant items would get from ideal lists.  A user with R held-out
    items gives each the mean of the first min(R, K) weights, spread over R."""
    spark = held.sparkSession
    w = weights(spark, (name,), k_len).select("rank", F.sum("w").over(Window.orderBy("rank")).alias("cum"))  # k_len rows
    per = held.groupBy("user_id").agg(F.count("*").alias("r")).withColumn("rank", F.least("r", F.lit(k_len)).cast("int"))
    value = per.join(F.broadcast(w), "rank").select("user_id", (F.col("cum") / F.col("r")).alias("value"))
    rows = held.join(providers.where("cold") if cold_only else providers, "item_id").join(value, "user_id").groupBy("provider").agg(F.sum("value").alias("m"))
    every = providers.select("provider").distinct().join(rows, "provider", "left").fillna(0.0, ["m"])
    total = every.agg(F.sum("m").alias("t"))
    return every.join(total).select("provider", F.coalesce(F.col("m") / F.nullif("t", F.lit(0.0)), F.lit(0.0)).alias("ref"))


def ratios(shares: DataFrame, reference: DataFrame, by: list[str], c: str) -> DataFrame:
    """(by..., provider, share, ref, ratio): null where the reference has nothing of a provider."""
    return shares.join(reference, "provider").select(*by, "provider", F.col(c).alias("share"), "ref", (F.col(c) / F.nullif("ref", F.lit(0.0))).alias("ratio"))


QUANTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def ratio_stats(r: DataFrame, by: list[str]) -> DataFrame:
    """Ten summaries of the defined ratios of each group; percentiles interpolate linearly between neighbours, which are found by their ranks, so no
    group is gathered."""
    defined = F.col("ratio").isNotNull()
    mass = F.when(defined, F.col("share"))
    out = r.groupBy(*by).agg(
        (F.sum(F.col("share") * F.col("ratio")) / F.nullif(F.sum(mass), F.lit(0.0))).alias("exposure_weighted_mean"), F.avg("ratio").alias("unweighted_mean"),
        F.exp(F.avg(F.when(F.col("ratio") > 0, F.log("ratio")))).alias("geometric_mean"),
        F.avg((F.col("ratio") < 1).cast("double")).alias("frac_below_1"), F.count("ratio").alias("n_scored"),
    )
    placed = running(r.where(defined).select(*by, "ratio"), ["ratio"], by)
    place = lambda q: F.lit(q) * (F.col("total") - 1)
    at = lambda rank: F.max(F.when(F.col("before") == rank, F.col("ratio")))
    ends = [x for n, q in QUANTILES.items() for x in (at(F.floor(place(q))).alias(f"{n}_lo"), at(F.ceil(place(q))).alias(f"{n}_hi"), F.max(place(q) - F.floor(place(q))).alias(f"{n}_part"))]
    cut = placed.groupBy(*by).agg(*ends)
    values = [(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n) for n in QUANTILES]
    return out.join(cut.select(*by, *values), by, "left")


def merit_guarded(stats: DataFrame, scored_users: DataFrame, held: DataFrame) -> DataFrame:
    """Merit statistics are null unless the scored users are just those with held-out rows."""
    a, b = scored_users.select("user_id").distinct(), held.select("user_id").distinct()
    odd = a.join(b, "user_id", "left_anti").union(b.join(a, "user_id", "left_anti")).agg(F.count("*").alias("odd"))
    values = [c for c, t in stats.dtypes if t == "double" or c == "n_scored"]
    return stats.join(odd).select(*(F.when(F.col("odd") == 0, F.col(c)).alias(c) if c in values else F.col(c) for c in stats.columns))


def report(full: DataFrame, providers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., gini, gini_cold, cold_share, top1_share, version) for every discount at once, from ``universe``'s rows."""
    shares = with_share(full.select(*keys, "provider", "exposure", "cold_exposure"), "exposure", keys, "s")
    cold = full.groupBy(*keys).agg((F.sum("cold_exposure") / F.nullif(F.sum("exposure"), F.lit(0.0))).alias("cold_share"))
    has_cold = providers.where("cold").select("provider").distinct()
    only_cold = shares.join(has_cold, "provider", "left_semi")
    return (
        gini(shares, keys, "exposure")
        .join(gini(only_cold, keys, "cold_exposure").withColumnRenamed("gini", "gini_cold"), keys, "left")
        .join(cold, keys)
        .join(top_share(shares, keys, "s").withColumnRenamed("top_share", "top1_share"), keys)
        .withColumn("version", F.lit(VERSION))
    )


def ratio_tables(full: DataFrame, providers: DataFrame, held: DataFrame, keys: list[str], names: tuple[str, ...], k_len: int, users: DataFrame) -> DataFrame:
    """(keys..., reference, ten statistics): exposure against the share of all items (catalog), cold exposure against the share of cold items
    (cold) and against merit, which is null unless ``users`` (the scored ones) are just those with held-out rows.  ``keys`` has discount."""
    all_of, cold_of = with_share(full, "exposure", keys, "s"), with_share(full, "cold_exposure", keys, "s")
    merit = None
    for name in names:
        one = merit_share(held, providers, name, k_len).withColumn("discount", F.lit(name))
        merit = one if merit is None else merit.unionByName(one)
    merit_rows = cold_of.join(merit, ["discount", "provider"]).select(*keys, "provider", F.col("s").alias("share"), "ref", (F.col("s") / F.nullif("ref", F.lit(0.0))).alias("ratio"))
    tables = {
        "catalog": ratio_stats(ratios(all_of, catalog_share(providers), keys, "s"), keys),
        "cold": ratio_stats(ratios(cold_of, catalog_share(providers, cold_only=True), keys, "s"), keys),
        "merit": merit_guarded(ratio_stats(merit_rows, keys), users, held),
    }
    out = None
    for name, rows in tables.items():
        rows = rows.withColumn("reference", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def seed_variance(shares: DataFrame, by: list[str], top_n: int | None = None) -> DataFrame:
    """Mean, deviation and coefficient of variation of each provider's share over seeds; the ``top_n`` greatest means, if asked."""
    out = shares.groupBy(*by, "provider").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"))
    out = out.withColumn("cv", F.col("std") / F.nullif(F.greatest("mean", F.lit(0.0)), F.lit(0.0)))
    return head(out, [F.desc(F.round("mean", 9)), *by, "provider"], top_n)


def coverage_gap(users: DataFrame, covered: DataFrame) -> int:
    """How many users no model covers; callers refuse to go on unless it is 0."""
    return users.join(covered, "user_id", "left_anti").count()


def common_users(*covered: DataFrame | None) -> DataFrame | None:
    """Users that every model covers; None covers all."""
    out = None
    for c in covered:
        if c is not None:
            out = c.select("user_id").distinct() if out is None else out.intersect(c.select("user_id"))
    return out


def check_unattributed(providers: DataFrame, most: float = 0.02) -> float:
    """Share of items without a named provider; refused at ``most`` or above."""
    got = providers.agg(F.avg((F.col("provider") == "UNKNOWN").cast("double"))).first()[0] or 0.0
    if got >= most:
        raise ValueError(f"{got:.1%} of the items have no provider")
    return got
