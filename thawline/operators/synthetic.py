"""Synthetic interactions: pair scoring, selection, controls, priors, audits and the resumable queue's plan."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import read_stats, write_text
from .ranking import hash_sample, running, top_per_key

#: Scores (user_id, item_id, prompt) rows of a batch; the default needs no model.
PairScorer = Callable[[list[int], list[int], list[str]], list[float]]


def hashed_scorer(users: list[int], items: list[int], prompts: list[str]) -> list[float]:
    """Deterministic stand-in for a language model: log odds in [-4, 4) from the md5 of the pair."""
    return [(int(hashlib.md5(f"{u}|{i}".encode()).hexdigest()[:8], 16) % 8000) / 1000 - 4 for u, i in zip(users, items)]


def score_pairs(pairs: DataFrame, scorer: PairScorer = hashed_scorer, done=None) -> DataFrame:
    """(user_id, item_id, score) from (user_id, item_id, prompt), batch by batch in the tasks.  ``done``, an accumulator of numbers, is told
    how many pairs are scored: the driver may read it while the job runs."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            u, i = b.column("user_id"), b.column("item_id")
            scores = scorer(u.to_pylist(), i.to_pylist(), b.column("prompt").to_pylist())
            if done is not None:
                done.add(len(scores))
            yield pa.RecordBatch.from_arrays([u, i, pa.array(scores, pa.float64())], ["user_id", "item_id", "score"])

    types = dict(pairs.dtypes)
    return pairs.select("user_id", "item_id", "prompt").mapInArrow(run, f"user_id {types['user_id']}, item_id {types['item_id']}, score double")


def repair(stored: DataFrame, wanted: DataFrame, scorer: PairScorer = hashed_scorer) -> DataFrame:
    """(user_id, item_id, score, rescored) of the wanted pairs (user_id, item_id, prompt): stored scores stay, only missing pairs are scored."""
    keys = ["user_id", "item_id"]
    stayed = stored.join(wanted.select(*keys), keys, "left_semi").select(*keys, "score", F.lit(False).alias("rescored"))
    return stayed.unionByName(score_pairs(wanted.join(stored.select(*keys), keys, "left_anti"), scorer).withColumn("rescored", F.lit(True)))


def adjusted(scored: DataFrame, priors: DataFrame | None) -> DataFrame:
    """score minus the user's own prior (0 where unknown); NaN scores are undefined."""
    out = scored.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    if priors is None:
        return out
    return out.join(priors.select("user_id", "prior"), "user_id", "left").withColumn("score", F.col("score") - F.coalesce("prior", F.lit(0.0))).drop("prior")


def select_top(scored: DataFrame, n: int, priors: DataFrame | None = None) -> DataFrame:
    """The n best users of each item; ties to the smaller user, undefined scores never."""
    rows = adjusted(scored, priors).where("score is not null")
    return top_per_key(rows, ["item_id"], [F.desc("score"), "user_id"], n)


def select_floored(scored: DataFrame, n: int, priors: DataFrame | None = None, floor: float = 0.0, digits: int | None = None) -> DataFrame:
    """Top n among the pairs that score above ``floor``, in ``digits`` decimals if asked; an item may get none."""
    rows = adjusted(scored, priors)
    rows = (rows if digits is None else rows.withColumn("score", F.round("score", digits))).where(F.col("score") > floor)
    return top_per_key(rows, ["item_id"], [F.desc("score"), "user_id"], n)


def item_counts(relation: DataFrame) -> DataFrame:
    return relation.groupBy("item_id").agg(F.count("*").alias("n"))


def _draw(seed: int):
    return F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.lit(str(seed))))


def random_n(candidates: DataFrame, n: int | DataFrame, seed: int) -> DataFrame:
    """Control: n users of each item's candidates by hash; ``n`` may be (item_id, n) to match another arm's volume."""
    wanted = candidates.withColumn("n", F.lit(n)) if isinstance(n, int) else candidates.join(n.select("item_id", "n"), "item_id")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(_draw(seed), "user_id"))
    return wanted.withColumn("place", place).where(F.col("place") <= F.col("n")).select("user_id", "item_id")


def popularity_n(candidates: DataFrame, train: DataFrame, n: int) -> DataFrame:
    """Control: the n most active candidates of each item."""
    degree = train.groupBy("user_id").agg(F.count("*").alias("degree"))
    rows = candidates.join(degree, "user_id", "left").fillna(0, ["degree"])
    return top_per_key(rows, ["item_id"], [F.desc("degree"), "user_id"], n)


def user_priors(scored: DataFrame) -> DataFrame:
    """(user_id, prior, n, within): mean score over the shared probe items, and the sample variance where n > 1."""
    return scored.where(~F.isnan("score")).groupBy("user_id").agg(F.avg("score").alias("prior"), F.count("score").alias("n"), F.when(F.count("score") > 1, F.var_samp("score")).alias("within"))


def variance_components(priors: DataFrame) -> DataFrame:
    """Noise of one probe, spread of the means, signal between users, and how many probes that asks for."""
    out = priors.agg(F.count("*").alias("n_users"), F.avg("within").alias("var_within"), F.avg(F.when(F.col("n") > 1, F.col("n"))).alias("n_eff"), F.var_samp("prior").alias("var_means"))
    out = out.withColumn("var_between", F.col("var_means") - F.col("var_within") / F.nullif("n_eff", F.lit(0.0)))
    return out.withColumn("n_required", F.when(F.col("var_between") > 0, F.col("var_within") / F.col("var_between")))


def impute_priors(users: DataFrame, priors: DataFrame, least: float = 0.98) -> DataFrame:
    """(user_id, prior, covered): unknown priors take the mean; ``covered`` tells whether coverage reaches ``least``."""
    one = priors.agg(F.avg("prior").alias("mean"))
    joined = users.join(priors.select("user_id", "prior"), "user_id", "left")
    gate = joined.agg((F.count("prior") / F.count("*") >= least).alias("covered"))
    return joined.join(one).join(gate).select("user_id", F.coalesce("prior", "mean").alias("prior"), "covered")


def abstentions(scored: DataFrame, n: int) -> DataFrame:
    """(item_id, positives, short): items whose candidates were endorsed fewer than n times."""
    out = scored.groupBy("item_id").agg(F.count_if(F.col("score") > 0).alias("positives"))
    return out.withColumn("short", F.col("positives") < n)


def abstention_rule(counted: DataFrame, most: float = 0.05) -> DataFrame:
    """One row: items, those that abstain, their share, and whether that is at most ``most``."""
    one = counted.agg(F.count("*").alias("n_items"), F.count_if("short").alias("n_short"))
    return one.withColumn("frac_short", F.col("n_short") / F.nullif("n_items", F.lit(0))).withColumn("usable", F.coalesce(F.col("frac_short") <= most, F.lit(False)))


def arms_by_n(scored: DataFrame, train: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """(n, arm, shared, union, jaccard): each control against the scored arm at each n.  Where n takes in all candidates, jaccard is 1: a check that all
    arms draw from one pool."""
    degree = train.groupBy("user_id").agg(F.count("*").alias("degree"))
    rows = adjusted(scored, None).join(degree, "user_id", "left").fillna(0, ["degree"]).withColumn("draw", _draw(seed))
    orders = {"top": [F.desc("score"), "user_id"], "random": ["draw", "user_id"], "popularity": [F.desc("degree"), "user_id"]}
    # a pair has its place in every arm at once: candidates are dealt once, and no arm is joined with another
    placed = rows.select("score", *(F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).alias(arm) for arm, order in orders.items()))
    counts = []
    for n in sizes:
        top = F.col("score").isNotNull() & (F.col("top") <= n)
        for arm in ("random", "popularity"):
            counts.append(F.struct(F.lit(n).alias("n"), F.lit(arm).alias("arm"), F.count_if(top & (F.col(arm) <= n)).alias("shared"), F.count_if(top | (F.col(arm) <= n)).alias("union")))
    out = placed.agg(F.array(*counts).alias("c")).select(F.inline("c"))
    return out.withColumn("jaccard", F.col("shared") / F.nullif("union", F.lit(0)))


def export_arms(arms: dict[tuple[str, int], DataFrame], path: str, fingerprint: str) -> None:
    """Writes (user_id, item_id) of each (arm, seed) under ``path``, in one table cut by arm and seed; seed -1 for arms that draw nothing.  The
    fingerprint of the split they belong to is stamped beside it."""
    out = None
    for (arm, seed), rows in arms.items():
        one = rows.select("user_id", "item_id", F.lit(arm).alias("arm"), F.lit(seed).alias("seed"))
        out = one if out is None else out.unionByName(one)
    spark = out.sparkSession
    write_text(spark, f"{path.rstrip('/')}.stats", json.dumps({"fingerprint": fingerprint}))
    out.write.partitionBy("arm", "seed").mode("errorifexists").option("compression", "zstd").parquet(path)


def read_arms(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Refuses relations that were made from another split."""
    held = read_stats(spark, path).get("fingerprint")
    if held != fingerprint:
        raise ValueError(f"the synthetic relations belong to another split: {held!r}")
    return spark.read.parquet(path).select("arm", "seed", "user_id", "item_id")


def probe_items(warm: DataFrame, n: int, seed: int) -> DataFrame:
    return hash_sample(warm.select("item_id").distinct(), "item_id", n, seed)


def pair_audit(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, item_id, state): kept, stale (stored only) or missing (wanted only)."""
    keys = ["user_id", "item_id"]
    both = stored.select(*keys, F.lit(1).alias("s")).join(wanted.select(*keys, F.lit(1).alias("w")), keys, "full")
    return both.select(*keys, F.when(F.col("w").isNull(), "stale").when(F.col("s").isNull(), "missing").otherwise("kept").alias("state"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs in common, pairs in all, and their ratio."""
    keys = ["user_id", "item_id"]
    both = a.select(*keys, F.lit(1).alias("a")).join(b.select(*keys, F.lit(1).alias("b")), keys, "full")
    out = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count("*").alias("union"))
    return out.withColumn("jaccard", F.col("shared") / F.nullif("union", F.lit(0)))


def completeness(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Statistics of the assembled scores, and how many wanted pairs lack one."""
    missing = wanted.join(scored, ["user_id", "item_id"], "left_anti").agg(F.count("*").alias("missing"))
    return scored.agg(F.count("*").alias("n_pairs"), F.avg((F.col("score") > 0).cast("double")).alias("frac_yes"), F.avg("score").alias("mean_score")).join(missing)


def check_complete(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The scores, refused where a wanted pair lacks one."""
    if missing := completeness(scored, wanted).first()["missing"]:
        raise ValueError(f"{missing} pairs have no score")
    return scored


def plan_chunks(items: DataFrame, size: int = 64) -> DataFrame:
    """(item_id, chunk): items in id order, ``size`` to a chunk; the same items always make the same chunks."""
    return running(items.select("item_id"), ["item_id"]).select("item_id", F.floor(F.col("before") / size).cast("int").alias("chunk"))


def progress(planned: DataFrame, done: DataFrame) -> DataFrame:
    state = planned.select("chunk").distinct().join(done.select("chunk").distinct().withColumn("d", F.lit(1)), "chunk", "left")
    return state.agg(F.count("*").alias("chunks"), F.count("d").alias("done"))
