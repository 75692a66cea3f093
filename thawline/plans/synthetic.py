"""Synthetic interactions, controls, audits, and selection over metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import synthetic as sy
from ..operators import tuning as tn
from ..sources.readers import Checkpoint, load_config, save_config, scratch_path
from .base import query
from .fixtures import table

#: A score for every pair of item and customer that met, in whole thousandths, so that no engine rounds it otherwise.
SCORED = "WITH sc AS (SELECT l_partkey AS item_id, o_custkey AS user_id, (sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // (count(*) * 1000)) / 1000 - 3 AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), pr AS (SELECT user_id, avg(score) AS prior, count(*) AS n, CASE WHEN count(*) > 1 THEN var_samp(score) END AS within FROM sc GROUP BY 1)"


def _scored(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    by = rows.groupBy(F.col("l_partkey").alias("item_id"), F.col("o_custkey").alias("user_id"))
    return by.agg((F.expr("sum(cast(round(l_extendedprice * 100) as bigint)) div (count(*) * 1000)") / 1000 - 3).alias("score"))


@query(SCORED + "SELECT item_id, user_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, user_id) AS rank FROM sc QUALIFY rank <= 7")
def select_top_n(spark, sf):
    """WIN-07, WIN-14, SYN-05"""
    return sy.select_top(_scored(spark, sf), 7).select("item_id", "user_id", "rank")


@query(SCORED + ", half AS (SELECT user_id, (sum(CAST(round((score + 4) * 1000) AS BIGINT)) // count(*)) / 1000 - 4 AS prior FROM sc WHERE user_id % 2 = 0 GROUP BY 1), adj AS (SELECT item_id, sc.user_id, round(score - coalesce(prior, 0), 3) AS score FROM sc LEFT JOIN half USING (user_id)) SELECT item_id, user_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, user_id) AS rank FROM adj WHERE score > 0 QUALIFY rank <= 7")
def select_floored(spark, sf):
    """SYN-06, JOIN-11: priors are known for every other user, 0 for the rest"""
    scored = _scored(spark, sf)
    whole = F.expr("sum(cast(round((score + 4) * 1000) as bigint)) div count(*)")
    prior = scored.where("user_id % 2 = 0").groupBy("user_id").agg((whole / 1000 - 4).alias("prior"))
    return sy.select_floored(scored, 7, prior, digits=3).select("item_id", "user_id", "rank")


@query(SCORED + "SELECT user_id, round(prior, 9) AS prior, n, round(within, 9) AS within FROM pr")
def user_priors(spark, sf):
    """SYN-04, AGG-17"""
    return sy.user_priors(_scored(spark, sf)).select("user_id", F.round("prior", 9).alias("prior"), "n", F.round("within", 9).alias("within"))


@query(SCORED + ", c AS (SELECT count(*) AS n_users, avg(within) AS var_within, avg(n) FILTER (n > 1) AS n_eff, var_samp(prior) AS var_means FROM pr) SELECT n_users, round(var_within, 6) AS var_within, round(n_eff, 6) AS n_eff, round(var_means, 6) AS var_means, round(var_means - var_within / nullif(n_eff, 0), 6) AS var_between FROM c")
def variance_components(spark, sf):
    """AGG-17"""
    out = sy.variance_components(sy.user_priors(_scored(spark, sf)))
    return out.select("n_users", *(F.round(c, 6).alias(c) for c in ("var_within", "n_eff", "var_means", "var_between")))


@query(SCORED + ", u AS (SELECT DISTINCT o_custkey AS user_id FROM orders) SELECT user_id, round(coalesce(prior, (SELECT avg(prior) FROM pr)), 9) AS prior, (SELECT count(*) FROM pr) / (SELECT count(*) FROM u) >= 0.98 AS covered FROM u LEFT JOIN pr USING (user_id)")
def imputed_priors(spark, sf):
    """SYN-08"""
    users = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return sy.impute_priors(users, sy.user_priors(_scored(spark, sf))).withColumn("prior", F.round("prior", 9))


@query(SCORED + "SELECT user_id, item_id FROM sc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5(user_id::VARCHAR || '|' || item_id::VARCHAR || '|3'), user_id) <= 7")
def random_n(spark, sf):
    """SMP-04, SYN-07"""
    return sy.random_n(_scored(spark, sf), 7, 3)


@query(SCORED + ", d AS (SELECT o_custkey AS user_id, count(*) AS degree FROM orders GROUP BY 1) SELECT item_id, user_id, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(degree, 0) DESC, user_id) AS rank FROM sc LEFT JOIN d USING (user_id) QUALIFY rank <= 7")
def popularity_n(spark, sf):
    """TOPK-06, SYN-07"""
    train = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    return sy.popularity_n(_scored(spark, sf), train, 7).select("item_id", "user_id", "rank")


@query(SCORED + "SELECT item_id, count(*) FILTER (score > 0) AS positives, count(*) FILTER (score > 0) < 40 AS short FROM sc GROUP BY 1")
def abstentions(spark, sf):
    """SYN-09, AGG-19"""
    return sy.abstentions(_scored(spark, sf), 40)


AUDIT = SCORED + ", a AS (SELECT user_id, item_id FROM sc WHERE user_id % 3 <> 0), b AS (SELECT user_id, item_id FROM sc WHERE user_id % 4 <> 0), f AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN b.user_id IS NULL THEN 'stale' WHEN a.user_id IS NULL THEN 'missing' ELSE 'kept' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id AND a.item_id = b.item_id)"


@query(AUDIT + "SELECT user_id, item_id, state FROM f")
def pair_audit(spark, sf):
    """SET-06, SYN-12, JOIN-12"""
    sc = _scored(spark, sf)
    return sy.pair_audit(sc.where("user_id % 3 <> 0"), sc.where("user_id % 4 <> 0"))


@query(AUDIT + """SELECT count(*) FILTER (state = 'kept') AS shared, count(*) AS "union", round(count(*) FILTER (state = 'kept') / count(*), 9) AS jaccard FROM f""")
def jaccard_arms(spark, sf):
    """SET-07"""
    sc = _scored(spark, sf)
    return sy.jaccard(sc.where("user_id % 3 <> 0"), sc.where("user_id % 4 <> 0")).withColumn("jaccard", F.round("jaccard", 9))


@query(SCORED + "SELECT count(*) FILTER (user_id % 5 <> 0) AS n_pairs, round(avg((score > 0)::INT) FILTER (user_id % 5 <> 0), 9) AS frac_yes, round(avg(score) FILTER (user_id % 5 <> 0), 6) AS mean_score, count(*) FILTER (user_id % 5 = 0) AS missing FROM sc")
def completeness(spark, sf):
    """SYN-03: assembled scores against the wanted pairs, a fifth of which lack"""
    sc = _scored(spark, sf)
    return sy.completeness(sc.where("user_id % 5 <> 0"), sc).withColumn("frac_yes", F.round("frac_yes", 9)).withColumn("mean_score", F.round("mean_score", 6))


@query(SCORED + "SELECT round(corr(score, prior), 6) AS corr, round(var_pop(prior) / var_pop(score), 6) AS var_ratio FROM sc JOIN pr USING (user_id)")
def score_prior_correlation(spark, sf):
    """AGG-21"""
    sc = _scored(spark, sf)
    both = sc.join(sy.user_priors(sc).select("user_id", "prior"), "user_id")
    return both.agg(F.round(F.corr("score", "prior"), 6).alias("corr"), F.round(F.var_pop("prior") / F.var_pop("score"), 6).alias("var_ratio"))


@query("SELECT p_partkey AS item_id, CAST(floor((row_number() OVER (ORDER BY p_partkey) - 1) / 64) AS INT) AS chunk FROM part")
def planned_chunks(spark, sf):
    """STR-01"""
    return sy.plan_chunks(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")))


@query("SELECT ceil(count(*) / 64)::BIGINT AS chunks, ceil((SELECT count(*) FROM part WHERE p_partkey <= 128) / 64)::BIGINT AS done FROM part")
def queue_progress(spark, sf):
    """STR-05"""
    planned = sy.plan_chunks(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")))
    return sy.progress(planned, planned.where("item_id <= 128"))


MD5_SCORE = "(CAST('0x' || md5(user_id::VARCHAR || '|' || item_id::VARCHAR)[1:8] AS BIGINT) % 8000) / 1000 - 4"


@query(SCORED + f"SELECT user_id, item_id, {MD5_SCORE} AS score FROM sc")
def scored_pairs(spark, sf):
    """SYN-02, UDF-02: pluggable scorer in the tasks; the default is the checksum of a pair"""
    return sy.score_pairs(_scored(spark, sf).select("user_id", "item_id", F.lit("").alias("prompt")))


@query(SCORED + f"SELECT user_id, item_id, CASE WHEN user_id % 3 <> 0 THEN score ELSE {MD5_SCORE} END AS score, user_id % 3 = 0 AS rescored FROM sc WHERE user_id % 4 <> 0")
def repaired_pairs(spark, sf):
    """SYN-12: stored scores of wanted pairs stay, missing ones are scored, stale ones go"""
    sc = _scored(spark, sf)
    return sy.repair(sc.where("user_id % 3 <> 0"), sc.where("user_id % 4 <> 0").select("user_id", "item_id", F.lit("").alias("prompt")))


@query(SCORED + ", nn AS (SELECT unnest([2, 7, 100000]) AS n), r AS (SELECT nn.n, item_id, user_id, row_number() OVER (PARTITION BY nn.n, item_id ORDER BY score DESC, user_id) AS a, row_number() OVER (PARTITION BY nn.n, item_id ORDER BY md5(user_id::VARCHAR || '|' || item_id::VARCHAR || '|3'), user_id) AS b, row_number() OVER (PARTITION BY nn.n, item_id ORDER BY coalesce(degree, 0) DESC, user_id) AS c FROM sc CROSS JOIN nn LEFT JOIN (SELECT o_custkey AS user_id, count(*) AS degree FROM orders GROUP BY 1) d USING (user_id)), x AS (SELECT n, a <= n AS ina, unnest(['popularity', 'random']) AS arm, unnest([c <= n, b <= n]) AS inb FROM r) SELECT n, arm, count(*) FILTER (ina AND inb) AS shared, count(*) FILTER (ina OR inb) AS union_n, round(count(*) FILTER (ina AND inb) / count(*) FILTER (ina OR inb), 9) AS jaccard FROM x GROUP BY 1, 2")
def arms_by_n(spark, sf):
    """SYN-10: arms against each other at several N; where N takes in every candidate all are one and the same"""
    sc = _scored(spark, sf)
    train = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    out = sy.arms_by_n(sc, train, [2, 7, 100_000], seed=3)
    return out.select("n", "arm", "shared", F.col("union").alias("union_n"), F.round("jaccard", 9).alias("jaccard"))


FLOORED = ", fl AS (SELECT item_id, user_id FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, user_id) <= 7), fc AS (SELECT item_id, count(*) AS n FROM fl GROUP BY 1)"


@query(SCORED + FLOORED + "SELECT item_id, n FROM fc")
def floored_counts(spark, sf):
    """AGG-19, SYN-06 without a prior: rows an item gets"""
    return sy.item_counts(sy.select_floored(_scored(spark, sf), 7))


@query(SCORED + FLOORED + "SELECT sc.user_id, item_id FROM sc JOIN fc USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5(sc.user_id::VARCHAR || '|' || item_id::VARCHAR || '|5'), sc.user_id) <= any_value(n) OVER (PARTITION BY item_id)")
def random_matched(spark, sf):
    """SYN-07: as many rows for each item as the floored arm gives it"""
    sc = _scored(spark, sf)
    return sy.random_n(sc, sy.item_counts(sy.select_floored(sc, 7)), 5)


@query("SELECT p_partkey AS item_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) ORDER BY md5(p_partkey::VARCHAR || '|9'), p_partkey LIMIT 40")
def probe_items(spark, sf):
    """SMP-05: one sample of items with rows, for all users"""
    return sy.probe_items(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id")), 40, 9)


@query(SCORED + ", t AS (SELECT item_id, count(*) FILTER (score > 0) < 40 AS short FROM sc GROUP BY 1) SELECT count(*) AS n_items, count(*) FILTER (short) AS n_short, round(count(*) FILTER (short) / count(*), 9) AS frac_short, count(*) FILTER (short) / count(*) <= 0.05 AS usable FROM t")
def abstention_rule(spark, sf):
    """SYN-09: the floored arm is usable where at most 5 % of the items abstain"""
    return sy.abstention_rule(sy.abstentions(_scored(spark, sf), 40)).withColumn("frac_short", F.round("frac_short", 9))


ARM_ROWS = SCORED + ", top AS (SELECT item_id, user_id FROM sc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, user_id) <= 7), rnd AS (SELECT seed, item_id, user_id FROM sc CROSS JOIN (SELECT unnest([0, 1]) AS seed) QUALIFY row_number() OVER (PARTITION BY seed, item_id ORDER BY md5(user_id::VARCHAR || '|' || item_id::VARCHAR || '|' || seed::VARCHAR), user_id) <= 7) "


@query(ARM_ROWS + "SELECT 'direct' AS arm, -1 AS seed, user_id, item_id FROM top UNION ALL SELECT 'random', seed, user_id, item_id FROM rnd")
def exported_arms(spark, sf):
    """SRC-19: written by arm and seed with the split's fingerprint, read back by it"""
    sc = _scored(spark, sf)
    arms = {("direct", -1): sy.select_top(sc, 7), **{("random", i): sy.random_n(sc, 7, i) for i in (0, 1)}}
    path = scratch_path(spark)
    sy.export_arms(arms, path, "some split")
    return sy.read_arms(spark, path, "some split")


POINTS = "WITH pt AS (SELECT p_brand AS arm, p_size AS point, round(avg(p_retailprice) / 1000, 6) AS objective, round(max(p_retailprice) / 1000, 6) AS warm FROM part GROUP BY 1, 2)"


def _points(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("arm"), F.col("p_size").alias("point")).agg(
        F.round(F.avg("p_retailprice") / 1000, 6).alias("objective"), F.round(F.max("p_retailprice") / 1000, 6).alias("warm"))


@query(POINTS + "SELECT arm, point, objective, warm FROM (SELECT *, max(warm) OVER (PARTITION BY arm) AS top FROM pt) WHERE warm >= 0.98 * top QUALIFY row_number() OVER (PARTITION BY arm ORDER BY objective DESC, point) = 1")
def constrained_argmax(spark, sf):
    """TUNE-03, TUNE-06"""
    return tn.constrained_argmax(_points(spark, sf), ["arm"])


@query(POINTS + "SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY objective DESC, point) AS place, point, objective FROM pt QUALIFY place <= 2")
def grid_top2(spark, sf):
    """TUNE-04: the two best points of each arm"""
    return tn.best_points(_points(spark, sf), ["arm"], 2)


@query("WITH pt AS (SELECT p_size AS point, round(avg(p_retailprice), 6) AS a, round(max(p_retailprice), 6) AS b FROM part GROUP BY 1) SELECT point, rank() OVER (ORDER BY a DESC) AS rank_a, rank() OVER (ORDER BY b DESC) AS rank_b, rank_a = rank_b AS agree FROM pt")
def rank_agreement(spark, sf):
    """TUNE-05"""
    pts = table(spark, sf, "part").groupBy(F.col("p_size").alias("point")).agg(F.round(F.avg("p_retailprice"), 6).alias("a"), F.round(F.max("p_retailprice"), 6).alias("b"))
    return tn.rank_agreement(pts, "a", "b")


GRID = "WITH pt AS (SELECT p_brand AS arm, p_size AS p, p_partkey % 3 AS k, round(avg(p_retailprice) / 1000, 9) AS value FROM part GROUP BY 1, 2, 3), o AS (SELECT arm, p, round(avg(value), 9) AS objective FROM pt GROUP BY 1, 2)"


def _grid(spark, sf):
    by = table(spark, sf, "part").groupBy(F.col("p_brand").alias("arm"), F.col("p_size").alias("p"), (F.col("p_partkey") % 3).alias("k"))
    return by.agg(F.round(F.avg("p_retailprice") / 1000, 9).alias("value"))


@query(GRID + "SELECT arm, p, objective FROM o")
def sweep_objective(spark, sf):
    """TUNE-02, TUNE-07: the mean over the levels of each point, kept by parts of the grid, so that a stopped sweep goes on"""
    curve, kept = _grid(spark, sf), Checkpoint(spark, scratch_path(spark), {"grid": "p_size"})
    out = None
    for part in range(4):
        one = kept.get(f"p mod 4 = {part}", lambda part=part: tn.objective(curve.where(F.col("p") % 4 == part), ["arm", "p"]))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("objective", F.round("objective", 9))


@query(GRID + ", b AS (SELECT arm, p, objective FROM o QUALIFY row_number() OVER (PARTITION BY arm ORDER BY objective DESC, p) = 1) SELECT arm, role, round(CASE role WHEN 'creator' THEN 1.0 WHEN 'taxonomy' THEN 0.5 WHEN 'reviews' THEN 0.25 ELSE p / sqrt(2) END, 9) AS weight FROM b, (SELECT unnest(['title', 'creator', 'taxonomy', 'blurb', 'reviews']) AS role)")
def derived_config(spark, sf):
    """TUNE-06, SRC-15: the best point of each arm, its prose weight dealt to title and blurb, written and read back under the data's fingerprint"""
    points = tn.objective(_grid(spark, sf), ["arm", "p"]).withColumn("objective", F.round("objective", 9)).withColumnRenamed("p", "point")
    best = {r.arm: r.point for r in tn.best_points(points, ["arm"], 1).collect()}
    path = scratch_path(spark)
    save_config(spark, path, {arm: tn.field_weights(p, 0.25) for arm, p in best.items()}, ["data", 1])
    held = load_config(spark, path, ["data", 1])
    rows = [(arm, role, round(w, 9)) for arm, weights in held.items() for role, w in weights.items()]
    return spark.createDataFrame(rows, "arm string, role string, weight double")
