"""Popularity and activity curves, ceilings, AUC, buckets, both directions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import retrieval as rt
from ..operators.models import Activity, Popularity
from ..sources.readers import materialise
from .base import query
from .fixtures import POPULARITY_SQL, SPLIT_SQL, items, kept, split

LEVELS = [0, 5, 10, 20]
K = 20
P = "WITH " + POPULARITY_SQL
S = "WITH " + SPLIT_SQL

GAINS_SQL = """,
rel AS (SELECT user_id, count(*) AS rel FROM reserved GROUP BY 1),
hit AS (SELECT r.k, r.user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM recs r JOIN reserved t ON t.user_id = r.user_id AND t.item_id = r.item_id GROUP BY 1, 2),
idcg AS (SELECT i AS n, sum(1 / log2(j + 1)) AS v FROM range(1, 21) a(i), range(1, 21) b(j) WHERE j <= i GROUP BY 1),
per AS (SELECT ks.k, rel.user_id, coalesce(dcg, 0) / v AS "NDCG", coalesce(hits, 0) / 20 AS "Precision", coalesce(hits, 0) / rel AS "Recall", (coalesce(hits, 0) > 0)::INT::DOUBLE AS "HitRate"
  FROM rel CROSS JOIN ks LEFT JOIN hit ON hit.user_id = rel.user_id AND hit.k = ks.k JOIN idcg ON n = least(rel, 20))
SELECT k, metric, round(avg(value), 6) AS value, count(*) AS n_eval FROM (UNPIVOT per ON "NDCG", "Precision", "Recall", "HitRate" INTO NAME metric VALUE value) GROUP BY 1, 2
"""


def lists(spark, sf, levels=LEVELS, n=K):
    """(split, scores, seen, lists): written once, since metrics, AUC and exposure all read the same lists."""
    return kept(spark, ("lists", sf, tuple(levels), n), lambda: _lists(spark, sf, levels, n))


def _lists(spark, sf, levels, n):
    s = split(spark, sf)
    train, shown = s.train, rt.revealed_by_k(s.reveal, levels)
    users = s.reserved.select("user_id").distinct()
    seen = rt.levels_frame(train.join(users, "user_id", "left_semi"), levels).unionByName(shown.join(users, "user_id", "left_semi"))
    scores = materialise(rt.popularity(train, shown, s.pool_items, levels))
    seen = materialise(seen)
    return s, scores, seen, materialise(rt.recommend_global(scores, users, seen, n))


@query(P + GAINS_SQL)
def pop_curve(spark, sf):
    """MET-01, MET-03, MET-04, ML-04, WIN-08, WIN-10, WIN-11, JOIN-09, AGG-11: the flagship"""
    s, _, _, recs = lists(spark, sf)
    levels = spark.createDataFrame([(k,) for k in LEVELS], "k int")
    return mt.macro(mt.gains(recs, s.reserved, ["k"], "user_id", "item_id", K, levels), ["k"])


@query(P + "SELECT k, user_id, rank, item_id FROM recs")
def popularity_topk(spark, sf):
    """AGG-04, JOIN-05, TOPK-01, TOPK-05, SET-04"""
    return lists(spark, sf)[3].select("k", "user_id", "rank", "item_id")


@query(
    P.replace("SELECT unnest([0, 5, 10, 20]) AS k", "SELECT 100 AS k").replace("revealed AS (SELECT k, user_id, item_id FROM ks JOIN reveal ON pos < k)", "revealed AS (SELECT k, user_id, item_id FROM ks, ceiling)")
    + GAINS_SQL.replace("SELECT k, metric,", "SELECT metric,").replace("GROUP BY 1, 2\n", "GROUP BY 1\n").replace("INTO NAME metric VALUE value) GROUP BY 1, 2", "INTO NAME metric VALUE value) GROUP BY 1")
)
def pop_ceiling(spark, sf):
    """MET-06"""
    s = split(spark, sf)
    recs = ceiling_lists(s)
    return mt.macro(mt.gains(recs, s.reserved, [], "user_id", "item_id", K), [])


def ceiling_lists(s, n=K):
    users = s.reserved.select("user_id").distinct()
    shown = s.ceiling.select(F.lit(100).alias("k"), "user_id", "item_id")
    seen = rt.levels_frame(s.train, [100]).unionByName(shown).join(users, "user_id", "left_semi")
    scores = rt.popularity(s.train, shown, s.pool_items, [100])
    return rt.recommend_global(scores, users, seen, n).drop("k")


AUC_SQL = """,
cand AS (SELECT pop.k, u.user_id, pop.item_id, pop.score FROM pop JOIN auc_items USING (item_id) CROSS JOIN eval_users u
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.k = pop.k AND s.user_id = u.user_id AND s.item_id = pop.item_id)),
rk AS (SELECT c.*, rank() OVER w + (count(*) OVER (PARTITION BY c.k, c.user_id, c.score) - 1) / 2 AS r, t.item_id IS NOT NULL AS is_pos
  FROM cand c LEFT JOIN reserved t ON t.user_id = c.user_id AND t.item_id = c.item_id WINDOW w AS (PARTITION BY c.k, c.user_id ORDER BY c.score)),
auc AS (SELECT k, user_id, (sum(r) FILTER (is_pos) - count(*) FILTER (is_pos) * (count(*) FILTER (is_pos) + 1) / 2) / nullif(count(*) FILTER (is_pos) * count(*) FILTER (NOT is_pos), 0) AS auc FROM rk GROUP BY 1, 2)
"""


@query(P + AUC_SQL + "SELECT k, round(avg(auc), 6) AS auc, count(auc) AS n FROM auc GROUP BY 1")
def pop_auc_curve(spark, sf):
    """MET-07, RET-04, WIN-09, ML-13"""
    s, scores, seen, _ = lists(spark, sf)
    pool = scores.join(s.auc_items, "item_id", "left_semi")
    users = s.reserved.select("user_id").distinct()
    return rt.popularity_auc(pool, users, seen, s.reserved).groupBy("k").agg(F.round(F.avg("auc"), 6).alias("auc"), F.count("auc").alias("n"))


@query(P.replace("SELECT unnest([0, 5, 10, 20]) AS k", "SELECT 100 AS k").replace("revealed AS (SELECT k, user_id, item_id FROM ks JOIN reveal ON pos < k)", "revealed AS (SELECT k, user_id, item_id FROM ks, ceiling)") + AUC_SQL + "SELECT round(avg(auc), 6) AS auc, count(auc) AS n FROM auc")
def pop_ceiling_auc(spark, sf):
    """MET-07: popularity with all rows before the test, over the degree-matched pool"""
    s = split(spark, sf)
    users = s.reserved.select("user_id").distinct()
    shown = s.ceiling.select(F.lit(100).alias("k"), "user_id", "item_id")
    seen = rt.levels_frame(s.train, [100]).unionByName(shown).join(users, "user_id", "left_semi")
    pool = rt.popularity(s.train, shown, s.auc_items, [100])
    return rt.popularity_auc(pool, users, seen, s.reserved).agg(F.round(F.avg("auc"), 6).alias("auc"), F.count("auc").alias("n"))


@query(P.replace("[0, 5, 10, 20]", "[20]") + AUC_SQL + "SELECT user_id, round(auc, 6) AS auc FROM auc WHERE auc IS NOT NULL")
def auc_by_user(spark, sf):
    """RET-03, ML-13: the general kernel, block by block; popularity is a factor model of one factor"""
    s, scores, seen, _ = lists(spark, sf, levels=[20])
    none = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("k", "long"), ("w", "double"))]
    users = s.reserved.select(F.col("user_id").alias("id")).distinct().select("id", F.array(F.lit(1.0)).alias("v"), *none)
    pool = scores.join(s.auc_items, "item_id", "left_semi").select(F.col("item_id").alias("id"), F.array(F.col("score").cast("double")).alias("v"), *none)
    pairs = lambda df: df.select(F.col("user_id").alias("id"), F.col("item_id").alias("other"))
    out = rt.rank_auc(users, pool, pairs(s.reserved), pairs(seen))
    return out.where("auc is not null").select(F.col("id").alias("user_id"), F.round("auc", 6).alias("auc"))


@query(
    P.replace("[0, 5, 10, 20]", "[10]").replace("QUALIFY rank <= 20", "QUALIFY rank <= 10")
    + "SELECT user_id, rank, item_id, score FROM recs"
)
def cold_merge(spark, sf):
    """TOPK-02, RET-02: cached warm lists, and lists of the fresh cold scores; neither forms users x items"""
    s = split(spark, sf)
    users = s.reserved.select("user_id").distinct()
    base = s.train.groupBy("item_id").agg(F.count("*").alias("score"))
    seen = rt.levels_frame(s.train.join(users, "user_id", "left_semi"), [10])
    cached = rt.recommend_global(base.withColumn("k", F.lit(10)), users, seen, 10)
    shown = s.revealed_at(10)
    cold = s.cold_ids.join(shown.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left").select(F.lit(10).alias("k"), "item_id", F.coalesce("n", F.lit(0)).alias("score"))
    fresh = rt.recommend_global(cold, users, rt.levels_frame(shown.join(users, "user_id", "left_semi"), [10]), 10)
    return rt.merge_top(cached, fresh, ["user_id"], "item_id", 10).select("user_id", "rank", "item_id", "score")


DEGREES = "deg AS (SELECT item_id, count(*) + 5 AS degree FROM ceiling GROUP BY 1), bk AS (SELECT item_id, degree, ntile(3) OVER (ORDER BY degree, item_id) - 1 AS bucket FROM deg)"


@query(S + ", " + DEGREES + " SELECT item_id, degree, bucket FROM bk")
def degree_buckets(spark, sf):
    """WIN-06, MET-09"""
    return mt.degree_buckets(split(spark, sf).ceiling.groupBy("item_id").agg((F.count("*") + 5).alias("degree")))


@query(
    P.replace("SELECT unnest([0, 5, 10, 20]) AS k", "SELECT 100 AS k").replace("revealed AS (SELECT k, user_id, item_id FROM ks JOIN reveal ON pos < k)", "revealed AS (SELECT k, user_id, item_id FROM ks, ceiling)")
    + ", "
    + DEGREES
    + """ SELECT bucket, count(*) AS n_interactions, round(avg((rank IS NOT NULL)::INT), 6) AS hitrate, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 / log2(rank + 1) END), 6) AS ndcg
    FROM reserved t JOIN bk USING (item_id) LEFT JOIN recs r ON r.user_id = t.user_id AND r.item_id = t.item_id GROUP BY 1"""
)
def bucket_ceiling(spark, sf):
    """MET-09"""
    s = split(spark, sf)
    buckets = mt.degree_buckets(s.ceiling.groupBy("item_id").agg((F.count("*") + 5).alias("degree")))
    return mt.bucket_hits(ceiling_lists(s), s.reserved, buckets)


ACTIVITY_SQL = (
    S
    + """, ks AS (SELECT unnest([0, 5, 10, 20]) AS k), act AS (SELECT user_id, count(*) AS score FROM train GROUP BY 1),
seen AS (SELECT k, item_id, user_id FROM ks JOIN reveal ON pos < k),
cand AS (SELECT ks.k, c.item_id, a.user_id, a.score FROM ks, cold_test c, act a WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.k = ks.k AND s.item_id = c.item_id AND s.user_id = a.user_id))"""
)


def activity_lists(s, n=10):
    shown = rt.revealed_by_k(s.reveal, LEVELS)
    scores = rt.levels_frame(Activity().fit(s).counts, LEVELS)
    return scores, shown, rt.recommend_global(scores, s.cold_ids, shown, n, entity="user_id", to="item_id")


@query(ACTIVITY_SQL + ", recs AS (SELECT *, row_number() OVER (PARTITION BY k, item_id ORDER BY score DESC, user_id) AS rank FROM cand QUALIFY rank <= 10)" + GAINS_SQL.replace("range(1, 21)", "range(1, 11)").replace("least(rel, 20)", "least(rel, 10)").replace("GROUP BY 1),\nhit", "GROUP BY 1),\nhit").replace("SELECT user_id, count(*) AS rel FROM reserved", "SELECT item_id, count(*) AS rel FROM reserved").replace("r.k, r.user_id, count(*) AS hits", "r.k, r.item_id, count(*) AS hits").replace("rel.user_id,", "rel.item_id,").replace("hit.user_id = rel.user_id", "hit.item_id = rel.item_id").replace("coalesce(hits, 0) / 20", "coalesce(hits, 0) / 10"))
def activity_curve(spark, sf):
    """MET-10, AGG-05, RET-07, ML-05"""
    s = split(spark, sf)
    _, _, recs = activity_lists(s)
    levels = spark.createDataFrame([(k,) for k in LEVELS], "k int")
    return mt.macro(mt.by_list_length(mt.gains(recs, s.reserved, ["k"], "item_id", "user_id", 10, levels)), ["k"])


@query(
    ACTIVITY_SQL
    + """, rk AS (SELECT c.*, rank() OVER w + (count(*) OVER (PARTITION BY c.k, c.item_id, c.score) - 1) / 2 AS r, t.item_id IS NOT NULL AS is_pos
  FROM cand c LEFT JOIN reserved t ON t.user_id = c.user_id AND t.item_id = c.item_id WINDOW w AS (PARTITION BY c.k, c.item_id ORDER BY c.score)),
auc AS (SELECT k, item_id, (sum(r) FILTER (is_pos) - count(*) FILTER (is_pos) * (count(*) FILTER (is_pos) + 1) / 2) / nullif(count(*) FILTER (is_pos) * count(*) FILTER (NOT is_pos), 0) AS auc FROM rk GROUP BY 1, 2)
SELECT k, round(avg(auc), 6) AS auc, count(auc) AS n FROM auc GROUP BY 1"""
)
def activity_auc_curve(spark, sf):
    """MET-08, RET-06"""
    s = split(spark, sf)
    scores, shown, _ = activity_lists(s)
    auc = rt.popularity_auc(rt.swapped(scores), rt.swapped(s.cold_ids), rt.swapped(shown), rt.swapped(s.reserved))
    return auc.groupBy("k").agg(F.round(F.avg("auc"), 6).alias("auc"), F.count("auc").alias("n"))


@query(S + "SELECT item_id, count(*) AS r, least(count(*), 10) / 10 AS precision_max, least(count(*), 10) / count(*) AS recall_max FROM reserved GROUP BY 1")
def mode_b_ceiling(spark, sf):
    """MET-11"""
    return mt.item_to_user_ceiling(split(spark, sf).reserved, 10)


@query(P.replace("[0, 5, 10, 20]", "[0]") + "SELECT user_id, rank, recs.item_id, p_name FROM recs JOIN part ON p_partkey = recs.item_id WHERE rank <= 5")
def top_n_titles(spark, sf):
    """RET-08"""
    recs = lists(spark, sf, levels=[0], n=5)[3]
    return recs.join(items(spark, sf).select("item_id", "p_name"), "item_id").select("user_id", "rank", "item_id", "p_name")


@query(S + "SELECT item_id, count(*) AS score FROM (SELECT user_id, item_id FROM train UNION ALL SELECT user_id, item_id FROM reveal WHERE pos < 5) GROUP BY 1")
def popularity_folded(spark, sf):
    """ML-01, ML-04: fold-in as refit"""
    s = split(spark, sf)
    return Popularity().fit(s).fold_in(s, 5).counts


SEEDS_SQL = """WITH c AS (SELECT o_custkey % 4 AS seed, year(o_orderdate) AS k, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS arm, avg(o_totalprice) / 1000 AS value FROM orders GROUP BY 1, 2, 3)"""


def _curve(spark, sf):
    from .fixtures import table

    arm = F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("arm")
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 4).alias("seed"), F.year("o_orderdate").alias("k"), arm).agg((F.avg("o_totalprice") / 1000).alias("value"))


@query(SEEDS_SQL + "SELECT arm, k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM c GROUP BY 1, 2")
def seed_means(spark, sf):
    """AGG-12, AGG-13, MET-14"""
    return mt.across_seeds(_curve(spark, sf), ["arm", "k"]).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(
    SEEDS_SQL
    + """, d AS (SELECT x.k, x.value - y.value AS d FROM c x JOIN c y ON x.k = y.k AND x.seed = y.seed WHERE x.arm = 'a' AND y.arm = 'b')
    SELECT k, round(avg(d), 6) AS mean_diff, count(d) AS n, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0), 5) AS t FROM d GROUP BY 1"""
)
def paired_t(spark, sf):
    """FN-21"""
    c = _curve(spark, sf)
    out = mt.paired_t(c.where("arm = 'a'"), c.where("arm = 'b'"), ["k"], ["seed"])
    return out.select("k", F.round("mean_diff", 6).alias("mean_diff"), "n", F.round("t", 5).alias("t"))


@query(
    SEEDS_SQL
    + """, d AS (SELECT x.k, x.value - y.value AS d FROM c x JOIN c y ON x.k = y.k AND x.seed = y.seed WHERE x.arm = 'a' AND y.arm = 'b'),
    m AS (SELECT k, avg(d) AS diff, 3.182 * stddev_samp(d) / sqrt(count(*)) AS half FROM d GROUP BY 1)
    SELECT k, round(diff, 6) AS diff, round(diff - half, 6) AS low, round(diff + half, 6) AS high, abs(diff) > half AS clear FROM m"""
)
def difference_curve(spark, sf):
    """MET-15"""
    out = mt.difference_curve(_curve(spark, sf), "a", "b", 3.182)
    return out.select("k", *(F.round(c, 6).alias(c) for c in ("diff", "low", "high")), "clear")


@query(SEEDS_SQL + "SELECT x.arm, x.k, x.seed, round(x.value, 6) AS value, round((x.value / nullif(y.value, 0) - 1) * 100, 6) AS delta_pct FROM c x JOIN c y ON x.k = y.k AND x.seed = y.seed WHERE x.arm = 'b' AND y.arm = 'a'")
def relative_delta(spark, sf):
    """MET-17"""
    out = mt.relative_delta(_curve(spark, sf), "a", ["k", "seed"])
    return out.select("arm", "k", "seed", F.round("value", 6).alias("value"), F.round("delta_pct", 6).alias("delta_pct"))


@query(
    S
    + """, ks AS (SELECT unnest([0, 5, 10, 20]) AS k), act AS (SELECT user_id, count(*) AS score FROM train WHERE user_id % 40 = 0 GROUP BY 1), nu AS (SELECT count(*) AS n FROM act),
few AS (SELECT item_id, user_id FROM reserved QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5(user_id::VARCHAR || '|' || item_id::VARCHAR || '|42'), user_id) <= 5),
cand AS (SELECT ks.k, c.item_id, a.user_id, a.score FROM ks, cold_test c, act a WHERE NOT EXISTS (SELECT 1 FROM reveal s WHERE s.pos < ks.k AND s.item_id = c.item_id AND s.user_id = a.user_id)),
recs AS (SELECT *, row_number() OVER (PARTITION BY k, item_id ORDER BY score DESC, user_id) AS rank FROM cand QUALIFY rank <= 400),
hit AS (SELECT r.k, r.item_id, count(*) AS shown, count(f.user_id) AS hits FROM recs r LEFT JOIN few f ON f.item_id = r.item_id AND f.user_id = r.user_id GROUP BY 1, 2)
SELECT ks.k, round(avg(coalesce(hits / nullif(shown, 0), 0)), 9) AS precision, count(*) AS n_eval FROM (SELECT DISTINCT item_id FROM few) i CROSS JOIN ks LEFT JOIN hit ON hit.item_id = i.item_id AND hit.k = ks.k GROUP BY 1"""
)
def short_lists(spark, sf):
    """MET-02: lists shorter than K, as few users are known: precision is over the list's own length, not over K = 400"""
    s = split(spark, sf)
    scores = rt.levels_frame(s.train.where("user_id % 40 = 0").groupBy("user_id").agg(F.count("*").alias("score")), LEVELS)
    recs = rt.recommend_global(scores, s.cold_ids, rt.revealed_by_k(s.reveal, LEVELS), 400, entity="user_id", to="item_id")
    levels = spark.createDataFrame([(k,) for k in LEVELS], "k int")
    got = mt.by_list_length(mt.gains(recs, s.few_users(5, 42), ["k"], "item_id", "user_id", 400, levels))
    return got.groupBy("k").agg(F.round(F.avg("Precision"), 9).alias("precision"), F.count("*").alias("n_eval"))


@query(
    SEEDS_SQL
    + """, m AS (SELECT arm, k, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM c GROUP BY 1, 2)
    SELECT x.arm, x.k, round(x.mean - y.mean, 6) AS diff, round(3.182 * x.std / sqrt(x.n), 6) AS half FROM m x JOIN m y ON x.k = y.k WHERE x.arm = 'b' AND y.arm = 'a'"""
)
def unpaired_difference(spark, sf):
    """MET-15: against a base arm, with the interval of the arm's own mean"""
    out = mt.unpaired_difference(_curve(spark, sf), "a", 3.182)
    return out.select("arm", "k", F.round("diff", 6).alias("diff"), F.round("half", 6).alias("half"))


@query(
    SEEDS_SQL
    + """, d AS (SELECT x.k, x.value - y.value AS d FROM c x JOIN c y ON x.k = y.k AND x.seed = y.seed WHERE x.arm = 'a' AND y.arm = 'b'),
    m AS (SELECT k, avg(d) AS diff, 3.182 * stddev_samp(d) / sqrt(count(*)) AS half FROM d GROUP BY 1)
    SELECT count(*) FILTER (abs(diff) > half) AS n_clear, count(*) AS n_levels FROM m"""
)
def clear_levels(spark, sf):
    """MET-15: at how many levels the paired interval clears zero"""
    return mt.clear_levels(mt.difference_curve(_curve(spark, sf), "a", "b", 3.182))


@query(
    SEEDS_SQL.replace("AS value FROM orders", "AS v FROM orders").replace("WITH c AS", "WITH c0 AS")
    + """, c AS (SELECT seed, k, arm, CASE WHEN arm = 'a' AND k = 1995 OR seed = 1 THEN NULL ELSE v END AS value FROM c0) SELECT arm, k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM c GROUP BY 1, 2"""
)
def seed_means_with_gaps(spark, sf):
    """AGG-13: undefined values don't count; where all are, so is the mean"""
    gap = ((F.col("arm") == "a") & (F.col("k") == 1995)) | (F.col("seed") == 1)
    curve = _curve(spark, sf).withColumn("value", F.when(~gap, F.col("value")))
    return mt.across_seeds(curve, ["arm", "k"]).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))
