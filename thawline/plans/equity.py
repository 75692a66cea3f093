"""Provider equity over the popularity lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import equity as eq
from ..operators.ranking import head
from ..sources.readers import materialise
from .accuracy import ceiling_lists, lists
from .base import query
from .fixtures import POPULARITY_SQL, SPLIT_SQL, items, kept, providers, split
from .fixtures import table as fixture_table

K = 20
NAMES = fx.DISCOUNTS
PROVIDERS = """,
prov AS (SELECT p_partkey AS item_id, lower(p_brand) AS provider, p_partkey IN (SELECT item_id FROM cold_test) AS cold FROM part WHERE p_partkey IN (SELECT item_id FROM pool_items))"""
P = "WITH " + POPULARITY_SQL + PROVIDERS
WEIGHTS = """, wt AS (SELECT 'uniform@10' AS discount, i AS rank, (i <= 10)::INT::DOUBLE AS w FROM range(1, 21) a(i) UNION ALL SELECT 'uniform@20', i, 1 FROM range(1, 21) a(i) UNION ALL SELECT 'uniform@100', i, 1 FROM range(1, 21) a(i)
  UNION ALL SELECT 'log', i, 1 / log2(i + 1) FROM range(1, 21) a(i) UNION ALL SELECT 'rbp0.90', i, pow(0.9, i - 1) FROM range(1, 21) a(i) UNION ALL SELECT 'rbp0.80', i, pow(0.8, i - 1) FROM range(1, 21) a(i) UNION ALL SELECT 'rbp0.95', i, pow(0.95, i - 1) FROM range(1, 21) a(i))"""
FULL = (
    P
    + WEIGHTS
    + """, ex AS (SELECT k, discount, provider, sum(w) AS exposure, sum(CASE WHEN cold THEN w ELSE 0 END) AS cold_exposure FROM recs JOIN prov USING (item_id) JOIN wt USING (rank) GROUP BY 1, 2, 3),
u AS (SELECT k, discount, p.provider, coalesce(exposure, 0) AS exposure, coalesce(cold_exposure, 0) AS cold_exposure
  FROM (SELECT DISTINCT k, discount FROM ex) g CROSS JOIN (SELECT DISTINCT provider FROM prov) p LEFT JOIN ex USING (k, discount, provider))"""
)


def _full(spark, sf):
    return kept(spark, ("exposure", sf), lambda: _exposed(spark, sf))


def _exposed(spark, sf):
    s, _, _, recs = lists(spark, sf)
    prov = materialise(providers(spark, sf, s))
    w = eq.weights(spark, NAMES, K)
    return s, recs, prov, materialise(eq.universe(materialise(eq.exposure(eq.exposure_by_rank(recs, prov, ["k"]), w, ["k"])), prov, ["k", "discount"]))


@query("SELECT 'uniform@10' AS discount, i::INT AS rank, (i <= 10)::INT::DOUBLE AS w FROM range(1, 101) a(i) UNION ALL SELECT 'uniform@20', i, (i <= 20)::INT FROM range(1, 101) a(i) UNION ALL SELECT 'uniform@100', i, 1 FROM range(1, 101) a(i) UNION ALL SELECT 'log', i, round(1 / log2(i + 1), 9) FROM range(1, 101) a(i) UNION ALL SELECT 'rbp0.90', i, round(pow(0.9, i - 1), 9) FROM range(1, 101) a(i) UNION ALL SELECT 'rbp0.80', i, round(pow(0.8, i - 1), 9) FROM range(1, 101) a(i) UNION ALL SELECT 'rbp0.95', i, round(pow(0.95, i - 1), 9) FROM range(1, 101) a(i)")
def discount_weights(spark, sf):
    """FN-11, UDF-06"""
    return eq.weights(spark).withColumn("w", F.round("w", 9))


@query("SELECT p_partkey AS item_id, CASE WHEN p_partkey % 7 = 0 THEN 'UNKNOWN' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9 ]', ' ', 'g')) END AS provider FROM part")
def canonical_creator(spark, sf):
    """FN-01, FN-03, FN-04, FN-07, EQ-01: role suffixes off, blocked names unknown"""
    raw = F.when(F.col("item_id") % 7 == 0, F.lit("DK Publishing")).otherwise(F.concat("p_brand", F.lit(" (Author, Artist)")))
    return items(spark, sf).select("item_id", fx.creator(fx.as_entities(raw)).alias("provider"))


@query(P + "SELECT k, rank, provider, cold, count(*) AS n FROM recs JOIN prov USING (item_id) GROUP BY 1, 2, 3, 4")
def exposure_by_rank(spark, sf):
    """EQ-02, JOIN-10"""
    s, _, _, recs = lists(spark, sf)
    return eq.exposure_by_rank(recs, providers(spark, sf, s), ["k"])


@query(FULL + "SELECT k, discount, provider, round(exposure, 6) AS exposure, round(coalesce(exposure / nullif(sum(exposure) OVER (PARTITION BY k, discount), 0), 0), 9) AS share FROM u")
def exposure_shares(spark, sf):
    """EQ-03, EQ-04"""
    full = _full(spark, sf)[3]
    shares = eq.with_share(full, "exposure", ["k", "discount"])
    return shares.select("k", "discount", "provider", F.round("exposure", 6).alias("exposure"), F.round("share", 9).alias("share"))


@query(
    FULL
    + """, g AS (SELECT k, discount, coalesce(sum((2 * i - n - 1) * v) / nullif(max(n) * sum(v), 0), 0) AS gini FROM (SELECT k, discount, exposure AS v, row_number() OVER (PARTITION BY k, discount ORDER BY exposure) AS i, count(*) OVER (PARTITION BY k, discount) AS n FROM u) GROUP BY 1, 2),
gc AS (SELECT k, discount, coalesce(sum((2 * i - n - 1) * v) / nullif(max(n) * sum(v), 0), 0) AS gini_cold FROM (SELECT k, discount, cold_exposure AS v, row_number() OVER (PARTITION BY k, discount ORDER BY cold_exposure) AS i, count(*) OVER (PARTITION BY k, discount) AS n FROM u WHERE provider IN (SELECT provider FROM prov WHERE cold)) GROUP BY 1, 2),
cs AS (SELECT k, discount, sum(cold_exposure) / nullif(sum(exposure), 0) AS cold_share FROM u GROUP BY 1, 2),
sh AS (SELECT k, discount, exposure / sum(exposure) OVER (PARTITION BY k, discount) AS s, row_number() OVER (PARTITION BY k, discount ORDER BY exposure DESC, provider) AS i, count(*) OVER (PARTITION BY k, discount) AS n FROM u),
t1 AS (SELECT k, discount, sum(s) AS top1_share FROM sh WHERE i <= greatest(1, ceil(n * 0.01)) GROUP BY 1, 2)
SELECT k, discount, round(gini, 6) AS gini, round(gini_cold, 6) AS gini_cold, round(cold_share, 6) AS cold_share, round(top1_share, 6) AS top1_share, 1 AS version FROM g JOIN gc USING (k, discount) JOIN cs USING (k, discount) JOIN t1 USING (k, discount)"""
)
def gini_curve(spark, sf):
    """EQ-10, WIN-12, WIN-13, CACHE-04"""
    s, recs, prov, full = _full(spark, sf)
    out = eq.report(full, prov, ["k", "discount"])
    return out.select("k", "discount", *(F.round(c, 6).alias(c) for c in ("gini", "gini_cold", "cold_share", "top1_share")), "version")


RATIOS = FULL + """, ref AS (SELECT provider, count(*) / (SELECT count(*) FROM prov) AS ref FROM prov GROUP BY 1),
r AS (SELECT k, discount, u.provider, coalesce(exposure / nullif(sum(exposure) OVER (PARTITION BY k, discount), 0), 0) AS share, ref, share / nullif(ref, 0) AS ratio FROM u JOIN ref USING (provider))"""


def _ratios(spark, sf):
    s, _, prov, full = _full(spark, sf)
    shares = eq.with_share(full, "exposure", ["k", "discount"], "s")
    return eq.ratios(shares, eq.catalog_share(prov), ["k", "discount"], "s")


@query(RATIOS + "SELECT k, discount, provider, round(share, 9) AS share, round(ref, 9) AS ref, round(ratio, 6) AS ratio FROM r")
def equity_ratio_table(spark, sf):
    """EQ-05, EQ-07, EQ-09, JOIN-13"""
    return _ratios(spark, sf).select("k", "discount", "provider", F.round("share", 9).alias("share"), F.round("ref", 9).alias("ref"), F.round("ratio", 6).alias("ratio"))


@query(
    RATIOS
    + """SELECT k, discount, round(sum(share * ratio) / nullif(sum(share), 0), 6) AS exposure_weighted_mean, round(avg(ratio), 6) AS unweighted_mean, round(exp(avg(ln(ratio)) FILTER (ratio > 0)), 6) AS geometric_mean,
    round(avg((ratio < 1)::INT), 6) AS frac_below_1, count(ratio) AS n_scored, round(quantile_cont(ratio, 0.1), 6) AS p10, round(quantile_cont(ratio, 0.25), 6) AS p25, round(quantile_cont(ratio, 0.5), 6) AS median,
    round(quantile_cont(ratio, 0.75), 6) AS p75, round(quantile_cont(ratio, 0.9), 6) AS p90 FROM r GROUP BY 1, 2"""
)
def equity_ratio_stats(spark, sf):
    """EQ-08, AGG-14, AGG-15, AGG-16, AGG-18"""
    out = eq.ratio_stats(_ratios(spark, sf), ["k", "discount"])
    return out.select("k", "discount", "n_scored", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("k", "discount", "n_scored")))


@query(
    "WITH " + SPLIT_SQL + PROVIDERS
    + """, per AS (SELECT user_id, count(*) AS r FROM reserved GROUP BY 1), cum AS (SELECT i AS n, sum(1 / log2(j + 1)) AS c FROM range(1, 21) a(i), range(1, 21) b(j) WHERE j <= i GROUP BY 1),
    val AS (SELECT user_id, c / r AS v FROM per JOIN cum ON n = least(r, 20)), m AS (SELECT provider, sum(v) AS m FROM reserved JOIN prov USING (item_id) JOIN val USING (user_id) WHERE cold GROUP BY 1)
    SELECT p.provider, round(coalesce(m, 0) / (SELECT sum(m) FROM m), 9) AS ref FROM (SELECT DISTINCT provider FROM prov) p LEFT JOIN m USING (provider)"""
)
def merit_share(spark, sf):
    """EQ-06"""
    s = split(spark, sf)
    return eq.merit_share(s.reserved, providers(spark, sf, s), "log", K).withColumn("ref", F.round("ref", 9))


@query(P.replace("[0, 5, 10, 20]", "[0]") + "SELECT provider, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM prov GROUP BY 1 ORDER BY round(share, 9) DESC, provider LIMIT 10")
def largest_providers(spark, sf):
    """TOPK-07: a head-limited table"""
    rows = providers(spark, sf, split(spark, sf)).groupBy("provider").agg(F.count("*").alias("n"))
    shares = eq.with_share(rows.withColumn("all", F.lit(1)), "n", ["all"]).select("provider", "n", F.round("share", 9).alias("share"))
    return head(shares, [F.desc("share"), "provider"], 10)


#: Seeds differ by which of the last places of the lists are served.
SEEDED = P.replace("[0, 5, 10, 20]", "[20]") + WEIGHTS + """, sd AS (SELECT unnest([0, 1, 2, 3]) AS seed), ex AS (SELECT seed, discount, provider, sum(w) AS exposure FROM recs JOIN prov USING (item_id) JOIN wt USING (rank) CROSS JOIN sd WHERE (user_id + rank) % 4 <> seed GROUP BY 1, 2, 3),
u AS (SELECT seed, discount, p.provider, coalesce(exposure, 0) AS exposure FROM (SELECT DISTINCT seed, discount FROM ex) CROSS JOIN (SELECT DISTINCT provider FROM prov) p LEFT JOIN ex USING (seed, discount, provider)),
sh AS (SELECT seed, discount, provider, exposure / sum(exposure) OVER (PARTITION BY seed, discount) AS s FROM u)"""


@query(SEEDED + " SELECT discount, provider, round(avg(s), 9) AS mean, round(stddev_pop(s), 9) AS std, round(stddev_pop(s) / nullif(avg(s), 0), 6) AS cv FROM sh GROUP BY 1, 2")
def seed_variance(spark, sf):
    """EQ-12: spread of each provider's share over seeds"""
    s, _, _, recs = lists(spark, sf, levels=[20])
    prov, keys = providers(spark, sf, s), ["seed", "discount"]
    seeded = recs.withColumn("seed", F.explode(F.array(*map(F.lit, range(4))))).where("(user_id + rank) % 4 <> seed")
    exposed = eq.exposure(eq.exposure_by_rank(seeded, prov, ["seed"]), eq.weights(spark, NAMES, K), ["seed"])
    out = eq.seed_variance(eq.with_share(eq.universe(exposed, prov, keys), "exposure", keys, "s"), ["discount"])
    return out.select("discount", "provider", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round("cv", 6).alias("cv"))


STATS = """round(sum(share * ratio) / nullif(sum(share) FILTER (ratio IS NOT NULL), 0), 5) AS exposure_weighted_mean, round(avg(ratio), 5) AS unweighted_mean, round(exp(avg(ln(ratio)) FILTER (ratio > 0)), 5) AS geometric_mean,
    round(avg((ratio < 1)::INT), 6) AS frac_below_1, count(ratio) AS n_scored, round(quantile_cont(ratio, 0.1), 5) AS p10, round(quantile_cont(ratio, 0.25), 5) AS p25, round(quantile_cont(ratio, 0.5), 5) AS median,
    round(quantile_cont(ratio, 0.75), 5) AS p75, round(quantile_cont(ratio, 0.9), 5) AS p90"""
#: Shares, references and ratios of the three tables from the universe u.
TABLES = """, cum AS (SELECT a.discount, a.rank AS n, sum(b.w) AS c FROM wt a JOIN wt b ON b.discount = a.discount AND b.rank <= a.rank GROUP BY 1, 2),
per AS (SELECT user_id, count(*) AS r FROM reserved GROUP BY 1), val AS (SELECT discount, user_id, c / r AS v FROM per JOIN cum ON n = least(r, 20)),
m AS (SELECT discount, provider, sum(v) AS m FROM reserved JOIN prov USING (item_id) JOIN val USING (user_id) WHERE cold GROUP BY 1, 2), mt AS (SELECT discount, sum(m) AS t FROM m GROUP BY 1),
np AS (SELECT provider, count(*) AS n, count(*) FILTER (cold) AS c FROM prov GROUP BY 1),
s3 AS (SELECT k, discount, provider, coalesce(exposure / nullif(sum(exposure) OVER w, 0), 0) AS sa, coalesce(cold_exposure / nullif(sum(cold_exposure) OVER w, 0), 0) AS sc FROM u WINDOW w AS (PARTITION BY k, discount)),
r3 AS (SELECT k, discount, 'catalog' AS reference, sa AS share, sa / nullif(n / (SELECT count(*) FROM prov), 0) AS ratio FROM s3 JOIN np USING (provider)
  UNION ALL SELECT k, discount, 'cold', sc, sc / nullif(c / (SELECT count(*) FROM prov WHERE cold), 0) FROM s3 JOIN np USING (provider)
  UNION ALL SELECT k, s3.discount, 'merit', sc, sc / nullif(coalesce(m, 0) / t, 0) FROM s3 JOIN mt USING (discount) LEFT JOIN m ON m.discount = s3.discount AND m.provider = s3.provider)"""


def _tables(spark, sf, users=None):
    s, recs, prov, full = _full(spark, sf)
    users = s.reserved.select("user_id") if users is None else users
    return eq.ratio_tables(full, prov, s.reserved, ["k", "discount"], NAMES, K, users)


def _rounded(out):
    keys = ("k", "discount", "reference", "n_scored")
    return out.select(*keys, *(F.round(c, 6 if c == "frac_below_1" else 5).alias(c) for c in out.columns if c not in keys))


@query(FULL + TABLES + f" SELECT k, discount, reference, {STATS} FROM r3 GROUP BY 1, 2, 3")
def ratio_tables(spark, sf):
    """EQ-10, EQ-05, EQ-06, EQ-08, EQ-11: ratios to the whole catalogue, to the cold items and to merit, for every level and discount"""
    return _rounded(_tables(spark, sf))


@query(FULL + TABLES + f" SELECT k, discount, reference, {STATS} FROM r3 WHERE discount = 'log' GROUP BY 1, 2, 3".replace("count(ratio) AS n_scored", "CASE WHEN reference <> 'merit' THEN count(ratio) END AS n_scored").replace("round(", "if(reference = 'merit', NULL, 1) * round("))
def merit_guard(spark, sf):
    """EQ-11: merit is null where the scored users aren't those with held-out rows"""
    return _rounded(_tables(spark, sf, split(spark, sf).train.select("user_id")).where("discount = 'log'"))


CEILING = FULL.replace("SELECT unnest([0, 5, 10, 20]) AS k", "SELECT 100 AS k").replace("revealed AS (SELECT k, user_id, item_id FROM ks JOIN reveal ON pos < k)", "revealed AS (SELECT k, user_id, item_id FROM ks, ceiling)")


@query(CEILING + TABLES + f" SELECT discount, reference, {STATS} FROM r3 GROUP BY 1, 2")
def equity_ceiling(spark, sf):
    """EQ-13: the tables where every cold item has all its rows before the test"""
    s = split(spark, sf)
    prov = materialise(providers(spark, sf, s))
    counts = eq.exposure_by_rank(ceiling_lists(s, K).withColumn("k", F.lit(100)), prov, ["k"])
    full = materialise(eq.universe(eq.exposure(counts, eq.weights(spark, NAMES, K), ["k"]), prov, ["k", "discount"]))
    return _rounded(eq.ratio_tables(full, prov, s.reserved, ["k", "discount"], NAMES, K, s.reserved.select("user_id"))).drop("k")


ATTRIBUTION = "SELECT p_partkey AS item_id, CASE WHEN p_partkey % 97 = 0 THEN [] WHEN p_partkey % 5 = 0 THEN [trim(regexp_replace(lower(p_brand), '[^a-z0-9 ]', ' ', 'g')), 'ann other'] ELSE [trim(regexp_replace(lower(p_brand), '[^a-z0-9 ]', ' ', 'g'))] END AS e FROM part"


@query(f"SELECT count(*) AS n_items, count(DISTINCT e[1]) AS n_providers, round(avg((len(e) = 0)::INT), 9) AS unattributed_frac, round(avg((len(e) > 1)::INT), 9) AS multi_creator_frac, avg((len(e) = 0)::INT) < 0.02 AS passes FROM ({ATTRIBUTION})")
def attribution_gate(spark, sf):
    """EQ-15, FN-02, FN-07: statistics of the creators, and the gate at 2 % without one"""
    k = F.col("item_id")
    raw = F.when(k % 97 == 0, F.lit("Various")).when(k % 5 == 0, F.concat("p_brand", F.lit(" (Author), Ann Other (Illustrator, Editor)"))).otherwise(F.concat("p_brand", F.lit(" (Author)")))
    docs = items(spark, sf).select("item_id", fx.as_entities(raw).alias("creator"))
    gate = eq.check_unattributed(docs.select(fx.creator("creator").alias("provider")))
    stats = fx.creator_stats(docs)
    return stats.select("n_items", "n_providers", *(F.round(c, 9).alias(c) for c in ("unattributed_frac", "multi_creator_frac")), F.lit(gate < 0.02).alias("passes"))


BOTH = (
    P.replace("[0, 5, 10, 20]", "[0, 20]").replace("eval_users AS (SELECT DISTINCT user_id FROM reserved)", "eval_users AS (SELECT user_id FROM train UNION SELECT user_id FROM reserved)")
    + """, pop2 AS (SELECT *, 'all' AS population FROM recs UNION ALL SELECT *, 'eval' FROM recs WHERE user_id IN (SELECT user_id FROM reserved)),
ex AS (SELECT population, k, provider, sum(1 / log2(rank + 1)) AS exposure, sum(CASE WHEN cold THEN 1 / log2(rank + 1) ELSE 0 END) AS cold_exposure FROM pop2 JOIN prov USING (item_id) GROUP BY 1, 2, 3),
u AS (SELECT g.population, g.k, p.provider, coalesce(exposure, 0) AS v, coalesce(cold_exposure, 0) AS c FROM (SELECT DISTINCT population, k FROM ex) g CROSS JOIN (SELECT DISTINCT provider FROM prov) p LEFT JOIN ex USING (population, k, provider)),
g AS (SELECT population, k, sum((2 * i - n - 1) * v) / nullif(max(n) * sum(v), 0) AS gini, sum(c) / sum(v) AS cold_share FROM (SELECT *, row_number() OVER (PARTITION BY population, k ORDER BY v) AS i, count(*) OVER (PARTITION BY population, k) AS n FROM u) GROUP BY 1, 2)"""
)


@query(BOTH + " SELECT a.k, round(e.gini, 6) AS gini_eval, round(a.gini, 6) AS gini_all, round(e.cold_share, 6) AS cold_eval, round(a.cold_share, 6) AS cold_all, round((a.gini / nullif(e.gini, 0) - 1) * 100, 4) AS gini_delta_pct FROM g a JOIN g e USING (k) WHERE a.population = 'all' AND e.population = 'eval'")
def population_sensitivity(spark, sf):
    """EQ-16: exposure over the users with held-out rows against the whole population"""
    from ..operators import retrieval as rt

    s, levels, keys = split(spark, sf), [0, 20], ["population", "k", "discount"]
    everyone = s.train.select("user_id").union(s.reserved.select("user_id")).distinct()
    shown, prov = rt.revealed_by_k(s.reveal, levels), materialise(providers(spark, sf, s))
    seen = rt.levels_frame(s.train, levels).unionByName(shown)
    recs = materialise(rt.recommend_global(materialise(rt.popularity(s.train, shown, s.pool_items, levels)), everyone, seen, K))
    held = s.reserved.select("user_id").distinct()
    both = recs.withColumn("population", F.lit("all")).unionByName(recs.join(held, "user_id", "left_semi").withColumn("population", F.lit("eval")))
    exposed = eq.exposure(eq.exposure_by_rank(both, prov, ["population", "k"]), eq.weights(spark, ("log",), K), ["population", "k"])
    out = eq.report(materialise(eq.universe(exposed, prov, keys)), prov, keys).select("population", "k", "gini", "cold_share")
    a, e = (out.where(F.col("population") == x).select("k", F.col("gini").alias(f"gini_{x}"), F.col("cold_share").alias(f"cold_{x}")) for x in ("all", "eval"))
    delta = ((F.col("gini_all") / F.nullif("gini_eval", F.lit(0.0)) - 1) * 100).alias("gini_delta_pct")
    return a.join(e, "k").select("k", *(F.round(c, 6).alias(c) for c in ("gini_eval", "gini_all", "cold_eval", "cold_all")), F.round(delta, 4).alias("gini_delta_pct"))


@query("SELECT count(*) FILTER (m % 2 = 0 AND m % 3 = 0) AS n_common, count(*) FILTER (m % 2 <> 0) AS n_gap FROM (SELECT DISTINCT o_custkey AS m FROM orders)")
def model_coverage(spark, sf):
    """EQ-14, SET-08: users that all models cover (one that names none covers all), and the gap of one of them"""
    users = fixture_table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    common = eq.common_users(users.where("user_id % 2 = 0"), None, users.where("user_id % 3 = 0"))
    gap = eq.coverage_gap(users, users.where("user_id % 2 = 0"))
    return common.agg(F.count("*").alias("n_common")).withColumn("n_gap", F.lit(gap).cast("long"))
