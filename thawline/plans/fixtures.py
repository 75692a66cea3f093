"""The driver's tables in the roles of this domain: interactions, item metadata, reviews, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.split import Split, make_split
from ..sources.readers import input_fingerprint
from ..sources.schemas import SplitParams


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rating = F.when(F.col("l_returnflag") == "R", 2.0).when(F.col("l_returnflag") == "N", 4.0).otherwise(5.0)
    # orders are hashed where they meet their lines: neither side is sorted, so none spills
    return lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"), rating.alias("rating"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
    )


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, key: tuple, make):
    """What ``make`` returns, once per application and key: the reuse points of the curves.  A key is (name, folder, ...); the files of the folder
    belong to it, so changed data at the same place are read anew."""
    key = (spark.sparkContext.applicationId, input_fingerprint(spark, key[1]), *key)
    if key not in _KEPT:
        for old in [k for k in _KEPT if k[0] != key[0]]:
            del _KEPT[old]
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what is kept, for timings that start from nothing."""
    _KEPT.clear()


def split(spark: SparkSession, sf: str, **changes) -> Split:
    """The split of the tables in ``sf``; its four relations are written once, since every curve starts from them."""

    return kept(spark, ("split", sf, *sorted(changes.items())), lambda: make_split(interactions(spark, sf), SplitParams(**changes)))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def providers(spark: SparkSession, sf: str, s: Split) -> DataFrame:
    """(item_id, provider, cold) over the candidate pool."""
    brand = items(spark, sf).select("item_id", F.lower("p_brand").alias("provider"))
    cold = s.cold_ids.withColumn("is_cold", F.lit(True))
    return brand.join(s.pool_items, "item_id", "left_semi").join(cold, "item_id", "left").select("item_id", "provider", F.coalesce("is_cold", F.lit(False)).alias("cold"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, v): each item takes the vector of its key modulo their number."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = v.agg(F.count("*").alias("n"))
    return items(spark, sf).select("item_id").join(n).withColumn("vec_id", F.col("item_id") % F.col("n")).join(v, "vec_id").select("item_id", "v")


# The same relations as common table expressions, for the SQL twins.
SPLIT_SQL = """
inter AS (SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, CASE l_returnflag WHEN 'R' THEN 2.0 WHEN 'N' THEN 4.0 ELSE 5.0 END AS rating,
  l_orderkey AS order_id, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
latest AS (SELECT * FROM inter QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, order_id DESC, line DESC, rating DESC) = 1),
pos AS (SELECT user_id, item_id, ts FROM latest WHERE rating >= 4),
elig AS (SELECT item_id FROM pos GROUP BY item_id HAVING count(*) >= 25),
drawn AS (SELECT item_id, row_number() OVER (ORDER BY md5(item_id::VARCHAR || '|42'), item_id) AS draw, count(*) OVER () AS n FROM elig),
cold AS (SELECT item_id, CASE WHEN draw <= round_even(n * 0.1, 0) THEN 'test' ELSE 'val' END AS population FROM drawn WHERE draw <= 2 * round_even(n * 0.1, 0)),
pool AS (SELECT p.item_id, c.population, p.user_id, row_number() OVER (PARTITION BY p.item_id ORDER BY p.ts, p.user_id) - 1 AS pos,
  row_number() OVER (PARTITION BY p.item_id ORDER BY p.ts DESC, p.user_id DESC) AS rdesc FROM pos p JOIN cold c USING (item_id)),
warm0 AS (SELECT * FROM pos WHERE item_id NOT IN (SELECT item_id FROM cold)),
warm1 AS (SELECT * FROM warm0 WHERE item_id IN (SELECT item_id FROM warm0 GROUP BY item_id HAVING count(*) >= 5)),
warm2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS fe, count(*) OVER (PARTITION BY user_id) AS nu FROM warm1),
warm3 AS (SELECT user_id, item_id, ts, CASE WHEN nu >= 3 AND fe = 1 THEN 'test' WHEN nu >= 3 AND fe = 2 THEN 'val' ELSE 'train' END AS label FROM warm2),
fed AS (SELECT DISTINCT item_id FROM warm3 WHERE label = 'train'),
warm AS (SELECT user_id, item_id, ts, CASE WHEN item_id IN (SELECT item_id FROM fed) THEN label ELSE 'train' END AS split, item_id NOT IN (SELECT item_id FROM fed) AS rescued FROM warm3),
train AS (SELECT user_id, item_id FROM warm WHERE split = 'train'),
reveal AS (SELECT item_id, user_id, pos FROM pool WHERE population = 'test' AND pos < 20),
ceiling AS (SELECT item_id, user_id, pos FROM pool WHERE population = 'test' AND rdesc > 5),
reserved AS (SELECT item_id, user_id FROM pool WHERE population = 'test' AND rdesc <= 5),
cold_test AS (SELECT item_id FROM cold WHERE population = 'test'),
pool_items AS (SELECT item_id FROM train UNION SELECT item_id FROM cold_test),
auc_items AS (SELECT item_id FROM train GROUP BY item_id HAVING count(*) >= 25 UNION SELECT item_id FROM cold_test)
"""

#: Popularity lists at k = 0, 5, 10, 20 of the users with reserved rows, K = 20.
POPULARITY_SQL = (
    SPLIT_SQL
    + """,
ks AS (SELECT unnest([0, 5, 10, 20]) AS k),
revealed AS (SELECT k, user_id, item_id FROM ks JOIN reveal ON pos < k),
seen AS (SELECT k, user_id, item_id FROM ks, train UNION ALL SELECT * FROM revealed),
pop AS (SELECT ks.k, p.item_id, coalesce(t.n, 0) + coalesce(r.n, 0) AS score FROM ks, pool_items p
  LEFT JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1) t ON t.item_id = p.item_id
  LEFT JOIN (SELECT k, item_id, count(*) AS n FROM revealed GROUP BY 1, 2) r ON r.item_id = p.item_id AND r.k = ks.k),
eval_users AS (SELECT DISTINCT user_id FROM reserved),
recs AS (SELECT pop.k, u.user_id, pop.item_id, pop.score, row_number() OVER (PARTITION BY pop.k, u.user_id ORDER BY pop.score DESC, pop.item_id) AS rank
  FROM pop CROSS JOIN eval_users u WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.k = pop.k AND s.user_id = u.user_id AND s.item_id = pop.item_id)
  QUALIFY rank <= 20)
"""
)
