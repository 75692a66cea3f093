"""Ingestion, filtering, joins, profiles and the split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import split as sp
from ..operators.ranking import hash_sample
from ..sources import readers
from .base import query
from .fixtures import SPLIT_SQL, interactions, items, kept, split, table

S = "WITH " + SPLIT_SQL


@query("SELECT count(*) FILTER (l_returnflag <> 'R') AS n_rows, count(*) AS n_source_rows, count(*) FILTER (l_returnflag <> 'R') / count(*) AS kept_frac FROM lineitem")
def footer_count(spark, sf):
    """SRC-06, SRC-07, SRC-08: written once, a second write of other rows is skipped; counts come from footers and from what is stamped beside them"""
    rows, path = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), readers.scratch_path(spark)
    readers.write_filtered(rows.where("l_returnflag <> 'R'"), rows, path)
    readers.write_filtered(rows, rows, path)
    return readers.footer_stats(spark, path)


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def distinct_users(spark, sf):
    """SRC-02, SRC-05"""
    return readers.distinct_ids(table(spark, sf, "events"), "user_id")


@query("SELECT p_partkey, p_brand FROM part")
def projected_scan(spark, sf):
    """SRC-03"""
    return table(spark, sf, "part").select("p_partkey", "p_brand")


@query("SELECT user_id, arg_max(title, event_id) AS title FROM (SELECT user_id, event_type AS title, event_id FROM events) GROUP BY user_id")
def title_lookup(spark, sf):
    """SRC-09: last row of each key"""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("parent_asin"), F.col("event_type").alias("title"), "event_id")
    return readers.titles(rows, ["event_id"]).select(F.col("parent_asin").alias("user_id"), "title")


@query("SELECT o_custkey AS user_id FROM orders INTERSECT SELECT user_id FROM events")
def common_users(spark, sf):
    """SET-01"""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).intersect(table(spark, sf, "events").select("user_id"))


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE user_id IN (SELECT o_custkey FROM orders)")
def reviews_of_common_users(spark, sf):
    """JOIN-01"""
    users = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return table(spark, sf, "events").join(users, "user_id", "left_semi").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT p_partkey AS item_id, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'R')")
def metadata_subset(spark, sf):
    """JOIN-02"""
    kept = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("item_id")).distinct()
    return items(spark, sf).select("item_id", "p_name").join(kept, "item_id", "left_semi")


SPINE = """WITH r AS (SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_quantity DESC, l_returnflag DESC) = 1),
    s AS (SELECT o_orderkey, o_custkey, o_orderkey % 200 + 1 AS part_key FROM orders),
    j AS (SELECT o_orderkey, o_custkey, part_key, l_quantity, l_returnflag, l_orderkey IS NOT NULL AS matched FROM s LEFT JOIN r ON l_orderkey = o_orderkey AND l_partkey = part_key)"""


def _enriched(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part_key"), "l_linenumber", "l_quantity", "l_returnflag")
    spine = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 200 + 1).alias("part_key"))
    return readers.enrich(spine, lines, ["o_orderkey", "part_key"], ["l_linenumber", "l_quantity", "l_returnflag"])


@query(SPINE + " SELECT o_orderkey, o_custkey, part_key, l_quantity, l_returnflag, matched FROM j")
def spine_enriched(spark, sf):
    """JOIN-03: spine left join deduplicated rows, many to one"""
    return _enriched(spark, sf).select("o_orderkey", "o_custkey", "part_key", "l_quantity", "l_returnflag", "matched")


@query(SPINE + " SELECT count(*) AS n, (SELECT count(*) FROM orders) AS n_spine, round(avg(matched::INT), 9) AS match_rate FROM j")
def spine_match_rate(spark, sf):
    """JOIN-03: as many rows as the spine, and how many found a partner"""
    n = table(spark, sf, "orders").agg(F.count("*").alias("n_spine"))
    return _enriched(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(F.col("matched").cast("double")), 9).alias("match_rate")).join(n)


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN value::FLOAT WHEN 2 THEN value::FLOAT WHEN 4 THEN (event_id % 90 * 100)::FLOAT END AS price FROM events"""
)
def price_coerced(spark, sf):
    """REL-05: numbers, also with an exponent, 'from x', dashes and nulls"""
    v, m = F.col("value").cast("string"), F.col("event_id") % 5
    power = F.concat((F.col("event_id") % 90).cast("string"), F.lit("e2"))
    raw = F.when(m == 1, v).when(m == 2, F.concat(F.lit("from "), v)).when(m == 3, F.lit("—")).when(m == 4, power)
    return table(spark, sf, "events").select("event_id", fx.price(raw).alias("price"))


@query("SELECT avg((l_linenumber = l_quantity)::INT) AS equal_frac, sum((l_linenumber = l_quantity)::INT)::BIGINT AS n_equal FROM lineitem")
def column_equality(spark, sf):
    """REL-06"""
    same = (F.col("l_linenumber") == F.col("l_quantity")).cast("int")
    return table(spark, sf, "lineitem").agg(F.avg(same).alias("equal_frac"), F.sum(same).alias("n_equal"))


@query("SELECT count(DISTINCT p_name) AS p_name, count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_size) AS p_size, count(DISTINCT string_split(p_type, ' ')) AS type_words FROM part")
def profile_nunique(spark, sf):
    """REL-07: distinct values of each column; a list counts as its text"""
    return readers.nunique(table(spark, sf, "part").select("p_name", "p_brand", "p_size", F.split("p_type", " ").alias("type_words")))


@query("SELECT coalesce(times, 0) AS times, count(*) AS n, (SELECT count(*) FROM documents WHERE doc_id % 9 = 0 OR source IS NULL) AS n_null FROM (SELECT source, count(*) AS times FROM documents WHERE doc_id % 9 <> 0 AND source IS NOT NULL GROUP BY source) GROUP BY 1")
def store_histogram(spark, sf):
    """AGG-06: how many values occur how often, and how many rows have none"""
    return readers.appearances(table(spark, sf, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("store")), "store")


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang, count(*) AS n, sum((n_chars > 1000)::INT)::BIGINT AS n_long FROM documents GROUP BY 1")
def value_counts_with_null(spark, sf):
    """AGG-07, AGG-08: NULL is a group; conditional counts"""
    lang = F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang")
    return table(spark, sf, "documents").groupBy(lang).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, md5(props)[1:12] AS key FROM events")
def json_field(spark, sf):
    """FN-17, and a field of a JSON text"""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), fx.short_hash("props").alias("key"))


@query(
    """WITH k AS (SELECT * FROM documents WHERE lang = 'en'), w AS (SELECT doc_id FROM labels),
    c AS (SELECT (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM w WHERE doc_id IN (SELECT doc_id FROM k)) AS covered, (SELECT count(*) FROM w) AS wanted)
    SELECT kept, total, covered, wanted, round(kept / total, 9) AS kept_frac, round(covered / wanted, 9) AS coverage FROM c"""
)
def filter_statistics(spark, sf):
    """SRC-18"""
    docs = table(spark, sf, "documents")
    out = readers.filter_stats(docs, docs.where("lang = 'en'"), table(spark, sf, "labels").select("doc_id"), "doc_id")
    return out.withColumn("kept_frac", F.round("kept_frac", 9)).withColumn("coverage", F.round("coverage", 9))


@query(S + "SELECT user_id, item_id, ts, rating FROM latest")
def dedup_latest(spark, sf):
    """WIN-01"""
    return sp.latest(interactions(spark, sf)).select("user_id", "item_id", "ts", "rating")


@query(S + "SELECT p_partkey AS item_id, count(user_id) AS degree FROM part LEFT JOIN pos ON item_id = p_partkey GROUP BY 1")
def item_degrees(spark, sf):
    """AGG-01, REL-01"""
    return sp.item_degrees(items(spark, sf), sp.positives(interactions(spark, sf)))


@query(S + "SELECT item_id, population FROM cold")
def cold_items(spark, sf):
    """SMP-01, REL-09"""
    return split(spark, sf).cold


@query(S + "SELECT user_id, item_id, split FROM warm")
def split_labels(spark, sf):
    """DS-01, WIN-02, WIN-03, JOIN-04, AGG-03, TOPK-04"""
    return split(spark, sf).warm.select("user_id", "item_id", "split")


@query(
    S.replace(">= 5)", ">= 12)").replace("nu >= 3", "nu >= 2")
    + "SELECT split, count(*) AS n, sum(rescued::INT)::BIGINT AS n_rescued FROM warm GROUP BY split"
)
def starvation_rescue(spark, sf):
    """DS-02 under stricter parameters"""
    s = split(spark, sf, min_warm=12, min_loo=2)
    return s.warm.groupBy("split").agg(F.count("*").alias("n"), F.count_if("rescued").alias("n_rescued"))


@query(S + "SELECT item_id, user_id, pos FROM reveal")
def reveal_pool(spark, sf):
    """WIN-04, WIN-05"""
    return split(spark, sf).reveal


@query(S + "SELECT item_id, user_id, pos FROM ceiling")
def ceiling_pool(spark, sf):
    """DS-05"""
    return split(spark, sf).ceiling


@query(S + "SELECT item_id, user_id FROM reserved")
def reserved_test(spark, sf):
    return split(spark, sf).reserved


@query(S + "SELECT user_id, item_id FROM reveal WHERE pos < 7")
def revealed_at_7(spark, sf):
    """REL-08, DS-04"""
    return split(spark, sf).revealed_at(7)


@query(S + "SELECT item_id, user_id FROM pool WHERE population = 'val' AND rdesc <= 5")
def validation_reserved(spark, sf):
    """DS-06"""
    return split(spark, sf).validation().reserved


@query(S + "SELECT item_id, item_id IN (SELECT item_id FROM auc_items) AS in_auc, item_id IN (SELECT item_id FROM cold_test) AS is_cold FROM pool_items")
def candidate_pools(spark, sf):
    """DS-09, SET-02, SET-03"""
    s = split(spark, sf)
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    out = s.pool_items.join(flag(s.auc_items, "a"), "item_id", "left").join(flag(s.cold_ids, "c"), "item_id", "left")
    return out.select("item_id", F.coalesce("a", F.lit(False)).alias("in_auc"), F.coalesce("c", F.lit(False)).alias("is_cold"))


@query(
    S
    + """SELECT (SELECT count(*) FROM inter) AS n_raw, (SELECT count(*) FROM latest) AS n_latest, (SELECT count(DISTINCT user_id) FROM latest) AS n_users,
    (SELECT count(DISTINCT item_id) FROM latest) AS n_items, (SELECT count(*) FROM pos) AS n_positive,
    (SELECT count(*) FROM cold WHERE population = 'test') AS n_cold_test, (SELECT count(*) FROM cold WHERE population = 'val') AS n_cold_val,
    (SELECT count(*) FROM warm WHERE split = 'train') AS n_train, (SELECT count(*) FROM warm WHERE split = 'val') AS n_val, (SELECT count(*) FROM warm WHERE split = 'test') AS n_test,
    (SELECT count(*) FROM warm WHERE rescued) AS n_rescued, (SELECT count(DISTINCT item_id) FROM warm) AS n_warm_items,
    (SELECT min(n) FROM c) AS ceiling_min, (SELECT quantile_cont(n, 0.5) FROM c) AS ceiling_median, (SELECT max(n) FROM c) AS ceiling_max,
    round(1 - (SELECT count(*) FROM pos) / (SELECT count(*) FROM latest), 6) AS dropped_frac""".replace("SELECT (SELECT count(*) FROM inter)", ", c AS (SELECT item_id, count(*) AS n FROM ceiling GROUP BY 1) SELECT (SELECT count(*) FROM inter)", 1)
)
def split_summary(spark, sf):
    """AGG-22, AGG-02"""
    return sp.summary(interactions(spark, sf), split(spark, sf))


@query(
    S
    + """, f AS (SELECT 'train' AS t, user_id, item_id FROM train UNION ALL SELECT 'val', user_id, item_id FROM warm WHERE split = 'val'
      UNION ALL SELECT 'reserved', user_id, item_id FROM reserved UNION ALL SELECT 'reveal', user_id, item_id FROM reveal)
    SELECT """
    + ", ".join(
        f"count(*) FILTER (t = '{t}') AS {t}_n, coalesce(sum(user_id) FILTER (t = '{t}'), 0)::BIGINT AS {t}_users, coalesce(sum(item_id) FILTER (t = '{t}'), 0)::BIGINT AS {t}_items"
        for t in ("train", "val", "reserved", "reveal")
    )
    + ", 0 AS salt FROM f"
)
def fingerprint(spark, sf):
    """AGG-23, CACHE-02"""
    return sp.fingerprint(split(spark, sf))


@query("SELECT o_custkey AS user_id FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5(o_custkey::VARCHAR || '|0'), o_custkey LIMIT 50")
def sampled_users(spark, sf):
    """SMP-03: hash-ordered sample"""
    return hash_sample(table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct(), "user_id", 50, 0)


@query(S + ", d AS (SELECT item_id, count(*) AS n FROM train GROUP BY 1) SELECT quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, quantile_cont(n, 0.9) AS p90, CAST(floor(quantile_cont(n, 0.5)) AS INT) AS n_select FROM d")
def warm_degree_stats(spark, sf):
    """AGG-20"""
    d = split(spark, sf).train.groupBy("item_id").agg(F.count("*").alias("n"))
    median = F.percentile("n", F.lit(0.5))
    return d.agg(median.alias("median"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.9)).alias("p90"), F.floor(median).cast("int").alias("n_select"))


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS window_start, event_type AS item, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_popularity(spark, sf):
    """Tumbling windows over event time (batch form of the streaming operator)"""
    from ..streaming.queue import windowed_popularity as windows

    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("item"))
    return windows(rows).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "item", "n")


# Raw files: the tables as JSON lines and CSV in the raw layouts, written to a scratch folder and read by the fixed schemas.


def _raw_reviews(spark, sf):
    def make():
        e = table(spark, sf, "events")
        pictures = F.when(F.col("event_id") % 3 != 0, F.array_repeat(F.struct(F.lit("h").alias("hi_res"), F.lit("l").alias("large"), F.lit("t").alias("thumb")), (F.col("event_id") % 4).cast("int")))
        rows = e.select(
            F.col("value").alias("rating"), F.col("event_type").alias("title"), F.col("props").alias("text"), pictures.alias("images"), F.concat(F.lit("a"), F.col("event_id") % 50).alias("asin"),
            F.concat(F.lit("p"), F.col("event_id") % 40).alias("parent_asin"), F.concat(F.lit("u"), F.col("user_id")).alias("user_id"), F.col("event_id").alias("timestamp"),
            (F.col("event_id") % 7).cast("int").alias("helpful_vote"), (F.col("event_id") % 2 == 0).alias("verified_purchase"),
        )
        path = readers.scratch_path(spark)
        rows.write.option("compression", "gzip").json(path)
        return path

    return readers.read_reviews(spark, kept(spark, ("raw reviews", sf), make))


def _raw_metadata(spark, sf):
    def make():
        k = F.col("p_partkey")
        none = lambda c, n: F.when(k % n != 0, c)
        rows = table(spark, sf, "part").select(
            F.concat(F.lit("p"), k).alias("parent_asin"), F.col("p_brand").alias("main_category"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("subtitle"),
            none(F.struct(F.col("p_brand").alias("name")), 3).alias("author"), (F.col("p_size") / 10).alias("average_rating"), F.col("p_size").cast("int").alias("rating_number"),
            F.when(k % 4 == 0, F.concat(F.lit("from "), k.cast("string"))).when(k % 4 == 1, F.lit("—")).when(k % 4 == 2, k.cast("string")).alias("price"),
            none(F.split("p_type", " "), 5).alias("features"), none(F.array("p_name"), 7).alias("description"), F.lit(None).cast("array<string>").alias("categories"), F.col("p_type").alias("store"),
            none(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("é"), F.col("p_brand")), 6).alias("details"),
            none(F.array_repeat(F.struct(F.lit("x").alias("large")), (k % 3).cast("int")), 2).alias("images"), F.lit(None).cast("array<struct<url:string>>").alias("videos"),
        )
        path = readers.scratch_path(spark)
        rows.write.option("compression", "gzip").json(path)
        return path

    return readers.read_metadata(spark, kept(spark, ("raw metadata", sf), make))


@query("SELECT least(count(*), 100) AS n, 0::BIGINT AS n_foreign FROM events")
def reviews_preview(spark, sf):
    """SRC-01: the first rows of gzip JSON lines, all of them rows of the file"""
    raw = _raw_reviews(spark, sf)
    shown = readers.preview(raw, 100).select("timestamp")
    foreign = shown.join(table(spark, sf, "events").select(F.col("event_id").alias("timestamp")), "timestamp", "left_anti")
    return shown.agg(F.count("*").alias("n")).join(foreign.agg(F.count("*").alias("n_foreign")))


@query("SELECT value::FLOAT AS rating, event_type AS title, props AS text, CASE WHEN event_id % 3 <> 0 THEN event_id % 4 ELSE 0 END::INT AS n_images, 'a' || event_id % 50 AS asin, 'p' || event_id % 40 AS parent_asin, 'u' || user_id AS user_id, event_id AS timestamp, (event_id % 7)::INT AS helpful_vote, event_id % 2 = 0 AS verified_purchase FROM events")
def review_layout(spark, sf):
    """REL-02, REL-03 on raw reviews: the filtered layout, a missing list of pictures counts as none"""
    return readers.review_rows(_raw_reviews(spark, sf))


@query("""SELECT 'p' || p_partkey AS parent_asin, p_brand AS main_category, p_name AS title, NULL::VARCHAR AS subtitle, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS author_name, (p_size / 10)::FLOAT AS average_rating, p_size::INT AS rating_number,
CASE WHEN p_partkey % 4 IN (0, 2) THEN p_partkey::FLOAT END AS price, CASE WHEN p_partkey % 5 <> 0 THEN array_to_string(string_split(p_type, ' '), '|') ELSE '' END AS features, CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE '' END AS description, '' AS categories, p_type AS store,
CASE WHEN p_partkey % 6 <> 0 THEN '{"size":"' || p_size || '","é":"' || p_brand || '"}' END AS details_json, CASE WHEN p_partkey % 2 <> 0 THEN p_partkey % 3 ELSE 0 END::INT AS n_images, 0::INT AS n_videos FROM part""")
def metadata_layout(spark, sf):
    """SRC-17, REL-02, REL-03, REL-04, FN-18: the fifteen fields of raw metadata; lists are shown joined"""
    out = readers.meta_rows(_raw_metadata(spark, sf))
    return out.select(*(F.array_join(c, "|").alias(c) if c in ("features", "description", "categories") else F.col(c) for c in out.columns))


@query("SELECT 'c' || o_custkey AS user_id, 'p' || o_orderkey % 40 AS parent_asin, (o_orderkey % 5 + 1)::FLOAT AS rating, o_orderkey AS timestamp FROM orders")
def spine_csv(spark, sf):
    """SRC-04: typed CSV with a header"""

    def make():
        k = F.col("o_orderkey")
        rows = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("user_id"), F.concat(F.lit("p"), k % 40).alias("parent_asin"), (k % 5 + 1).cast("float").alias("rating"), k.alias("timestamp"))
        path = readers.scratch_path(spark)
        rows.write.option("header", True).csv(path)
        return path

    return readers.read_spine(spark, kept(spark, ("raw spine", sf), make))


@query("SELECT p_brand AS arm, CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE round(avg(p_retailprice), 6) END AS value, count(*) AS n FROM part GROUP BY 1")
def json_results(spark, sf):
    """SRC-14: metrics as JSON and back; an undefined one is null"""
    by = table(spark, sf, "part").groupBy(F.col("p_brand").alias("arm")).agg(F.round(F.avg("p_retailprice"), 6).alias("value"), F.count("*").alias("n"))
    path = readers.scratch_path(spark)
    readers.write_json(by.withColumn("value", F.when(F.col("arm") == "Brand#11", float("nan")).otherwise(F.col("value"))), path)
    return spark.read.schema("arm string, value double, n long").json(path)


@query("SELECT bit_xor(CAST('0x' || md5(o_custkey::VARCHAR || '|' || l_partkey::VARCHAR)[1:15] AS BIGINT)) AS key, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def relation_keys(spark, sf):
    """CACHE-01, CACHE-03: a key of the content, whatever the order of the rows; a memo written under its parameters, and read the second time"""
    root = readers.scratch_path(spark)
    rows = interactions(spark, sf).agg(fx.relation_key("user_id", "item_id").alias("key"), F.count("*").alias("n"))
    readers.memoised(spark, root, "relation", {"of": "interactions"}, lambda: rows)
    return readers.memoised(spark, root, "relation", {"of": "interactions"}, lambda: rows.where("false"))


@query(S + """, sy AS (SELECT DISTINCT p.user_id, item_id FROM pos p JOIN cold_test USING (item_id) WHERE p.user_id % 3 = 0), few AS (SELECT item_id FROM cold_test WHERE item_id % 2 = 0)
SELECT 'fold' AS part, user_id, item_id FROM (SELECT user_id, item_id FROM reveal WHERE pos < 7 UNION SELECT user_id, item_id FROM sy) UNION ALL SELECT 'seen', user_id, item_id FROM reveal WHERE pos < 7 UNION ALL SELECT 'held', user_id, item_id FROM reserved WHERE item_id IN (FROM few)""")
def augmented_split(spark, sf):
    """DS-07, SET-05, SMP-06: synthetic rows enter the fold-in once a pair, not what counts as seen; the test is held to some items"""
    s = split(spark, sf)
    synthetic = s.rows.join(s.cold_ids, "item_id").where("user_id % 3 = 0").select("user_id", "item_id").distinct()
    a = s.augmented(synthetic, s.cold_ids.where("item_id % 2 = 0"))
    tag = lambda name, rows: rows.select(F.lit(name).alias("part"), "user_id", "item_id")
    return tag("fold", a.fold_in_at(7)).unionByName(tag("seen", a.revealed_at(7))).unionByName(tag("held", a.reserved))


@query(S + "SELECT item_id, user_id FROM reserved QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5(user_id::VARCHAR || '|' || item_id::VARCHAR || '|42'), user_id) <= 3")
def few_reserved(spark, sf):
    """SMP-02: some reserved users of each cold item, the same for all levels"""
    return split(spark, sf).few_users(3, 42)
