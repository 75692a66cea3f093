"""Readers and writers: raw JSON lines, typed CSV, Parquet with and without data, settings files."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from . import schemas


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Raw reviews (JSON lines, gzip or not) under the fixed schema; never inferred."""
    return spark.read.schema(schemas.REVIEW_RAW).json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.META_RAW).json(path)


def read_spine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SPINE_CSV).option("header", True).csv(path)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def review_rows(reviews: DataFrame) -> DataFrame:
    """Filtered-review layout: images become their number, rating a float."""
    return reviews.select(
        F.col("rating").cast("float").alias("rating"), "title", "text", F.coalesce(F.size("images"), F.lit(0)).alias("n_images"),
        "asin", "parent_asin", "user_id", "timestamp", "helpful_vote", "verified_purchase",
    )


def meta_rows(meta: DataFrame) -> DataFrame:
    """The fifteen fields of an item's metadata from its raw record."""
    none = F.array().cast("array<string>")
    return meta.select(
        "parent_asin", "main_category", "title", "subtitle", F.col("author.name").alias("author_name"),
        F.col("average_rating").cast("float").alias("average_rating"), "rating_number", fx.price("price").alias("price"),
        *(F.coalesce(c, none).alias(c) for c in ("features", "description", "categories")),
        "store", F.to_json("details").alias("details_json"),
        F.coalesce(F.size("images"), F.lit(0)).alias("n_images"), F.coalesce(F.size("videos"), F.lit(0)).alias("n_videos"),
    )


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by ``order``.  Combines before the shuffle, so hot keys cost one row a task."""
    rest = [c for c in df.columns if c not in keys]
    more = [c for c in rest if c not in order]  # what is compared travels once
    packed = F.struct(*order, F.struct(*more).alias("_row")) if more else F.struct(*order)
    if any(t.startswith("map") for _, t in df.dtypes):  # maps have no order
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
        return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    best = df.groupBy(*keys).agg(F.max(packed).alias("best"))
    return best.select(*keys, *((F.col("best") if c in order else F.col("best")["_row"])[c].alias(c) for c in rest))


def enrich(spine: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every spine row with its row's columns, the spine's own winning; ``matched`` tells whether there is one.  Many to one: ``rows``
    are reduced to the last one a key, so a spine row never multiplies."""
    last = keep_last(rows, keys, order).withColumn("matched", F.lit(True))
    both = [c for c in last.columns if c in spine.columns and c not in keys]
    return spine.join(last.drop(*both), keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def check_many_to_one(rows: DataFrame, keys: list[str]) -> None:
    """Refuses a right side that would multiply rows."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"keys {keys} aren't unique")


def titles(meta: DataFrame, order: list[str]) -> DataFrame:
    return keep_last(meta.select(*dict.fromkeys(["parent_asin", "title", *order])), ["parent_asin"], order).select("parent_asin", "title")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``: local, distributed and object stores alike."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def is_built(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished the table at ``path``."""
    files, at = _files(spark, f"{path.rstrip('/')}/_SUCCESS")
    return files.exists(at)


def input_fingerprint(spark: SparkSession, path: str, **params) -> tuple:
    """What a result depends on: name, size and time of each file under ``path``, and the parameters."""
    files, at = _files(spark, path)
    listed = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(at))
    inner = [x for f in files.listStatus(at) if f.isDirectory() for x in sorted((y.getPath().getName(), y.getLen()) for y in files.listStatus(f.getPath()))]
    return (tuple(listed), tuple(inner), tuple(sorted(params.items())))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, through Spark's writer, so that it lands in whatever store ``path`` names."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\x00").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("lineSep", "\x00").text(path).first()[0]


def write_once(df: DataFrame, path: str, stats: dict | None = None) -> bool:
    """zstd Parquet, and ``stats`` (row counts, provenance) beside it under ``<path>.stats``.  The committer makes the table
    whole or absent; one that is finished is never written again.  Returns whether it was written now."""
    spark = df.sparkSession
    if is_built(spark, path):
        return False
    if stats is not None:  # first, so that a finished table has its statistics
        write_text(spark, f"{path.rstrip('/')}.stats", json.dumps(stats, sort_keys=True))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return True


def write_filtered(after: DataFrame, before: DataFrame, path: str) -> bool:
    """``write_once`` with the number of source rows stamped beside the kept ones."""
    return not is_built(before.sparkSession, path) and write_once(after, path, {"n_source_rows": before.count()})


def read_stats(spark: SparkSession, path: str) -> dict:
    """What was stamped beside a table, without reading its data; {} for a table without it."""
    at = f"{path.rstrip('/')}.stats"
    return json.loads(read_text(spark, at)) if is_built(spark, at) else {}


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """Number of rows: no column is read, so the scan takes it from the footers."""
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows"))


def footer_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows now, source rows as stamped, and the share that was kept; no data is read."""
    source = read_stats(spark, path).get("n_source_rows")
    return row_count(spark, path).select("n_rows", F.lit(source).cast("long").alias("n_source_rows"), (F.col("n_rows") / F.nullif(F.lit(source), F.lit(0))).alias("kept_frac"))


def nunique(df: DataFrame) -> DataFrame:
    """One row: the number of distinct values of each column; lists count by their text."""
    kinds = dict(df.dtypes)
    as_value = lambda c: F.to_json(F.array(c)) if kinds[c].startswith(("array", "struct")) else F.col(c)
    return df.agg(*(F.countDistinct(as_value(c)).alias(c) for c in df.columns))


def appearances(df: DataFrame, column: str) -> DataFrame:
    """(times, n, n_null): how many values stand in so many rows, and in how many rows there is none."""
    by = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("n"))
    return by.join(df.agg(F.count_if(F.col(column).isNull()).alias("n_null")))


def filter_stats(before: DataFrame, after: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """kept and total rows, and how many of the wanted keys are covered, as one row."""
    covered = wanted.join(after.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("covered"))
    return (
        before.agg(F.count("*").alias("total"))
        .join(after.agg(F.count("*").alias("kept")))
        .join(covered)
        .join(wanted.agg(F.count("*").alias("wanted")))
        .select("kept", "total", "covered", "wanted", (F.col("kept") / F.col("total")).alias("kept_frac"), (F.col("covered") / F.col("wanted")).alias("coverage"))
    )


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: later plans start from a scan, and a lost executor costs no
    recomputation."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A fresh place under spark.checkpoint.dir; under a local folder only where that is unset and all of Spark is on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="thawline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/thawline-core-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        files, at = _files(spark, f"{root.rstrip('/')}/thawline-core-{spark.sparkContext.applicationId}")
        files.delete(at, True)


def write_json(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines; NaN is written as null, since JSON has no word for it."""
    kinds = dict(df.dtypes)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    df.select(*clean).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def run_key(params: dict) -> str:
    """Twelve hex digits that name a set of parameters."""
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]


def memoised(spark: SparkSession, root: str, name: str, params: dict, make) -> DataFrame:
    """The table that ``make`` returns, written under ``root`` once for each set of parameters and read from there on."""
    path = f"{root.rstrip('/')}/{name}_{run_key(params)}"
    if not is_built(spark, path):
        write_once(make(), path, params)
    return spark.read.parquet(path)


def save_config(spark: SparkSession, path: str, config: dict, fingerprint: list) -> None:
    write_text(spark, path, json.dumps({"fingerprint": fingerprint, "config": config}, sort_keys=True))


def load_config(spark: SparkSession, path: str, fingerprint: list) -> dict:
    """Refuses settings that were tuned on other data, or that aren't whole."""
    held = json.loads(read_text(spark, path))
    if not {"fingerprint", "config"} <= set(held):
        raise ValueError("the settings file is not whole")
    if held["fingerprint"] != fingerprint:
        raise ValueError("the settings were tuned on other data: tune again")
    return held["config"]


class Checkpoint:
    """Results by key, kept as one small table a key, so that a stopped sweep goes on where it was.  All keys live under the
    fingerprint of what they depend on; a changed input starts anew."""

    def __init__(self, spark: SparkSession, root: str, depends: dict) -> None:
        self.spark, self.root = spark, f"{root.rstrip('/')}/{run_key(depends)}"

    def path(self, key: str) -> str:
        return f"{self.root}/{run_key({'key': key})}"

    def get(self, key: str, make) -> DataFrame:
        path = self.path(key)
        if not is_built(self.spark, path):
            write_once(make(), path, {"key": key})
        return self.spark.read.parquet(path)
