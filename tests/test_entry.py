"""Every query with a SQL twin at the smallest scale, every other query's rows, and the contract of the entry module."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from thawline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def plain(df, columns):
    said = lambda x: "none" if pd.isna(x) else str(bool(x)) if type(x).__name__ in ("bool", "bool_") else f"{x:.6g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)
    return sorted(tuple(said(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, oracle, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), oracle.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_changed_data_is_read_anew(spark, tmp_path):
    """What is kept belongs to the files of a folder, not to its name."""
    from thawline.plans import fixtures

    asked = []
    for n in (1, 2):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
        for _ in range(2):
            fixtures.kept(spark, ("probe", str(tmp_path)), lambda n=n: asked.append(n))
    assert asked == [1, 2]


def test_sweep_tells_its_times(spark):
    from thawline.plans import fixtures, modelling

    curve, took = modelling.sweep([modelling._als(spark, SF)], fixtures.split(spark, SF), [0], on_lists=lambda k, seed, recs: None)
    assert set(took) == {"fold", "rank", "hook"} and min(took.values()) >= 0 and took["rank"] > 0 and curve.count() == 4


def test_warm_guard_is_measured(spark):
    """The validation's users have profiles of their own, and the warm rows held out for them are what the guard reads."""
    from thawline.plans import fixtures, modelling

    s = fixtures.split(spark, SF).validation()
    users = s.reserved.select("user_id").distinct()
    profiled = modelling._content(spark, SF, s.population).users.select("id")
    assert users.join(s.train, "user_id", "left_semi").subtract(profiled).count() == 0
    held = s.part("val").join(users, "user_id", "left_semi")
    assert modelling.warm_ndcg(held.selectExpr("user_id", "item_id", "1 as rank"), s).first().warm == 1.0
    assert modelling.warm_ndcg(held.selectExpr("user_id", "item_id", "3 as rank"), s).first().warm == 0.5
