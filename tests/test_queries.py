"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from weftline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or str(v) in ("<NA>", "nan"):
            return "~"
        if isinstance(v, float):
            return f"{v:.6g}" if not math.isclose(v, round(v)) else str(round(v))
        return str(v)

    return sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(name, spark, sf_dir, duck):
    got = plans.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def large(sf_dir, tmp_path_factory):
    """Tables in which requests find more than a page; half of the members of one name are in a derived class."""
    d = tmp_path_factory.mktemp("large")
    c = duckdb.connect()
    made = {"supplier": "SELECT i AS s_suppkey, 'S' || i AS s_name, CASE WHEN i // 7 % 2 = 0 THEN 3 ELSE 7 END::INTEGER AS s_nationkey, 0.5::DOUBLE AS s_acctbal FROM range(5000) AS t(i)",
            "part": "SELECT i AS p_partkey, 'red widget' AS p_name, 'Brand' AS p_brand, 'SMALL TIN' AS p_type, (5 + i % 2)::INTEGER AS p_size, 0.5::DOUBLE AS p_retailprice FROM range(24000) AS t(i)"}
    for t in ("region", "nation", "customer", "supplier", "part"):
        c.sql(f"COPY ({made.get(t, f"SELECT * FROM '{sf_dir}/{t}.parquet'")}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    return str(d), c


@pytest.mark.parametrize("name,page", [("request_member_usages", 300), ("request_search_files", 10_000), ("request_search_files_in_modules", 10_000)])
def test_request_beyond_a_page(name, page, spark, large):
    d, c = large
    want = c.sql(plans.oracle_sql()[name]).df()
    assert len(want) > page
    assert rows(plans.queries()[name](spark, d).toPandas()) == rows(want)
