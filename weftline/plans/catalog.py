"""The driver's tables in the shapes that operators take, in Spark and, as text, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build
from ..sources.text import lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as symbols of five kinds."""
    t = lambda n: table(spark, d, n)
    nation, region = t("nation"), t("region")
    base = nation.select(F.col("n_nationkey").alias("nk"), "n_name")

    def rows(df: DataFrame, kind: str, shift: int, key: str, name: str, owner, module) -> DataFrame:
        path = F.concat(F.lit(f"/Data/{kind}/"), F.col(name), F.lit(".h"))
        return df.select((F.col(key).cast("long") + shift).alias("symbol_id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), owner.cast("string").alias("owner_name"), module.cast("string").alias("module_name"), path.alias("path"), F.col(key).cast("long").alias("line_number"))

    none = F.lit(None)
    every = rows(region, "class", 0, "r_regionkey", "r_name", none, none)
    every = every.unionByName(rows(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "struct", 10**9, "n_nationkey", "n_name", F.col("r_name"), none))
    every = every.unionByName(rows(t("customer").join(base, F.col("c_nationkey") == F.col("nk")), "function", 2 * 10**9, "c_custkey", "c_name", F.col("n_name"), F.col("c_mktsegment")))
    every = every.unionByName(rows(t("supplier").join(base, F.col("s_nationkey") == F.col("nk")), "method", 3 * 10**9, "s_suppkey", "s_name", F.col("n_name"), none))
    every = every.unionByName(rows(t("part"), "property", 4 * 10**9, "p_partkey", "p_name", F.col("p_brand"), F.col("p_type")))
    return build.search_symbols(every)


_ROWS = "SELECT {key}::BIGINT + {shift} AS symbol_id, '{kind}' AS kind, {name} AS name, {owner}::VARCHAR AS owner_name, {module}::VARCHAR AS module_name, '/Data/{kind}/' || {name} || '.h' AS path, {key}::BIGINT AS line_number FROM {source}"
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def low(c: str) -> str:
    return LOW.format(c)


def compact(c: str) -> str:
    return low(f"regexp_replace({c}, '[^A-Za-z0-9]', '', 'g')")


SYMBOLS_SQL = (
    "raw_symbols AS ("
    + " UNION ALL ".join(
        _ROWS.format(key=k, shift=s * 10**9, kind=kind, name=n, owner=o, module=m, source=f)
        for s, (kind, k, n, o, m, f) in enumerate((
            ("class", "r_regionkey", "r_name", "NULL", "NULL", "region"),
            ("struct", "n_nationkey", "n_name", "r_name", "NULL", "nation JOIN region ON n_regionkey = r_regionkey"),
            ("function", "c_custkey", "c_name", "n_name", "c_mktsegment", "customer JOIN nation ON c_nationkey = n_nationkey"),
            ("method", "s_suppkey", "s_name", "n_name", "NULL", "supplier JOIN nation ON s_nationkey = n_nationkey"),
            ("property", "p_partkey", "p_name", "p_brand", "p_type", "part"),
        ))
    )
    + "), symbols AS (SELECT *, CASE WHEN kind IN ('class', 'struct') THEN 0 WHEN kind IN ('function', 'method') THEN 1 ELSE 2 END AS kind_rank, "
    + f"{low('name')} AS name_lc, {compact('name')} AS compact_name, {low('owner_name')} AS owner_name_lc, {low('module_name')} AS module_name_lc, {low('path')} AS path_lc, kind IN ('class', 'struct') AS is_class_like FROM raw_symbols)"
)


def document_lines(spark: SparkSession, d: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return lines(table(spark, d, name), key, "text")


def lines_sql(name: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"lines AS (SELECT {key}, i AS line_number, regexp_replace(parts[i], '\\r+$', '') AS line_text FROM (SELECT {key}, string_split({text}, chr(10)) AS parts FROM {name}), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))"
