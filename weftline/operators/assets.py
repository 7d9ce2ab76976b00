"""Asset references: usages by name, hints, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .resolve import lookup_by_suffix


def usage_rows(assets: DataFrame, references: DataFrame, functions: DataFrame) -> DataFrame:
    """(lookup_key, usage_kind, asset_path): what each asset derives from, references and calls, keys lower-cased."""
    derived = assets.select(S.lower_ascii("parent_class").alias("lookup_key"), F.lit("derived").alias("usage_kind"), "asset_path").filter("lookup_key is not null")
    refs = references.select(S.lower_ascii("referenced").alias("lookup_key"), F.lit("reference").alias("usage_kind"), "asset_path")
    calls = functions.select(S.lower_ascii("function_name").alias("lookup_key"), F.lit("function").alias("usage_kind"), "asset_path")
    return derived.unionByName(refs).unionByName(calls).distinct()


def asset_usages(usages: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Usages of each name or its form without a type prefix, by whole key or last part, sorted."""
    spelled = names.select(F.explode(S.lookup_names(name)).alias("name"))
    return lookup_by_suffix(usages, "lookup_key", spelled, "name").select("looked_up", "usage_kind", "asset_path").distinct().orderBy("looked_up", "usage_kind", "asset_path")


def usage_hints(usages: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """(name, derived_count, reference_count): distinct assets; references and function calls count together."""
    hits = lookup_by_suffix(usages, "lookup_key", names.select(S.lower_ascii(name).alias("name")), "name")
    return hits.groupBy(F.col("looked_up").alias("name")).agg(
        F.count_distinct(F.when(F.col("usage_kind") == "derived", F.col("asset_path"))).alias("derived_count"),
        (F.count_distinct(F.when(F.col("usage_kind") == "reference", F.col("asset_path"))) + F.count_distinct(F.when(F.col("usage_kind") == "function", F.col("asset_path")))).alias("reference_count"),
    )


def best_parent(candidates: DataFrame, group: str, path: str = "path", position: str = "position") -> DataFrame:
    """The likeliest parent class of each asset: project classes over engine classes over other built-ins, then the first seen.

    The module is what stands between ``/Script/`` and the first dot.
    """
    from .checks import cap_per_group

    module = F.regexp_extract(path, r"^/Script/([^.]*)", 1)
    score = F.when(module == "Engine", 20).when(module.isin("CoreUObject", "UnrealEd"), 10).otherwise(100)
    return cap_per_group(candidates.withColumn("score", score), [group], [F.desc("score"), F.col(position)], 1)


def index_status(assets: DataFrame, references: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: counts, orphan counts, a sample of the first eight orphans and the issues that follow from them."""
    known = assets.select("asset_path").distinct()
    lost = references.join(known, "asset_path", "left_anti")
    lost_functions = functions.join(known, "asset_path", "left_anti")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sample = lost.select("asset_path").distinct().orderBy("asset_path").limit(8).agg(F.array_sort(F.collect_list("asset_path")).alias("sample"))
    row = count(assets, "n_assets").crossJoin(count(references, "n_references")).crossJoin(count(lost, "n_orphan_references")).crossJoin(count(lost_functions, "n_orphan_functions")).crossJoin(sample)
    issues = F.array_compact(F.array(
        F.when(F.col("n_assets") == 0, "no assets indexed"),
        F.when(F.col("n_orphan_references") > 0, "references without an asset"),
        F.when(F.col("n_orphan_functions") > 0, "functions without an asset"),
    ))
    return row.withColumn("issues", issues)
