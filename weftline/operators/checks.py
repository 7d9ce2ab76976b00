"""Checks across files, and the reductions that finish a list of diagnostics."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def conflicting_definitions(rows: DataFrame, group: list[str], differ: str, place: str) -> DataFrame:
    """Every member of the groups in which ``differ`` has several values, with the sorted places of the group joined."""
    found = rows.groupBy(*group).agg(F.count_distinct(differ).alias("__n"), F.array_join(F.array_sort(F.collect_set(F.col(place).cast("string"))), ", ").alias("locations"))
    return rows.join(found.filter("__n > 1").drop("__n"), group)


def class_conflicts(rows: DataFrame, name: str, fingerprint: str) -> DataFrame:
    """(name, n_rows, n_fingerprints) of names with several rows and several fingerprints."""
    found = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(fingerprint).alias("n_fingerprints"))
    return found.filter("n_rows > 1 and n_fingerprints > 1")


def name_clashes(rows: DataFrame, name: str, kind: str) -> DataFrame:
    """(name, kinds) of names used for several kinds, kinds sorted and joined."""
    found = rows.groupBy(name).agg(F.array_sort(F.collect_set(kind)).alias("__k"))
    return found.filter(F.size("__k") > 1).select(name, F.array_join("__k", ", ").alias("kinds"))


def missing_definitions(declared: DataFrame, defined: DataFrame, signature: list[str]) -> DataFrame:
    return declared.join(defined.select(*signature).distinct(), signature, "left_anti")


def keep_most_severe(rows: DataFrame, key: list[Column], severity: Column, order: list[Column]) -> DataFrame:
    """Of each key the row of the highest severity; of equal ones the earlier."""
    names = [f"__k{i}" for i in range(len(key))]
    for n, c in zip(names, key, strict=True):
        rows = rows.withColumn(n, c)
    w = Window.partitionBy(*names).orderBy(severity.desc(), *order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", *names)


def cap_per_group(rows: DataFrame, group: list[str], order: list[Column], most: int, rank: str | None = None) -> DataFrame:
    """The first ``most`` rows of each group. Spark drops the surplus of every task before it shuffles."""
    out = rows.withColumn(rank or "__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank or "__rank") <= most)
    return out if rank else out.drop("__rank")


def cap_per_file(rows: DataFrame, file: str, order: list[Column], most: int, message: str = "message") -> DataFrame:
    """The first ``most`` rows of each file, and one row that tells how many were omitted where there were more."""
    kept = cap_per_group(rows, [file], order, most)
    over = rows.groupBy(file).agg((F.count(F.lit(1)) - most).alias("__over")).filter("__over > 0")
    told = over.select(file, F.concat(F.col("__over").cast("string"), F.lit(" omitted")).alias(message))
    return kept.unionByName(told, allowMissingColumns=True)


def finalize_diagnostics(rows: DataFrame, per_line: int = 3, per_file: int = 200, window: int = 4) -> DataFrame:
    """Diagnostics (file_path, line, character, severity, code, message, input_order): deduplicated, then capped by line and file."""
    once = keep_most_severe(rows, [F.col("file_path"), F.col("line"), S.dedupe_bucket("character", window), F.col("code")], S.severity_rank("severity"), [F.col("input_order")])
    by_line = cap_per_group(once, ["file_path", "line"], [S.severity_rank("severity").desc(), F.col("input_order")], per_line)
    return cap_per_file(by_line, "file_path", [F.col("line"), F.col("character"), F.col("input_order")], per_file)


def pick_definition(rows: DataFrame, name: str, path: str, line: str) -> DataFrame:
    """One definition a name: generated files last, headers by extension, then line."""
    rank = F.when(S.extension(path) == "h", 0).when(S.extension(path).isin("hpp", "hh"), 1).when(S.extension(path) == "inl", 2).otherwise(3)
    return cap_per_group(rows, [name], [S.lower_ascii(path).contains(".generated.").cast("int"), rank, F.col(line), F.col(path)], 1)


def latency_stats(rows: DataFrame, ts: str, label: str, millis: Column, failed: Column, width: str = "2 seconds") -> DataFrame:
    """(window_start, label, n, avg_ms (whole), max_ms, errors) in aligned windows of event time."""
    found = rows.groupBy(F.window(ts, width).alias("w"), label).agg(F.count(F.lit(1)).alias("n"), F.sum(millis).alias("__sum"), F.max(millis).alias("max_ms"), F.count_if(failed).alias("errors"))
    return found.select(F.col("w.start").alias("window_start"), label, "n", F.floor(F.col("__sum") / F.col("n")).alias("avg_ms"), "max_ms", "errors")


def top_groups(rows: DataFrame, key: str, most: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(key)).limit(most)


def plugin_audit(symbols: DataFrame, on_disk: DataFrame, limit: int = 20) -> DataFrame:
    """One row about plugins: symbol counts, plugins known and on disk, the differences and the largest plugins.

    ``symbols(path)``, ``on_disk(plugin)``. A plugin is the path between ``/Engine/Plugins/`` and its
    ``Source`` folder.
    """
    plugin = F.regexp_extract(S.normalize_path("path"), "/Engine/Plugins/(.+?)/Source/", 1)
    rows = symbols.select(F.col("path"), F.nullif(plugin, F.lit("")).alias("plugin"))
    known, disk = rows.select("plugin").filter("plugin is not null").distinct(), on_disk.select("plugin").distinct()
    first = lambda df, name: df.orderBy("plugin").limit(limit).agg(F.array_sort(F.collect_list("plugin")).alias(name))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    missing, extra = disk.subtract(known), known.subtract(disk)
    largest = top_groups(rows.filter("plugin is not null"), "plugin", limit)
    top = largest.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "plugin"))).alias("t")).select(F.transform("t", lambda x: F.concat_ws(":", x["plugin"], (-x["minus_n"]).cast("string"))).alias("top_plugins"))
    out = rows.agg(F.count(F.lit(1)).alias("n_symbols"), F.count("plugin").alias("n_plugin_symbols"))
    for part in (count(known, "n_known"), count(disk, "n_on_disk"), count(missing, "n_missing"), count(extra, "n_extra"), first(missing, "missing_sample"), first(extra, "extra_sample"), top):
        out = out.crossJoin(part)
    return out


# Match qualities that count as high.
HIGH_QUALITIES = ("exact_symbol", "prefix_symbol", "normalized_symbol")


def result_stats(rows: DataFrame, path: str, quality: str) -> DataFrame:
    """One row: n, paths (distinct, case folded) and high_quality (rows of HIGH_QUALITIES)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(S.lower_ascii(path)).alias("paths"), F.count_if(F.col(quality).isin(*HIGH_QUALITIES)).alias("high_quality"))


# The rules that hold where a rule file says nothing, by section.
DEFAULT_RULES = {
    "finalize": {"max_per_file": 200, "max_per_line": 3, "dedupe_window_cols": 4, "suppress_tail_lines": 0},
    "linker": {
        "enabled": True, "check_odr_function": True, "odr_function_severity": "error", "check_odr_class": True, "odr_class_severity": "error",
        "check_missing_def": False, "missing_def_severity": "warning", "check_name_clash": True, "name_clash_severity": "error",
    },
}


def read_rules(text: str) -> dict[str, dict]:
    """The sections of a rule file (TOML) over DEFAULT_RULES; sections and keys that it adds are kept."""
    said = tomllib.loads(text)
    return {name: {**DEFAULT_RULES.get(name, {}), **said.get(name, {})} for name in [*DEFAULT_RULES, *(n for n in said if n not in DEFAULT_RULES)]}


def by_rules(findings: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """``findings(check, ...)`` of the linker's checks that the rules turn on, with their ``severity``."""
    linker = rules["linker"]
    on = {name: linker[f"{name}_severity"] for name in ("odr_function", "odr_class", "missing_def", "name_clash") if linker.get("enabled", True) and linker.get(f"check_{name}", False)}
    if not on:
        return findings.limit(0).withColumn("severity", F.lit(""))
    severity = F.create_map(*[F.lit(x) for pair in on.items() for x in pair])
    return findings.withColumn("severity", F.try_element_at(severity, "check")).filter("severity is not null")
