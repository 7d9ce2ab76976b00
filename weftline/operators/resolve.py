"""Joins that resolve names, paths and snapshots, each as equality joins that Spark can hash or sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(key, status): ``new``, ``deleted``, ``changed`` where the versions differ, else ``unchanged``."""
    o = old.select(F.col(key).alias("__k"), F.col(version).alias("__ov"), F.lit(1).alias("__o"))
    n = new.select(F.col(key).alias("__j"), F.col(version).alias("__nv"), F.lit(1).alias("__n"))
    status = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "deleted").when(F.col("__ov").eqNullSafe(F.col("__nv")), "unchanged").otherwise("changed")
    return o.join(n, F.col("__k") == F.col("__j"), "full_outer").select(F.coalesce("__k", "__j").alias(key), status.alias("status"))


def missing_on_disk(known: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return known.join(present.select(key).distinct(), key, "left_anti")


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame, root: str, value: str, fold_case: bool = True, fallback=None) -> DataFrame:
    """Add ``value`` of the longest root that begins a row's path, whatever follows it; ``fallback`` or null without one.

    Paths are cut to the lengths that roots have, so the join is on equality. Of equal roots the least
    value counts. The lengths of roots, a handful of numbers, are the only thing the driver sees.
    """
    fold = S.lower_ascii if fold_case else (lambda c: c)
    r = roots.groupBy(fold(F.col(root)).alias("__root")).agg(F.min(value).alias("__value")).withColumn("__len", F.length("__root"))
    lengths = F.array(*[F.lit(x["__len"]) for x in r.select("__len").distinct().orderBy("__len").collect()]).cast("array<int>")
    paths = rows.select(fold(F.col(path)).alias("__path")).distinct()
    cut = paths.select("__path", F.explode(F.filter(lengths, lambda n: n <= F.length("__path"))).alias("__n"))
    hits = cut.withColumn("__root", F.substring(F.col("__path"), F.lit(1), F.col("__n"))).join(r, "__root")
    best = hits.groupBy("__path").agg(F.max_by("__value", "__n").alias(value))
    out = rows.join(best, fold(F.col(path)) == F.col("__path"), "left").drop("__path")
    return out if fallback is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(fallback)))


def resolve_first(rows: DataFrame, name: str, targets: DataFrame, target_name: str, target_id: str, out: str) -> DataFrame:
    """Add ``out``: the least id among the targets of that name, null without one."""
    first = targets.groupBy(F.col(target_name).alias("__name")).agg(F.min(target_id).alias(out))
    return rows.join(first, F.col(name) == F.col("__name"), "left").drop("__name")


def resolve_iff_unique(rows: DataFrame, name: str, targets: DataFrame, target_name: str, target_id: str, out: str) -> DataFrame:
    """Add ``out``: the id of the only target of that name, null if there are none or several."""
    only = targets.groupBy(F.col(target_name).alias("__name")).agg(F.count(F.lit(1)).alias("__n"), F.min(target_id).alias(out)).filter("__n = 1").drop("__n")
    return rows.join(only, F.col(name) == F.col("__name"), "left").drop("__name")


def either_key(rows: DataFrame, seeds: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that equal a seed in any of the column pairs (row column, seed column); one join a pair, then distinct."""
    found = None
    for mine, theirs in pairs:
        got = rows.join(seeds.select(F.col(theirs).alias("__s")).filter("__s is not null").distinct(), F.col(mine) == F.col("__s"), "left_semi")
        found = got if found is None else found.unionByName(got)
    return found.distinct()


def with_order(rows: DataFrame, candidates: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the candidates, with the order that the candidates carry."""
    return rows.join(candidates.select(key, order), key)


def lookup_by_suffix(rows: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """Rows whose key equals a name or ends in ``.name`` or ``:name``; the suffixes are spelled out once and joined."""
    spelled = rows.withColumn("__suffix", F.explode(S.suffix_keys(key)))
    return spelled.join(names.select(F.col(name).alias("__suffix"), F.col(name).alias("looked_up")).distinct(), "__suffix").drop("__suffix")


def include_fallback(unresolved: DataFrame, files: DataFrame) -> DataFrame:
    """All files of an unresolved include's base name: (file_id, include_path, target_id, rank), same module first.

    ``unresolved(file_id, include_path, base_filename, module_id)``, ``files(target_id, basename, target_module, path)``.
    """
    hits = unresolved.join(files, F.col("base_filename") == F.col("basename"))
    same = F.col("module_id").eqNullSafe(F.col("target_module"))
    order = Window.partitionBy("file_id", "include_path").orderBy(same.desc(), "path", "target_id")
    return hits.withColumn("rank", F.row_number().over(order)).select("file_id", "include_path", "target_id", "rank")


def include_target(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For each include path the file it most likely means: same path, then shortest path that ends in it.

    ``wanted(include_path)``, ``files(target_id, path)``. A path that ends in the include has its base name.
    """
    w = wanted.select("include_path", S.basename("include_path").alias("__b"))
    hits = w.join(files.withColumn("__b", S.basename("path")), "__b")
    exact = F.col("path") == F.col("include_path")
    suffix = F.col("path").endswith(F.concat(F.lit("/"), F.col("include_path")))
    order = Window.partitionBy("include_path").orderBy(exact.desc(), suffix.desc(), F.length("path"), "path", "target_id")
    return hits.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select("include_path", "target_id", "path")


def federated(project: DataFrame, engine: DataFrame, identity: list[str], order: list[Column], limit: int) -> DataFrame:
    """Project rows, then engine rows, without repeating an identity, up to ``limit``."""
    both = project.withColumn("source_rank", F.lit(0)).unionByName(engine.withColumn("source_rank", F.lit(1)))
    once = both.withColumn("__r", F.row_number().over(Window.partitionBy(*identity).orderBy("source_rank", *order))).filter("__r = 1").drop("__r")
    return once.orderBy("source_rank", *order).limit(limit)


def engine_skip_reason(hits: int, paths: int, found_definition: bool, cursor_in_project: bool, scope: str, symbol_strong: bool, type_like: bool, identifier: bool, text_like: bool) -> str | None:
    """Why references need not be looked for in the engine's index too, given what the project's has; None if they must."""
    if scope in ("local", "member"):
        return "scope_local"
    if not cursor_in_project or hits == 0:
        return None
    rules = [
        ("project_definition_dense", found_definition and hits >= 24),
        ("unreal_type_project_hits", symbol_strong and type_like and hits >= 4 and paths >= 2),
        ("sym_strong_project_hits", symbol_strong and hits >= 8),
        ("identifier_project_hits", identifier and not text_like and hits >= 16),
        ("project_hits_dense", hits >= 40 or paths >= 8),
    ]
    return next((name for name, holds in rules if holds), None)


def federated_references(project: DataFrame, engine: Callable[[], DataFrame], identity: list[str], order: list[Column], limit: int, skip: Callable[[int, int], str | None]) -> DataFrame:
    """The project's references and, unless ``skip(hits, paths)`` gives a reason against it, the engine's after them.

    Both have a ``path``. The driver sees two counts; the engine's plan is not made where it is skipped.
    """
    stats = project.agg(F.count(F.lit(1)).alias("hits"), F.count_distinct(S.lower_ascii("path")).alias("paths")).first()
    if skip(stats["hits"], stats["paths"]):
        return project.withColumn("source_rank", F.lit(0)).orderBy(*order).limit(limit)
    return federated(project, engine(), identity, order, limit)


def nearest_preceding(rows: DataFrame, key: list[str], order: list[Column], is_mark: Column, is_cursor: Column, values: list[str], prefix: str = "near_") -> DataFrame:
    """For every cursor row the values of the last mark before or at it, by one window over the key."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(is_mark, F.struct(*values))
    out = rows.withColumn("__mark", F.last(mark, True).over(w)).filter(is_cursor)
    for v in values:
        out = out.withColumn(prefix + v, F.col("__mark")[v])
    return out.drop("__mark")


def enclosing_range(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, label: str, bucket: int) -> DataFrame:
    """For each point the range that holds it and starts first; ranges are spread over buckets of the line, so the join is on equality.

    A range lands in as many buckets as it spans; choose ``bucket`` near a usual range's length.
    """
    spread = ranges.select(F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(label).alias("__l"), F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("__b"))
    hit = points.withColumn("__b", F.floor(F.col(point) / bucket)).join(spread, "__b").filter(F.col(point).between(F.col("__s"), F.col("__e")))
    first = hit.groupBy(*points.columns).agg(F.min(F.struct("__s", "__e", "__l")).alias("__m"))
    return first.select(*points.columns, F.col("__m.__l").alias(label), F.col("__m.__s").alias(start), F.col("__m.__e").alias(end))


def brace_ranges(rows: DataFrame, key: str) -> DataFrame:
    """(key, name, start, end) of blocks named by the line that opens them at depth 0; an open one runs to the last line.

    ``rows(key, line_number, line_text)``. Depth is a running sum of braces per key.
    """
    opens = F.length("line_text") - F.length(F.replace(F.col("line_text"), F.lit("{"), F.lit("")))
    closes = F.length("line_text") - F.length(F.replace(F.col("line_text"), F.lit("}"), F.lit("")))
    by_line = Window.partitionBy(key).orderBy("line_number")
    run = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = rows.withColumn("__after", F.sum(opens - closes).over(run)).withColumn("__before", F.col("__after") - (opens - closes))
    r = r.withColumn("__start", F.when((F.col("__before") <= 0) & (opens > 0), F.col("line_number")))
    r = r.withColumn("__block", F.last("__start", True).over(run)).filter("__block is not null and (__before > 0 or __start is not null)")
    return r.groupBy(key, F.col("__block").alias("start")).agg(F.min_by(F.trim(F.regexp_replace("line_text", r"\{.*$", "")), "line_number").alias("name"), F.max("line_number").alias("end")).select(key, "name", "start", "end")
