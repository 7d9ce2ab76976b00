"""Graphs: hierarchy paths, closures and breadth-first ranks.

Without seeds a closure doubles the length of its paths each step, so the number of steps grows with the
logarithm of the depth. From seeds it advances a frontier. Steps are written to the folder that driver and
executors share, as their lineage would otherwise grow with depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise

#: walks from at least one in so many nodes are cut out of those from everywhere
MANY_SEEDS = 8


def hierarchy_paths(spark: SparkSession, nodes: DataFrame, separator: str = "/") -> DataFrame:
    """(id, full_path, depth) of ``nodes(id, parent_id, name)`` that hang below a root (a null parent), of any depth.

    Every step puts a node's path behind that of the node it hangs from, which doubles the paths. Nodes
    below a missing parent or on a cycle have no root and are left out.
    """
    state = nodes.select("id", F.col("parent_id").alias("above"), F.col("name").cast("string").alias("full_path"), F.lit(0).alias("depth"))
    state, steps = materialise(state, "paths"), 0
    count = state.count()
    while True:
        waiting = state.filter("above is not null")
        if waiting.isEmpty() or 1 << steps > 2 * count:
            return state.filter("above is null").select("id", "full_path", "depth")
        up = state.select(F.col("id").alias("__id"), F.col("above").alias("__above"), F.col("full_path").alias("__path"), F.col("depth").alias("__depth"))
        moved = waiting.join(up, F.col("above") == F.col("__id")).select("id", F.col("__above").alias("above"), F.concat("__path", F.lit(separator), "full_path").alias("full_path"), (F.col("depth") + F.col("__depth") + 1).alias("depth"))
        state, steps = materialise(state.filter("above is null").unionByName(moved), "paths"), steps + 1


def closure(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): every node reachable over at least one edge, with the least number of edges.

    ``edges(src, dst)`` may have cycles and null targets (ignored); a node on a cycle reaches itself.
    ``seeds(src)`` limits where walks begin; without it they begin everywhere.
    """
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    if seeds is None:
        return _from_everywhere(e, max_depth)
    e = materialise(e, "edges")
    begin = materialise(e.select("src").distinct().join(seeds.select("src").distinct(), "src", "left_semi"), "seeds")
    if begin.count() * MANY_SEEDS < e.select("src").distinct().count():
        return _from_seeds(e, begin, max_depth)
    return _from_everywhere(e, max_depth).join(begin, "src", "left_semi")


def _from_everywhere(e: DataFrame, max_depth: int | None) -> DataFrame:
    """Pairs of up to 2, 4, 8, ... edges: a shortest path of d < n <= 2d edges is one of d and one of at most d."""
    parts, reach = [materialise(e.withColumn("depth", F.lit(1)), "closure")], 1
    while max_depth is None or reach < max_depth:
        far = parts[-1].filter(F.col("depth") == reach)
        if far.isEmpty():
            break
        found = reduce(DataFrame.unionByName, parts)
        on = found.select(F.col("src").alias("__from"), F.col("dst").alias("__to"), F.col("depth").alias("__more"))
        if max_depth is not None:
            on = on.filter(F.col("__more") <= max_depth - reach)
        reached = far.join(on, F.col("dst") == F.col("__from")).groupBy("src", F.col("__to").alias("dst")).agg((F.min("__more") + reach).alias("depth"))
        parts.append(materialise(reached.join(found.select("src", "dst"), ["src", "dst"], "left_anti"), "closure"))
        reach *= 2
    return reduce(DataFrame.unionByName, parts)


def _from_seeds(e: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    step = e.select(F.col("src").alias("__from"), F.col("dst").alias("__to"))
    first = e.join(seeds, "src", "left_semi").withColumn("depth", F.lit(1))
    parts, depth = [materialise(first, "closure")], 1
    while (max_depth is None or depth < max_depth) and not parts[-1].isEmpty():
        depth += 1
        found = reduce(DataFrame.unionByName, parts)
        reached = parts[-1].join(step, F.col("dst") == F.col("__from")).select("src", F.col("__to").alias("dst")).distinct()
        parts.append(materialise(reached.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "closure"))
        if len(parts) > 32:  # keep the union short on deep graphs
            parts = [materialise(reduce(DataFrame.unionByName, parts[:-1]), "closure"), parts[-1]]
    return reduce(DataFrame.unionByName, parts)


def depend_files(edges: DataFrame, start: DataFrame, recursive: bool = True) -> DataFrame:
    """Targets that the start files include, directly or through others; a start file on a cycle is among them."""
    return closure(edges, start, None if recursive else 1).select("dst").distinct()


def ancestors(edges: DataFrame, child: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth) from each child up; ``edges(src=child, dst=parent)``."""
    return closure(edges, child, max_depth)


def is_descendant(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(child, parent)`` with ``is_descendant``."""
    reach = closure(edges, pairs.select(F.col("child").alias("src"))).select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.lit(True).alias("is_descendant"))
    return pairs.join(reach, ["child", "parent"], "left").withColumn("is_descendant", F.coalesce("is_descendant", F.lit(False)))


def inherited_members(edges: DataFrame, seeds: DataFrame, members: DataFrame, name: str = "name", limit: int | None = None) -> DataFrame:
    """Members of each seed class and its ancestors with ``class_rank`` (0 own); of one name the nearest class's.

    ``members(class_id, name, member_id)``.
    """
    from pyspark.sql import Window

    up = closure(edges, seeds).select("src", "dst", F.col("depth").alias("class_rank"))
    own = seeds.select("src", F.col("src").alias("dst"), F.lit(0).alias("class_rank"))
    rows = own.unionByName(up).join(members, F.col("dst") == F.col("class_id"))
    first = Window.partitionBy("src", name).orderBy("class_rank", "class_id", "member_id")
    rows = rows.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r", "dst")
    if limit is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("src").orderBy("class_rank", name, "member_id"))).filter(F.col("__n") <= limit).drop("__n")
    return rows


def first_in_chain(edges: DataFrame, seeds: DataFrame, members: DataFrame, symbol: str) -> DataFrame:
    """The member of that name nearest to each seed class up the inheritance graph."""
    return inherited_members(edges, seeds, members.filter(F.col("name") == symbol))


def descendants(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src=root, dst=descendant, depth) over reversed edges."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots, max_depth)


def overrides(edges: DataFrame, roots: DataFrame, members: DataFrame, symbol: str) -> DataFrame:
    """Members of that name in the descendants of the roots."""
    below = descendants(edges, roots).select(F.col("dst").alias("class_id"), "depth")
    return members.filter(F.col("name") == symbol).join(below, "class_id")


def reachable_with_fallback(includes: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst, depth) from each root over includes, those without a target standing for all files of their base name.

    ``includes(file_id, resolved_file_id, include_path, base_filename, module_id)``, ``files(target_id, basename,
    target_module, path)``, ``roots(src)``; a root reaches itself at depth 0.
    """
    from .resolve import include_fallback

    known = includes.filter("resolved_file_id is not null").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst"))
    guessed = include_fallback(includes.filter("resolved_file_id is null"), files).select(F.col("file_id").alias("src"), F.col("target_id").alias("dst"))
    reach = closure(known.unionByName(guessed), roots).filter("src <> dst")
    return roots.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth")).distinct().unionByName(reach)


def reverse_edges(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that point at the targets (who includes X)."""
    return edges.join(targets.select("dst").distinct(), "dst", "left_semi")


def module_closure(dependencies: DataFrame) -> DataFrame:
    """(module, dependencies): the sorted transitive dependencies of each module; the module itself is left out."""
    reach = closure(dependencies).filter("src <> dst")
    return reach.groupBy(F.col("src").alias("module")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))


def alias_target(aliases: DataFrame, names: DataFrame, max_depth: int = 4) -> DataFrame:
    """(name, target): what each name finally stands for after at most ``max_depth`` alias steps.

    ``aliases(alias, target)``; of several targets the least counts.
    """
    a = aliases.groupBy("alias").agg(F.min("target").alias("__t"))
    out = names.select("name", F.col("name").alias("target"))
    for _ in range(max_depth):
        out = out.join(a, F.col("target") == F.col("alias"), "left").select("name", F.coalesce("__t", "target").alias("target"))
    return out


def outer_paths(spark: SparkSession, objects: DataFrame, max_depth: int = 32) -> DataFrame:
    """(id, full_path) of package objects ``(id, parent_id, name)`` by their chain of outers, no deeper than ``max_depth``."""
    return hierarchy_paths(spark, objects, ".").filter(F.col("depth") <= max_depth).select("id", "full_path")
