"""Symbol usages in lines of source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def usage_lines(lines: DataFrame, key: str, symbol: str) -> DataFrame:
    """(key, line_number, column, usage, qualifier, operator) of the first whole-word occurrence in each line.

    Occurrences in comments or quotes are dropped. The plain ``contains`` comes first and is cheap.
    """
    rows = lines.filter(F.col("line_text").contains(symbol)).withColumn("column", S.whole_word_column("line_text", symbol)).filter("column > 0")
    rows = rows.filter(S.is_code_occurrence("line_text", F.col("column")))
    identifier, operator = S.qualifier_before("line_text", F.col("column"))
    return rows.select(key, "line_number", "column", S.classify_usage("line_text", F.col("column"), symbol).alias("usage"), identifier.alias("qualifier"), operator.alias("operator"))


def candidate_files(definitions: DataFrame, calls: DataFrame, includers: DataFrame, current: DataFrame, most: int = 2000) -> DataFrame:
    """Files worth looking into: the union of four sources of file ids, the least ids first."""
    every = definitions.select("file_id").union(calls.select("file_id")).union(includers.select("file_id")).union(current.select("file_id"))
    return every.distinct().orderBy("file_id").limit(most)


def names_type(symbols: DataFrame, symbol: str) -> bool:
    """Whether some class-like symbol has this name."""
    return not symbols.filter(F.col("is_class_like") & (F.col("name") == symbol)).limit(1).isEmpty()


def names_function(symbols: DataFrame, symbol: str, owner: str | None = None) -> bool:
    """Whether some function-like symbol has this name, of that owner if one is given."""
    rows = symbols.filter(F.col("is_function_like") & (F.col("name") == symbol))
    return not (rows if owner is None else rows.filter(F.col("owner_name") == owner)).limit(1).isEmpty()


def candidate_paths(symbol: str, symbols: DataFrame, calls: DataFrame, includes: DataFrame, owner: str | None = None, current: str | None = None, most: int | None = 2000) -> DataFrame:
    """(path): files in which a symbol can be used, without ``most`` all of them.

    Of a member (with its owner) those that define it, those that include these, and the current file. Of
    any other symbol also those that call it. ``includes(src, dst)`` are paths; the least paths come first.
    """
    rows = symbols.filter(F.col("name") == symbol)
    defined = (rows if owner is None else rows.filter(F.col("owner_name") == owner)).select("path").distinct()
    found = defined.union(includes.join(defined, F.col("dst") == F.col("path"), "left_semi").select("src"))
    if owner is None and not names_type(symbols, symbol):
        found = found.union(calls.filter(S.lower_ascii("name") == S.lower_ascii_text(symbol)).select("path"))
    if current is not None:
        found = found.union(symbols.sparkSession.createDataFrame([(current,)], "path string"))
    found = found.distinct()
    return found if most is None else found.orderBy("path").limit(most)


def direct_calls(calls: DataFrame, symbol: str, limit: int | None, within: DataFrame | None = None) -> DataFrame:
    """The first call sites of a name by path and line, eight times as many as wanted, and of these the ones ``within`` files.

    Without a limit all call sites count.
    """
    rows = calls.filter(S.lower_ascii("name") == S.lower_ascii_text(symbol))
    if limit is not None:
        rows = rows.orderBy(S.lower_ascii("path"), "line_number", "path").limit(min(max(limit, 8 * limit), 4096))
    return rows if within is None else rows.join(within.select("path").distinct(), "path", "left_semi")


def scoped_usages(symbol: str, symbols: DataFrame, overrides: DataFrame, calls: DataFrame, includes: DataFrame, lines: DataFrame, owner: str | None = None, current: str | None = None, local: tuple[int, int] | None = None, most: int | None = 300) -> DataFrame:
    """Usages of a symbol in its scope, each place once, up to ``most``; without it all, from all candidate files and calls.

    A local symbol is looked for in lines ``local`` of the current file alone. A member's declarations are
    those of its owner, and calls and lines count in its candidate files only. Function-like symbols are not
    looked for in lines. ``overrides(path, line_number)``.
    """
    if local is not None:
        here = lines.filter((F.col("path") == current) & F.col("line_number").between(*local))
        found = usage_lines(here, "path", symbol).select("path", F.col("line_number").cast("long").alias("line_number"), "usage").orderBy("path", "line_number")
        return found if most is None else found.limit(most)
    candidates = candidate_paths(symbol, symbols, calls, includes, owner, current, None if most is None else 2000)
    function_like = names_function(symbols, symbol, owner)
    rows = symbols.filter(F.col("name") == symbol)
    declared = (rows if owner is None else rows.filter(F.col("owner_name") == owner)).select("path", "line_number", F.lit("declaration").alias("usage"))
    over = overrides.select("path", "line_number", F.lit("override").alias("usage"))
    called = direct_calls(calls, symbol, most, candidates if owner is not None else None).select("path", "line_number", F.lit("call").alias("usage"))
    inside = lines if function_like else lines.join(candidates, "path", "left_semi")
    return find_usages(symbol, declared, over if function_like else over.limit(0), called, inside, function_like, most)


def find_usages(symbol: str, declarations: DataFrame, overrides: DataFrame, calls: DataFrame, lines: DataFrame, function_like: bool, most: int | None = 300) -> DataFrame:
    """Declarations, overrides, direct calls, then lines of text (not for function-like symbols), each place once.

    All inputs have (path, line_number, usage); the earlier kind of a place counts.
    """
    from .search import priority_merge

    buckets = [x.select("path", F.col("line_number").cast("long").alias("line_number"), "usage") for x in (declarations, overrides, calls)]
    if not function_like:
        buckets.append(usage_lines(lines, "path", symbol).select("path", F.col("line_number").cast("long").alias("line_number"), "usage"))
    return priority_merge(buckets, ["path", "line_number"], [F.col("path"), F.col("line_number")], most)
