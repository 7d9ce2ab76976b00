"""Ranked search over the symbol, file and line projections. Every ranking ends in a total order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def query_profile(pattern: str) -> dict[str, bool]:
    """Flags of a literal pattern: short, path-like, literal code, text-like, type-like, strong symbol."""
    p = pattern.strip()
    word = p.replace("_", "").replace(":", "").isalnum() and p[:1].isascii() and not p[:1].isdigit()
    return {
        "short": len(p) < 4,
        "path_like": "/" in p or "\\" in p or p.lower().endswith((".h", ".cpp", ".cs", ".ini")),
        "literal_code": any(c in p for c in "(){};=<>\"'") or "->" in p,
        "text_like": " " in p and not any(c in p for c in "(){};="),
        "looks_like_type": len(p) > 2 and p[0] in "AUFEIT" and p[1:2].isupper(),
        "symbol_strong": word and len(p) >= 4,
    }


def search_terms(pattern: str) -> list[str]:
    """An identifier is one compact term; otherwise the white-space separated terms of three letters or more."""
    import re

    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_:]*", pattern):
        return [re.sub("[^a-z0-9]", "", pattern.lower())]
    return [t.lower() for t in pattern.split() if len(t) >= 3]


def priority_merge(buckets: list[DataFrame], identity: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """Buckets one after the other, each in order; an identity stays where it comes first. Adds bucket and position."""
    tagged = [b.withColumn("bucket", F.lit(i)) for i, b in enumerate(buckets)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    once = every.withColumn("__r", F.row_number().over(Window.partitionBy(*identity).orderBy("bucket", *order))).filter("__r = 1").drop("__r")
    out = once.orderBy("bucket", *order)
    return out if limit is None else out.limit(limit)


SYMBOL_IDENTITY = ["kind", "path", "line_number", "name"]


def _symbol_order() -> list[Column]:
    return [F.col("kind_rank"), F.length("name"), F.col("name_lc"), F.col("symbol_id")]


def with_limit(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 10_000) -> DataFrame:
    """Ordered page; limit is held between 1 and ``most``, offset between 0 and a million."""
    return df.orderBy(*order).offset(min(max(offset, 0), 1_000_000)).limit(min(max(limit, 1), most))


def bucketed_symbols(symbols: DataFrame, pattern: str, limit: int, class_only: bool = False) -> DataFrame:
    """Exact, then prefix, then substring matches of the name; each bucket by kind, length and name.

    A qualified pattern also asks for the owner.
    """
    owner, _, name = pattern.rpartition("::")
    low = name.lower()
    compact = "".join(c for c in low if c.isascii() and c.isalnum())
    rows = symbols.filter("is_class_like") if class_only else symbols
    if owner:
        rows = rows.filter(F.coalesce("owner_name_lc", F.lit("")) == owner.lower())
    hit = F.when(F.col("name_lc") == low, 0).when(F.col("name_lc").startswith(low), 1).when(F.col("name_lc").contains(low) | (F.lit(bool(compact)) & F.col("compact_name").contains(compact)), 2)
    return with_limit(_once(rows.withColumn("bucket", hit).filter("bucket is not null")), [F.col("bucket"), *_symbol_order()], limit)


def _once(rows: DataFrame) -> DataFrame:
    """One row of each identity, the best one."""
    w = Window.partitionBy(*SYMBOL_IDENTITY).orderBy("bucket", *_symbol_order())
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def bucketed_files(files: DataFrame, pattern: str, limit: int) -> DataFrame:
    """Exact base name, then prefix, then substring of base name or path; assets are left out."""
    low = pattern.lower()
    rows = files.filter(~F.coalesce("ext", F.lit("")).isin("uasset", "umap"))
    hit = F.when(F.col("basename_lc") == low, 0).when(F.col("basename_lc").startswith(low), 1).when(F.col("basename_lc").contains(low), 2).when(F.col("path_lc").contains(low), 3)
    return with_limit(rows.withColumn("bucket", hit).filter("bucket is not null"), [F.col("bucket"), F.length("path"), F.col("path"), F.col("file_id")], limit)


def fuzzy_tokens(symbols: DataFrame, pattern: str, limit: int = 256) -> DataFrame:
    """Every token must match: its compact form in the name's, its first five letters beginning the name, or in the owner."""
    rows = symbols
    for t in search_terms(pattern) if " " in pattern else [x for x in [pattern.lower()] if x]:
        c = "".join(ch for ch in t if ch.isascii() and ch.isalnum())
        rows = rows.filter(F.col("compact_name").contains(c) | F.col("compact_name").startswith(c[:5]) | F.coalesce("owner_name_lc", F.lit("")).contains(t))
    return with_limit(rows, _symbol_order(), limit)


def fuzzy_files(files: DataFrame, pattern: str, limit: int = 200) -> DataFrame:
    """Files in whose base name or path every white-space separated part of the pattern occurs; assets are left out."""
    tokens = S.lower_ascii_text(pattern).split()
    if not tokens:
        return files.limit(0)
    rows = files.filter(~S.lower_ascii(F.coalesce("ext", F.lit(""))).isin("uasset", "umap"))
    for t in tokens:
        rows = rows.filter(F.col("basename_lc").contains(t) | F.col("path_lc").contains(t))
    return with_limit(rows, [F.length("basename_lc"), F.col("basename_lc"), F.col("path_lc"), F.col("file_id")], limit, most=1000)


def escalated(buckets: list[Callable[[], DataFrame]], identity: list[str], order: list[Column], limit: int) -> DataFrame:
    """``priority_merge`` of the first buckets that fill a page; a later one is not even planned before it is needed.

    Each bucket yields ``limit`` rows at most, so what is counted between two of them is a page.
    """
    taken: list[DataFrame] = []
    for bucket in buckets:
        taken.append(bucket().orderBy(*order).limit(limit))
        page = priority_merge(taken, identity, order, limit)
        if page.count() >= limit:
            break
    return page


def suppress_for_exact_type(rows: DataFrame, pattern: str) -> DataFrame:
    """If some class-like row is named exactly so, other class-likes go, and rows of other names too; files stay."""
    low = pattern.lower()
    exact = F.coalesce(F.col("is_class_like"), F.lit(False)) & (F.col("name_lc") == low)
    found = rows.agg(F.max(exact.cast("int")).alias("__exact"))
    return rows.crossJoin(F.broadcast(found)).filter((F.coalesce("__exact", F.lit(0)) == 0) | (F.col("name_lc") == low) | (F.col("kind") == "file")).drop("__exact")


def token_lane(symbols: DataFrame, token: str, exact: bool = True) -> DataFrame:
    """Symbols one of whose identifier tokens is (or begins with) the token."""
    tokens = symbols.withColumn("token", F.explode(S.identifier_tokens("name")))
    hit = F.col("token") == token if exact else F.col("token").startswith(token)
    return tokens.filter(hit).groupBy(*symbols.columns).agg(F.min("token").alias("token"))


def infix_lane(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols whose name holds the query (four letters or more); compact forms count unless ``_`` or ``::`` is in it."""
    low = query.lower()
    if len(low) < 4:
        return symbols.limit(0)
    hit = F.col("name_lc").contains(low)
    if "_" not in low and "::" not in low:
        hit = hit | F.col("compact_name").contains("".join(c for c in low if c.isascii() and c.isalnum()))
    return symbols.filter(hit)


def class_rank(symbols: DataFrame, pattern: str) -> DataFrame:
    """Class-like rows with rank 0 exact, 1 prefix, 2 in the name, 3 owner, 4 module, 5 path."""
    low = pattern.lower()
    rank = (
        F.when(F.col("name_lc") == low, 0).when(F.col("name_lc").startswith(low), 1).when(F.col("name_lc").contains(low), 2)
        .when(F.coalesce("owner_name_lc", F.lit("")).contains(low), 3).when(F.coalesce("module_name_lc", F.lit("")).contains(low), 4).when(F.col("path_lc").contains(low), 5)
    )
    rows = symbols.filter("is_class_like").withColumn("rank", rank).filter("rank is not null")
    w = Window.partitionBy("kind", "name", "path").orderBy("rank", "symbol_id")
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").orderBy("rank", F.length("name"), "name_lc", "symbol_id")


def live_find(symbols: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Rows by match quality, path depth, kind, name, path, line; rows that don't match are dropped; adds backend_rank."""
    rows = symbols.withColumn("quality", S.match_quality(F.col("name"), F.col("owner_name"), F.col("path"), pattern)).filter("quality < 8")
    order = [F.col("quality"), F.size(F.split("path", "/")), F.col("kind_rank"), F.col("name_lc"), F.col("path"), F.col("line_number"), F.col("symbol_id")]
    page = rows.orderBy(*order).limit(limit)
    return page.withColumn("backend_rank", F.row_number().over(Window.orderBy(*order)) - 1)


def complete(names: DataFrame, name: str, prefix: str, limit: int = 80) -> DataFrame:
    """Completion candidates by rank, length and name."""
    rows = names.withColumn("rank", S.completion_match_rank(name, prefix)).filter("rank is not null")
    return rows.orderBy("rank", F.length(name), name).limit(limit)


def complete_includes(files: DataFrame, prefix: str, limit: int = 80) -> DataFrame:
    """Headers as include paths, those that begin with the prefix first, then by length."""
    rows = files.filter(S.is_header(S.extension("path"))).withColumn("insert_path", S.include_insert_path("path"))
    low = prefix.lower()
    rank = F.when(S.lower_ascii("insert_path").startswith(low), 0).when(S.lower_ascii(S.basename("insert_path")).startswith(low), 1).when(S.lower_ascii("insert_path").contains(low), 2)
    return rows.withColumn("rank", rank).filter("rank is not null").orderBy("rank", F.length("insert_path"), "insert_path", "path").limit(limit)


def prefix_lookup(rows: DataFrame, name: str, prefix: str, limit: int = 200) -> DataFrame:
    return rows.filter(F.col(name).startswith(prefix)).orderBy(name).limit(limit)


def _folded(line: Column | str, needle: str) -> tuple[Column, str]:
    """Long needles fold case as Unicode does; those under three bytes fold ASCII only."""
    c = F.col(line) if isinstance(line, str) else line
    if len(needle.encode()) < 3:
        return S.lower_ascii(c), "".join(x.lower() if x.isascii() else x for x in needle)
    return F.lower(c), needle.lower()


def code_text(lines: DataFrame, key: str, needle: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Lines (key, line_number, line_text) that hold the needle, by key and line."""
    folded, n = _folded("line_text", needle)
    rows = lines.filter(folded.contains(n)).orderBy(key, "line_number")
    return rows if limit is None else rows.offset(offset).limit(limit)


def bm25(lines: DataFrame, term: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Lines that hold a term, with a BM25 score over trigrams: smaller is better, as in SQLite's ``bm25``.

    Length is the number of trigrams, frequency the number of places where the term occurs. The totals are
    one aggregate row.
    """
    low, t = F.lower("line_text"), term.lower()
    places = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(low) - len(t) + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(len(t))) == t))
    rows = lines.withColumn("__tf", F.when(low.contains(t), places).otherwise(0)).withColumn("__len", F.greatest(F.length("line_text") - 2, F.lit(0)))
    totals = rows.agg(F.count(F.lit(1)).alias("__n"), F.sum((F.col("__tf") > 0).cast("int")).alias("__df"), F.avg("__len").alias("__avg"))
    hits = rows.filter("__tf > 0").crossJoin(F.broadcast(totals))
    idf = F.greatest(F.log((F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5)), F.lit(1e-6))
    score = -idf * (F.col("__tf") * (k1 + 1)) / (F.col("__tf") + k1 * (1 - b + b * F.col("__len") / F.col("__avg")))
    return hits.withColumn("score", score).drop("__tf", "__len", "__n", "__df", "__avg")


def trigrams(c: Column | str) -> Column:
    """The distinct lower-cased trigrams of a text, for a filter ahead of ``contains``."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))


def path_hits(lines: DataFrame, key: str, needle: str) -> DataFrame:
    """(key, first_line, hits) of the documents that hold the needle."""
    return code_text(lines, key, needle).groupBy(key).agg(F.min("line_number").alias("first_line"), F.count(F.lit(1)).alias("hits"))


def lines_in(lines: DataFrame, key: str, keys: DataFrame, needle: str) -> DataFrame:
    return code_text(lines.join(keys.select(key).distinct(), key, "left_semi"), key, needle)


def budget_scan(rows: DataFrame, key: str, size: Column, most_files: int, most_bytes: int, rows_each: int = 100_000) -> DataFrame:
    """The first rows in key order within a number of files and a sum of sizes (the row that crosses it is read still).

    Only the first ``most_files`` keys can qualify, so the running sum is over that many rows.
    """
    first = rows.withColumn("__size", size).orderBy(key).limit(most_files)
    before = F.coalesce(F.sum("__size").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("bytes_before", before).filter(F.col("bytes_before") < most_bytes).withColumnRenamed("__size", "bytes")


# Files, bytes and matches that the phases of a live text search may take.
PHASE_BUDGETS = {"near": (50, 8 << 20, 10), "project": (200, 32 << 20, 30), "engine": (1000, 64 << 20, 50)}


def phased_scan(files: DataFrame, key: str, size: Column, text: str, needle: str, phases: list[tuple[str, Column, tuple[int, int, int]]], most: int) -> DataFrame:
    """(key, phase, matches): files that hold the needle, phase by phase until ``most`` files are found.

    A phase (name, condition, (files, bytes, results)) scans the first files in key order that its condition
    admits and no earlier phase has read, within its budget. The driver sees one count a phase.
    """
    found, read, left = None, None, most
    for name, condition, (most_files, most_bytes, most_results) in phases:
        if left <= 0:
            break
        rows = files.filter(condition)
        if read is not None:
            rows = rows.join(read, key, "left_anti")
        scanned = budget_scan(rows, key, size, most_files, most_bytes)
        folded, n = _folded(text, needle)
        hits = scanned.filter(folded.contains(n)).withColumn("matches", F.size(F.split(folded, F.lit("\\Q" + n + "\\E"))) - 1)
        hits = hits.orderBy(key).limit(min(most_results, left)).select(key, F.lit(name).alias("phase"), "matches")
        left -= hits.count()
        found = hits if found is None else found.unionByName(hits)
        seen = scanned.select(key)
        read = seen if read is None else read.unionByName(seen)
    return found


def new_rows(page: DataFrame, sent: DataFrame, identity: list[str]) -> DataFrame:
    """Rows of a page that were not sent yet."""
    return page.join(sent.select(*identity).distinct(), identity, "left_anti")


def fast_find(symbols: DataFrame, files: DataFrame, pattern: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Symbols by bucket, then files unless the pattern is an identifier, then fuzzy matches of symbols and files.

    A bucket is looked into only while the page is not full. Exact types suppress others.
    """
    import re

    columns = ["kind", "name", "name_lc", "owner_name", "path", "line_number", "is_class_like", "kind_rank", "symbol_id"]
    rows = bucketed_symbols(symbols, pattern, 500).select(*columns)
    as_rows = lambda found: found.select(F.lit("file").alias("kind"), F.col("basename").alias("name"), F.col("basename_lc").alias("name_lc"), F.lit(None).cast("string").alias("owner_name"), "path", F.lit(0).alias("line_number"), F.lit(False).alias("is_class_like"), F.lit(3).alias("kind_rank"), F.col("file_id").alias("symbol_id"))
    buckets = [lambda: rows]
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_:]*", pattern):
        buckets.append(lambda: as_rows(bucketed_files(files, pattern, 500)))
    buckets += [lambda: fuzzy_tokens(symbols, pattern).select(*columns), lambda: as_rows(fuzzy_files(files, pattern))]
    merged = escalated(buckets, SYMBOL_IDENTITY, _symbol_order(), min(max(offset, 0) + min(max(limit, 1), 500), 1000))
    return suppress_for_exact_type(merged, pattern).orderBy("bucket", *_symbol_order()).offset(offset).limit(min(max(limit, 1), 500))


def global_find(symbols: DataFrame, files: DataFrame, lines: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """``fast_find`` and then lines of text (kind ``text``; ``lines(path, line_number, line_text)``)."""
    found = fast_find(symbols, files, pattern, limit).select("kind", "name", "path", F.col("line_number").cast("long").alias("line_number"), "bucket")
    texts = code_text(lines, "path", pattern, limit).select(F.lit("text").alias("kind"), F.col("line_text").alias("name"), "path", F.col("line_number").cast("long").alias("line_number"), F.lit(9).alias("bucket"))
    return found.unionByName(texts).orderBy("bucket", "path", "line_number", "name").limit(limit)


def grep_binary(files: DataFrame, pattern: bytes) -> DataFrame:
    """Files (path, content) whose bytes hold the pattern."""
    return files.filter(F.col("content").contains(F.lit(bytearray(pattern)))).select("path").orderBy("path")
