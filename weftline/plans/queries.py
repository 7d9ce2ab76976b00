"""Every operator as a query over the driver's tables, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assets, build, checks, fold, graph, resolve, search, usages
from ..operators.scratch import scratch_path
from ..sources import text as T
from ..streaming import changes
from .catalog import SYMBOLS_SQL, document_lines, lines_sql, low, symbols, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- text search


@query(f"WITH {lines_sql()} SELECT doc_id, line_number, line_text FROM lines WHERE contains(lower(line_text), 'license')")
def code_text_search(spark, d):
    return search.code_text(document_lines(spark, d), "doc_id", "License")


@query(f"SELECT conv_id, turn, text FROM conversations WHERE contains({low('text')}, 'sh')")
def short_needle_search(spark, d):
    rows = table(spark, d, "conversations")
    folded, needle = search._folded("text", "Sh")
    return rows.filter(folded.contains(needle)).select("conv_id", "turn", "text")


@query(f"WITH {lines_sql()} SELECT doc_id, min(line_number) AS first_line, count(*) AS hits FROM lines WHERE contains(lower(line_text), 'license') GROUP BY doc_id")
def path_hits(spark, d):
    return search.path_hits(document_lines(spark, d), "doc_id", "license")


@query(f"WITH {lines_sql()} SELECT doc_id, line_number, line_text FROM lines WHERE contains(lower(line_text), 'tion') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def lines_in_paths(spark, d):
    return search.lines_in(document_lines(spark, d), "doc_id", table(spark, d, "labels").filter("quality = 1"), "tion")


@query(f"""WITH {lines_sql()}, f AS (SELECT doc_id, line_number, greatest(length(line_text) - 2, 0) AS len,
  len(list_filter(range(1, greatest(length(line_text) - 5, 1) + 1), lambda i: substr(lower(line_text), i, 7) = 'license')) AS tf FROM lines),
  t AS (SELECT count(*) AS n, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS df, avg(len) AS avgdl FROM f)
  SELECT doc_id, line_number, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)), 6) AS score FROM f, t WHERE tf > 0""")
def bm25_lines(spark, d):
    return search.bm25(document_lines(spark, d), "license").select("doc_id", "line_number", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- symbol search

_PAGE = "symbol_id, kind, name, owner_name, path"


@query(f"WITH {SYMBOLS_SQL} SELECT symbol_id, kind, kind_rank, name, name_lc, compact_name, owner_name_lc, path_lc, is_class_like FROM symbols")
def symbol_projection(spark, d):
    return symbols(spark, d).select("symbol_id", "kind", "kind_rank", "name", "name_lc", "compact_name", "owner_name_lc", "path_lc", "is_class_like")


def _bucket_sql(pattern: str, limit: int) -> str:
    p, c = pattern.lower(), "".join(x for x in pattern.lower() if x.isalnum())
    return f"""WITH {SYMBOLS_SQL}, b AS (SELECT *, CASE WHEN name_lc = '{p}' THEN 0 WHEN starts_with(name_lc, '{p}') THEN 1 WHEN contains(name_lc, '{p}') OR contains(compact_name, '{c}') THEN 2 END AS bucket FROM symbols),
  o AS (SELECT *, row_number() OVER (PARTITION BY kind, path, line_number, name ORDER BY bucket, kind_rank, length(name), name_lc, symbol_id) AS r FROM b WHERE bucket IS NOT NULL)
  SELECT {_PAGE}, bucket FROM o WHERE r = 1 ORDER BY bucket, kind_rank, length(name), name_lc, symbol_id LIMIT {limit}"""


@query(_bucket_sql("customer#0000001", 50))
def search_exact_prefix(spark, d):
    return search.bucketed_symbols(symbols(spark, d), "customer#0000001", 50).select(*_PAGE.split(", "), "bucket")


@query(f"WITH {SYMBOLS_SQL} SELECT {_PAGE} FROM symbols WHERE (contains(compact_name, 'small') OR contains(coalesce(owner_name_lc, ''), 'small')) AND (contains(compact_name, 'widget') OR starts_with(compact_name, 'widge') OR contains(coalesce(owner_name_lc, ''), 'widget')) ORDER BY kind_rank, length(name), name_lc, symbol_id LIMIT 256")
def search_fuzzy_tokens(spark, d):
    return search.fuzzy_tokens(symbols(spark, d), "small widget").select(*_PAGE.split(", "))


@query(f"""WITH {SYMBOLS_SQL}, m AS (SELECT * FROM symbols WHERE contains(name_lc, 'asia') OR contains(coalesce(owner_name_lc, ''), 'asia')),
  e AS (SELECT max(CASE WHEN is_class_like AND name_lc = 'asia' THEN 1 ELSE 0 END) AS hit FROM m)
  SELECT {_PAGE} FROM m, e WHERE coalesce(hit, 0) = 0 OR name_lc = 'asia' OR kind = 'file'""")
def exact_type_suppress(spark, d):
    rows = symbols(spark, d).filter(F.col("name_lc").contains("asia") | F.coalesce("owner_name_lc", F.lit("")).contains("asia"))
    return search.suppress_for_exact_type(rows, "Asia").select(*_PAGE.split(", "))


@query(f"""WITH {SYMBOLS_SQL}, w AS (SELECT {_PAGE}, list_transform(regexp_extract_all(name, '([A-Z][a-z]*|[a-z]+|[0-9]+)', 1), lambda x: {low('x')}) AS t FROM symbols)
  SELECT {_PAGE} FROM w WHERE list_contains(CASE WHEN len(t) > 1 AND length(t[1]) = 1 THEN t[2:] ELSE t END, 'red')""")
def token_lane(spark, d):
    return search.token_lane(symbols(spark, d), "red").select(*_PAGE.split(", "))


@query(f"""WITH {SYMBOLS_SQL}, w AS (SELECT {_PAGE}, list_transform(regexp_extract_all(name, '([A-Z][a-z]*|[a-z]+|[0-9]+)', 1), lambda x: {low('x')}) AS t FROM symbols),
  k AS (SELECT *, list_filter(CASE WHEN len(t) > 1 AND length(t[1]) = 1 THEN t[2:] ELSE t END, lambda x: starts_with(x, 'wid')) AS h FROM w) SELECT {_PAGE}, list_min(h) AS token FROM k WHERE len(h) > 0""")
def token_prefix_lane(spark, d):
    return search.token_lane(symbols(spark, d), "wid", exact=False).select(*_PAGE.split(", "), "token")


@query(f"WITH {SYMBOLS_SQL} SELECT {_PAGE} FROM symbols WHERE contains(name_lc, 'plier#00000001') OR contains(compact_name, 'plier00000001')")
def infix_lane(spark, d):
    return search.infix_lane(symbols(spark, d), "plier#00000001").select(*_PAGE.split(", "))


@query(f"""WITH {SYMBOLS_SQL}, r AS (SELECT *, CASE WHEN name_lc = 'asia' THEN 0 WHEN starts_with(name_lc, 'asia') THEN 1 WHEN contains(name_lc, 'asia') THEN 2 WHEN contains(coalesce(owner_name_lc, ''), 'asia') THEN 3 WHEN contains(coalesce(module_name_lc, ''), 'asia') THEN 4 WHEN contains(path_lc, 'asia') THEN 5 END AS rank FROM symbols WHERE is_class_like),
  o AS (SELECT *, row_number() OVER (PARTITION BY kind, name, path ORDER BY rank, symbol_id) AS rn FROM r WHERE rank IS NOT NULL) SELECT {_PAGE}, rank FROM o WHERE rn = 1""")
def class_rank(spark, d):
    return search.class_rank(symbols(spark, d), "Asia").select(*_PAGE.split(", "), "rank")


@query(f"""WITH {SYMBOLS_SQL}, q AS (SELECT *, CASE WHEN name_lc = 'red' THEN 0 WHEN starts_with(name_lc, 'red') THEN 1 WHEN compact_name = 'red' THEN 2 WHEN starts_with(compact_name, 'red') THEN 3 WHEN contains(name_lc, 'red') THEN 4
  WHEN regexp_matches(compact_name, '^[^r]*r([^e]?)e([^d]?)d') AND length(regexp_extract(compact_name, '^[^r]*(r[^e]?e[^d]?d)', 1)) <= 4 THEN 5
  WHEN contains(coalesce(owner_name_lc, ''), 'red') THEN 6 WHEN contains(path_lc, 'red') THEN 7 ELSE 8 END AS quality FROM symbols),
  p AS (SELECT * FROM q WHERE quality < 8 ORDER BY quality, len(string_split(path, '/')), kind_rank, name_lc, path, line_number, symbol_id LIMIT 50)
  SELECT {_PAGE}, quality, row_number() OVER (ORDER BY quality, len(string_split(path, '/')), kind_rank, name_lc, path, line_number, symbol_id) - 1 AS backend_rank FROM p""")
def live_find_rank(spark, d):
    return search.live_find(symbols(spark, d), "Red").select(*_PAGE.split(", "), "quality", "backend_rank")


@query("""WITH n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w, replace(p_name, ' ', '') AS j FROM part),
  r AS (SELECT p_name, coalesce(CASE WHEN starts_with(p_name, 'wi') THEN 0 END, CASE WHEN starts_with(j, 'wi') THEN 1 END, CASE WHEN starts_with(w[1], 'wi') THEN 2 WHEN starts_with(w[2], 'wi') THEN 3 END,
    CASE WHEN contains(p_name, 'wi') THEN instr(p_name, 'wi') - 1 + 40 END, CASE WHEN contains(j, 'wi') THEN instr(j, 'wi') - 1 + 100 END) AS rank FROM n)
  SELECT p_name, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, length(p_name), p_name LIMIT 80""")
def completion_rank(spark, d):
    return search.complete(table(spark, d, "part").select("p_name").distinct(), "p_name", "wi").select("p_name", "rank")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000000') ORDER BY c_name LIMIT 200")
def prefix_classes(spark, d):
    return search.prefix_lookup(table(spark, d, "customer"), "c_name", "Customer#00000000").select("c_custkey", "c_name")


@query(f"SELECT page_id, url FROM pages WHERE contains({low('url')}, 'page')")
def contains_files(spark, d):
    return table(spark, d, "pages").filter(S.lower_ascii("url").contains("page")).select("page_id", "url")


@query(f"SELECT page_id, url FROM pages WHERE ends_with({low('url')}, '1')")
def suffix_files(spark, d):
    return table(spark, d, "pages").filter(S.lower_ascii("url").endswith("1")).select("page_id", "url")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 20")
def paginate(spark, d):
    return search.with_limit(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 40, 20)


@query(f"""WITH {SYMBOLS_SQL}, a AS (SELECT {_PAGE}, line_number, 0 AS bucket FROM symbols WHERE starts_with(name_lc, 'red')),
  b AS (SELECT {_PAGE}, line_number, 1 AS bucket FROM symbols WHERE contains(name_lc, 'ring')), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
  o AS (SELECT *, row_number() OVER (PARTITION BY kind, path, name ORDER BY bucket, symbol_id) AS r FROM u) SELECT {_PAGE}, bucket FROM o WHERE r = 1 ORDER BY bucket, symbol_id LIMIT 100""")
def priority_merge(spark, d):
    s = symbols(spark, d)
    return search.priority_merge([s.filter(F.col("name_lc").startswith("red")), s.filter(F.col("name_lc").contains("ring"))], ["kind", "path", "name"], [F.col("symbol_id")], 100).select(*_PAGE.split(", "), "bucket")


@query(f"WITH p AS (SELECT DISTINCT p_name FROM part) SELECT p_name, CASE WHEN instr({low('p_name')}, 'ring') > 0 THEN instr({low('p_name')}, 'ring') - 1 END AS score FROM p WHERE instr({low('p_name')}, 'ring') > 0")
def fuzzy_score(spark, d):
    rows = table(spark, d, "part").select("p_name").distinct()
    return rows.filter(S.lower_ascii("p_name").contains("ring")).select("p_name", S.fuzzy_token_score("p_name", "ring").alias("score"))


# ---------------------------------------------------------------- hierarchies and joins


def _places(spark, d) -> DataFrame:
    region, nation, customer = (table(spark, d, n) for n in ("region", "nation", "customer"))
    a = region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    b = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name"))
    c = customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"), F.col("c_name").alias("name"))
    return a.unionByName(b).unionByName(c)


@query("""SELECT 'r' || r_regionkey AS id, r_name AS full_path, 0 AS depth FROM region UNION ALL
  SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT 'c' || c_custkey, r_name || '/' || n_name || '/' || c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def hierarchy_paths(spark, d):
    return graph.hierarchy_paths(spark, _places(spark, d))


@query("""WITH s AS (SELECT DISTINCT unnest(list_filter(string_split(url, '/'), lambda x: x <> '')) AS seg, url FROM pages) SELECT seg AS segment, count(*) AS n_urls FROM s GROUP BY seg""")
def url_path_tree(spark, d):
    parts = table(spark, d, "pages").select("url", F.explode(S.path_components("url")).alias("segment")).distinct()
    return parts.filter("segment <> '/'").groupBy("segment").agg(F.count(F.lit(1)).alias("n_urls"))


_ROOTS = [("http", 1), ("https://", 2), ("https://site1", 3), ("https://site12", 4), ("https://example", 5), ("https://example.com/page/1", 6)]


@query("""WITH roots(root, module) AS (VALUES """ + ", ".join(f"('{a}', {b})" for a, b in _ROOTS) + f"""), h AS (SELECT url, module, row_number() OVER (PARTITION BY url ORDER BY length(root) DESC) AS r FROM pages JOIN roots ON starts_with({low('url')}, root))
  SELECT page_id, url, coalesce((SELECT module FROM h WHERE h.url = pages.url AND r = 1 LIMIT 1), 0) AS module FROM pages""")
def longest_prefix_module(spark, d):
    roots = spark.createDataFrame(_ROOTS, "root string, module int")
    return resolve.longest_prefix(table(spark, d, "pages").select("page_id", "url"), "url", roots, "root", "module", fallback=0)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 < 8), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 10 > 1)
  SELECT coalesce(o.k, n.k) AS o_orderkey, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'deleted' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.k = n.k""")
def snapshot_diff(spark, d):
    orders = table(spark, d, "orders")
    old = orders.filter("o_orderkey % 10 < 8")
    new = orders.filter("o_orderkey % 10 > 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return resolve.snapshot_diff(old, new, "o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, p_name, (SELECT min(q.p_partkey) FROM part q WHERE q.p_name = p.p_name) AS first_part FROM lineitem JOIN part p ON l_partkey = p_partkey")
def resolve_first(spark, d):
    part = table(spark, d, "part")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")
    return resolve.resolve_first(rows, "p_name", part, "p_name", "p_partkey", "first_part")


@query("""WITH s AS (SELECT page_id, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS seg FROM pages), u AS (SELECT seg, count(*) AS n, min(page_id) AS id FROM s GROUP BY seg)
  SELECT s.page_id, s.seg, CASE WHEN u.n = 1 THEN u.id END AS resolved FROM s LEFT JOIN u ON s.seg = u.seg""")
def resolve_iff_unique(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1).alias("seg"))
    return resolve.resolve_iff_unique(rows, "seg", rows.select(F.col("seg").alias("t"), F.col("page_id").alias("i")), "t", "i", "resolved")


@query("SELECT DISTINCT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR s_name IN (SELECT 'Supplier#' || lpad((n_nationkey)::VARCHAR, 9, '0') FROM nation WHERE n_regionkey = 1)")
def or_join_children(spark, d):
    seeds = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Supplier#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("name"))
    return resolve.either_key(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), seeds, [("s_nationkey", "id"), ("s_name", "name")])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_anti(spark, d):
    return resolve.missing_on_disk(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT p_partkey, p_brand FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p.p_partkey AND s_nationkey < 5)")
def missing_definition(spark, d):
    defined = table(spark, d, "lineitem").join(table(spark, d, "supplier").filter("s_nationkey < 5"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("p_partkey"))
    return checks.missing_definitions(table(spark, d, "part").select("p_partkey", "p_brand"), defined, ["p_partkey"])


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 NOT IN (0, 1) UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 5 = 0""")
def upsert_delete(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changed = base.filter("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("N"))
    return build.upsert(base, changed, ["o_orderkey"], base.filter("o_orderkey % 5 = 1"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 GROUP BY 1")
def upsert_latest(spark, d):
    return build.latest(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


# ---------------------------------------------------------------- grouping and checks


@query("SELECT c_nationkey, count(*) AS n, string_agg(c_name, ',' ORDER BY c_name) AS names FROM customer GROUP BY c_nationkey")
def group_collect(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("c_name")), ",").alias("names"))


@query("SELECT l_partkey, string_agg(s, ',' ORDER BY s) AS suppliers FROM (SELECT DISTINCT l_partkey, lpad(l_suppkey::VARCHAR, 9, '0') AS s FROM lineitem) GROUP BY l_partkey")
def postings(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("s"))
    return rows.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("suppliers"))


_HREF = 'href="([^"]+)"'


def _href_usages(spark, d) -> DataFrame:
    rows = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("asset_path"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("referenced"))
    return rows.select(S.lower_ascii("referenced").alias("lookup_key"), F.when(F.col("referenced").startswith("http"), "reference").when(F.col("referenced").startswith("/"), "derived").otherwise("function").alias("usage_kind"), "asset_path").distinct()


_USAGES_SQL = f"""u AS (SELECT DISTINCT {low('h')} AS lookup_key, CASE WHEN starts_with(h, 'http') THEN 'reference' WHEN starts_with(h, '/') THEN 'derived' ELSE 'function' END AS usage_kind, asset_path FROM (SELECT page_id::VARCHAR AS asset_path, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS h FROM pages))"""


@query(f"""WITH {_USAGES_SQL}, n AS (SELECT DISTINCT lookup_key AS name FROM u) SELECT name, count(DISTINCT CASE WHEN usage_kind = 'derived' THEN asset_path END) AS derived_count,
  count(DISTINCT CASE WHEN usage_kind = 'reference' THEN asset_path END) + count(DISTINCT CASE WHEN usage_kind = 'function' THEN asset_path END) AS reference_count
  FROM n JOIN u ON lookup_key = name OR string_split(lookup_key, '.')[-1] = name OR string_split(lookup_key, ':')[-1] = name GROUP BY name""")
def usage_hints(spark, d):
    u = _href_usages(spark, d)
    return assets.usage_hints(u, u.select(F.col("lookup_key").alias("name")).distinct())


@query(f"""WITH {_USAGES_SQL}, n AS (SELECT DISTINCT string_split(lookup_key, '.')[-1] AS name FROM u) SELECT DISTINCT name AS looked_up, usage_kind, asset_path
  FROM n JOIN u ON lookup_key = name OR string_split(lookup_key, '.')[-1] = name OR string_split(lookup_key, ':')[-1] = name""")
def asset_usages(spark, d):
    u = _href_usages(spark, d)
    return assets.asset_usages(u, u.select(F.substring_index("lookup_key", ".", -1).alias("name")).distinct())


@query("""WITH g AS (SELECT p_name, p_type, count(DISTINCT p_brand) AS n, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS locations FROM part GROUP BY 1, 2) SELECT p_partkey, p.p_name, p.p_type, locations FROM part p JOIN g ON p.p_name = g.p_name AND p.p_type = g.p_type WHERE n > 1""")
def odr_conflict(spark, d):
    return checks.conflicting_definitions(table(spark, d, "part"), ["p_name", "p_type"], "p_brand", "p_brand").select("p_partkey", "p_name", "p_type", "locations")


@query("SELECT p_name, count(*) AS n_rows, count(DISTINCT p_size) AS n_fingerprints FROM part GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT p_size) > 1")
def class_odr(spark, d):
    return checks.class_conflicts(table(spark, d, "part"), "p_name", "p_size")


@query("SELECT p_name, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS kinds FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def name_clash(spark, d):
    return checks.name_clashes(table(spark, d, "part"), "p_name", "p_type")


@query("""WITH c AS (SELECT (SELECT count(*) FROM documents) AS n_assets, (SELECT count(*) FROM conversations) AS n_references,
  (SELECT count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents)) AS n_orphan_references, (SELECT count(*) FROM pages WHERE page_id + 100 NOT IN (SELECT doc_id FROM documents)) AS n_orphan_functions)
  SELECT n_assets, n_references, n_orphan_references, n_orphan_functions, concat_ws('; ', CASE WHEN n_assets = 0 THEN 'no assets indexed' END, CASE WHEN n_orphan_references > 0 THEN 'references without an asset' END, CASE WHEN n_orphan_functions > 0 THEN 'functions without an asset' END) AS issues FROM c""")
def health_report(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("asset_path"))
    r = table(spark, d, "conversations").select(F.col("conv_id").alias("asset_path"))
    f = table(spark, d, "pages").select((F.col("page_id") + 100).alias("asset_path"))
    return assets.index_status(a, r, f).select("n_assets", "n_references", "n_orphan_references", "n_orphan_functions", F.array_join("issues", "; ").alias("issues"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source NULLS FIRST LIMIT 10")
def top_groups(spark, d):
    return checks.top_groups(table(spark, d, "documents"), "source", 10)


@query("""SELECT floor(epoch(ts) / 3600)::BIGINT * 3600 AS window_start, event_type, count(*) AS n, floor(sum(floor(value)) / count(*))::BIGINT AS avg_ms, max(floor(value))::BIGINT AS max_ms, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM events GROUP BY 1, 2""")
def latency_window(spark, d):
    rows = checks.latency_stats(table(spark, d, "events"), "ts", "event_type", F.floor("value"), F.col("event_type") == "error", "1 hour")
    return rows.withColumn("window_start", F.unix_timestamp(F.col("window_start").cast("timestamp")))


_DIAGNOSTIC = "user_id AS file, CAST(floor(value) AS BIGINT) AS line, event_type AS code, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS severity, event_id"


def _diagnostics(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr(*_DIAGNOSTIC.split(", "))


@query(f"WITH e AS (SELECT {_DIAGNOSTIC} FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY file, line // 4 ORDER BY severity DESC, event_id) AS rn FROM e) SELECT file, line, code, severity, event_id FROM r WHERE rn = 1")
def keep_max_severity(spark, d):
    rows = _diagnostics(spark, d)
    return checks.keep_most_severe(rows, [F.col("file"), S.dedupe_bucket("line")], F.col("severity"), [F.col("event_id")])


@query(f"WITH e AS (SELECT {_DIAGNOSTIC} FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY severity DESC, event_id) AS rn FROM e) SELECT file, line, code, severity, event_id FROM r WHERE rn <= 3")
def per_line_cap(spark, d):
    return checks.cap_per_group(_diagnostics(spark, d), ["file", "line"], [F.desc("severity"), F.col("event_id")], 3)


@query(f"""WITH e AS (SELECT {_DIAGNOSTIC} FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) AS rn FROM e), c AS (SELECT file, count(*) AS n FROM e GROUP BY file)
  SELECT file, event_id, code AS message FROM r WHERE rn <= 10 UNION ALL SELECT file, NULL, (n - 10)::VARCHAR || ' omitted' FROM c WHERE n > 10""")
def per_file_cap(spark, d):
    rows = _diagnostics(spark, d).select("file", "event_id", F.col("code").alias("message"))
    return checks.cap_per_file(rows, "file", [F.col("event_id")], 10)


@query("WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R')::INT, l_linenumber, l_orderkey) AS rn FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE rn = 1")
def definition_pick(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return checks.cap_per_group(rows, ["l_partkey"], [(F.col("l_returnflag") == "R").cast("int"), F.col("l_linenumber"), F.col("l_orderkey")], 1).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""WITH m AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS near_event_id FROM events) SELECT event_id, near_event_id FROM m WHERE event_type = 'purchase'""")
def nearest_preceding(spark, d):
    rows = table(spark, d, "events")
    return resolve.nearest_preceding(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "signup", F.col("event_type") == "purchase", ["event_id"]).select("event_id", "near_event_id")


_RANGES = [(i, i * 40_000, i * 40_000 + 90_000) for i in range(12)]


@query("WITH r(label, s, e) AS (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in _RANGES) + """), h AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS p FROM orders), m AS (SELECT o_orderkey, p, label, row_number() OVER (PARTITION BY o_orderkey ORDER BY s) AS rn FROM h JOIN r ON p BETWEEN s AND e)
  SELECT o_orderkey, p, label FROM m WHERE rn = 1""")
def enclosing_range(spark, d):
    ranges = spark.createDataFrame(_RANGES, "label int, s long, e long")
    points = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("p"))
    return resolve.enclosing_range(points, "p", ranges, "s", "e", "label", 50_000).select("o_orderkey", "p", "label")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS near_turn FROM conversations")
def section_ffill(spark, d):
    rows = table(spark, d, "conversations")
    return resolve.nearest_preceding(rows, ["conv_id"], [F.col("turn"), F.col("text")], F.col("role") == "user", F.lit(True), ["turn"]).select("conv_id", "turn", "near_turn")


# ---------------------------------------------------------------- folds, throttle, graphs


def _operations(spark, d) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "+").when(F.col("event_type") == "error", "-").when(F.col("event_type") == "click", "!").otherwise("")
    return table(spark, d, "events").filter("event_type <> 'view'").select("user_id", "event_id", op.alias("op"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("value"))


_FOLD_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'purchase' THEN '+' WHEN 'error' THEN '-' WHEN 'click' THEN '!' ELSE '' END AS op, 'v' || (event_id % 3) AS v FROM events WHERE event_type <> 'view'),
  f AS (SELECT user_id, 0::BIGINT AS i, false AS l, CAST([] AS VARCHAR[]) AS s FROM (SELECT DISTINCT user_id FROM o) UNION ALL
    SELECT f.user_id, o.i, CASE o.op WHEN '+' THEN len(f.s) > 0 WHEN '-' THEN f.l AND len(list_filter(f.s, lambda x: x <> o.v)) > 0 ELSE false END,
      CASE o.op WHEN '+' THEN list_append(f.s, o.v) WHEN '-' THEN list_filter(f.s, lambda x: x <> o.v) WHEN '!' THEN CAST([] AS VARCHAR[]) ELSE [o.v] END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1),
  g AS (SELECT f.user_id, f.i, o.op, o.event_id, CASE WHEN len(s) = 0 THEN 'nil' WHEN l THEN '[Array x' || len(s) || '] ' || s[-1] ELSE s[-1] END AS value FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i) """


@query(_FOLD_SQL + "SELECT user_id, value, i AS n_ops FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1")
def config_fold(spark, d):
    return fold.config_fold(_operations(spark, d), ["user_id"], ["event_id"])


@query(_FOLD_SQL + "SELECT user_id, i - 1 AS step, event_id, op, value FROM g")
def config_history(spark, d):
    return fold.config_history(_operations(spark, d), ["user_id"], ["event_id"])


_THROTTLE_SQL = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events), p AS (
  SELECT user_id, t, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM e) WHERE r = 1
  UNION ALL SELECT n.user_id, n.t, n.event_id FROM (SELECT e.user_id, e.t, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.t, e.event_id) AS r FROM e JOIN p ON e.user_id = p.user_id AND e.t - p.t >= 21600000000) n WHERE n.r = 1)
  SELECT {columns} FROM p"""


@query(_THROTTLE_SQL.format(columns="user_id, t AS ts_us, event_id"))
def throttle(spark, d):
    rows = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id")
    return fold.throttle(rows, ["user_id"], "ts_us", 6 * 3600 * 1_000_000, ["event_id"])


def _transitions(spark, d) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "events").withColumn("dst", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.filter("dst is not null").select(F.col("event_type").alias("src"), "dst").distinct()


_TRANSITIONS_SQL = "t AS (SELECT DISTINCT event_type AS src, dst FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


@query(f"WITH RECURSIVE {_TRANSITIONS_SQL}, c AS (SELECT src, dst FROM t UNION SELECT c.src, t.dst FROM c JOIN t ON c.dst = t.src) SELECT src, dst FROM c")
def include_closure(spark, d):
    return graph.closure(_transitions(spark, d)).select("src", "dst")


@query(f"WITH RECURSIVE {_TRANSITIONS_SQL}, c AS (SELECT dst FROM t WHERE src = 'signup' UNION SELECT t.dst FROM c JOIN t ON c.dst = t.src) SELECT dst FROM c")
def depend_files(spark, d):
    return graph.depend_files(_transitions(spark, d), spark.createDataFrame([("signup",)], "src string"))


@query(f"WITH {_TRANSITIONS_SQL} SELECT src, dst FROM t WHERE dst IN ('error', 'purchase')")
def reverse_edges(spark, d):
    return graph.reverse_edges(_transitions(spark, d), spark.createDataFrame([("error",), ("purchase",)], "dst string"))


def _chain(spark, d) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "orders").withColumn("dst", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return rows.select(F.col("o_orderkey").alias("src"), "dst")


_CHAIN_SQL = "e AS (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders)"


@query(f"WITH RECURSIVE {_CHAIN_SQL}, c AS (SELECT src, dst, 1 AS depth FROM e WHERE dst IS NOT NULL UNION ALL SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON c.dst = e.src WHERE e.dst IS NOT NULL) SELECT src, dst, depth FROM c")
def ancestor_depth(spark, d):
    return graph.closure(_chain(spark, d))


@query(f"""WITH RECURSIVE {_CHAIN_SQL}, c AS (SELECT src, dst FROM e WHERE dst IS NOT NULL UNION ALL SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src WHERE e.dst IS NOT NULL),
  p AS (SELECT src AS child, src - 7 AS parent FROM e) SELECT child, parent, EXISTS (SELECT 1 FROM c WHERE c.src = child AND c.dst = parent) AS is_descendant FROM p""")
def is_descendant(spark, d):
    e = _chain(spark, d)
    return graph.is_descendant(e, e.select(F.col("src").alias("child"), (F.col("src") - 7).alias("parent")))


@query(f"""WITH RECURSIVE {_CHAIN_SQL}, c AS (SELECT src, src AS dst, 0 AS r FROM e UNION ALL SELECT c.src, e.dst, c.r + 1 FROM c JOIN e ON c.dst = e.src WHERE e.dst IS NOT NULL),
  m AS (SELECT c.src, c.r, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY c.src, l_linenumber ORDER BY c.r, l_orderkey, l_orderkey * 10 + l_linenumber) AS rn FROM c JOIN lineitem ON l_orderkey = c.dst)
  SELECT src, l_linenumber AS name, r AS class_rank, l_orderkey AS class_id FROM m WHERE rn = 1""")
def inherited_members(spark, d):
    e = _chain(spark, d)
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("class_id"), F.col("l_linenumber").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member_id"))
    return graph.inherited_members(e, e.select("src"), members).select("src", "name", "class_rank", "class_id")


@query("""WITH RECURSIVE e AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r.r_name, n.n_name FROM region r JOIN nation n ON n.n_nationkey = r.r_regionkey * 5),
  c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src AS module, string_agg(dst, ',' ORDER BY dst) AS dependencies FROM c WHERE src <> dst GROUP BY src""")
def module_closure(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    down = region.join(nation, F.col("n_nationkey") == F.col("r_regionkey") * 5).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return graph.module_closure(up.unionByName(down)).select("module", F.array_join("dependencies", ",").alias("dependencies"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9700), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 3000)
  SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'only_customer', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'only_supplier', k FROM (SELECT k FROM s EXCEPT SELECT k FROM c) UNION ALL SELECT 'unsent', k FROM c WHERE k NOT IN (SELECT k FROM s)""")
def set_ops(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9700").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, d, "supplier").filter("s_acctbal < 3000").select(F.col("s_nationkey").alias("k")).distinct()
    named = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return named(c.union(s).distinct(), "union").union(named(c.subtract(s), "only_customer")).union(named(s.subtract(c), "only_supplier")).union(named(search.new_rows(c, s, ["k"]), "unsent"))


@query("WITH b AS (SELECT doc_id, length(text)::BIGINT AS bytes, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 200)) SELECT doc_id, bytes, bytes_before FROM b WHERE bytes_before < 100000")
def budget_scan(spark, d):
    return search.budget_scan(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.length("text").cast("long"), 200, 100_000).select("doc_id", "bytes", "bytes_before")


# ---------------------------------------------------------------- source lines

_HTML = lines_sql("pages", "page_id", "html")


@query(f"""WITH {_HTML}, o AS (SELECT page_id, line_number, line_text, strlen(regexp_extract(' ' || line_text, '^(.*?)[^A-Za-z0-9_]class(?:[^A-Za-z0-9_]|$)', 1)) AS b, length(regexp_extract(' ' || line_text, '^(.*?[^A-Za-z0-9_])class(?:[^A-Za-z0-9_]|$)', 1)) AS c FROM lines WHERE contains(line_text, 'class')),
  p AS (SELECT *, left(line_text, c - 1) AS before, ltrim(substr(line_text, c + 5)) AS after FROM o WHERE c > 0)
  SELECT page_id, line_number, c AS "column", CASE WHEN contains(line_text, 'UPROPERTY(') OR contains(line_text, 'UFUNCTION(') THEN 'declaration' WHEN contains(before, '::') AND starts_with(after, '(') THEN 'definition' WHEN starts_with(after, '(') THEN 'call' WHEN regexp_matches(after, '^[-+*/]?=') THEN 'write' ELSE 'read' END AS usage FROM p
  WHERE NOT contains(before, '//') AND (length(before) - length(replace(regexp_replace(before, '\\\\.', '', 'g'), '"', '')) - (length(before) - length(regexp_replace(before, '\\\\.', '', 'g')))) % 2 = 0""")
def usage_classify(spark, d):
    return usages.usage_lines(T.lines(table(spark, d, "pages"), "page_id", "html"), "page_id", "class").select("page_id", "line_number", "column", "usage")


@query(f"""WITH {_HTML}, q AS (SELECT page_id, line_number, instr(line_text, 'com') AS c, line_text FROM lines WHERE contains(line_text, 'com'))
  SELECT page_id, line_number, regexp_extract(left(line_text, c - 1), '([A-Za-z0-9_]+)(->|\\.|::)\\s*$', 1) AS qualifier, regexp_extract(left(line_text, c - 1), '([A-Za-z0-9_]+)(->|\\.|::)\\s*$', 2) AS operator FROM q""")
def qualifier_before(spark, d):
    rows = T.lines(table(spark, d, "pages"), "page_id", "html").filter(F.col("line_text").contains("com"))
    identifier, operator = S.qualifier_before("line_text", F.instr("line_text", "com"))
    return rows.select("page_id", "line_number", identifier.alias("qualifier"), operator.alias("operator"))


def _log(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    k = F.col("p_partkey") % 6
    line = F.when(k == 0, F.format_string("C:\\src\\%s.cpp(%d,%d): error C%d: '%s' is undefined", "p_brand", "p_size", F.col("p_partkey") % 80, F.col("p_partkey") % 9000 + 1000, "p_name"))
    line = line.when(k == 1, F.format_string("D:/game/%s.h:%d: Warning: unused %s", "p_type", "p_size", "p_name"))
    line = line.when(k == 2, F.format_string("C:/src/%s.h(%d): fatal error C1083: no %s", "p_brand", "p_size", "p_name"))
    line = line.when(k == 3, F.format_string("C:/a/%s.h:12: Error: bad %s", "p_brand", "p_name"))
    line = line.when(k == 4, F.format_string("/home/%s.c:3:5: error: not of these forms", "p_brand")).otherwise(F.format_string("building %s", "p_name"))
    return part.select("p_partkey", line.alias("line_text"))


@query("""WITH p AS (SELECT *, p_partkey % 6 AS k FROM part WHERE p_partkey % 6 < 4)
  SELECT p_partkey, CASE k WHEN 0 THEN 'C:/src/' || p_brand || '.cpp' WHEN 1 THEN 'D:/game/' || p_type || '.h' WHEN 2 THEN 'C:/src/' || p_brand || '.h' ELSE 'C:/a/' || p_brand || '.h' END AS file_path,
  CASE k WHEN 3 THEN 11 ELSE greatest(p_size - 1, 0) END AS line, CASE k WHEN 0 THEN greatest(p_partkey % 80 - 1, 0) ELSE 0 END AS "character", CASE k WHEN 1 THEN 'warning' ELSE 'error' END AS severity,
  CASE WHEN k IN (0, 2) THEN 'MSVC' ELSE 'UHT' END AS source, 'BUILD' AS code,
  CASE k WHEN 0 THEN 'C' || (p_partkey % 9000 + 1000) || ': ''' || p_name || ''' is undefined' WHEN 1 THEN 'unused ' || p_name WHEN 2 THEN 'C1083: no ' || p_name ELSE 'bad ' || p_name END AS message FROM p""")
def build_log_parse(spark, d):
    return T.build_diagnostics(_log(spark, d), "p_partkey")


def _ini(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    text = F.concat_ws("\n", F.lit("; head"), F.concat(F.lit("Early="), F.col("p_brand")), F.concat(F.lit("  ["), F.col("p_type"), F.lit("]")), F.concat(F.lit("Name = "), F.col("p_name")), F.concat(F.lit("+Size="), F.col("p_size").cast("string")), F.lit("!Clear"), F.lit("!Gone="), F.lit("=none"), F.concat(F.lit("-Brand="), F.col("p_brand"), F.lit("=x")))
    return T.lines(part.select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("""SELECT p_partkey, p_type AS section, 'Name' AS name, '' AS op, p_name AS value, 4 AS line FROM part UNION ALL SELECT p_partkey, p_type, 'Size', '+', p_size::VARCHAR, 5 FROM part
  UNION ALL SELECT p_partkey, 'Default', 'Early', '', p_brand, 2 FROM part UNION ALL SELECT p_partkey, p_type, 'Gone', '!', '', 7 FROM part UNION ALL SELECT p_partkey, p_type, 'Brand', '-', p_brand || '=x', 9 FROM part""")
def ini_parse(spark, d):
    return T.ini_entries(_ini(spark, d), "p_partkey")


# ---------------------------------------------------------------- streams


def _drained(stream: DataFrame, spark: SparkSession, mode: str = "append", each=None) -> str:
    """Run a stream over what is there and return the folder that it wrote."""
    folder = scratch_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    started = writer.foreachBatch(each(f"{folder}/rows")).start() if each else writer.format("parquet").option("path", f"{folder}/rows").start()
    started.awaitTermination()
    return f"{folder}/rows"


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query(_THROTTLE_SQL.format(columns="user_id, t AS ts_us"))
def stream_throttle(spark, d):
    rows = _stream(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return spark.read.parquet(_drained(changes.throttled(rows, "user_id", 6 * 3600 * 1_000_000), spark))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderstatus, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderstatus <> 'F' GROUP BY 1")
def stream_upsert(spark, d):
    rows = _stream(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("gone"))
    folder = _drained(rows, spark, "update", lambda store: changes.upsert_each_batch(store, ["o_custkey"], "o_orderkey", "gone"))
    return changes.read_store(spark, folder, ["o_custkey"], "o_orderkey", "gone")


_EVENT_PATHS = {"error": "/Game/Config/a.ini", "view": "/Game/Maps/b.uasset", "click": "/Game/Source/c.cpp", "signup": "E:\\\\P\\\\INTERMEDIATE\\\\d.h", "purchase": "/Game/Source/e.Generated.h"}


@query("""WITH e AS (SELECT event_id, event_type, value > 5 AS present FROM events)
  SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN present THEN 'config' ELSE 'ignore' END WHEN 'view' THEN CASE WHEN present THEN 'asset' ELSE 'delete' END WHEN 'click' THEN CASE WHEN present THEN 'source' ELSE 'ignore' END ELSE 'ignore' END AS route FROM e""")
def event_routing(spark, d):
    path = F.lit("/Game/f.bin")
    for kind, p in _EVENT_PATHS.items():
        path = F.when(F.col("event_type") == kind, p.replace("\\\\", "\\")).otherwise(path)
    rows = table(spark, d, "events").select("event_id", path.alias("path"), (F.col("value") > 5).alias("exists"))
    return changes.routed(rows).select("event_id", "route")
