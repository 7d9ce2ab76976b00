"""Queries of the operators that build, keep and search an index, over files made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import build, checks, graph, resolve, search
from ..sources import text as T
from .catalog import low, table
from .queries import query

# ---------------------------------------------------------------- files


def _files(spark, d) -> DataFrame:
    """Parts as files of five modules."""
    part = table(spark, d, "part")
    end = F.when(F.col("p_partkey") % 4 == 0, ".cpp").when(F.col("p_partkey") % 4 == 1, ".uasset").otherwise(".h")
    path = F.concat(F.lit("/Game/Source/M"), (F.col("p_size") % 5).cast("string"), F.lit("/Public/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("")), end)
    files = part.select(F.col("p_partkey").alias("file_id"), path.alias("path"), (F.col("p_size") % 5).cast("long").alias("module_id"))
    modules = spark.range(4).select(F.col("id").alias("module_id"), F.concat(F.lit("M"), F.col("id").cast("string")).alias("module_name"))
    return build.search_files(files, modules)


_FILES = f"""f0 AS (SELECT p_partkey AS file_id, '/Game/Source/M' || (p_size % 5) || '/Public/' || replace(p_type, ' ', '/') || '/' || replace(p_name, ' ', '') || CASE p_partkey % 4 WHEN 0 THEN '.cpp' WHEN 1 THEN '.uasset' ELSE '.h' END AS path, p_size % 5 AS module_id FROM part),
  files AS (SELECT *, CASE WHEN module_id < 4 THEN 'M' || module_id END AS module_name, {low("path")} AS path_lc, {low("list_extract(string_split(path, '/'), -1)")} AS basename_lc, regexp_extract(path, '\\.([^./]+)$', 1) AS ext FROM f0)"""


@query(f"WITH {_FILES} SELECT file_id, path, module_name, basename_lc, ext, ext <> 'uasset' AS is_source, ext = 'h' AS is_header, ext <> 'uasset' AS is_searchable_text FROM files")
def file_projection(spark, d):
    return _files(spark, d).select("file_id", "path", "module_name", "basename_lc", "ext", "is_source", "is_header", "is_searchable_text")


@query(f"""WITH {_FILES}, b AS (SELECT *, CASE WHEN basename_lc = 'small' THEN 0 WHEN starts_with(basename_lc, 'small') THEN 1 WHEN contains(basename_lc, 'small') THEN 2 WHEN contains(path_lc, 'small') THEN 3 END AS bucket FROM files WHERE ext <> 'uasset')
  SELECT file_id, path, bucket FROM b WHERE bucket IS NOT NULL ORDER BY bucket, length(path), path, file_id LIMIT 300""")
def file_buckets(spark, d):
    return search.bucketed_files(_files(spark, d), "Small", 300).select("file_id", "path", "bucket")


@query(f"WITH {_FILES} SELECT file_id, path FROM files WHERE ext <> 'uasset' AND contains(path_lc, 'public') AND contains(path_lc, 'widget') ORDER BY length(basename_lc), basename_lc, path_lc, file_id LIMIT 250")
def file_fuzzy(spark, d):
    return search.fuzzy_files(_files(spark, d), " Public  WIDGET", 250).select("file_id", "path")


@query(f"""WITH {_FILES}, h AS (SELECT file_id, path, regexp_extract(path, '/Public/(.*)$', 1) AS insert_path, basename_lc FROM files WHERE ext = 'h'),
  r AS (SELECT *, CASE WHEN starts_with({low("insert_path")}, 'sma') THEN 0 WHEN starts_with(basename_lc, 'sma') THEN 1 WHEN contains({low("insert_path")}, 'sma') THEN 2 END AS rank FROM h)
  SELECT insert_path, path, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, length(insert_path), insert_path, path LIMIT 80""")
def include_completion(spark, d):
    return search.complete_includes(_files(spark, d), "Sma").select("insert_path", "path", "rank")


_SCAN = """WITH d AS (SELECT doc_id, lang, length(text) AS b, lower(text) AS t FROM documents),
  s1 AS (SELECT * FROM (SELECT *, coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM d WHERE doc_id % 10 = 0 ORDER BY doc_id LIMIT 20)) WHERE before < 60000),
  h1 AS (SELECT * FROM s1 WHERE contains(t, 'license') ORDER BY doc_id LIMIT 5),
  s2 AS (SELECT * FROM (SELECT *, coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM d WHERE lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM s1) ORDER BY doc_id LIMIT 100)) WHERE before < 200000),
  h2 AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM s2 WHERE contains(t, 'license')),
  k2 AS (SELECT * FROM h2 WHERE r <= least(8, 30 - (SELECT count(*) FROM h1))),
  s3 AS (SELECT * FROM (SELECT *, coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s1) AND doc_id NOT IN (SELECT doc_id FROM s2) ORDER BY doc_id LIMIT 300)) WHERE before < 10000000),
  h3 AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM s3 WHERE contains(t, 'license')),
  k3 AS (SELECT * FROM h3 WHERE r <= least(40, 30 - (SELECT count(*) FROM h1) - (SELECT count(*) FROM k2)))
  SELECT doc_id, 'near' AS phase, (b - length(replace(t, 'license', ''))) // 7 AS matches FROM h1 UNION ALL SELECT doc_id, 'project', (b - length(replace(t, 'license', ''))) // 7 FROM k2 UNION ALL SELECT doc_id, 'engine', (b - length(replace(t, 'license', ''))) // 7 FROM k3"""


@query(_SCAN)
def phased_scan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    phases = [("near", F.col("doc_id") % 10 == 0, (20, 60_000, 5)), ("project", F.col("lang") == "fr", (100, 200_000, 8)), ("engine", F.lit(True), (300, 10_000_000, 40))]
    return search.phased_scan(docs, "doc_id", F.length("text").cast("long"), "text", "License", phases, 30)


@query("SELECT count(*) AS n, 5 AS paths, count(*) FILTER (WHERE user_id % 4 < 2) AS high_quality FROM events")
def result_stats(spark, d):
    path = F.concat(F.lit("/Game/"), F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    quality = F.when(F.col("user_id") % 4 == 0, "exact_symbol").when(F.col("user_id") % 4 == 1, "normalized_symbol").otherwise("other")
    return checks.result_stats(table(spark, d, "events").select(path.alias("path"), quality.alias("quality")), "path", "quality")


# ---------------------------------------------------------------- names and lines


@query("SELECT p_partkey, lower(replace(replace(replace(p_name || '::b_' || p_type, '_', ''), ':', ''), ' ', '')) AS compact FROM part")
def compact_names(spark, d):
    return table(spark, d, "part").select("p_partkey", S.compact_name(F.concat("p_name", F.lit("::b_"), "p_type")).alias("compact"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND (p_size % 2 = 1 OR p_partkey % 5 = 0) THEN 'definition' ELSE 'declaration' END AS place FROM part""")
def classify_locations(spark, d):
    path = F.when(F.col("p_partkey") % 3 == 0, "/a/B.CPP").otherwise("/a/b.h")
    owner = F.when(F.col("p_size") % 2 == 0, "Owner")
    context = F.when(owner.isNull(), "void Run(int x)").when(F.col("p_partkey") % 5 == 0, "void Owner::Run(int x) {").otherwise("Run(1);")
    return table(spark, d, "part").select("p_partkey", S.classify_location(path, context, F.lit("Run"), owner).alias("place"))


def _sources(spark, d) -> DataFrame:
    """A small header made of every part."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    text = F.concat(
        F.lit("#define "), name, F.lit("_MAX(a, \\\n  b) ((a) + (b))\n#define ONE_"), F.col("p_size").cast("string"), F.lit(" 1\nclass GAME_API C"), F.col("p_partkey").cast("string"), F.lit(" : public Base\n{\n  int Hidden = 3;\npublic:\n  void Run"),
        F.col("p_size").cast("string"), F.lit("(int x);\n  // Lost(1);\n  FString Name;\n};\nint main() {\n  Run"), F.col("p_size").cast("string"), F.lit('(1); print("No(2)");\n  if (x) return;\n}\n'),
    )
    return table(spark, d, "part").select("p_partkey", text.alias("text"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') || '_MAX' AS name, true AS is_function_like, 'a, b' AS parameters, '((a) + (b))' AS detail FROM part UNION ALL SELECT p_partkey, 'ONE_' || p_size, false, '', '1' FROM part")
def macro_parse(spark, d):
    return T.macro_definitions(_sources(spark, d), "p_partkey", "text")


@query("SELECT p_partkey, 'Run' || p_size AS name, 8 AS line FROM part UNION ALL SELECT p_partkey, 'main', 12 FROM part UNION ALL SELECT p_partkey, 'Run' || p_size, 13 FROM part UNION ALL SELECT p_partkey, 'print', 13 FROM part")
def call_parse(spark, d):
    return T.calls(_sources(spark, d), "p_partkey", "text")


@query("SELECT p_partkey, 'C' || p_partkey AS class_name, 'field' AS kind, 'Hidden' AS name, 'private' AS access, 6 AS line FROM part UNION ALL SELECT p_partkey, 'C' || p_partkey, 'method', 'Run' || p_size, 'public', 8 FROM part UNION ALL SELECT p_partkey, 'C' || p_partkey, 'field', 'Name', 'public', 10 FROM part")
def member_parse(spark, d):
    return T.members(_sources(spark, d), "p_partkey", "text")


@query("SELECT p_partkey, replace(p_brand, '#', '') || ',Core' AS public, 'Z' || p_size AS private FROM part")
def build_rules_parse(spark, d):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    text = F.concat(F.lit('PublicDependencyModuleNames.AddRange(new string[] { "'), brand, F.lit('", "Core" });\nPublicDependencyModuleNames.Add("Core");\nPrivateDependencyModuleNames.Add("Z'), F.col("p_size").cast("string"), F.lit('");'))
    rows = T.build_dependencies(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return rows.select("p_partkey", F.array_join("public", ",").alias("public"), F.array_join("private", ",").alias("private"))


@query("SELECT p_partkey, p_name || '|' || p_brand || '-' || p_size AS strings FROM part WHERE p_name NOT LIKE '%|%'")
def ascii_string_scan(spark, d):
    content = F.concat(F.unhex(F.lit("0001")), F.encode("p_name", "UTF-8"), F.unhex(F.lit("FF41420007")), F.encode(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")), "UTF-8"), F.unhex(F.lit("0A")))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.ascii_strings(content), "|").alias("strings"))


@query("""WITH s AS (SELECT doc_id, '/d/' || CASE WHEN doc_id % 13 = 0 THEN 'ThirdParty/' ELSE '' END || doc_id || '.cpp' AS path, text FROM documents),
  o AS (SELECT path, i AS line_number, regexp_replace(parts[i], '\\r+$', '') AS line_text FROM (SELECT path, string_split(text, chr(10)) AS parts FROM s WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))
  SELECT * FROM o UNION ALL SELECT path, 1, 'new ' || doc_id FROM s WHERE doc_id % 7 = 0 AND doc_id % 13 <> 0 UNION ALL SELECT path, 2, 'line' FROM s WHERE doc_id % 7 = 0 AND doc_id % 13 <> 0""")
def text_index_sync(spark, d):
    name = F.concat(F.lit("/d/"), F.when(F.col("doc_id") % 13 == 0, "ThirdParty/").otherwise(""), F.col("doc_id").cast("string"), F.lit(".cpp"))
    docs = table(spark, d, "documents").select("doc_id", name.alias("path"), "text")
    changed = docs.filter("doc_id % 7 = 0").select(F.replace("path", F.lit("/d/"), F.lit("\\d\\")).alias("path"), F.concat(F.lit("new "), F.col("doc_id").cast("string"), F.lit("\nline")).alias("text"))
    return build.sync_lines(T.lines(docs, "path", "text"), changed, docs.filter("doc_id % 11 = 0 and doc_id % 7 <> 0").select("path"))


# ---------------------------------------------------------------- keeping tables


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'F' THEN 'seen' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey FROM orders")
def touch_seen(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    seen = base.filter("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", "seen").alias("o_orderstatus"), (-F.col("o_custkey")).alias("o_custkey"))
    return build.touch(base, seen, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("""WITH gone AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1)
  SELECT 'customer' AS kind, c_custkey AS k, c_nationkey AS owner, CASE WHEN c_custkey % 25 NOT IN (SELECT id FROM gone) THEN c_custkey % 25 END AS bound FROM customer WHERE c_nationkey NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL FROM supplier WHERE s_nationkey NOT IN (SELECT id FROM gone)""")
def cascade(spark, d):
    customer = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("owner"), (F.col("c_custkey") % 25).alias("bound"))
    supplier = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("owner"))
    gone = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    kept = build.cascade_delete({"customer": customer, "supplier": supplier}, "owner", gone, {"customer": "bound"})
    return kept["customer"].unionByName(kept["supplier"], allowMissingColumns=True)


def _parsed(spark, d) -> DataFrame:
    """Orders as files with one class each, whose members are the order's lines."""
    item = table(spark, d, "lineitem").groupBy(F.col("l_orderkey")).agg(
        F.collect_list(F.struct(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_linenumber") % 3 == 0, "enum_item").otherwise("property").alias("type"), F.col("l_linenumber").cast("int").alias("line"))).alias("members")
    )
    c = F.struct(F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("class_name"), F.lit("N").alias("namespace"), F.array(F.lit("Base"), F.lit("IFace")).alias("base_classes"), F.lit("class").alias("symbol_type"), F.lit(3).alias("line"), F.lit(9).alias("end_line"), "members")
    return item.select(F.concat(F.lit("/o/"), F.col("l_orderkey").cast("string")).alias("path"), F.struct(F.array(c).alias("classes")).alias("data"))


@query("""WITH m AS (SELECT '/o/' || l_orderkey AS path, 'C' || l_orderkey AS class_name, 'm' || l_linenumber AS name, l_linenumber AS line FROM lineitem)
  SELECT path, class_name, name, CASE WHEN line % 3 = 0 THEN 'value' ELSE 'member' END AS kind, line FROM m UNION ALL SELECT DISTINCT path, class_name, 'Base', 'parent', 0 FROM m UNION ALL SELECT DISTINCT path, class_name, 'IFace', 'parent', 0 FROM m UNION ALL SELECT DISTINCT path, class_name, class_name, 'class', 3 FROM m""")
def shred(spark, d):
    p = _parsed(spark, d)
    members = build.shred_members(p).select("path", "class_name", "name", F.lit("member").alias("kind"), "line")
    values = build.shred_enum_values(p).select("path", F.col("enum_name").alias("class_name"), "name", F.lit("value").alias("kind"), F.col("line_number").alias("line"))
    parents = build.shred_inheritance(p).select("path", F.col("child").alias("class_name"), F.col("parent").alias("name"), F.lit("parent").alias("kind"), F.lit(0).alias("line"))
    classes = build.shred_classes(p).select("path", F.col("name").alias("class_name"), "name", F.lit("class").alias("kind"), F.col("line_number").alias("line"))
    return members.unionByName(values).unionByName(parents).unionByName(classes)


@query("""WITH t AS (SELECT c_mktsegment AS name, min(c_custkey) AS id FROM customer GROUP BY 1),
  e AS (SELECT o_orderkey AS child_id, CASE o_custkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'gone' END AS parent_name, -1 AS parent_id FROM orders)
  SELECT child_id, parent_name, CASE WHEN child_id % 4 = 0 OR parent_name IN ('MACHINERY', 'gone') THEN (SELECT id FROM t WHERE t.name = parent_name) ELSE parent_id END AS parent_id FROM e""")
def resolve_incremental(spark, d):
    name = F.when(F.col("o_custkey") % 3 == 0, "BUILDING").when(F.col("o_custkey") % 3 == 1, "MACHINERY").otherwise("gone")
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("child_id"), name.alias("parent_name"), F.lit(-1).cast("long").alias("parent_id"))
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    changed = edges.filter("child_id % 4 = 0").select("child_id")
    return build.resolve_again(edges, targets, changed, spark.createDataFrame([("MACHINERY",), ("gone",)], "name string"))


@query("SELECT c_custkey, c_name, 100 - c_custkey % 100 AS ord FROM customer WHERE c_custkey % 9 = 0")
def ordered_values(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    return resolve.with_order(customer, customer.filter("c_custkey % 9 = 0").withColumn("ord", 100 - F.col("c_custkey") % 100), "c_custkey", "ord")


# ---------------------------------------------------------------- includes and graphs


def _includes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nations as headers of their region's module; each includes two others, every third one by name only."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    files = nation.select(F.col("k").alias("target_id"), F.concat(F.col("n_name"), F.lit(".h")).alias("basename"), F.col("n_regionkey").alias("target_module"), F.concat(F.lit("/M"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name", F.lit(".h")).alias("path"))
    pairs = nation.select("k", F.col("n_regionkey").alias("module_id"), F.explode(F.array(F.lit(1), F.lit(7))).alias("step")).withColumn("to", (F.col("k") + F.col("step")) % 25)
    named = pairs.join(files, F.col("to") == F.col("target_id"))
    unknown = (F.col("k") + F.col("step")) % 3 == 0
    return named.select(F.col("k").alias("file_id"), F.when(~unknown, F.col("to")).alias("resolved_file_id"), F.concat(F.lit("Sub/"), "basename").alias("include_path"), F.col("basename").alias("base_filename"), "module_id"), files


_INCLUDES = "e AS (SELECT n_nationkey AS src, (n_nationkey + s) % 25 AS dst, s FROM nation, (VALUES (1), (7)) AS v(s)), f AS (SELECT n_nationkey AS target_id, n_name || '.h' AS basename, n_regionkey AS target_module, '/M' || n_regionkey || '/' || n_name || '.h' AS path FROM nation)"


@query(f"""WITH RECURSIVE {_INCLUDES}, c AS (SELECT n_nationkey AS src, n_nationkey AS dst, 0 AS depth FROM nation WHERE n_nationkey < 2 UNION SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON c.dst = e.src WHERE c.depth < 25)
  SELECT src, dst, min(depth) AS depth FROM c GROUP BY src, dst""")
def include_reach(spark, d):
    includes, files = _includes(spark, d)
    return graph.reachable_with_fallback(includes, files, table(spark, d, "nation").filter("n_nationkey < 2").select(F.col("n_nationkey").alias("src")))


@query(f"WITH {_INCLUDES} SELECT src AS file_id, 'Sub/' || basename AS include_path, target_id, 1 AS rank FROM e JOIN f ON f.target_id = e.dst WHERE (src + s) % 3 = 0")
def include_by_name(spark, d):
    includes, files = _includes(spark, d)
    return resolve.include_fallback(includes.filter("resolved_file_id is null"), files)


@query(f"WITH {_INCLUDES} SELECT regexp_extract(path, '/(M.*)$', 1) AS include_path, target_id, path FROM f UNION ALL SELECT basename, target_id, path FROM f")
def include_targets(spark, d):
    _, files = _includes(spark, d)
    wanted = files.select(F.regexp_extract("path", "/(M.*)$", 1).alias("include_path")).unionByName(files.select(F.col("basename").alias("include_path")))
    return resolve.include_target(wanted, files.select("target_id", "path"))


@query("""WITH e AS (SELECT n_nationkey AS src, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS dst FROM nation),
  c AS (SELECT src, src AS cur, 0 AS depth FROM e), w AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT src, dst, 1 AS depth FROM e WHERE dst IS NOT NULL UNION ALL SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON r.dst = e.src WHERE e.dst IS NOT NULL) SELECT * FROM r))
  SELECT s_suppkey AS member_id, s_nationkey AS class_id, depth FROM supplier JOIN w ON s_nationkey = src WHERE dst = 1 AND s_suppkey % 2 = 0""")
def override_members(spark, d):
    edges = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 2)).alias("dst"))
    members = table(spark, d, "supplier").select(F.col("s_suppkey").alias("member_id"), F.col("s_nationkey").alias("class_id"), F.when(F.col("s_suppkey") % 2 == 0, "Run").otherwise("Stop").alias("name"))
    return graph.overrides(edges, spark.createDataFrame([(1,)], "src long"), members, "Run").select("member_id", "class_id", "depth")


@query("""WITH a AS (SELECT n_nationkey AS alias, least(n_nationkey + 1 + n_nationkey % 3, 24) AS target FROM nation WHERE n_nationkey < 24),
  s AS (SELECT n_nationkey AS n0, coalesce(a.target, n_nationkey) AS n1 FROM nation LEFT JOIN a ON alias = n_nationkey),
  t AS (SELECT n0, coalesce(a.target, n1) AS n2 FROM s LEFT JOIN a ON alias = n1), u AS (SELECT n0, coalesce(a.target, n2) AS n3 FROM t LEFT JOIN a ON alias = n2)
  SELECT n0 AS name, coalesce(a.target, n3) AS target FROM u LEFT JOIN a ON alias = n3""")
def alias_targets(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    aliases = nation.filter("k < 24").select(F.col("k").alias("alias"), F.least(F.col("k") + 1 + F.col("k") % 3, F.lit(24)).alias("target"))
    return graph.alias_target(aliases, nation.select(F.col("k").alias("name")))
