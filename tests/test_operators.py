"""Small cases, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import python_scalars as P
from weftline.functions import scalars as S
from weftline.operators import assets, build, checks, fold, graph, resolve, search, usages
from weftline.plans.api import Index
from weftline.sources import text as T
from weftline.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name,want", [("HTTPServer2", ["2", "p", "server", "t"]), ("snake_case", ["case", "snake"]), ("AActor", ["actor"]), ("", [])])
def test_identifier_tokens(spark, name, want):
    assert one(spark, S.identifier_tokens(F.lit(name))) == want


def test_ascii_folding_leaves_other_letters(spark):
    assert one(spark, S.lower_ascii(F.lit("ÄBc"))) == "Äbc"
    assert one(spark, S.compact_identifier(F.lit("A_b::Ñ c1"))) == "abc1"


def test_paths(spark):
    assert one(spark, S.normalize_path(F.lit("a\\b//c"))) == "a/b/c"
    assert one(spark, S.extension(F.lit("/x.y/File.CPP"))) == "cpp"
    assert one(spark, S.components_path(S.path_components(F.lit("/a//b/c")))) == "/a/b/c"
    assert one(spark, S.include_insert_path(F.lit("/p/Source/M/Public/Sub/T.h"))) == "Sub/T.h"
    assert one(spark, S.join_path(F.lit("a/"), F.lit("b"))) == "a/b"


@pytest.mark.parametrize("name,query,want", [("gamplay", "gmp", True), ("gxxmxxp", "gmp", False), ("abc", "ab", False), ("playercontroller", "plyrcon", True)])
def test_fuzzy(spark, name, query, want):
    assert one(spark, S.compact_fuzzy_match(F.lit(name), query)) is want


@pytest.mark.parametrize("name,prefix,want", [("GetActor", "get", 0), ("get_actor", "getac", 1), ("GetActor", "act", 3), ("GetActorLocation", "actorloc", 11), ("xyactz", "act", 42), ("zzz", "act", None)])
def test_completion_rank(spark, name, prefix, want):
    assert one(spark, S.completion_match_rank(F.lit(name), prefix)) == want


@pytest.mark.parametrize("line,want", [("foo = 1;", "write"), ("if (foo == 2)", "write"), ("foo(1)", "call"), ("class foo;", "read"), ("void A::foo(int x)", "definition"), ("UFUNCTION() void foo();", "declaration"), ("foo += 1", "write"), ("foo |= 1", "read"), ("return foo;", "read")])
def test_usage(spark, line, want):
    df = spark.createDataFrame([("p", 1, line)], "path string, line_number int, line_text string")
    assert [r["usage"] for r in usages.usage_lines(df, "path", "foo").collect()] == [want]


@pytest.mark.parametrize("line", ["// foo", 'x = "foo"', "foobar", "a_foo"])
def test_not_a_usage(spark, line):
    df = spark.createDataFrame([("p", 1, line)], "path string, line_number int, line_text string")
    assert usages.usage_lines(df, "path", "foo").count() == 0


def test_parameter_signature():
    assert P.parameter_signature("(int a = f(1, 2),  const FString&  b = TEXT(\"x,y\"))") == "(int a, const FString& b)"
    assert P.ordered_words_rank(["get", "actor", "location"], ["act", "loc"]) == 10
    assert P.matching_bracket("f(a(b)c)d", 1) == 7
    assert P.top_level_split("a<b,c>, d") == ["a<b,c>", "d"]


def test_closure_ends_on_cycles_and_keeps_the_least_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", None)], "src string, dst string")
    got = {(r["src"], r["dst"]): r["depth"] for r in graph.closure(e).collect()}
    assert got[("a", "a")] == 2 and got[("a", "c")] == 1 and ("x", None) not in got and len(got) == 9
    assert graph.closure(e.limit(0)).count() == 0
    assert {r["dst"] for r in graph.depend_files(e, spark.createDataFrame([("a",)], "src string"), recursive=False).collect()} == {"b", "c"}


def test_alias_target_stops(spark):
    a = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(6)], "alias string, target string")
    assert graph.alias_target(a, spark.createDataFrame([("t0",), ("q",)], "name string")).orderBy("name").collect()[1]["target"] == "t4"


def test_longest_prefix_has_no_boundary_check(spark):
    rows = spark.createDataFrame([("/a/bc/x",), ("/A/b",), ("/z",), (None,)], "path string")
    roots = spark.createDataFrame([("/a/b", 1), ("/a", 2)], "root string, m int")
    got = {r["path"]: r["m"] for r in resolve.longest_prefix(rows, "path", roots, "root", "m", fallback=9).collect()}
    assert got == {"/a/bc/x": 1, "/A/b": 1, "/z": 9, None: 9}


def test_include_target_prefers_exact_then_short(spark):
    files = spark.createDataFrame([(1, "x/long/Sub/A.h"), (2, "y/Sub/A.h"), (3, "q/A.h")], "target_id int, path string")
    wanted = spark.createDataFrame([("Sub/A.h",), ("q/A.h",)], "include_path string")
    assert {r["include_path"]: r["target_id"] for r in resolve.include_target(wanted, files).collect()} == {"Sub/A.h": 2, "q/A.h": 3}


def test_config_fold_semantics(spark):
    ops = [("a", 1, "", "x"), ("a", 2, "+", "y"), ("a", 3, "-", "x"), ("b", 1, "+", "z"), ("b", 2, "-", "z"), ("c", 1, "", "v"), ("c", 2, "!", ""), ("d", 1, "", "w" * 60)]
    df = spark.createDataFrame(ops, "name string, line int, op string, value string")
    got = {r["name"]: r["value"] for r in fold.config_fold(df, ["name"], ["line"]).collect()}
    assert got == {"a": "[Array x1] y", "b": "nil", "c": "nil", "d": "w" * 47 + "..."}
    assert [r["value"] for r in fold.config_history(df, ["name"], ["line"]).filter("name = 'a'").orderBy("step").collect()] == ["x", "[Array x2] y", "[Array x1] y"]


def test_throttle_is_moved_by_passed_events_only(spark):
    df = spark.createDataFrame([("p", t, t) for t in (0, 30, 60, 90, 110)], "k string, ts long, id int")
    assert sorted(r["id"] for r in fold.throttle(df, ["k"], "ts", 50, ["id"]).collect()) == [0, 60, 110]


def test_ini_and_build_rules(spark):
    df = spark.createDataFrame([("f", "; c\n[S]\nA=1=2\n+B = x\r\n[T]\n-C=y\nnoise")], "path string, text string")
    got = [(r["section"], r["name"], r["op"], r["value"], r["line"]) for r in T.ini_entries(T.lines(df, "path", "text")).orderBy("line").collect()]
    assert got == [("S", "A", "", "1=2", 3), ("S", "B", "+", "x", 4), ("T", "C", "-", "y", 6)]
    early = spark.createDataFrame([("f", "a = 1\n!Key\n!Gone=\n =x\n[open\n[o=1\n [S] \n # c\nb=2")], "path string, text string")
    got = [(r["section"], r["name"], r["op"], r["value"], r["line"]) for r in T.ini_entries(T.lines(early, "path", "text")).orderBy("line").collect()]
    assert got == [("Default", "a", "", "1", 1), ("Default", "Gone", "!", "", 3), ("Default", "[o", "", "1", 6), ("S", "b", "", "2", 9)]
    rules = spark.createDataFrame([("b", 'PublicDependencyModuleNames.AddRange(new string[] { "Core", "A" });\nPrivateDependencyModuleNames.Add("Z");')], "path string, text string")
    r = T.build_dependencies(rules, "path", "text").first()
    assert (r["public"], r["private"]) == (["A", "Core"], ["Z"])


def test_macros_tags_strings(spark):
    df = spark.createDataFrame([("f", '#define MAX(a, \\\n b) ((a)>(b))\n#define ONE 1\nUE_DEFINE_GAMEPLAY_TAG(TagA, "A.B")\nUE_DECLARE_GAMEPLAY_TAG_EXTERN(TagA)\nUE_DECLARE_GAMEPLAY_TAG_EXTERN(TagB)\n#include "x/y.h"')], "path string, text string")
    m = {r["name"]: (r["is_function_like"], r["detail"]) for r in T.macro_definitions(df, "path", "text").collect()}
    assert m == {"MAX": (True, "((a)>(b))"), "ONE": (False, "1")}
    assert {(r["identifier"], r["kind"]) for r in T.gameplay_tags(df, "path", "text").collect()} == {("TagA", "define"), ("TagB", "declare")}
    assert T.includes(df, "path", "text").first()["base_filename"] == "y.h"
    b = spark.createDataFrame([(bytearray(b"\x00\x01hello\xffab\x00world!"),)], "content binary")
    assert b.select(T.ascii_strings("content").alias("s")).first()["s"] == ["hello", "world!"]


def test_build_log_forms(spark):
    text = "C:/a/b.h:12: Error: bad\nD:\\x\\y.cpp(3,5): fatal error C1083: no file\nE:/z.cpp(0): warning C4: w\nE:/z.h:1: Note: n\n/home/a.c:1:2: error: no\nlinking"
    rows = T.lines(spark.createDataFrame([("log", text)], "path string, text string"), "path", "text")
    got = sorted((r["file_path"], r["line"], r["character"], r["severity"], r["source"], r["message"]) for r in T.build_diagnostics(rows).collect())
    assert got == [("C:/a/b.h", 11, 0, "error", "UHT", "bad"), ("D:/x/y.cpp", 2, 4, "error", "MSVC", "C1083: no file"), ("E:/z.cpp", 0, 0, "warning", "MSVC", "C4: w")]


def test_facts_of_files_and_kinds(spark):
    for path, want in [("a/B.HPP", True), ("P/ThirdParty/x.h", False), ("a/EXTERNAL/x.cpp", False), ("x.md", False), ("p/Framework/Libs/a.c", False), ("g.uproject", True)]:
        assert one(spark, T.text_eligible(F.lit(path))) is want, path
    assert [one(spark, S.kind_rank(F.lit(k))) for k in ("typedef", "interface", "Method", "field")] == [0, 2, 1, 2]
    assert [one(spark, S.is_member_like(F.lit(k))) for k in ("class", "UFunction", "field")] == [False, False, True]
    assert one(spark, S.compact_name(F.lit("A_b::C-d e"))) == "abc-de"
    assert [one(spark, T.worth_parsing(F.lit(t))) for t in ("class A;", "#include <x>", "x DECLARE_Y")] == [False, True, True]
    told = [("a.h", "void F();", "F", None), ("a.cpp", "void F() {", "F", None), ("a.CC", "void A::F()", "F", "A"), ("a.cc", "F()", "F", "A")]
    assert [one(spark, S.classify_location(*[F.lit(x).cast("string") for x in t])) for t in told] == ["declaration", "definition", "definition", "declaration"]


def test_tags_yield_in_their_own_file_and_delegates_may_nest(spark):
    df = spark.createDataFrame([("a", 'UE_DEFINE_GAMEPLAY_TAG(TagA, "A")'), ("b", "UE_DECLARE_GAMEPLAY_TAG_EXTERN(TagA)\nDECLARE_DELEGATE_OneParam(FDone, TFunction<void(int, int)>)")], "path string, text string")
    assert {(r["path"], r["kind"]) for r in T.gameplay_tags(df, "path", "text").collect()} == {("a", "define"), ("b", "declare")}
    assert [(r["macro"], r["name"]) for r in T.delegate_macros(df, "path", "text").collect()] == [("DECLARE_DELEGATE_OneParam", "FDone")]


def test_best_parent_by_module(spark):
    rows = [("a", "/Script/Engine.Actor", 0), ("a", "/Script/UMG.UserWidget", 1), ("b", "/Script/UnrealEd.X", 0), ("b", "/Script/Engine.Pawn", 1), ("c", "/Script/EngineSettings.Y", 1), ("c", "/Script/Engine.Z", 0)]
    got = assets.best_parent(spark.createDataFrame(rows, "asset string, path string, position int"), "asset")
    assert {r["asset"]: r["path"] for r in got.collect()} == {"a": "/Script/UMG.UserWidget", "b": "/Script/Engine.Pawn", "c": "/Script/EngineSettings.Y"}


def test_store_keeps_the_greatest_version_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "COMPACT_EVERY", 2)
    store = f"file://{tmp_path}/store"
    apply = changes.upsert_each_batch(store, ["k"], "v", "gone")
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v int, x string, gone boolean")
    now = lambda: sorted((r["k"], r["v"], r["x"]) for r in changes.read_store(spark, store, ["k"], "v", "gone").collect())
    apply(batch(("a", 5, "new", False), ("b", 2, "b", False), ("c", 1, "c", False)), 0)
    apply(batch(("a", 3, "old", False), ("b", 3, "", True)), 1)
    assert now() == [("a", 5, "new"), ("c", 1, "c")]
    apply(batch(("b", 2, "late", False), ("c", 2, "c2", False), ("d", 1, "d", False)), 2)
    apply(batch(("c", 2, "c2", False)), 2)
    assert now() == [("a", 5, "new"), ("c", 2, "c2")]


def test_paths_and_closures_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(400)] + [(1000, 999, "lost"), (2000, 2001, "x"), (2001, 2000, "y")]
    got = {r["id"]: (r["full_path"].count("/"), r["depth"]) for r in graph.hierarchy_paths(spark, spark.createDataFrame(chain, "id int, parent_id int, name string")).collect()}
    assert got == {i: (i, i) for i in range(400)}
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(60, 0), (3, 50), (70, 71)], "src int, dst int")
    want = {}
    for s in [*range(61), 70]:
        seen, front, depth = {}, {s}, 0
        while front:
            depth += 1
            front = {b for a in front for b in ([a + 1] if a < 60 else [0] if a == 60 else [71] if a == 70 else []) + ([50] if a == 3 else [])} - seen.keys()
            seen |= dict.fromkeys(front, depth)
        want |= {(s, d): n for d, n in seen.items()}
    rows = lambda df: {(r["src"], r["dst"]): r["depth"] for r in df.collect()}
    assert rows(graph.closure(edges)) == want
    assert rows(graph.closure(edges, None, 7)) == {k: n for k, n in want.items() if n <= 7}
    seeds = spark.createDataFrame([(5,), (70,)], "src int")
    assert rows(graph.closure(edges, seeds, 9)) == {k: n for k, n in want.items() if k[0] in (5, 70) and n <= 9}


def test_escalation_stops_at_a_full_page(spark):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "k int, name string")

    def never():
        raise AssertionError("the page was full")

    got = search.escalated([lambda: rows.filter("k < 2"), lambda: rows, never], ["k"], [F.col("k")], 4)
    assert [(r["k"], r["bucket"]) for r in got.collect()] == [(0, 0), (1, 0), (2, 1), (3, 1)]
    short = search.escalated([lambda: rows.filter("k < 2")], ["k"], [F.col("k")], 4)
    assert [r["k"] for r in short.collect()] == [0, 1]


def test_references_of_the_engine_are_skipped_where_the_project_has_enough(spark):
    reason = lambda **k: resolve.engine_skip_reason(**{"hits": 0, "paths": 0, "found_definition": False, "cursor_in_project": True, "scope": "global", "symbol_strong": False, "type_like": False, "identifier": False, "text_like": False, **k})
    assert reason(scope="member") == "scope_local" and reason() is None and reason(hits=99, cursor_in_project=False) is None
    assert reason(hits=24, found_definition=True) == "project_definition_dense" and reason(hits=4, paths=2, symbol_strong=True, type_like=True) == "unreal_type_project_hits"
    assert reason(hits=8, symbol_strong=True) == "sym_strong_project_hits" and reason(hits=16, identifier=True) == "identifier_project_hits"
    assert reason(hits=16, identifier=True, text_like=True) is None and reason(hits=9, paths=8) == "project_hits_dense" and reason(hits=39) is None
    project = spark.createDataFrame([("/p/A.h", 1), ("/p/a.h", 2)], "path string, line_number int")
    engine = spark.createDataFrame([("/e/b.h", 1), ("/p/A.h", 1)], "path string, line_number int")
    find = lambda skip: [(r["path"], r["source_rank"]) for r in resolve.federated_references(project, lambda: engine, ["path", "line_number"], [F.col("path"), F.col("line_number")], 10, skip).collect()]
    assert find(lambda hits, paths: "enough" if (hits, paths) == (2, 1) else None) == [("/p/A.h", 0), ("/p/a.h", 0)]
    assert find(lambda hits, paths: None) == [("/p/A.h", 0), ("/p/a.h", 0), ("/e/b.h", 1)]


def test_rules_turn_checks_on_and_set_severities(spark):
    rules = checks.read_rules('[linker]\ncheck_odr_class = false\nodr_function_severity = "hint"\ncheck_missing_def = true\n[own]\nx = 1')
    assert rules["finalize"]["max_per_line"] == 3 and rules["own"] == {"x": 1}
    found = spark.createDataFrame([(c,) for c in ("odr_function", "odr_class", "missing_def", "name_clash")], "check string")
    assert {r["check"]: r["severity"] for r in checks.by_rules(found, rules).collect()} == {"odr_function": "hint", "missing_def": "warning", "name_clash": "error"}
    assert checks.by_rules(found, checks.read_rules("[linker]\nenabled = false")).count() == 0


def test_versions_are_read_by_their_manifest(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/index"
    assert build.read_version(spark, folder) is None
    table = lambda n: {"files": spark.range(n).select(F.col("id").alias("path"))}
    build.write_version(table(3), folder, "a")
    first = build.read_version(spark, folder, "a")["files"]
    build.write_version(table(5), folder, "b")
    assert build.read_version(spark, folder, "a") is None and build.read_version(spark, folder, "b")["files"].count() == 5 and first.count() == 3
    monkeypatch.setattr(build, "SCHEMA_VERSION", build.SCHEMA_VERSION + 1)
    assert build.read_version(spark, folder, "b") is None


def test_brace_ranges(spark):
    df = spark.createDataFrame([("f", "class A {\n x\n}\nint g() {\n{\n}\n y")], "path string, text string")
    got = [(r["name"], r["start"], r["end"]) for r in resolve.brace_ranges(T.lines(df, "path", "text"), "path").orderBy("start").collect()]
    assert got == [("class A", 1, 3), ("int g()", 4, 7)]


def test_finalize_diagnostics(spark):
    rows = [("f", 1, c, s, "C", "m", i) for i, (c, s) in enumerate([(0, "warning"), (1, "error"), (8, "error"), (16, "error"), (24, "warning")])]
    df = spark.createDataFrame(rows, "file_path string, line int, character int, severity string, code string, message string, input_order int")
    got = checks.finalize_diagnostics(df, per_line=3, per_file=2).orderBy(F.col("input_order").asc_nulls_last()).collect()
    assert [r["input_order"] for r in got] == [1, 2, None] and got[-1]["message"] == "1 omitted"


def test_asset_names_with_and_without_prefix(spark):
    u = spark.createDataFrame([("/script/game.hero", "derived", "p1"), ("hero", "reference", "p2"), ("ahero", "function", "p2")], "lookup_key string, usage_kind string, asset_path string")
    names = spark.createDataFrame([("AHero",)], "name string")
    assert {(r["looked_up"], r["asset_path"]) for r in assets.asset_usages(u, names).collect()} == {("hero", "p1"), ("hero", "p2"), ("ahero", "p2")}


def test_upsert_and_cascade(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (4, "D")], "id int, v string")
    assert sorted(tuple(r) for r in build.upsert(base, new, ["id"], spark.createDataFrame([(3,)], "id int")).collect()) == [(1, "a"), (2, "B"), (4, "D")]
    edges = spark.createDataFrame([(1, 2), (2, 3)], "file_id int, resolved int")
    out = build.cascade_delete({"e": edges}, "file_id", spark.createDataFrame([(2,)], "id int"), {"e": "resolved"})
    assert [tuple(r) for r in out["e"].collect()] == [(1, None)]


@pytest.fixture(scope="module")
def index(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Index({
        "files": t([(1, "Game/Public/Hero.h", 1, 5), (2, "Game/Private/Hero.cpp", 1, 6)], "file_id int, path string, module_id int, mtime int"),
        "modules": t([(1, "Game", "Game")], "module_id int, module_name string, root_path string"),
        "classes": t([(1, "AHero", None, "AActor", "Game/Public/Hero.h", 3, 9, "class", "Game"), (2, "AActor", None, None, "Engine/Actor.h", 1, 5, "class", "Engine")], "class_id int, name string, namespace string, base_class string, path string, line_number int, end_line_number int, symbol_type string, module_name string"),
        "members": t([(1, 1, "Jump", "function", "public", "(int n = 2)", "void", "Game/Public/Hero.h", 4), (2, 2, "Tick", "function", "protected", "()", "void", "Engine/Actor.h", 2), (3, 2, "Secret", "property", "private", None, None, "Engine/Actor.h", 3)], "member_id int, class_id int, name string, type string, access string, detail string, return_type string, path string, line_number int"),
        "inheritance": t([("AHero", "AActor")], "child string, parent string"),
        "includes": t([("Game/Private/Hero.cpp", "Game/Public/Hero.h")], "src string, dst string"),
        "calls": t([("Jump", "Game/Private/Hero.cpp", 7)], "name string, path string, line_number int"),
        "lines": t([("Game/Private/Hero.cpp", 7, "Jump();"), ("Game/Private/Hero.cpp", 8, "// Jump")], "path string, line_number int, line_text string"),
        "macros": t([("JUMP_MAX",)], "name string"),
    }).with_projections()


def test_requests(index):
    names = lambda df, c="name": [r[c] for r in df.collect()]
    assert names(index.fast_find("hero"))[0] == "AHero"
    assert names(index.search_symbols("AHero")) == ["AHero"]
    assert names(index.get_class_members_recursive("AHero")) == ["Jump", "Secret", "Tick"]
    assert names(index.visible_members("AHero", "AHero2")) == ["Jump"]
    assert names(index.get_recursive_derived_classes("AActor")) == ["AHero"]
    assert names(index.goto_definition("Tick", "AHero"), "path") == ["Engine/Actor.h"]
    assert names(index.get_signature_help("Jump"), "signature") == ["(int n)"]
    assert names(index.search_files("hero.h"), "path") == ["Game/Public/Hero.h"]
    assert names(index.get_depend_files("Game/Private/Hero.cpp"), "path") == ["Game/Public/Hero.h"]
    places = lambda *a, **k: [(r["usage"], r["path"], r["line_number"]) for r in index.find_symbol_usages(*a, **k).collect()]
    assert places("Jump") == places("Jump", "AHero") == [("declaration", "Game/Public/Hero.h", 4), ("call", "Game/Private/Hero.cpp", 7)]
    assert places("Jump", "AActor") == [] and places("Jump", current="Game/Private/Hero.cpp", local=(1, 7)) == [("call", "Game/Private/Hero.cpp", 7)]
    assert T.engine_roots("/u/") == ["/u/Engine/Source", "/u/Engine/Plugins", "/u/Engine/Config", "/u/Engine/Shaders"]
    assert names(index.get_completions("ju", "AHero")) == ["Jump", "JUMP_MAX"]
    assert names(index.global_find("Jump();"), "kind") == ["function", "text"]
    assert index.get_diagnostics().count() == 0


def test_usages_without_a_limit(spark, index):
    """Calls elsewhere, however many come first, push out none of a candidate file; overrides can be left out."""
    many = spark.range(5000).select(F.lit("Tick").alias("name"), F.lit("A.cpp").alias("path"), F.col("id").cast("int").alias("line_number"))
    calls = many.union(spark.createDataFrame([("Tick", "Engine/Actor.h", 9)], many.schema))
    members = spark.createDataFrame([(4, 1, "Tick", "function", "public", "()", "void", "Game/Public/Hero.h", 5)], index["members"].schema)
    x = Index({**index.tables, "calls": calls, "members": index["members"].union(members)}).with_projections()
    usages_of = lambda **k: [(r["usage"], r["path"], r["line_number"]) for r in x.find_symbol_usages("Tick", "AActor", **k).collect()]
    own, over, call = ("declaration", "Engine/Actor.h", 2), ("override", "Game/Public/Hero.h", 5), ("call", "Engine/Actor.h", 9)
    assert usages_of() == [own, over]
    assert usages_of(limit=None) == [own, over, call]
    assert usages_of(limit=None, overridden=False) == [own, call]


def test_exact_type_suppresses_others(index):
    assert set(r["name"] for r in search.suppress_for_exact_type(index["search_symbols"], "AHero").collect()) == {"AHero"}


def _package():
    import struct

    text = lambda s: struct.pack("<i", len(s) + 1) + s.encode() + b"\0"
    names = ["/Script/Engine", "Class", "Package", "Actor", "Function", "Jump", "Hero_C", "None"]
    head = lambda n, i, e: struct.pack("<Iiiiiii", 0x9E2A83C1, -7, 0, 522, 0, 0, 0) + text("None") + struct.pack("<Iii", 0x80000000, len(names), n) + struct.pack("<ii", 0, 0) + struct.pack("<iiii", 1, e, 3, i)
    n = len(head(0, 0, 0))
    table = b"".join(text(x) + b"\0\0\0\0" for x in names)
    rows = struct.pack("<qqiqq", 0, 2, 0, 0, 7) + struct.pack("<qqiqq", 0, 1, -1, 3, 7) + struct.pack("<qqiqq", 0, 4, -2, 5, 7)
    i = n + len(table)
    e = i + len(rows)
    return head(n, i, e) + table + rows + struct.pack("<iiiiqI", -2, -2, 0, 0, 6, 0) + bytes(120)


def test_packages(spark):
    from weftline.sources.packages import packages

    df = spark.createDataFrame([("/x/Hero.uasset", bytearray(_package())), ("/x/bad.uasset", bytearray(b"nothing")), ("/x/cut.uasset", bytearray(_package()[:60]))], "path string, content binary")
    got = {r["path"]: r for r in packages(df).collect()}
    hero = got["/x/Hero.uasset"]
    assert hero["imports"] == ["/Script/Engine", "/Script/Engine.Actor"] and hero["functions"] == ["/Script/Engine.Actor.Jump"]
    assert hero["parent_class"] == "/Script/Engine.Actor" and hero["error"] is None
    assert got["/x/bad.uasset"]["error"] and got["/x/cut.uasset"]["error"]


def test_plugin_audit(spark):
    s = spark.createDataFrame([("/e/Engine/Plugins/A/B/Source/x.h",), ("/e/Engine/Plugins/A/B/Source/y.h",), ("/e/Engine/Plugins/C/Source/z.h",), ("/e/q.h",)], "path string")
    r = checks.plugin_audit(s, spark.createDataFrame([("A/B",), ("D",)], "plugin string")).first()
    assert (r["n_symbols"], r["n_plugin_symbols"], r["n_known"], r["n_on_disk"]) == (4, 3, 2, 2)
    assert (r["missing_sample"], r["extra_sample"], r["top_plugins"]) == (["D"], ["C"], ["A/B:2", "C:1"])
