"""The query interface: one method a request, each a lazy plan over the index tables.

``Index`` holds DataFrames by name. Only the tables that a request reads need to be there:

files(file_id, path, module_id, mtime) - modules(module_id, module_name, type, scope, root_path, owner_name)
components(name, display_name, type, owner_name, root_path)
classes(class_id, name, namespace, base_class, path, line_number, end_line_number, symbol_type, module_name)
members(member_id, class_id, name, type, access, is_static, detail, return_type, line_number, path)
enum_values(enum_name, name, path, line_number) - inheritance(child, parent) - includes(src, dst) as paths
calls(name, path, line_number) - lines(path, line_number, line_text) - macros(name, ...)
assets(asset_path, parent_class) - references(asset_path, referenced) - functions(asset_path, function_name)
config(path, layer, section, name, op, value, line)
and, made by ``with_projections``, search_files and search_symbols.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assets, build, checks, fold, graph, resolve, search, usages


@dataclass
class Index:
    """Index tables by name; a request that needs a missing table fails with its name."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def with_projections(self) -> Index:
        """The index with search_files and search_symbols built from files, modules, classes and members."""
        t = self.tables
        classes = t["classes"].select((F.col("class_id") * 2).alias("symbol_id"), F.col("symbol_type").alias("kind"), "name", F.col("namespace").alias("owner_name"), "module_name", "path", "line_number")
        owners = t["classes"].select("class_id", F.col("name").alias("owner_name"), "module_name")
        members = t["members"].join(owners, "class_id").select((F.col("member_id") * 2 + 1).alias("symbol_id"), F.col("type").alias("kind"), "name", "owner_name", "module_name", "path", "line_number")
        return Index({**t, "search_files": build.search_files(t["files"], t["modules"]), "search_symbols": build.search_symbols(classes.unionByName(members))})

    # ------------------------------------------------------------ files and modules

    def get_files_in_modules(self, modules: list[str], extensions: list[str] | None = None, path_part: str | None = None) -> DataFrame:
        rows = self["search_files"].filter(F.col("module_name").isin(modules))
        if extensions:
            rows = rows.filter(F.col("ext").isin([e.lower().lstrip(".") for e in extensions]))
        if path_part:
            rows = rows.filter(F.col("path").contains(path_part))
        return rows.select("path", "module_name").orderBy("path")

    def get_files_in_module(self, module: str) -> DataFrame:
        return self.get_files_in_modules([module])

    def get_depend_files(self, path: str, recursive: bool = True, game_only: bool = False) -> DataFrame:
        start = self["files"].filter(F.col("path") == path).select(F.col("path").alias("src"))
        rows = graph.depend_files(self["includes"], start, recursive).select(F.col("dst").alias("path"))
        return (rows.filter(~S.lower_ascii("path").contains("/engine/")) if game_only else rows).orderBy("path")

    def search_files(self, pattern: str, limit: int | None = 100) -> DataFrame:
        """Base names first; whole paths only if base names give fewer than fifty. Without a limit all files that match."""
        low = pattern.lower()
        names = self["search_files"].filter(F.col("basename_lc").contains(low)).select("path", F.lit(0).alias("bucket"))
        paths = self["search_files"].filter(F.col("path_lc").contains(low) & ~F.col("basename_lc").contains(low)).select("path", F.lit(1).alias("bucket"))
        enough = names.agg((F.count(F.lit(1)) >= 50).alias("__enough"))
        found = names.unionByName(paths.crossJoin(F.broadcast(enough)).filter("not __enough").drop("__enough")).orderBy("bucket", "path")
        return found if limit is None else found.limit(limit)

    search_files_by_path_part = search_files

    def search_files_in_modules(self, modules: list[str], pattern: str, limit: int | None = 100) -> DataFrame:
        """Files of the modules by path; without a limit all that match."""
        found = self["search_files"].filter(F.col("module_name").isin(modules) & F.col("path_lc").contains(pattern.lower())).select("path", "module_name").orderBy("path")
        return found if limit is None else found.limit(limit)

    def get_target_files(self) -> DataFrame:
        return self["search_files"].filter(F.col("basename_lc").endswith(".target.cs")).select("path").orderBy("path")

    def get_program_files(self) -> DataFrame:
        return self["search_files"].filter(F.col("path_lc").contains("/programs/")).select("path").orderBy("path")

    def get_all_ini_files(self) -> DataFrame:
        return self["search_files"].filter(F.col("ext") == "ini").select("path").orderBy("path")

    def get_all_file_paths(self) -> DataFrame:
        return self["files"].select("path").orderBy("path")

    def get_all_files_metadata(self) -> DataFrame:
        return self["files"].join(self["modules"].select("module_id", "module_name"), "module_id", "left").select("path", "mtime", "module_name").orderBy("path")

    def get_modules(self) -> DataFrame:
        return self["modules"].orderBy("module_name")

    def get_module_names(self) -> DataFrame:
        return self["modules"].select("module_name").distinct().orderBy("module_name")

    def get_module_by_name(self, name: str) -> DataFrame:
        return self["modules"].filter(F.col("module_name") == name).orderBy("module_id").limit(1)

    def get_module_id_by_name(self, name: str) -> DataFrame:
        return self.get_module_by_name(name).select("module_id")

    def get_module_root_path(self, name: str) -> DataFrame:
        return self.get_module_by_name(name).select("root_path")

    def search_modules(self, prefix: str, limit: int = 100) -> DataFrame:
        return self["modules"].filter(S.lower_ascii("module_name").contains(prefix.lower())).orderBy(F.length("module_name"), "module_name").limit(limit)

    def get_directories_in_module(self, name: str) -> DataFrame:
        return self["search_files"].filter(F.col("module_name") == name).select(S.parent_path("path").alias("directory")).distinct().orderBy("directory")

    def get_module_files_by_name_and_root(self, name: str, root: str) -> DataFrame:
        return self["search_files"].filter((F.col("module_name") == name) & F.col("path").startswith(root)).select("path").orderBy("path")

    def get_module_dirs_by_name_and_root(self, name: str, root: str) -> DataFrame:
        return self.get_module_files_by_name_and_root(name, root).select(S.parent_path("path").alias("directory")).distinct().orderBy("directory")

    def get_components(self) -> DataFrame:
        return self["components"].orderBy("name")

    load_component_data = get_components

    # ------------------------------------------------------------ symbols

    def search_symbols(self, pattern: str, limit: int = 50, offset: int = 0) -> DataFrame:
        if not pattern:
            return search.with_limit(self["search_symbols"].filter(~F.col("name").startswith("(")), [F.col("name_lc"), F.col("symbol_id")], limit, offset)
        return search.fast_find(self["search_symbols"], self["search_files"].limit(0), pattern, limit, offset)

    def search_class_symbols(self, pattern: str, limit: int = 50) -> DataFrame:
        return search.bucketed_symbols(self["search_symbols"], pattern, limit, class_only=True)

    def search_symbols_in_modules(self, modules: list[str], pattern: str, limit: int = 50) -> DataFrame:
        return search.bucketed_symbols(self["search_symbols"].filter(F.col("module_name").isin(modules)), pattern, limit)

    def get_symbols_by_type(self, kind: str) -> DataFrame:
        return self["search_symbols"].filter(F.col("kind") == kind).orderBy("name", "symbol_id")

    def fast_find(self, pattern: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return search.fast_find(self["search_symbols"], self["search_files"], pattern, limit, offset)

    def global_find(self, pattern: str, limit: int = 50) -> DataFrame:
        return search.global_find(self["search_symbols"], self["search_files"], self["lines"], pattern, limit)

    def search_code_text(self, needle: str, limit: int = 200, offset: int = 0) -> DataFrame:
        return search.code_text(self["lines"], "path", needle, limit, offset)

    def unified_live_find(self, pattern: str, limit: int = 50, engine: Index | None = None) -> DataFrame:
        """Ranked symbols of the project and then the engine; lines of text where the pattern reads like text."""
        rows = self["search_symbols"].withColumn("source", F.lit(0))
        if engine is not None:
            rows = rows.unionByName(engine["search_symbols"].withColumn("source", F.lit(1)))
        quality = S.match_quality(F.col("name"), F.col("owner_name"), F.col("path"), pattern)
        ranked = rows.withColumn("quality", quality).filter("quality < 8").select("quality", "source", "kind", "kind_rank", "name", "path", F.col("line_number").cast("long").alias("line_number"))
        profile = search.query_profile(pattern)
        if profile["text_like"] or profile["literal_code"]:
            text = search.code_text(self["lines"], "path", pattern, limit)
            ranked = ranked.unionByName(text.select(F.lit(0).alias("quality"), F.lit(0).alias("source"), F.lit("text").alias("kind"), F.lit(9).alias("kind_rank"), F.col("line_text").alias("name"), "path", F.col("line_number").cast("long").alias("line_number")))
        return ranked.orderBy("quality", "source", F.size(F.split("path", "/")), "kind_rank", "name", "path", "line_number").limit(limit)

    def get_structs_only(self) -> DataFrame:
        return self["classes"].filter((F.col("symbol_type") == "struct") & ~F.col("name").startswith("(")).orderBy("name", "class_id")

    get_structs = get_structs_only

    def get_classes(self) -> DataFrame:
        return self["classes"].filter((F.col("symbol_type") == "class") & ~F.col("name").startswith("(")).orderBy("name", "class_id")

    def find_class_by_name(self, name: str) -> DataFrame:
        return self["classes"].filter(F.col("name") == name).orderBy("class_id")

    def get_class_file_path(self, name: str) -> DataFrame:
        return self.find_class_by_name(name).select("path").limit(1)

    def search_classes_prefix(self, prefix: str, limit: int = 200) -> DataFrame:
        """``%`` and ``_`` in the prefix are wildcards here, in either case of ASCII letters."""
        return self["classes"].filter(S.lower_ascii("name").like(prefix.lower() + "%")).select("name", "path", "line_number", F.lit(None).cast("string").alias("base_class")).orderBy("name", "path").limit(limit)

    def get_classes_in_modules(self, modules: list[str]) -> DataFrame:
        rows = self["classes"].filter(F.col("module_name").isin(modules))
        return rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_number", "name", "symbol_type", "base_class"))).alias("classes")).orderBy("path")

    def get_file_symbols(self, path: str) -> DataFrame:
        members = self["members"].groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("line_number", "name", "type", "access"))).alias("members"))
        return self["classes"].filter(F.col("path") == path).join(members, "class_id", "left").orderBy("line_number", "class_id")

    def get_class_members(self, name: str) -> DataFrame:
        return self["members"].join(self.find_class_by_name(name).select("class_id"), "class_id", "left_semi").orderBy("line_number", "member_id")

    def get_class_members_by_id(self, class_id: int) -> DataFrame:
        return self["members"].filter(F.col("class_id") == class_id).orderBy("line_number", "member_id")

    def get_class_methods(self, name: str) -> DataFrame:
        return self.get_class_members(name).filter(S.is_function_like("type"))

    def get_class_properties(self, name: str) -> DataFrame:
        return self.get_class_members(name).filter(~S.is_function_like("type"))

    def get_enum_values(self, name: str) -> DataFrame:
        """Values of the enumeration by its name, with or without the leading ``E``; the exact name wins."""
        names = [name, name[1:] if name[:1] == "E" else "E" + name]
        rank = F.when(F.col("enum_name") == names[0], 0).otherwise(1)
        rows = self["enum_values"].filter(F.col("enum_name").isin(names)).withColumn("__r", rank)
        best = rows.agg(F.min("__r").alias("__best"))
        return rows.crossJoin(F.broadcast(best)).filter("__r = __best").drop("__r", "__best").orderBy("line_number", "name")

    # ------------------------------------------------------------ inheritance

    def _edges(self) -> DataFrame:
        return self["inheritance"].select(F.col("child").alias("src"), F.col("parent").alias("dst"))

    def _seed(self, name: str) -> DataFrame:
        return self["classes"].sparkSession.createDataFrame([(name,)], "src string")

    def get_recursive_parent_classes(self, name: str) -> DataFrame:
        return graph.ancestors(self._edges(), self._seed(name)).select(F.col("dst").alias("name"), "depth").orderBy("depth", "name")

    def get_recursive_derived_classes(self, name: str) -> DataFrame:
        return graph.descendants(self._edges(), self._seed(name)).select(F.col("dst").alias("name"), "depth").orderBy("depth", "name")

    def find_derived_classes(self, name: str) -> DataFrame:
        """Derived classes in source and assets that derive from the class."""
        source = self.get_recursive_derived_classes(name).select("name", F.lit("class").alias("kind"))
        derived = assets.usage_rows(self["assets"], self["references"], self["functions"]).filter("usage_kind = 'derived'")
        found = assets.asset_usages(derived, self._seed(name), "src").select(F.col("asset_path").alias("name"), F.lit("asset").alias("kind"))
        return source.union(found).distinct().orderBy("kind", "name")

    def _named_members(self) -> DataFrame:
        names = self["classes"].select("class_id", F.col("name").alias("class_name"))
        m = self["members"].join(names, "class_id")
        return m.select(F.col("class_name").alias("class_id"), "name", "member_id", "type", "access", "path", "line_number")

    def get_class_members_recursive(self, name: str, limit: int | None = None) -> DataFrame:
        return graph.inherited_members(self._edges(), self._seed(name), self._named_members(), limit=limit).orderBy("class_rank", "name")

    def visible_members(self, name: str, from_class: str | None = None) -> DataFrame:
        """Members of a class as seen from another: private ones from itself, protected ones from its descendants too."""
        rows = self.get_class_members_recursive(name)
        if from_class == name:
            return rows
        inside = graph.ancestors(self._edges(), self._seed(from_class or "")).select(F.col("dst").alias("class_id")).distinct().withColumn("__in", F.lit(True))
        rows = rows.join(inside, "class_id", "left")
        return rows.filter((F.col("access") == "public") | ((F.col("access") == "protected") & F.col("__in").isNotNull())).drop("__in")

    def get_virtual_functions_in_inheritance_chain(self, name: str) -> DataFrame:
        return self.get_class_members_recursive(name).filter(S.is_function_like("type"))

    def find_symbol_in_inheritance_chain(self, name: str, symbol: str) -> DataFrame:
        return graph.first_in_chain(self._edges(), self._seed(name), self._named_members(), symbol)

    def find_symbol_in_module(self, module: str, symbol: str) -> DataFrame:
        return checks.pick_definition(self["search_symbols"].filter((F.col("module_name") == module) & (F.col("name") == symbol)), "name", "path", "line_number")

    def goto_definition(self, symbol: str, in_class: str | None = None) -> DataFrame:
        """The first answer of: the class's own chain, a type of that name, any symbol of that name."""
        shape = lambda df: df.select("name", "path", F.col("line_number").cast("long").alias("line_number"))
        steps = [shape(self.find_symbol_in_inheritance_chain(in_class, symbol))] if in_class else []
        steps.append(shape(checks.pick_definition(self["classes"].filter(F.col("name") == symbol), "name", "path", "line_number")))
        steps.append(shape(checks.pick_definition(self["search_symbols"].filter(F.col("name") == symbol), "name", "path", "line_number")))
        return search.priority_merge(steps, ["name"], [F.col("path"), F.col("line_number")], 1)

    def goto_implementation(self, symbol: str) -> DataFrame:
        """Source files before headers."""
        rows = self["search_symbols"].filter(F.col("name") == symbol)
        return rows.orderBy(S.is_header("ext").cast("int"), "path", "line_number").limit(1)

    def get_hover(self, symbol: str, in_class: str | None = None) -> DataFrame:
        place = self.goto_definition(symbol, in_class).select(F.col("path").alias("__p"), F.col("line_number").alias("__l"))
        return self["search_symbols"].join(place, (F.col("path") == F.col("__p")) & (F.col("line_number") == F.col("__l"))).drop("__p", "__l").filter(F.col("name") == symbol)

    def get_signature_help(self, symbol: str) -> DataFrame:
        from ..functions.python_scalars import normalize_parameter_signature

        rows = self["members"].filter((F.col("name") == symbol) & S.is_function_like("type"))
        return rows.select("name", normalize_parameter_signature(F.coalesce("detail", F.lit("()"))).alias("signature"), "return_type", "path", "line_number").orderBy("path", "line_number")

    # ------------------------------------------------------------ usages, assets, config, diagnostics

    def find_symbol_usages(self, symbol: str, owner: str | None = None, current: str | None = None, local: tuple[int, int] | None = None, limit: int | None = 300, overridden: bool = True) -> DataFrame:
        """Usages in the scope of a member (with ``owner``), of a local symbol (lines of the current file), or anywhere.

        Without ``overridden`` members of that name in derived classes are not usages. Without a limit all usages count.
        """
        members = self._named_members()
        roots = members.filter((F.col("name") == symbol) if owner is None else (F.col("name") == symbol) & (F.col("class_id") == owner)).select(F.col("class_id").alias("src")).distinct()
        over = graph.overrides(self._edges(), roots, members, symbol) if overridden else members.limit(0)
        return usages.scoped_usages(symbol, self["search_symbols"], over, self["calls"], self["includes"], self["lines"], owner, current, local, limit)

    def get_assets(self, limit: int = 1000) -> DataFrame:
        return self["assets"].orderBy(S.lower_ascii("asset_path"), "asset_path").limit(limit)

    def _usages(self) -> DataFrame:
        return assets.usage_rows(self["assets"], self["references"], self["functions"])

    def get_asset_usages(self, names: DataFrame) -> DataFrame:
        return assets.asset_usages(self._usages(), names)

    def get_asset_usage_hints(self, names: DataFrame) -> DataFrame:
        return assets.usage_hints(self._usages(), names)

    def get_asset_dependencies(self, asset: str) -> DataFrame:
        return self["references"].filter(F.col("asset_path") == asset).select("referenced").distinct().orderBy("referenced")

    def get_asset_index_status(self) -> DataFrame:
        return assets.index_status(self["assets"], self["references"], self["functions"])

    def get_config_data(self) -> DataFrame:
        return fold.config_fold(self["config"], ["section", "name"], ["layer", "line"])

    def get_config_history(self) -> DataFrame:
        return fold.config_history(self["config"], ["section", "name"], ["layer", "line"])

    def get_completions(self, prefix: str, in_class: str | None = None, limit: int = 128) -> DataFrame:
        """Members of the class, then symbols, then macros, each by match rank."""
        shape = lambda df: df.withColumn("rank", S.completion_match_rank("name", prefix)).filter("rank is not null").select("name", "rank")
        parts = [shape(self.get_class_members_recursive(in_class, 96))] if in_class else []
        parts += [shape(self["search_symbols"].filter(F.col("name_lc").startswith(prefix.lower()))), shape(self["macros"])]
        merged = search.priority_merge([p.distinct() for p in parts], ["name"], [F.col("rank"), F.length("name"), F.col("name")], limit)
        return merged.withColumn("sort_text", S.completion_sort_text(F.col("bucket"), F.col("rank"), F.col("name")))

    def get_include_completions(self, prefix: str, limit: int = 80) -> DataFrame:
        return search.complete_includes(self["files"], prefix, limit)

    def get_diagnostics(self) -> DataFrame:
        """Types defined differently in several files, as finished diagnostics."""
        clash = checks.conflicting_definitions(self["classes"], ["name", "symbol_type"], "path", "path")
        rows = clash.select(F.col("path").alias("file_path"), F.col("line_number").alias("line"), F.lit(0).alias("character"), F.lit("warning").alias("severity"), F.lit("odr").alias("code"), F.concat(F.col("name"), F.lit(" is defined in "), F.col("locations")).alias("message"), F.col("class_id").alias("input_order"))
        return checks.finalize_diagnostics(rows)

    def module_of_paths(self, paths: DataFrame) -> DataFrame:
        return resolve.longest_prefix(paths, "path", self["modules"], "root_path", "module_id")
