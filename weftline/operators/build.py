"""Building and maintaining the index: shredding nested records, projections, keyed upserts and deletes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: the version that datasets are written under; readers of another version rebuild
SCHEMA_VERSION = 1


def shred_classes(parsed: DataFrame) -> DataFrame:
    """One row a class of ``parsed(path, data)``."""
    c = parsed.select("path", F.explode("data.classes").alias("c"))
    return c.select("path", F.col("c.class_name").alias("name"), F.col("c.namespace").alias("namespace"), F.col("c.base_classes").alias("base_classes"), F.col("c.symbol_type").alias("symbol_type"), F.col("c.line").alias("line_number"), F.col("c.end_line").alias("end_line_number"))


def _members(parsed: DataFrame) -> DataFrame:
    c = parsed.select("path", F.explode("data.classes").alias("c"))
    return c.select("path", F.col("c.class_name").alias("class_name"), F.explode("c.members").alias("m")).select("path", "class_name", "m.*")


def shred_members(parsed: DataFrame) -> DataFrame:
    """One row a member; values of enumerations are left to ``shred_enum_values``."""
    return _members(parsed).filter("type <> 'enum_item'")


def shred_enum_values(parsed: DataFrame) -> DataFrame:
    return _members(parsed).filter("type = 'enum_item'").select("path", F.col("class_name").alias("enum_name"), "name", F.col("line").alias("line_number"))


def shred_inheritance(parsed: DataFrame) -> DataFrame:
    return shred_classes(parsed).select("path", F.col("name").alias("child"), F.explode("base_classes").alias("parent"))


def shred_calls(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("data.calls").alias("c")).select("path", "c.*")


def shred_includes(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("path", F.explode("data.includes").alias("include_path"))
    return rows.withColumn("base_filename", S.basename("include_path"))


def search_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """The file projection of ``files(file_id, path, module_id)`` and ``modules(module_id, module_name)``."""
    j = files.join(modules.select("module_id", "module_name"), "module_id", "left")
    e = S.extension("path")
    return j.select(
        "file_id", "module_id", "module_name", S.lower_ascii("module_name").alias("module_name_lc"), "path", S.lower_ascii("path").alias("path_lc"),
        S.basename("path").alias("basename"), S.lower_ascii(S.basename("path")).alias("basename_lc"), e.alias("ext"),
        S.is_source(e).alias("is_source"), S.is_header(e).alias("is_header"), S.is_searchable_text(e).alias("is_searchable_text"),
    )


def search_symbols(rows: DataFrame) -> DataFrame:
    """The symbol projection of ``rows(symbol_id, kind, name, owner_name, module_name, path, line_number)``."""
    return rows.select(
        "symbol_id", "kind", S.kind_rank("kind").alias("kind_rank"), "name", S.lower_ascii("name").alias("name_lc"), S.compact_identifier("name").alias("compact_name"),
        "owner_name", S.lower_ascii("owner_name").alias("owner_name_lc"), "module_name", S.lower_ascii("module_name").alias("module_name_lc"),
        "path", S.lower_ascii("path").alias("path_lc"), S.basename("path").alias("basename"), S.extension("path").alias("ext"), "line_number",
        S.is_class_like("kind").alias("is_class_like"), S.is_function_like("kind").alias("is_function_like"), S.is_member_like("kind").alias("is_member_like"),
    )


def latest(rows: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """One row a key: the last by version."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*[v.desc() for v in version]))).filter("__r = 1").drop("__r")


def upsert(base: DataFrame, changed: DataFrame, key: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """The base without changed and deleted keys, and the changed rows (a later dataset version, not an update in place)."""
    gone = changed.select(*key) if deleted is None else changed.select(*key).unionByName(deleted.select(*key))
    return base.join(gone.distinct(), key, "left_anti").unionByName(changed)


def touch(base: DataFrame, seen: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with the columns of ``seen`` where it has the key and a value, for files whose content is the same."""
    s = seen.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(s, F.col(key) == F.col("__k"), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)))
    return out.select(*base.columns)


def cascade_delete(tables: dict[str, DataFrame], owner: str, gone: DataFrame, late_bound: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Every table without the rows of the ids in ``gone(id)``; late-bound columns that point at them become null."""
    ids = gone.select(F.col("id").alias("__id")).distinct()
    out = {}
    for name, df in tables.items():
        kept = df.join(ids, F.col(owner) == F.col("__id"), "left_anti") if owner in df.columns else df
        bound = (late_bound or {}).get(name)
        if bound:
            kept = kept.join(ids, F.col(bound) == F.col("__id"), "left").withColumn(bound, F.when(F.col("__id").isNull(), F.col(bound))).drop("__id")
        out[name] = kept
    return out


def sync_lines(lines: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The line table after a change: the lines (path, line_number, line_text) of other files, and those of changed ones.

    ``changed(path, text)`` replaces a file's lines, ``deleted(path)`` takes them away; paths are normalised
    and files that do not belong in the index have no lines.
    """
    from ..sources.text import lines as split, text_eligible

    path = S.normalize_path("path").alias("path")
    new = changed.select(path, "text")
    gone = new.select("path").unionByName(deleted.select(path)).distinct()
    return lines.join(gone, "path", "left_anti").unionByName(split(new.filter(text_eligible("path")), "path", "text"))


def resolve_again(edges: DataFrame, targets: DataFrame, changed_children: DataFrame, changed_names: DataFrame) -> DataFrame:
    """``edges(child_id, parent_name, parent_id)`` with the parents of changed children and of changed names looked up anew.

    ``targets(id, name)``; of several targets of a name the least id counts. Other edges stay as they are.
    """
    children = changed_children.select(F.col("child_id").alias("__c")).distinct()
    names = changed_names.select(F.col("name").alias("__n")).distinct()
    first = targets.groupBy(F.col("name").alias("__t")).agg(F.min("id").alias("__id"))
    marked = edges.join(children, F.col("child_id") == F.col("__c"), "left").join(names, F.col("parent_name") == F.col("__n"), "left").join(first, F.col("parent_name") == F.col("__t"), "left")
    again = F.col("__c").isNotNull() | F.col("__n").isNotNull()
    return marked.select("child_id", "parent_name", F.when(again, F.col("__id")).otherwise(F.col("parent_id")).alias("parent_id"))


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_version(tables: dict[str, DataFrame], folder: str, source: str = "") -> str:
    """Write a set of tables beside the ones before, symbols and files sorted by their lookup key; returns their folder.

    The manifest, which readers go by, is replaced last: it names the schema version, the folder, the
    tables and ``source``, a mark of what they were built from. A reader sees the old set or the new one.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"{folder}/v{SCHEMA_VERSION}-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        order = next((c for c in ("name_lc", "basename_lc", "path") if c in df.columns), None)
        (df.sortWithinPartitions(order) if order else df).write.parquet(f"{version}/{name}")
    said = json.dumps({"schema": SCHEMA_VERSION, "folder": version, "tables": sorted(tables), "source": source})
    jvm, place, files = _files(spark, folder)
    draft, final = jvm.org.apache.hadoop.fs.Path(place, f"manifest-{uuid.uuid4().hex[:12]}"), jvm.org.apache.hadoop.fs.Path(place, "manifest.json")
    out = files.create(draft, True)
    out.write(bytearray(said.encode()))
    out.close()
    files.delete(final, False)
    files.rename(draft, final)
    return version


def read_version(spark: SparkSession, folder: str, source: str = "") -> dict[str, DataFrame] | None:
    """The tables that the manifest names, or None where there is none, or one of another schema or source: rebuild then."""
    jvm, place, files = _files(spark, folder)
    manifest = jvm.org.apache.hadoop.fs.Path(place, "manifest.json")
    if not files.exists(manifest):
        return None
    said = json.loads("\n".join(r["value"] for r in spark.read.text(manifest.toString()).collect()))
    if said["schema"] != SCHEMA_VERSION or said["source"] != source:
        return None
    return {name: spark.read.parquet(f"{said['folder']}/{name}") for name in said["tables"]}
