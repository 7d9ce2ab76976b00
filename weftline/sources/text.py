"""Line, config, rule and log readers over tables of (key, text) rows; all are expressions in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# What is indexed by default.
EXCLUDED_DIRECTORIES = ("Intermediate", "Binaries", "Build", "Saved", ".git", ".vs")
INCLUDED_EXTENSIONS = ("h", "hh", "hpp", "cpp", "cc", "cxx", "inl", "cs", "ini", "uasset", "umap", "uproject", "uplugin")
# What makes a header worth parsing, and parts of paths that the text index leaves out.
INTERESTING = ("#include", "#define", "UCLASS", "USTRUCT", "UENUM", "UINTERFACE", "UDELEGATE", "UFUNCTION", "UPROPERTY", "GENERATED_BODY", "DECLARE_")
NOT_INDEXED = ("/intermediate/", "/binaries/", "/deriveddatacache/", "/thirdparty/", "/source/thirdparty/", "/framework/libs/", "/external/")
# The folders of an engine that are scanned.
ENGINE_FOLDERS = ("Engine/Source", "Engine/Plugins", "Engine/Config", "Engine/Shaders")
#: the section of assignments before the first header
DEFAULT_SECTION = "Default"


def scan_files(spark: SparkSession, roots: list[str], include: tuple[str, ...] = INCLUDED_EXTENSIONS, exclude: tuple[str, ...] = EXCLUDED_DIRECTORIES) -> DataFrame:
    """path, mtime, size, content of every file below the roots with an included extension and no excluded directory.

    Only the metadata is read unless ``content`` is used; Spark packs files into tasks by size.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    segments = F.split(S.normalize_path("path"), "/")
    kept = found.filter(S.extension("path").isin(*include) & ~F.arrays_overlap(segments, F.array(*[F.lit(x) for x in exclude])))
    return kept.select(S.normalize_path("path").alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def engine_roots(root: str) -> list[str]:
    """The folders of an engine below ``root`` that are scanned, for ``scan_files``."""
    return [f"{root.rstrip('/')}/{folder}" for folder in ENGINE_FOLDERS]


def with_cache_status(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Add content_hash and status (``cache_hit`` where ``previous(path, content_hash)`` agrees, else ``parse``)."""
    hashed = files.withColumn("content_hash", S.content_hash("content"))
    before = previous.select(F.col("path").alias("__p"), F.col("content_hash").alias("__h"))
    joined = hashed.join(before, F.col("path") == F.col("__p"), "left")
    return joined.withColumn("status", F.when(F.col("content_hash") == F.col("__h"), "cache_hit").otherwise("parse")).drop("__p", "__h")


def worth_parsing(text: Column | str) -> Column:
    """A cheap test before an expensive parser: does the text hold any of the INTERESTING words?"""
    t = F.col(text) if isinstance(text, str) else text
    return reduce(or_, [t.contains(word) for word in INTERESTING])


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_number from 1, line_text) of every line; line ends are stripped. Null texts have no line."""
    split = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    return split.select(key, (F.col("at") + 1).alias("line_number"), F.regexp_replace("line", r"\r+$", "").alias("line_text"))


def text_eligible(path: Column | str, excluded: tuple[str, ...] = NOT_INDEXED) -> Column:
    """Whether a path belongs in the text index: a searchable extension and no excluded part, in any case."""
    p = S.lower_ascii(S.normalize_path(path))
    return S.is_searchable_text(S.extension(p)) & ~reduce(or_, [p.contains(part) for part in excluded])


def ini_entries(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, section, name, op, value, line) from lines (key, line_number, line_text) of layered config files.

    A line that starts with ``;`` or ``#`` is a comment, ``[x]`` opens a section that holds until the next,
    the first ``=`` separates and a line without one says nothing; a leading ``+``, ``-`` or ``!`` is the
    operation. What comes before the first section belongs to DEFAULT_SECTION.
    """
    t = F.regexp_replace("line_text", r"^\s+|\s+$", "")
    header = F.regexp_extract(t, r"^\[(.*)\]$", 1)
    by_line = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.coalesce(F.last(F.when(t.rlike(r"^\[.*\]$"), header), True).over(by_line), F.lit(DEFAULT_SECTION))
    rows = rows.withColumn("section", section).filter(~t.rlike(r"^[;#]|^\[.*\]$") & t.contains("="))
    whole = F.regexp_replace(F.regexp_extract(t, r"^([^=]*)=", 1), r"\s+$", "")
    value = F.regexp_replace(F.regexp_extract(t, r"^[^=]*=(.*)$", 1), r"^\s+", "")
    found = rows.select(key, "section", F.regexp_replace(whole, r"^[+!-]", "").alias("name"), F.regexp_extract(whole, r"^([+!-]?)", 1).alias("op"), value.alias("value"), F.col("line_number").alias("line"))
    return found.filter("name != ''")


def build_dependencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, public, private): sorted distinct module names that build rules add singly or as a range."""

    def named(kind: str) -> Column:
        ranges = F.regexp_extract_all(F.col(text), F.lit(kind + r"DependencyModuleNames\s*\.\s*AddRange\s*\([^{]*\{([^}]*)\}"), 1)
        single = F.regexp_extract_all(F.col(text), F.lit(kind + r'DependencyModuleNames\s*\.\s*Add\s*\(\s*"([^"]+)"'), 1)
        inside = F.flatten(F.transform(ranges, lambda r: F.regexp_extract_all(r, F.lit('"([^"]+)"'), 1)))
        return F.array_sort(F.array_distinct(F.concat(inside, single)))

    return df.select(key, named("Public").alias("public"), named("Private").alias("private"))


def json_descriptor(df: DataFrame, text: str, schema: str, out: str = "descriptor") -> DataFrame:
    return df.withColumn(out, F.from_json(F.col(text), schema))


def gameplay_tags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, identifier, tag_path, kind): tags defined or declared by macros; a declaration yields to a definition in the same file."""
    define = F.regexp_extract_all(F.col(text), F.lit(r'UE_DEFINE_GAMEPLAY_TAG(?:_COMMENT|_STATIC)?\s*\(\s*(\w+\s*,\s*"[^"]*")'), 1)
    declare = F.regexp_extract_all(F.col(text), F.lit(r"UE_DECLARE_GAMEPLAY_TAG_EXTERN\s*\(\s*(\w+)"), 1)
    defined = df.select(key, F.explode(define).alias("d")).select(key, F.regexp_extract("d", r"^(\w+)", 1).alias("identifier"), F.regexp_extract("d", '"([^"]*)"', 1).alias("tag_path"), F.lit("define").alias("kind"))
    declared = df.select(key, F.explode(declare).alias("identifier")).withColumn("tag_path", F.lit(None).cast("string")).withColumn("kind", F.lit("declare"))
    return defined.unionByName(declared.join(defined.select(key, "identifier").distinct(), [key, "identifier"], "left_anti"))


def macro_definitions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, is_function_like, parameters, detail): ``#define`` lines, continued lines joined first."""
    joined = F.regexp_replace(F.col(text), r"\\\r?\n", " ")
    found = df.select(key, F.explode(F.regexp_extract_all(joined, F.lit(r"(?m)^[ \t]*#[ \t]*define[ \t]+(.*)$"), 1)).alias("d"))
    parameters = F.regexp_extract("d", r"^\w+\(([^)]*)\)", 1)
    return found.select(key, F.regexp_extract("d", r"^(\w+)", 1).alias("name"), F.col("d").rlike(r"^\w+\(").alias("is_function_like"), S.normalize_space(parameters).alias("parameters"), S.normalize_space(F.regexp_replace("d", r"^\w+(\([^)]*\))?", "")).alias("detail"))


def delegate_macros(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, macro, name): delegates declared by macros; names stand first, after a return type where there is one."""
    found = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(DECLARE_(?:DYNAMIC_)?(?:MULTICAST_)?DELEGATE\w*\s*\((?:[^()]|\([^()]*\))*\))"), 1)).alias("d"))
    macro = F.regexp_extract("d", r"^(\w+)", 1)
    arguments = F.transform(F.split(F.regexp_extract("d", r"^\w+\s*\((.*)\)$", 1), r",(?![^()]*\))"), lambda x: F.trim(x))
    return found.select(key, macro.alias("macro"), F.when(macro.contains("RetVal"), F.get(arguments, F.lit(1))).otherwise(F.get(arguments, F.lit(0))).alias("name"))


def symbols(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name, base, line): type declarations by pattern; one row a line that opens or names a type."""
    pattern = r"^\s*(?:template\s*<[^>]*>\s*)?(class|struct|enum(?:\s+class)?|interface|namespace)\s+(?:[A-Z_]+_API\s+)?(\w+)"
    rows = lines(df, key, text).filter(F.col("line_text").rlike(pattern))
    base = F.regexp_extract("line_text", r":\s*(?:public|protected|private)?\s*(\w+)", 1)
    return rows.select(key, F.regexp_extract("line_text", pattern, 1).alias("kind"), F.regexp_extract("line_text", pattern, 2).alias("name"), F.when(base != "", base).alias("base"), F.col("line_number").alias("line"))


# Words before a parenthesis that call nothing.
NOT_CALLED = ("if", "for", "while", "switch", "return", "sizeof", "catch", "defined", "alignof", "decltype", "noexcept", "static_assert")


def _code(line: Column) -> Column:
    """A line without its strings and its trailing comment."""
    return F.regexp_replace(F.regexp_replace(line, r'"(?:\\.|[^"\\])*"', '""'), r"//.*$", "")


def calls(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, line) of every name before a parenthesis in code; control words and macro definitions are none."""
    rows = lines(df, key, text).filter(~F.col("line_text").rlike(r"^\s*#"))
    found = rows.select(key, F.explode(F.regexp_extract_all(_code(F.col("line_text")), F.lit(r"(?<![A-Za-z0-9_~])([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)).alias("name"), F.col("line_number").alias("line"))
    return found.filter(~F.col("name").isin(*NOT_CALLED))


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_name, kind, name, access, line): fields and methods declared one to a line in class and struct bodies.

    The class is the one whose brace opened last at the depth above; access is private in a class until said
    otherwise, public in a struct.
    """
    head = r"^\s*(class|struct)\s+(?:[A-Z_]+_API\s+)?(\w+)[^;]*$"
    rows = lines(df, key, text).withColumn("c", _code(F.col("line_text")))
    count = lambda sign: F.length("c") - F.length(F.replace(F.col("c"), F.lit(sign), F.lit("")))
    by_line = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__after", F.sum(count("{") - count("}")).over(by_line)).withColumn("__before", F.col("__after") - count("{") + count("}"))
    is_head = F.col("c").rlike(head)
    at = F.last(F.when(is_head, F.col("line_number")), True).over(by_line)
    rows = rows.withColumn("__name", F.last(F.when(is_head, F.regexp_extract("c", head, 2)), True).over(by_line)).withColumn("__kind", F.last(F.when(is_head, F.regexp_extract("c", head, 1)), True).over(by_line)).withColumn("__head", at)
    # A line opens the level below it; whose body that is, is told by the class head on this line or the one before.
    opener = rows.filter("__after > __before").select(key, "line_number", F.lit("").alias("c"), (F.col("__before") + 1).alias("level"), F.struct(F.when(F.col("line_number") - F.col("__head") <= 1, F.col("__name")).alias("name"), F.col("__kind").alias("kind")).alias("opener"))
    inside = rows.select(key, "line_number", "c", F.col("__before").alias("level"), F.lit(None).cast(opener.schema["opener"].dataType).alias("opener"))
    by_level = Window.partitionBy(key, "level").orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = inside.unionByName(opener).withColumn("__class", F.last("opener", True).over(by_level))
    said = F.regexp_extract("c", r"^\s*(public|protected|private)\s*:", 1)
    mark = F.when(F.col("opener").isNotNull(), F.when(F.col("opener.kind") == "class", "private").otherwise("public")).when(said != "", said)
    rows = rows.withColumn("access", F.last(mark, True).over(by_level)).filter(F.col("opener").isNull() & F.col("__class.name").isNotNull() & F.col("c").rlike(r"[;{]\s*\}?\s*$") & ~F.col("c").rlike(r"^\s*(public|protected|private|using|typedef|friend|class|struct|enum)\b"))
    method, field = r"(~?\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)[^;{]*[;{]", r"^\s*[\w:<>,*&\s]+?[\s*&](\w+)\s*(?:\[[^\]]*\])?\s*(?:=[^;]*|\{[^;]*\})?;\s*$"
    is_method = F.col("c").rlike(method) & ~F.col("c").rlike(r"^[^(]*=")
    name = F.when(is_method, F.regexp_extract("c", method, 1)).otherwise(F.regexp_extract("c", field, 1))
    return rows.select(key, F.col("__class.name").alias("class_name"), F.when(is_method, "method").otherwise("field").alias("kind"), name.alias("name"), "access", F.col("line_number").alias("line")).filter("name != ''")


def includes(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r'(?m)^\s*#\s*include\s*["<]([^">]+)[">]'), 1)).alias("include_path"))
    return rows.select(key, "include_path", S.basename("include_path").alias("base_filename"))


def ascii_strings(content: Column | str, least: int = 4) -> Column:
    """Runs of printable ASCII of at least ``least`` characters in binary content, in order."""
    c = F.col(content) if isinstance(content, str) else content
    return F.regexp_extract_all(F.decode(c, "ISO-8859-1"), F.lit("([ -~]{%d,})" % least), 1)


def build_diagnostics(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, file_path, line, character, severity, source, code, message) from build output lines; places count from 0.

    Two forms are read, of the compiler, ``C:/f.cpp(3,5): error C2065: ...``, and of the header tool,
    ``C:/f.h:12: Error: ...``. The compiler's own code stands at the beginning of the message.
    """
    t = F.col("line_text")
    compiler = r"^([A-Za-z]:[^\r\n()]+)\((\d+)(?:,(\d+))?\):\s*(fatal error|error|warning)\s*([A-Z]+\d+):\s*(.+)$"
    headers = r"^([A-Za-z]:[^\r\n:]+):(\d+):\s*(Error|Warning):\s*(.+)$"
    place = lambda c: F.greatest(F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(1)) - 1, F.lit(0))

    def read(pattern: str, source: str, column: Column, level: int, message: Column) -> DataFrame:
        got = rows.filter(t.rlike(pattern))
        severity = F.when(S.lower_ascii(F.regexp_extract(t, pattern, level)).contains("warning"), "warning").otherwise("error")
        path = F.replace(F.regexp_extract(t, pattern, 1), F.lit("\\"), F.lit("/"))
        return got.select(key, path.alias("file_path"), place(F.regexp_extract(t, pattern, 2)).alias("line"), column.alias("character"), severity.alias("severity"), F.lit(source).alias("source"), F.lit("BUILD").alias("code"), message.alias("message"))

    first = read(compiler, "MSVC", place(F.regexp_extract(t, compiler, 3)), 4, F.concat(F.regexp_extract(t, compiler, 5), F.lit(": "), F.regexp_extract(t, compiler, 6)))
    return first.unionByName(read(headers, "UHT", F.lit(0), 3, F.regexp_extract(t, headers, 4)))
