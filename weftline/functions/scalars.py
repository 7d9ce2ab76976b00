"""Column functions: names, paths, identifiers, source lines and ranks. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Kinds of symbols and file extensions as the index knows them.
CLASS_KINDS = ("class", "struct", "enum", "uclass", "ustruct", "uenum", "uinterface", "typedef")
FUNCTION_KINDS = ("function", "method", "delegate")
SOURCE_EXTENSIONS = ("h", "hh", "hpp", "hxx", "inl", "ipp", "c", "cc", "cpp", "cxx", "cs")
HEADER_EXTENSIONS = ("h", "hpp", "hh", "inl")
TEXT_EXTENSIONS = (*SOURCE_EXTENSIONS, "ini", "json", "uproject", "uplugin")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_ascii(c: Column | str) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``."""
    return F.translate(_col(c), UPPER, LOWER)


def lower_ascii_text(text: str) -> str:
    """``lower_ascii`` of a plain string."""
    return text.translate(str.maketrans(UPPER, LOWER))


def compact_identifier(c: Column | str) -> Column:
    """ASCII letters and digits only, lower-cased."""
    return lower_ascii(F.regexp_replace(_col(c), "[^A-Za-z0-9]", ""))


def compact_name(c: Column | str) -> Column:
    """Lower-cased without underscores, colons and spaces; other signs stay, unlike in ``compact_identifier``."""
    return lower_ascii(F.translate(_col(c), "_: ", ""))


def is_class_like(kind: Column | str) -> Column:
    return lower_ascii(kind).isin(*CLASS_KINDS)


def is_function_like(kind: Column | str) -> Column:
    k = lower_ascii(kind)
    return k.contains("function") | k.contains("method") | k.contains("delegate")


def is_member_like(kind: Column | str) -> Column:
    """Neither class-like nor function-like."""
    return ~is_class_like(kind) & ~is_function_like(kind)


def kind_rank(kind: Column | str) -> Column:
    """0 for class-like kinds, 1 for exactly a function kind, 2 for others."""
    return F.when(is_class_like(kind), 0).when(lower_ascii(kind).isin(*FUNCTION_KINDS), 1).otherwise(2)


def normalize_path(p: Column | str) -> Column:
    r"""``\`` to ``/``, then ``//`` to ``/`` in one pass."""
    return F.replace(F.replace(_col(p), F.lit("\\"), F.lit("/")), F.lit("//"), F.lit("/"))


def basename(p: Column | str) -> Column:
    return F.element_at(F.split(_col(p), "/"), -1)


def extension(p: Column | str) -> Column:
    """Lower-cased text after the last dot of the last segment; empty without one."""
    return lower_ascii(F.regexp_extract(_col(p), r"\.([^./]+)$", 1))


def parent_path(p: Column | str) -> Column:
    return F.regexp_extract(_col(p), r"^(.*)/[^/]*$", 1)


def join_path(parent: Column | str, name: Column | str) -> Column:
    """parent/name, without a doubled or leading-only slash for empty, null and slash-ended parents."""
    parent, name = _col(parent), _col(name)
    return F.when(parent.isNull() | (parent == ""), name).when(parent.endswith("/"), F.concat(parent, name)).otherwise(F.concat(parent, F.lit("/"), name))


def path_components(p: Column | str) -> Column:
    """The non-empty segments of a normalised path; a leading slash is kept as a first segment ``/``."""
    n = normalize_path(p)
    parts = F.filter(F.split(n, "/"), lambda x: x != "")
    return F.when(n.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


def components_path(parts: Column | str) -> Column:
    """The inverse of ``path_components``."""
    p = _col(parts)
    return F.when(p[0] == "/", F.concat(F.lit("/"), F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), "/"))).otherwise(F.array_join(p, "/"))


def is_source(ext: Column | str) -> Column:
    return lower_ascii(ext).isin(*SOURCE_EXTENSIONS)


def is_header(ext: Column | str) -> Column:
    return lower_ascii(ext).isin(*HEADER_EXTENSIONS)


def is_searchable_text(ext: Column | str) -> Column:
    return lower_ascii(F.coalesce(_col(ext), F.lit(""))).isin(*TEXT_EXTENSIONS)


def is_identifier_query(c: Column | str) -> Column:
    return _col(c).rlike("^[A-Za-z_][A-Za-z0-9_:]*$")


def split_qualified(c: Column | str) -> tuple[Column, Column]:
    """(owner, name) at the last ``::``; the owner is null without one."""
    c = _col(c)
    name = F.substring_index(c, "::", -1)
    owner = F.substring(c, F.lit(1), F.length(c) - F.length(name) - 2)
    return F.when(c.contains("::"), owner), name


def strip_namespace(c: Column | str) -> Column:
    return F.substring_index(_col(c), "::", -1)


def identifier_tokens(c: Column | str) -> Column:
    """Sorted distinct tokens: every capital starts one, digits stand alone, a one-letter head is dropped."""
    raw = F.regexp_extract_all(_col(c), F.lit("([A-Z][a-z]*|[a-z]+|[0-9]+)"), 1)
    low = F.transform(raw, lower_ascii)
    kept = F.when((F.size(low) > 1) & (F.length(low[0]) == 1), F.slice(low, 2, F.greatest(F.size(low) - 1, F.lit(1)))).otherwise(low)
    return F.array_sort(F.array_distinct(kept))


def preferred_token(tokens: Column | str) -> Column:
    """The longest token of three letters or more; of equally long ones the first in order."""
    long = F.filter(_col(tokens), lambda t: F.length(t) >= 3)
    best = F.array_max(F.transform(long, lambda t: F.length(t)))
    return F.element_at(F.filter(F.array_sort(long), lambda t: F.length(t) == best), 1)


def identifier_words(c: Column | str) -> Column:
    """Words split at underscores and where a lower-case letter or digit meets a capital, lower-cased."""
    cut = F.regexp_replace(F.regexp_replace(_col(c), "_+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(lower_ascii(F.trim(cut)), " +"), lambda w: w != "")


def normalize_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def clean_type(c: Column | str) -> Column:
    """The bare type name: without qualifiers, pointer and reference marks and template arguments."""
    bare = F.regexp_replace(_col(c), r"\b(const|class|struct|enum|virtual|static|inline|typename|mutable|volatile)\b", " ")
    return normalize_space(F.regexp_replace(F.regexp_replace(bare, "<.*>", " "), r"[*&]", " "))


def template_argument(c: Column | str) -> Column:
    """The text between the outermost angle brackets, or null."""
    found = F.regexp_extract(_col(c), "<(.*)>", 1)
    return F.when(found != "", F.trim(found))


def lookup_names(c: Column | str) -> Column:
    """Lower-cased name, and the same without a one-letter type prefix (A, U, F, E, I, T before a capital)."""
    c = _col(c)
    return F.array_distinct(F.array(lower_ascii(c), lower_ascii(F.regexp_replace(c, "^[AUFEIT](?=[A-Z])", ""))))


def suffix_keys(c: Column | str) -> Column:
    """A lookup key and what follows its last dot and its last colon, so that suffix matches become equality."""
    c = _col(c)
    return F.array_distinct(F.array(c, F.substring_index(c, ".", -1), F.substring_index(c, ":", -1)))


def asset_path(c: Column | str) -> Column:
    """A file path below ``Content`` as a game path without its extension."""
    return F.regexp_replace(F.regexp_replace(normalize_path(c), "^.*/Content/", "/Game/"), r"\.[^./]*$", "")


def asset_class_leaf(c: Column | str) -> Column:
    """The class name at the end of an object path, without the generated-class suffix ``_C`` and quotes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(_col(c), r"([^./:]+)$", 1), "'$", ""), "_C$", "")


def include_insert_path(c: Column | str) -> Column:
    """The path from behind its last ``/Public/``, ``/Classes/`` or ``/Private/``; the base name without one."""
    c = normalize_path(c)
    out = basename(c)
    for mark in ("/Private/", "/Classes/", "/Public/"):
        out = F.when(c.contains(mark), F.substring_index(c, mark, -1)).otherwise(out)
    return out


def completion_sort_text(rank: Column, order: Column, label: Column) -> Column:
    return F.format_string("%04d_%04d_%s", rank, order, label)


def display_value(is_list: Column, values: Column) -> Column:
    """``nil`` for nothing, ``[Array xN] last`` for a list, at most 50 characters and then dots."""
    last = F.element_at(values, -1)
    text = F.when(values.isNull() | (F.size(values) == 0), "nil").when(is_list, F.concat(F.lit("[Array x"), F.size(values).cast("string"), F.lit("] "), last)).otherwise(last)
    return F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 47), F.lit("..."))).otherwise(text)


def dedupe_bucket(column: Column | str, window: int = 4) -> Column:
    return F.floor(_col(column) / window)


def severity_rank(severity: Column | str) -> Column:
    """error 3, warning 2, information 1, anything else 0."""
    s = _col(severity)
    return F.when(s == "error", 3).when(s == "warning", 2).when(s == "information", 1).otherwise(0)


def whole_word_column(line: Column | str, symbol: str) -> Column:
    """The place (from 1) of a whole-word occurrence, 0 without one. Word characters are ASCII."""
    return F.regexp_instr(_col(line), F.lit(f"(?<![A-Za-z0-9_])\\Q{symbol}\\E(?![A-Za-z0-9_])"))


def is_code_occurrence(line: Column | str, column: Column) -> Column:
    """Whether the place is neither behind ``//`` nor inside double quotes."""
    before = F.substring(_col(line), F.lit(1), column - 1)
    plain = F.regexp_replace(before, r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    return ~before.contains("//") & (quotes % 2 == 0)


def classify_usage(line: Column | str, column: Column, symbol: str) -> Column:
    """declaration, definition, call, write or read.

    A line with a property or function macro declares; a parenthesis after the symbol defines where ``::``
    stands before it and calls otherwise. Any ``=`` right after the symbol counts as a write, ``==`` too.
    """
    line = _col(line)
    before = F.substring(line, F.lit(1), column - 1)
    after = F.regexp_replace(F.substring(line, column + len(symbol), F.lit(1 << 30)), r"^\s+", "")
    return (
        F.when(line.contains("UPROPERTY(") | line.contains("UFUNCTION("), "declaration")
        .when(before.contains("::") & after.startswith("("), "definition")
        .when(after.startswith("("), "call")
        .when(after.rlike(r"^[-+*/]?="), "write")
        .otherwise("read")
    )


def classify_location(path: Column | str, context: Column | str, symbol: Column | str, owner: Column | str | None = None) -> Column:
    """definition or declaration, by the file's kind and the line.

    Members (with an owner) are defined in implementation files on lines that hold ``::`` and the symbol,
    other symbols there on lines that hold the symbol and a brace or a parenthesis.
    """
    context, symbol = _col(context), _col(symbol)
    implementation = lower_ascii(path).rlike(r"\.(cpp|cc|cxx)$") & context.contains(symbol)
    free = context.contains("{") | context.contains("(")
    told = free if owner is None else F.when(_col(owner).isNotNull(), context.contains("::")).otherwise(free)
    return F.when(implementation & told, "definition").otherwise("declaration")


def qualifier_before(line: Column | str, column: Column) -> tuple[Column, Column]:
    """The identifier and the operator (``->``, ``.`` or ``::``) that end right before a place; empty without."""
    before = F.substring(_col(line), F.lit(1), column - 1)
    pattern = r"([A-Za-z0-9_]+)(->|\.|::)\s*$"
    return F.regexp_extract(before, pattern, 1), F.regexp_extract(before, pattern, 2)


def line_of_offset(text: Column | str, offset: Column) -> Column:
    """The line number (from 1) of a character offset."""
    before = F.substring(_col(text), F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def compact_fuzzy_match(name: Column | str, query: str) -> Column:
    """Greedy subsequence match of compact forms: the surplus of the span and the largest gap stay small.

    Both may be 1 for queries of up to four characters and 2 beyond; shorter queries than three never match.
    """
    n, slack = len(query), 1 if len(query) <= 4 else 2
    if n < 3:
        return F.lit(False)
    wanted = F.array(*[F.lit(ch) for ch in query])
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("gap"))

    def step(acc: Column, ch: Column) -> Column:
        i = acc["i"] + 1
        hit = (acc["q"] < n) & (ch == F.element_at(wanted, F.least(acc["q"] + 1, F.lit(n))))
        first = F.when(hit & (acc["q"] == 0), i).otherwise(acc["first"])
        gap = F.when(hit & (acc["q"] > 0), F.greatest(acc["gap"], i - acc["last"] - 1)).otherwise(acc["gap"])
        return F.struct((acc["q"] + hit.cast("int")).alias("q"), i.alias("i"), first.alias("first"), F.when(hit, i).otherwise(acc["last"]).alias("last"), gap.alias("gap"))

    def verdict(acc: Column) -> Column:
        return (acc["q"] == n) & (acc["last"] - acc["first"] + 1 - n <= slack) & (acc["gap"] <= slack)

    return F.aggregate(F.split(_col(name), ""), start, step, verdict)


def fuzzy_token_score(text: Column | str, token: str) -> Column:
    """Place of the token (from 0), else 1000 plus the gaps of a greedy subsequence, null if it is none."""
    low, n = lower_ascii(text), len(token)
    wanted = F.array(*[F.lit(ch) for ch in token.lower()])
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("i"), F.lit(0).alias("last"), F.lit(0).alias("gaps"))

    def step(acc: Column, ch: Column) -> Column:
        i = acc["i"] + 1
        hit = (acc["q"] < n) & (ch == F.element_at(wanted, F.least(acc["q"] + 1, F.lit(n))))
        gaps = acc["gaps"] + F.when(hit & (acc["q"] > 0), i - acc["last"] - 1).otherwise(0)
        return F.struct((acc["q"] + hit.cast("int")).alias("q"), i.alias("i"), F.when(hit, i).otherwise(acc["last"]).alias("last"), gaps.alias("gaps"))

    loose = F.aggregate(F.split(low, ""), start, step, lambda acc: F.when(acc["q"] == n, acc["gaps"] + 1000))
    place = F.instr(low, token.lower())
    return F.when(place > 0, place - 1).otherwise(loose)


def match_quality(name: Column, owner: Column, path: Column, pattern: str) -> Column:
    """How a row matches: 0 exact, 1 prefix, 2 compact equality, 3 compact prefix, 4 substring, 5 fuzzy,
    6 owner, 7 path, 8 not at all."""
    low, compact = pattern.lower(), "".join(c for c in pattern.lower() if c.isascii() and c.isalnum())
    n, c = lower_ascii(name), compact_identifier(name)
    return (
        F.when(n == low, 0)
        .when(n.startswith(low), 1)
        .when((c == compact) & F.lit(bool(compact)), 2)
        .when(c.startswith(compact) & F.lit(bool(compact)), 3)
        .when(n.contains(low), 4)
        .when(compact_fuzzy_match(c, compact), 5)
        .when(lower_ascii(F.coalesce(owner, F.lit(""))).contains(low), 6)
        .when(lower_ascii(F.coalesce(path, F.lit(""))).contains(low), 7)
        .otherwise(8)
    )


def matches_type_fragment(name: Column | str, query: str) -> Column:
    """Whether the query is the name up to a one-letter type prefix; queries under six letters never are."""
    if len(query) < 6:
        return F.lit(False)
    q = query.lower()
    return lower_ascii(name).isin(q, *[p + q for p in "aufeit"])


def completion_match_rank(name: Column | str, prefix: str) -> Column:
    """Rank of a completion candidate, null if it does not match.

    0 prefix; 1 prefix of the joined words; 2 + i prefix of word i; 10 + s prefix of the words joined from
    word s on; 40 + place of a substring; 80 compact prefix; 100 + place in the compact form.
    """
    p = prefix.lower()
    compact = "".join(c for c in p if c.isascii() and c.isalnum())
    low, words = lower_ascii(name), identifier_words(name)
    joined = F.array_join(words, "")
    at_word = F.array_min(F.transform(words, lambda w, i: F.when(w.startswith(p), i + 2)))
    tails = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.when((i > 0) & F.array_join(F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(1))), "").startswith(p), i + 10))
    small = compact_identifier(name)
    return F.coalesce(
        F.when(low.startswith(p), 0),
        F.when(joined.startswith(p), 1),
        at_word,
        F.array_min(tails),
        F.when(low.contains(p), F.instr(low, p) - 1 + 40),
        F.when(small.startswith(compact) & F.lit(bool(compact)), 80),
        F.when(small.contains(compact) & F.lit(bool(compact)), F.instr(small, compact) - 1 + 100),
    )


def content_hash(c: Column | str) -> Column:
    """A hex digest of which only equality matters."""
    return F.sha2(_col(c).cast("binary"), 256)
