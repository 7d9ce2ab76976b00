"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are compared, not documents. Two 64-bit fingerprints within three bits agree in
one of their four 16-bit words at least, so tiles are cut first by (word, value of the word) and, where
that leaves many, by population count and a salt. Tiles of one word value meet pair by pair; pairs of
tiles whose population counts differ beyond the radius are never made. Inside a pair, numpy compares all
fingerprints by exclusive-or and bit counts. Every pair of tiles reports a spanning forest of its links,
so a group of n copies costs n links and not n squared, and no link between different texts is lost.
Components are then found by alternating star contractions on the distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, read_texts
from .tokens import release_memory, rows_of, text_batches

WORDS, WORD_BITS = 4, 16
RADIUS = 3
TILE = 2048
#: groups of at most so many fingerprints are compared by shifts, many groups at once
SMALL = 64
BLOCK = 256
SEED = 42


def fingerprints(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """The fingerprint of each whole text, as unsigned 64-bit integers.

    A-Z is lower-cased; words are runs of anything but ASCII white space; a shingle is ``shingle`` words
    joined by spaces, repeats included (fewer words: the whole sequence). A bit is set if it is set in
    over half of the shingles' XXH64 with seed 42. A text without words has fingerprint zero.
    """
    import xxhash

    digest = xxhash.xxh64_digest
    parts, sizes = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "replace").lower().split()
        runs = zip(*[words[i:] for i in range(shingle)], strict=False) if len(words) >= shingle else [words] if words else []
        hashed = [digest(b" ".join(r), SEED) for r in runs]
        parts.append(b"".join(hashed))
        sizes.append(len(hashed))
    out = np.zeros(len(texts), np.uint64)
    for i, (part, n) in enumerate(zip(parts, sizes, strict=True)):
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 65536):
            rows = np.frombuffer(part, np.uint8, 8 * min(65536, n - at), 8 * at).reshape(-1, 8)
            ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n).view(">u8")[0]
    return out


def fingerprint_rows(docs: DataFrame, shingle: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row of ``docs(doc_id, text)``, with the long columns ``carried``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            got = [fingerprints([t for _, t in part], shingle) for part in text_batches((None, t) for (t,) in rows_of(batch.select([1])))]
            fp = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *carried])

    return read_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried).mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} long" for c in carried))


def _first_word(x: np.ndarray) -> np.ndarray:
    """The first word in which two fingerprints agree, given their exclusive-or."""
    out = np.full(x.shape, WORDS, np.int8)
    for j in range(WORDS - 1, -1, -1):
        out[(x >> np.uint64(j * WORD_BITS)) & np.uint64(0xFFFF) == 0] = j
    return out


def small_groups(group: np.ndarray, fp: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups (rows in order of group), comparing each row with its 1st, 2nd, ... follower."""
    a, b = [], []
    at = np.arange(len(fp) - 1)
    shift = 1
    while len(at):
        at = at[at + shift < len(fp)]
        at = at[group[at] == group[at + shift]]
        x = fp[at] ^ fp[at + shift]
        hit = at[(np.bitwise_count(x) <= radius) & (_first_word(x) == word[at])]
        a.append(fp[hit])
        b.append(fp[hit + shift])
        shift += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def tile_pair(left: np.ndarray, right: np.ndarray, word: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or within one, if they are the same array)."""
    both = np.concatenate([left, right]) if right is not left else left
    shift = len(left) if right is not left else 0
    root = np.arange(len(both))
    for i in range(0, len(left), BLOCK):
        x = left[i : i + BLOCK, None] ^ right[None, :]
        r, c = np.nonzero(np.bitwise_count(x) <= radius)
        ok = _first_word(x[r, c]) == word
        root = _merge(root, r[ok] + i, c[ok] + shift)
    moved = np.flatnonzero(root != np.arange(len(both)))
    return both[moved], both[root[moved]]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of a[i] and b[i]; every root is the least member of its component."""
    while True:
        while (root[root] != root).any():
            root = root[root]
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def tile_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between fingerprints of ``distinct(fp)``: a spanning forest of each pair of tiles.

    Memory: a task holds the rows of one pair of tiles, at most twice ``tile``, and a block of
    comparisons.
    """
    if radius >= WORDS:
        raise ValueError("four words serve a radius of three at most")
    word = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.shiftright("fp", j * WORD_BITS).bitwiseAND(0xFFFF).alias("v")) for j in range(WORDS)]))
    rows = distinct.select("fp", word.alias("w")).select("fp", F.col("w.j").cast("long").alias("j"), (F.col("w.v") + F.col("w.j") * 65536).alias("g"), F.bit_count("fp").alias("pc"))
    cells = rows.groupBy("g", "pc").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("g").agg(F.sum("n").alias("all"))
    alone = totals.filter(F.col("all") == 1).select("g")
    large = totals.filter(F.col("all") > tile).select("g")
    # Tiles of large groups: population count and salt. Small groups are one tile: count -1, salt 0.
    salts = cells.join(large, "g", "left_semi").select("g", "pc", F.ceil(F.col("n") / tile).alias("salts"))
    tiles = salts.select("g", "pc", "salts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("s"))
    other = tiles.select(F.col("g").alias("g2"), F.col("pc").alias("pc2"), F.col("s").alias("s2"))
    ordered = (F.col("pc") < F.col("pc2")) | ((F.col("pc") == F.col("pc2")) & (F.col("s") <= F.col("s2")))
    pairs = tiles.join(other, (F.col("g") == F.col("g2")) & (F.abs(F.col("pc") - F.col("pc2")) <= radius) & ordered)
    pairs = pairs.select("g", "pc", "s", "pc2", "s2", F.xxhash64("g", "pc", "s", "pc2", "s2").alias("p"))
    sides = pairs.select("g", "pc", "s", "p", F.lit(0).alias("side")).unionByName(
        pairs.filter((F.col("pc") != F.col("pc2")) | (F.col("s") != F.col("s2"))).select("g", F.col("pc2").alias("pc"), F.col("s2").alias("s"), "p", F.lit(1).alias("side"))
    )
    big = rows.join(salts, ["g", "pc"]).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("salts")))
    big = big.join(sides, ["g", "pc", "s"]).select("j", "g", "p", "side", "fp")
    small = rows.join(large, "g", "left_anti").join(alone, "g", "left_anti").select("j", "g", F.col("g").alias("p"), F.lit(0).alias("side"), "fp")
    work = small.unionByName(big)
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    work = work.repartition(parts, "g", "p").sortWithinPartitions("g", "p", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5

        def links(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            j, g, p, side, fp = cols
            fp = fp.view(np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])])) if len(fp) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([edge, [len(fp)]]))
            group = np.repeat(np.arange(len(edge)), size)
            two = np.bincount(group, side, len(edge)) > 0 if len(edge) else size > 0
            little = (size <= SMALL) & ~two
            keep = little[group] if len(edge) else np.zeros(0, bool)
            yield small_groups(group[keep], fp[keep], j[keep], radius)
            for k in np.flatnonzero(~little):
                at = slice(edge[k], edge[k] + size[k])
                left = fp[at][side[at] == 0]
                right = fp[at][side[at] == 1] if two[k] else left
                yield tile_pair(left, right, int(j[edge[k]]), radius)

        def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in links(cols):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            yield from emit([c[:cut] for c in cols])
        yield from emit(held)

    return work.mapInArrow(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links(a, b)``: root is the least node of its component.

    Each round is a large-star and a small-star contraction: the number of rounds grows with the
    logarithm of the longest path. A hub's links are reduced to one minimum before they are shuffled;
    the join that follows is one Spark can split. Every round is written to the shared folder.
    """
    edges = materialise(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        before = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
        # Links are distinct: of as many as before, none is new where nothing changed.
        if edges.count() == before.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(rows: DataFrame, radius: int) -> DataFrame:
    """fp, least (its least doc_id) and root (the name of its component) of every fingerprint of ``rows(doc_id, fp)``."""
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = tile_links(rows.select("fp").distinct(), radius)
    found = components(links)
    return first.join(found, first.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs(doc_id, text)``.

    Null and empty texts have fingerprint zero and are linked like any other. ``component_id`` is the
    least doc_id reachable over links of at most ``radius`` bits; null ids take part but are never it.
    Repeated rows are answered each. Other columns are not read.
    """
    rows = materialise(fingerprint_rows(docs, shingle), "fingerprints")
    rooted = _rooted(rows, radius)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """All columns of ``docs``, one row of each component: the one with the least doc_id, then the least text hash.

    Rows without an id come last. A row is told by its id and two 64-bit hashes of its text, so different
    texts that share an id, or have none, are different documents; rows alike in both are one.
    """
    own = ["__wl_h1", "__wl_h2"]
    told = docs.withColumn(own[0], F.xxhash64("text")).withColumn(own[1], F.xxhash64(F.lit(1), "text"))
    rows = materialise(fingerprint_rows(told, shingle, tuple(own)), "fingerprints")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", *own)).alias("first")
    # Reduced to a row a fingerprint first: copies of one text are many rows of one key.
    firsts = rows.groupBy("fp").agg(first)
    stay = firsts.join(_rooted(rows, radius).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.doc_id").alias("__wl_id"), *[F.col(f"first.{c}").alias(f"{c}_stay") for c in own])
    same = [F.col(c) == F.col(f"{c}_stay") for c in own]
    kept = told.join(stay, [F.col("doc_id").cast("long").eqNullSafe(F.col("__wl_id")), *same], "left_semi")
    return kept.dropDuplicates(["doc_id", *own]).drop(*own)
