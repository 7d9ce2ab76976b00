"""One-permutation MinHash with optimal densification and packed low-order bits, in DataFrame expressions.

A text's word shingles are hashed once. The top bits of a hash choose one of 128 bins, and a bin keeps
its least hash. An empty bin borrows from a bin drawn by a hash of (empty bin, full bin): the full bin
with the least draw, which is the first full bin of a fixed random order and so serves any number of
empty bins at once. Of every bin the low four bits are kept, 512 bits in all, written as 128 hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 4
PER_LONG = 64 // LOW_BITS
SHINGLE = 5
#: a table of at most so many rows of three longs may be broadcast; a larger one is joined by shuffle
BROADCAST_ROWS = 250_000


def word_hashes(text: Column) -> Column:
    """A hash of each white-space separated word, ASCII lower case folded only; null text counts as empty."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _pair(a: Column, b: Column, salt: int) -> Column:
    return F.xxhash64(a, b, F.lit(salt))


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Add ``out``: an array of eight longs, the packed fingerprint of column ``text``.

    A text of fewer than ``shingle`` words is one shingle, the whole sequence (none: the empty one).
    Equal word sequences have equal fingerprints. Each step is a column of its own, used more than
    once by the next, so that no step is evaluated again for every array element.
    """
    h, s, m = "__wl_h", "__wl_s", "__wl_m"
    keep = [c for c in df.columns]
    df = df.withColumn(h, word_hashes(F.col(text)))
    n = F.size(h)
    # Words i..i+4 are hashed as ((0,1),(2,3)),4: three passes over longs instead of five lookups a shingle.
    if shingle != 5:
        raise ValueError("shingles are of five words")
    two = F.when(n >= 5, F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: _pair(a, b, 2)))
    df = df.withColumn("__wl_2", two)
    four = F.zip_with(F.slice("__wl_2", 1, n - 4), F.slice("__wl_2", 3, n - 4), lambda a, b: _pair(a, b, 4))
    five = F.zip_with(four, F.slice(h, 5, n - 4), lambda a, b: _pair(a, b, 5))
    whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    df = df.withColumn(s, F.sort_array(F.when(n >= 5, five).otherwise(whole)))
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")
    # Sorted hashes lie in order of unsigned bins within each sign; the first of a run of equal bins is its least.
    least = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.element_at(F.col(s), F.greatest(i, F.lit(1))))))
    df = df.withColumn(m, least)
    full = F.transform(m, bin_of)
    df = df.withColumn("__wl_full", full)
    at = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.array_position(F.col("__wl_full"), j).cast("int"))
    df = df.withColumn("__wl_at", at)
    borrowed = lambda j: F.array_min(F.transform(F.col("__wl_full"), lambda b, i: F.struct(F.xxhash64(j, b).alias("d"), (i + 1).alias("p"))))["p"]
    place = F.transform("__wl_at", lambda p, j: F.when(p > 0, p).otherwise(borrowed(j)))
    df = df.withColumn("__wl_p", place)
    low = F.transform("__wl_p", lambda p, j: F.shiftrightunsigned(F.xxhash64(F.element_at(F.col(m), p), F.lit(7)), 64 - LOW_BITS))
    df = df.withColumn("__wl_low", low)
    longs = []
    for k in range(BINS // PER_LONG):
        part = F.slice("__wl_low", k * PER_LONG + 1, PER_LONG)
        longs.append(F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x)))
    return df.withColumn(out, F.array(*longs)).select(*keep, out)


def hex_digits(packed: Column) -> Column:
    """The packed longs as lower-case hex, four low bits of a bin to a digit."""
    return F.concat(*[F.lower(F.lpad(F.hex(packed[k]), 16, "0")) for k in range(BINS // PER_LONG)])


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1: the share of equal bins, corrected for chance agreement of the low bits."""
    ones = int("1" * PER_LONG, 16)
    differ = F.lit(0)
    for k in range(BINS // PER_LONG):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), ((F.lit(BINS) - differ) / float(BINS) - chance) / (1 - chance))


def _range_buckets(ids: DataFrame, rows_each: int, coarse: int = 64) -> tuple[Column, int]:
    """A bucket number that grows with doc_id, of about ``rows_each`` rows each, and a bound on their count.

    ``coarse`` quantiles follow the spread of the ids and are cut into equal pieces. Null ids go to -1.
    """
    got = ids.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 10000).alias("q")).first()
    cuts = sorted(set(got["q"] or [0]))
    pieces = max(1, -(-got["n"] // (rows_each * max(1, len(cuts)))))
    d = F.col("doc_id")
    low = F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]), lambda c: c > d)) - 1
    low = F.greatest(low, F.lit(0))
    begin = F.element_at(F.array(*[F.lit(x).cast("long") for x in cuts]), low + 1)
    end = F.element_at(F.array(*[F.lit(x).cast("long") for x in [*cuts[1:], cuts[-1] + 1]]), low + 1)
    inside = F.floor((d - begin).cast("double") * pieces / F.greatest(end - begin, F.lit(1)).cast("double"))
    inside = F.least(F.greatest(inside, F.lit(0)), F.lit(pieces - 1))
    return F.coalesce(low.cast("long") * pieces + inside, F.lit(-1).cast("long")), pieces * len(cuts) + 1


def fingerprint_documents(docs: DataFrame, rows_each: int = 4_000) -> DataFrame:
    """Fingerprint every text of ``docs(doc_id, text)`` and its edited text.

    The edited text is the text with its last floor(n_chars/3) code points replaced by the first as
    many (or all) of the next document in descending doc_id order; after the last comes the first, and
    a lone document follows itself. Ties of doc_id are ordered by text, descending; null ids come last
    and null texts count as empty. The order is found in id ranges of about ``rows_each`` rows; the
    head of every range is also sent to the range before it, so no task sees the whole order.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (128 hex digits),
    near_edited and near_next. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    bucket, buckets = _range_buckets(ids, rows_each)
    # One row a range: its head and the range that comes before it in descending order.
    heads = ids.groupBy(bucket.alias("own")).agg(F.max("doc_id").alias("head"))
    order = Window.orderBy(F.col("own").desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        F.col("own").alias("__wl_own"), F.col("head").alias("__wl_head"), F.coalesce(F.lag("own").over(order), F.last("own").over(whole)).alias("__wl_before")
    )
    if buckets <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    rows = rows.withColumn("__wl_bucket", bucket)
    rows = rows.join(heads, (F.col("__wl_bucket") == F.col("__wl_own")) & F.col("doc_id").eqNullSafe(F.col("__wl_head")), "left")
    copies = F.when(F.col("__wl_own").isNull(), F.array(F.struct(F.col("__wl_bucket").alias("b"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("__wl_bucket").alias("b"), F.lit(False).alias("ghost")), F.struct(F.col("__wl_before").alias("b"), F.lit(True).alias("ghost")))
    )
    rows = with_fingerprint(rows.select("doc_id", "text", copies.alias("__wl_copies")), "text", "__wl_fp")
    rows = rows.select("doc_id", "text", "__wl_fp", F.inline("__wl_copies"))
    after = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    nxt = F.lead(F.struct("text", "__wl_fp")).over(after)
    rows = rows.withColumn("__wl_next", nxt).filter(~F.col("ghost"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("__wl_next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("__wl_edited"), "__wl_fp", F.col("__wl_next.__wl_fp").alias("__wl_next_fp"))
    rows = with_fingerprint(rows, "__wl_edited", "__wl_efp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("__wl_edited").cast("binary"), 256).alias("edited_sha256"),
        hex_digits(F.col("__wl_fp")).alias("fingerprint"),
        hex_digits(F.col("__wl_efp")).alias("edited_fingerprint"),
        likeness(F.col("__wl_fp"), F.col("__wl_efp")).alias("near_edited"),
        likeness(F.col("__wl_fp"), F.col("__wl_next_fp")).alias("near_next"),
    )
