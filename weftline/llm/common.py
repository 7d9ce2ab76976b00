"""Shared helpers of the training-data operators: scratch tables, key hashes and gapless numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scratch import materialise, scratch_path, shared_dir  # noqa: F401


#: rows of text that go to a Python worker at a time
ROWS_SENT = 1000


def read_texts(docs: DataFrame) -> DataFrame:
    """``docs`` for an operator that reads texts in Python workers.

    Rows hold whole texts, so the session's number of rows sent to a worker at a time, meant for rows of a
    few numbers, is lowered to ROWS_SENT: both sides hold a batch.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(docs.sparkSession.conf.get(key))
    if now <= 0 or now > ROWS_SENT:
        docs.sparkSession.conf.set(key, str(ROWS_SENT))
    return docs


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    jvm, hadoop = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application. Call it once no lazy result reads them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether the row belongs to the fold that no model may learn from; a null id belongs to none."""
    return F.coalesce(id_remainder(doc_id, modulus) == remainder, F.lit(False))


#: a table of at most so many rows of a few numbers may be broadcast; a larger one is joined by shuffle
BROADCAST_ROWS = 100_000


def numbered(df: DataFrame, group: list[str], order: list[str], rank: str, rows_each: int = 1000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, without gathering a group in one task.

    A group is dealt by a hash of ``order`` into one bucket for every ``rows_each`` of its rows; each
    bucket is numbered on its own and shifted by the counts of the group's earlier buckets. So a window
    sees about ``rows_each`` rows whatever the share of one group. Equal rows are folded into one with a
    multiplicity first: a row that repeats without bound stays one row until it is unfolded.

    ``df`` is read several times; pass a scan or a materialised table. Its columns must be groupable.
    """
    cols = df.columns
    folded = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__wl_many"))
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__wl_all"))
    totals = totals.select(*[F.col(c).alias(f"__wl_t{i}") for i, c in enumerate(group)], "__wl_all")
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        totals = F.broadcast(totals)
    same = [F.col(c).eqNullSafe(F.col(f"__wl_t{i}")) for i, c in enumerate(group)]
    buckets = F.ceil(F.col("__wl_all") / rows_each)
    folded = folded.join(totals, same).withColumn("__wl_bucket", F.pmod(F.xxhash64(*order), buckets)).select(*cols, "__wl_many", "__wl_bucket")
    earlier = (Window.unboundedPreceding, -1)
    of_group = Window.partitionBy(*group).orderBy("__wl_bucket").rowsBetween(*earlier)
    of_bucket = Window.partitionBy(*group, "__wl_bucket").orderBy(*order, *[c for c in cols if c not in order]).rowsBetween(*earlier)
    sizes = folded.groupBy(*group, "__wl_bucket").agg(F.sum("__wl_many").alias("__wl_size"))
    shifts = sizes.select(*[F.col(c).alias(f"__wl_g{i}") for i, c in enumerate(group)], F.col("__wl_bucket").alias("__wl_b"), F.coalesce(F.sum("__wl_size").over(of_group), F.lit(0)).alias("__wl_shift"))
    on = [F.col(c).eqNullSafe(F.col(f"__wl_g{i}")) for i, c in enumerate(group)] + [F.col("__wl_bucket") == F.col("__wl_b")]
    joined = folded.withColumn("__wl_inner", F.coalesce(F.sum("__wl_many").over(of_bucket), F.lit(0))).join(shifts, on)
    base = F.col("__wl_shift") + F.col("__wl_inner")
    return joined.select(*cols, F.explode(F.sequence(base, base + F.col("__wl_many") - 1)).alias(rank))


def least_hashed(rows: DataFrame, key: str, ties: list[str], most: int) -> DataFrame:
    """The ``most`` rows with the least hashes of ``key``: a bounded sample that any partitioning gives alike.

    The row count sets how small a hash must be to be looked at, so that tasks send on a few times the
    sample together, and not the whole sample each. Should that leave too few rows by chance, which is
    next to impossible, the sample is smaller.
    """
    count = rows.count()
    hashed = rows.withColumn("__wl_h", F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long"))
    if count > 4 * most:
        hashed = hashed.filter(F.col("__wl_h") <= int(2.0 * most / count * 0xFFFFFFFF) + 1)
    return hashed.orderBy("__wl_h", key, *ties).limit(most).drop("__wl_h")
