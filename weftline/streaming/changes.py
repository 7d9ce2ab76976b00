"""Change streams: file events, routing, stateful throttle, incremental index updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S
from ..operators.build import latest

# Folders and ends of file names that are not watched, and the extensions of assets and sources.
IGNORED = ("Intermediate", "Binaries", "Build", "Saved", "DerivedDataCache", ".git", ".vs", "ExternalActors", "ExternalObjects")
IGNORED_ENDS = (".generated.h", ".gen.cpp", ".gen.h", ".designer.cs")
ASSETS, SOURCES = ("uasset",), ("h", "hh", "hpp", "cpp", "cc", "cxx", "inl", "cs")
#: after so many micro-batches the changes are folded into one table
COMPACT_EVERY = 16


def change_stream(spark: SparkSession, folder: str, schema: str, files_each: int = 1000, kind: str = "parquet") -> DataFrame:
    """A stream of the change records that appear in a folder."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_each).load(folder)


def routed(events: DataFrame, path: str = "path", exists: str = "exists") -> DataFrame:
    """Add ``route``: delete, config, asset, source or ignore.

    Folders and ends of names are compared without case. Of files that are gone only assets are routed.
    """
    p = S.lower_ascii(S.normalize_path(path))
    e = S.extension(p)
    ends = F.lit(False)
    for end in IGNORED_ENDS:
        ends = ends | p.endswith(end)
    ignored = ends | F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(x.lower()) for x in IGNORED]))
    gone = F.when(e.isin(*ASSETS), "delete").otherwise("ignore")
    route = F.when(ignored, "ignore").when(~F.col(exists), gone).when(e == "ini", "config").when(e.isin(*ASSETS), "asset").when(e.isin(*SOURCES), "source").otherwise("ignore")
    return events.withColumn("route", route)


def throttled(events: DataFrame, key: str, micros: int, forget_after_ms: int | None = None) -> DataFrame:
    """Leading-edge throttle a key over ``events(key, ts_us)``: state is the time of the last event that passed.

    Events of one key are taken in time order within a micro-batch. With ``forget_after_ms`` the state of
    a key that stays silent so long, in wall-clock time, is dropped; choose it well above the width. A
    stream with it never runs dry, so leave it out with ``availableNow``.
    """
    schema = f"{key} {dict(events.dtypes)[key]}, ts_us long"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out: list[int] = []
        times = sorted(int(t) for b in batches for t in b["ts_us"])
        for t in times:
            if last is None or t - last >= micros:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        if forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame({key: [group[0]] * len(out), "ts_us": out})

    return events.select(key, "ts_us").groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout)


def _written(spark: SparkSession, store: str) -> tuple[int | None, list[int]]:
    """The number of the last whole table in a store, and those of the changes after it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(store)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    whole = lambda name: files.exists(jvm.org.apache.hadoop.fs.Path(place, f"{name}/_SUCCESS"))
    number = lambda kind: sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and whole(n))
    base = max(number("base"), default=None)
    return base, [n for n in number("changes") if base is None or n > base]


def _merged(spark: SparkSession, store: str, key: list[str], version: str) -> DataFrame:
    base, changes = _written(spark, store)
    parts = [f"{store}/changes={n}" for n in changes] + ([] if base is None else [f"{store}/base={base}"])
    if not parts:
        raise ValueError(f"nothing has been written to {store}")
    return latest(reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in parts]), key, [F.col(version)])


def read_store(spark: SparkSession, store: str, key: list[str], version: str, deleted: str) -> DataFrame:
    """The rows that a store of ``upsert_each_batch`` holds now: the greatest version of each key, unless that deletes it."""
    return _merged(spark, store, key, version).filter(~F.col(deleted)).drop(deleted)


def upsert_each_batch(store: str, key: list[str], version: str, deleted: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps a keyed table current; ``read_store`` reads it.

    A micro-batch writes its own changes and nothing else, one row a key; every COMPACT_EVERY batches they
    are folded into one table. The greatest version of a key counts, whatever batch it came in; deletions
    are kept as rows, so that an older version that comes late stays deleted. A batch that is run again
    writes the same changes again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        latest(batch, key, [F.col(version)]).write.mode("overwrite").parquet(f"{store}/changes={number}")
        if (number + 1) % COMPACT_EVERY == 0:
            _merged(batch.sparkSession, store, key, version).write.mode("overwrite").parquet(f"{store}/base={number}")

    return apply


def latency_windows(events: DataFrame, ts: str, label: str, late: str = "10 minutes", width: str = "2 seconds") -> DataFrame:
    """Counts and latencies a label in aligned windows; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), label).agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("millis") / F.count(F.lit(1))).alias("avg_ms"), F.max("millis").alias("max_ms"), F.count_if(F.col("failed")).alias("errors"))
