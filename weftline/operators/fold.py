"""Ordered folds: layered configuration with history, and the leading-edge throttle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _apply(state: Column, op: Column, value: Column) -> Column:
    """State is (is_list, values); an empty state has null values.

    ``+`` adds (a scalar becomes a list of two), ``-`` removes all equal values, ``!`` clears, anything
    else sets.
    """
    held = F.coalesce(state["values"], F.array().cast("array<string>"))
    added = F.concat(held, F.array(value))
    left = F.filter(held, lambda v: v != value)
    return (
        F.when(op == "+", F.struct((F.size(held) > 0).alias("is_list"), added.alias("values")))
        .when(op == "-", F.struct((state["is_list"] & (F.size(left) > 0)).alias("is_list"), F.when(F.size(left) > 0, left).alias("values")))
        .when(op == "!", F.struct(F.lit(False).alias("is_list"), F.lit(None).cast("array<string>").alias("values")))
        .otherwise(F.struct(F.lit(False).alias("is_list"), F.array(value).alias("values")))
    )


def _start() -> Column:
    return F.struct(F.lit(False).alias("is_list"), F.lit(None).cast("array<string>").alias("values"))


#: operations that go on from the state before; any other one starts anew
GOES_ON = ("+", "-")


def _ordered(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return entries.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, "op", "value"))).alias("__ops"))


def config_fold(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """key, display value and number of operations, after applying (op, value) of each key in order.

    What comes before a key's last set or clear cannot matter, so only operations from there on are
    gathered in a row.
    """
    starts = F.max(F.when(~F.coalesce(F.col("op"), F.lit("")).isin(*GOES_ON), F.struct(*order, "op", "value"))).alias("__from")
    last = entries.groupBy(*key).agg(starts, F.count(F.lit(1)).cast("int").alias("n_ops"))
    last = last.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], "__from", "n_ops")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)]
    tail = entries.join(last, same).filter(F.col("__from").isNull() | (F.struct(*order, "op", "value") >= F.col("__from")))
    folded = _ordered(tail, [*key, "n_ops"], order).withColumn("__s", F.aggregate("__ops", _start(), lambda s, o: _apply(s, o["op"], o["value"])))
    return folded.select(*key, S.display_value(F.col("__s.is_list"), F.col("__s.values")).alias("value"), "n_ops")


def config_history(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """key, step, order columns, op and the display value after every operation.

    A set or clear starts a run of operations; each run is folded by itself.
    """
    run = Window.partitionBy(*key).orderBy(*order, "op", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = entries.withColumn("__at", F.count(F.lit(1)).over(run) - 1).withColumn("__run", F.count_if(~F.coalesce(F.col("op"), F.lit("")).isin(*GOES_ON)).over(run))
    rows = rows.groupBy(*key, "__run").agg(F.sort_array(F.collect_list(F.struct("__at", *order, "op", "value"))).alias("__ops"))
    rows = rows.select(*key, "__ops", F.posexplode("__ops").alias("__i", "__o"))
    rows = rows.withColumn("__s", F.aggregate(F.slice("__ops", F.lit(1), F.col("__i") + 1), _start(), lambda s, o: _apply(s, o["op"], o["value"])))
    step = F.col("__o.__at").cast("int").alias("step")
    return rows.select(*key, step, *[F.col(f"__o.{c}").alias(c) for c in order], F.col("__o.op").alias("op"), S.display_value(F.col("__s.is_list"), F.col("__s.values")).alias("value"))


def throttle(events: DataFrame, key: list[str], ts: str, micros: int, keep: list[str]) -> DataFrame:
    """The events that pass a leading-edge throttle: one passes if none passed in the ``micros`` before it.

    ``ts`` counts microseconds. Events that don't pass don't move the clock, so this is a fold and not a
    difference to the row before.
    """
    rows = events.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), *keep))).alias("__e"))
    kind = dict(rows.dtypes)["__e"]
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(kind).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        passes = acc["last"].isNull() | (e["t"] - acc["last"] >= micros)
        return F.struct(F.when(passes, e["t"]).otherwise(acc["last"]).alias("last"), F.when(passes, F.concat(acc["out"], F.array(e))).otherwise(acc["out"]).alias("out"))

    return rows.select(*key, F.explode(F.aggregate("__e", start, step, lambda a: a["out"])).alias("__x")).select(*key, F.col("__x.t").alias(ts), *[F.col(f"__x.{c}").alias(c) for c in keep])
