"""Consecutive numbers for the rows of groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.sources import scratch


def _fresh(columns: list[str], stem: str) -> str:
    return next(f"_{stem}{i}" for i in range(len(columns) + 1) if f"_{stem}{i}" not in columns)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equal in all of the names; a null equals a null."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "ordinal", attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` with ``name`` 0, 1, 2 ... within each group of ``by``, in the order of ``order``.

    Rows are dealt to ranges of (by, order), sorted there and written down with their place in the range. A group may
    lie in many ranges: the first number of each of its pieces is a running sum of the pieces' counts, one row a piece.
    Rows that agree in ``by`` and ``order`` are dealt over ranges as well and keep the number they are written with.
    Nulls are a group of their own, and come first in an ascending order. ``attach``: from (by, n_rows), a table (by,
    more columns); these come along with the pieces, so that a large group's rows need no join by group. Of an empty
    table there are no rows; a column of the name ``name`` is replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop(name)
    tie, at, part, shift = (_fresh([*rows.columns, name], s) for s in ("tie", "at", "part", "shift"))
    keys = [*by, *order, tie]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).drop(tie)
    dealt = dealt.withColumn(at, F.monotonically_increasing_id())  # the number of the range above 33 bits of the place in it
    held = scratch.written(dealt.withColumn(part, F.shiftright(at, 33).cast("int")), "ranges")
    pieces = held.groupBy(part, *by).agg(F.count("*").alias("n_rows"), F.min(at).alias(shift))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(part, *by, (F.coalesce(F.sum("n_rows").over(before), F.lit(0)) - F.col(shift)).alias(shift))
    extra: list[str] = []
    if attach is not None:
        more = attach(pieces.groupBy(*by).agg(F.sum("n_rows").alias("n_rows")))
        extra = [c for c in more.columns if c not in by]
        starts = starts.join(more, same(starts, more, by)).select(part, *(starts[c] for c in by), shift, *extra)
    starts = scratch.written(starts, "starts")  # its size is known when the join with it is planned
    out = held.join(starts, same(held, starts, [part, *by]))
    return out.select(*(held[c] for c in rows.columns), *(starts[c] for c in extra), (held[at] + starts[shift]).alias(name))


def dense(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """``rows``, written down, with ``name`` 0, 1, 2 ... in the order in which they lie there: no shuffle, one count a
    partition."""
    part, at = (_fresh([*rows.columns, name], s) for s in ("part", "at"))
    held = rows.withColumn(at, F.monotonically_increasing_id())
    held = scratch.written(held.withColumn(part, F.shiftright(at, 33).cast("int")), "dense")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(part).agg(F.count("*").alias("n"), F.min(at).alias("first"))  # a row a partition
    starts = counts.select(part, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return held.join(F.broadcast(starts), part).select(*(held[c] for c in rows.columns if c != name), (F.col(at) + F.col("shift")).alias(name))
