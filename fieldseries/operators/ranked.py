"""Cumulative counts over sorted values, without a single-task sort.

ROC, average precision, exact medians and quantiles and threshold searches all
need "how much weight lies below this value". A window without partition
columns would send every distinct value to one task. Here:

1. equal values are added up first (map-side combine), so ties never travel,
   and the cells are written once: everything below reads them, not the rows;
2. few cells (the count is checked) take one window per group. Otherwise the
   value axis is cut into buckets of about equal numbers of distinct values.
   The cuts are sampled by the hash of the value: the same cuts on every
   recomputation, also after a lost executor, unlike those of a sketch;
3. running sums are taken inside each ``(group, bucket)``, and the sums of the
   buckets before it, at most ``max_buckets`` rows per group, are joined on.

A group that holds most of the data owns most of the cuts and is spread over
as many buckets.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseries.operators.materialize import materialize

# Binary search steps: enough for any array that a driver can hold.
_SEARCH_STEPS = 31


def bisect_right(cuts: Column, value: Column, steps: int = _SEARCH_STEPS) -> Column:
    """Number of elements of the sorted array ``cuts`` that are <= ``value``."""

    def step(state: Column, _: Column) -> Column:
        low, high = state.getField("low"), state.getField("high")
        middle = F.floor((low + high) / 2).cast("int")
        go_right = (low < high) & (F.get(cuts, middle) <= value)
        return F.struct(
            F.when(go_right, middle + 1).otherwise(low).alias("low"),
            F.when((low < high) & ~go_right, middle).otherwise(high).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s.getField("low"))


def _group_key(by: Iterable[str]) -> Column:
    """Grouping columns as one never-null key, so null groups survive a join."""
    by = list(by)
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def value_cells(
    df: DataFrame, value: str, sums: dict[str, Column], by: Iterable[str] = ()
) -> DataFrame:
    """One row per group and distinct value: ``_g, _v`` and the summed weights."""
    keyed = df.where(F.col(value).isNotNull()).select(
        _group_key(by).alias("_g"),
        # adding 0.0 merges -0.0 and 0.0
        (F.col(value).cast("double") + F.lit(0.0)).alias("_v"),
        *[c.cast("long").alias(n) for n, c in sums.items()],
    )
    return keyed.groupBy("_g", "_v").agg(*[F.sum(n).alias(n) for n in sums])


def ranked_cells(cells: DataFrame, sums: Iterable[str], ranges: int | None = None) -> DataFrame:
    """Add ``{s}_before`` (weight of smaller values) and ``{s}_total`` per group.

    ``cells`` has one row per ``(_g, _v)``; its other columns are kept. The cells are
    dealt out by ranges of ``(_g, _v)`` and written once, so that range numbers stay the
    same; each range is added up by itself, and the sums of earlier ranges of a group are
    added to its rows. A hot group takes as many ranges as its distinct values need. Spark
    sizes the ranges unless ``ranges`` asks for a number.
    """
    sums = list(sums)
    names = [c for c in cells.columns]
    dealt = cells.repartitionByRange(ranges, "_g", "_v") if ranges else cells.repartitionByRange("_g", "_v")
    placed = materialize(dealt.withColumn("_b", F.spark_partition_id()))

    inside = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"_in_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})

    parts = placed.groupBy("_g", "_b").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("_g")
    offsets = parts.select(
        "_g",
        "_b",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"{s}_total") for s in sums],
    )
    joined = local.join(offsets, ["_g", "_b"])
    return joined.select(
        *names,
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def ungroup(df: DataFrame, by: Iterable[str], *columns: str | Column) -> DataFrame:
    """Replace the packed key by the grouping columns."""
    return df.select(*[F.col(f"_g.{b}").alias(b) for b in by], *columns)


def _quantile_positions(probs: list[float] | int) -> tuple[Column, int]:
    """Probabilities as an array column; an integer asks for that many even steps."""
    if isinstance(probs, int):
        step = 1.0 / (probs - 1)
        # the even grid 0, step, 2*step, ... with its end set to exactly 1
        grid = F.transform(
            F.sequence(F.lit(0), F.lit(probs - 1)),
            lambda i: F.when(i == probs - 1, F.lit(1.0)).otherwise(i * F.lit(step)),
        )
        return grid, probs
    return F.array(*[F.lit(float(p)) for p in probs]), len(probs)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: list[float] | int,
    by: Iterable[str] = (),
    **bucketing: int,
) -> DataFrame:
    """Exact quantiles with linear interpolation: rows ``(by.., q_index, quantile)``.

    A quantile needs the values at two ranks. Each distinct value knows the
    ranks it covers, so the wanted ranks are picked where they lie and at most
    two rows per quantile are shuffled.
    """
    by = list(by)
    cells = value_cells(df, value, {"n": F.lit(1)}, by)
    return ungroup(quantiles_of_cells(cells, probs, **bucketing), by, "q_index", "quantile")


def quantiles_of_cells(cells: DataFrame, probs: list[float] | int, **bucketing: int) -> DataFrame:
    """:func:`exact_quantiles` on cells with a count column ``n``; keeps ``_g``."""
    ranked = ranked_cells(cells.select("_g", "_v", "n"), ["n"], **bucketing)
    grid, size = _quantile_positions(probs)
    last = F.col("n_total") - 1
    first_rank, end_rank = F.col("n_before"), F.col("n_before") + F.col("n")
    if isinstance(probs, int):
        # Only grid points next to the ranks of this value can match.
        scale = F.lit(float(size - 1)) / F.greatest(last, F.lit(1))
        low = F.greatest(F.lit(0), F.floor((first_rank - 1) * scale).cast("int") - 1)
        high = F.least(F.lit(size - 1), F.ceil(end_rank * scale).cast("int") + 1)
    else:
        low, high = F.lit(0), F.lit(size - 1)
    near = ranked.withColumn(
        "_q",
        F.transform(
            F.sequence(F.least(low, high), high),
            lambda i: F.struct(i.alias("i"), (F.get(grid, i) * last).alias("at")),
        ),
    )
    hits = F.filter(
        F.col("_q"),
        lambda q: ((F.floor(q["at"]) >= first_rank) & (F.floor(q["at"]) < end_rank))
        | ((F.least(F.floor(q["at"]) + 1, last) >= first_rank) & (F.least(F.floor(q["at"]) + 1, last) < end_rank)),
    )
    picked = near.select("_g", "_v", "n_before", "n", "n_total", F.explode(hits).alias("q"))
    rank = F.floor(F.col("q.at"))
    upper = F.least(rank + 1, last)
    ends = picked.groupBy("_g", F.col("q.i").alias("q_index")).agg(
        F.max(F.when((rank >= first_rank) & (rank < end_rank), F.col("_v"))).alias("lo"),
        F.max(F.when((upper >= first_rank) & (upper < end_rank), F.col("_v"))).alias("hi"),
        F.max(F.col("q.at") - rank).alias("t"),
    )
    gap = F.col("hi") - F.col("lo")
    value = F.when(F.col("t") >= 0.5, F.col("hi") - gap * (1 - F.col("t"))).otherwise(
        F.col("lo") + gap * F.col("t")
    )
    return ends.select("_g", "q_index", value.alias("quantile"))


def column_medians(df: DataFrame, columns: list[str], **bucketing: int) -> DataFrame:
    """Exact medians of many columns: rows ``(column_name, median)``.

    Columns become rows first, so all medians share one job; the values are
    combined map-side before the shuffle.
    """
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("e")
    ).select("e.*")
    return exact_quantiles(long, "value", [0.5], ["column_name"], **bucketing).select(
        "column_name", F.col("quantile").alias("median")
    )
