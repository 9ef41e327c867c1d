"""Chronological splits by whole periods (years).

A split is two cut values. They are read once, and tagging a row is a
comparison with two constants: the panel is neither joined nor shuffled for it,
and a filter on one split is a filter on the period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def split_cuts(
    df: DataFrame, n_validation: int = 6, n_test: int = 6, by: str = "year", fallback: bool = False
) -> DataFrame:
    """One row: first validation value, first test value, number of periods.

    Strict mode raises when nothing would be left to train on. ``fallback``
    shrinks test and validation to a fifth (rounded up) of what is left; it
    needs three periods. Distinct calendar years are few at any data size.
    """
    years = (
        df.where(F.col(by).isNotNull())
        .select(F.col(by).cast("int").alias("p"))
        .distinct()
        .agg(F.sort_array(F.collect_list("p")).alias("years"))
        .select("years", F.size("years").alias("n"))
    )
    fits = F.col("n") > n_validation + n_test
    if fallback:
        n_test_used = F.when(fits, F.lit(n_test)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") * 0.2).cast("int")))
        rest = F.col("n") - F.col("n_test")
        n_val_used = F.when(fits, F.lit(n_validation)).otherwise(F.greatest(F.lit(1), F.ceil(rest * 0.2).cast("int")))
        enough = F.col("n") >= 3
        message = "fewer than three periods: one each for fitting, validation and test is the least"
    else:
        n_test_used, n_val_used, enough = F.lit(n_test), F.lit(n_validation), fits
        message = "the asked periods of validation and test leave none to fit on"
    sized = years.withColumn("n_test", n_test_used).withColumn("n_val", n_val_used)
    train_end = F.greatest(F.lit(1), F.col("n") - F.col("n_val") - F.col("n_test"))

    def checked(index: Column) -> Column:
        value = F.get("years", index.cast("int"))
        return F.when(enough, value).otherwise(F.raise_error(F.lit(message)).cast("int"))

    return sized.select(
        checked(train_end).alias("validation_from"),
        checked(F.col("n") - F.col("n_test")).alias("test_from"),
        F.col("n").alias("n_periods"),
    )


def split_of(period: Column, validation_from: int, test_from: int) -> Column:
    return (
        F.when(period >= test_from, F.lit(TEST))
        .when(period >= validation_from, F.lit(VALIDATION))
        .otherwise(F.lit(TRAIN))
    )


def with_split(df: DataFrame, cuts: DataFrame, by: str = "year", output: str = "split") -> DataFrame:
    """Tag every row with its split; ``cuts`` comes from :func:`split_cuts`."""
    row = cuts.collect()[0]
    return df.withColumn(output, split_of(F.col(by), row["validation_from"], row["test_from"]))


def split_table(df: DataFrame, cuts: DataFrame, by: str = "year") -> DataFrame:
    """The split as a table: one row per period."""
    periods = df.where(F.col(by).isNotNull()).select(F.col(by).cast("int").alias(by)).distinct()
    return with_split(periods, cuts, by)


def split_lists(df: DataFrame, cuts: DataFrame, by: str = "year") -> dict[str, list[int]]:
    """The split as driver lists, for configuration files and messages."""
    lists: dict[str, list[int]] = {TRAIN: [], VALIDATION: [], TEST: []}
    for row in split_table(df, cuts, by).orderBy(by).collect():
        lists[row["split"]].append(row[by])
    return lists
