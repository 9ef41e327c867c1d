"""Reading daily observations: one file per year, or one flat table.

``read_year_files`` expects a directory of CSV files named after their year
(``1972.csv``, ``G1972.csv``); columns are taken by position. ``read_named``
takes any CSV or parquet table and goes by normalised header names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldseries.functions.cleaning import (
    binary_half_even,
    coerce_numeric,
    half_even_int,
    normalize_name,
    rain_flag,
    repair_numeric,
    season_start,
    snake_name,
)
from fieldseries.operators.windows import add_columns
from fieldseries.panel import Panel
from fieldseries.schema import (
    FEATURE_COLUMNS,
    LABEL,
    RAIN,
    SEASON_FIRST_DAYS,
    SEASON_ROWS,
    SOURCE_COLUMNS,
    WEATHER_VARIABLES,
)

FILE_ORDER = ["_block", "_line"]
_CLEANERS: dict[str, Callable[[Column], Column]] = {"repair": repair_numeric, "basic": coerce_numeric}


def _year_of_file(rule: str) -> Column:
    """Year in the file name, or null when the file is no year unit."""
    stem = F.regexp_replace("_file", r"\.[^.]*$", "")
    if rule == "strict":
        return F.when(stem.rlike(r"^G?\d{4}$"), F.regexp_extract(stem, r"(\d{4})", 1).cast("int"))
    if rule == "digits":
        digits = F.regexp_replace(stem, r"\D", "")
        return F.when(F.length(digits) == 4, digits.cast("int"))
    raise ValueError(f"Unknown file-name rule: {rule}")


def scan_year_files(spark: SparkSession, path: str, rule: str = "strict", suffix: str = "*.csv") -> DataFrame:
    """Raw text cells by position, the year from the file name and the file order.

    The header row is skipped and its names ignored; absent columns are null.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in SOURCE_COLUMNS])
    raw = (
        spark.read.schema(schema).option("header", True).option("pathGlobFilter", suffix).csv(path)
        .select(
            *SOURCE_COLUMNS[1:],
            F.col("_metadata.file_name").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
    )
    return raw.withColumn("year", _year_of_file(rule)).where(F.col("year").isNotNull())


def cap_rows(df: DataFrame, unit: list[str], order: list[str], rows: int = SEASON_ROWS) -> DataFrame:
    """The first ``rows`` rows of each unit.

    The filter on ``row_number`` lets Spark drop surplus rows of a unit before
    the shuffle, so an overlong file is never gathered in one task.
    """
    number = F.row_number().over(Window.partitionBy(*unit).orderBy(*order))
    return df.withColumn("_n", number).where(F.col("_n") <= rows).drop("_n")


def season_days(df: DataFrame, unit: list[str], order: list[str], year: str = "year", day: str = "day") -> DataFrame:
    """Check the day numbers of each unit and renumber the broken ones.

    A unit is valid with exactly 92 known days, consecutive in file order and
    starting on day 152 or 153. Others count up from June 1st. Adds
    ``valid_days``. Units must be capped (:func:`cap_rows`) or short.
    """
    w = Window.partitionBy(*unit).orderBy(*order)
    whole = Window.partitionBy(*unit)
    stepped = df.withColumns(
        {
            "_d": F.col(day).cast("int"),
            "_step": F.col(day).cast("int") - F.lag(F.col(day).cast("int")).over(w),
            "_n": F.row_number().over(w),
        }
    )
    first = F.max(F.when(F.col("_n") == 1, F.col("_d"))).over(whole)
    valid = F.coalesce(
        (F.count(F.lit(1)).over(whole) == SEASON_ROWS)
        & (F.count("_d").over(whole) == SEASON_ROWS)
        & (F.min("_step").over(whole) == 1)
        & (F.max("_step").over(whole) == 1)
        & first.isin(*SEASON_FIRST_DAYS),
        F.lit(False),
    )
    renumbered = season_start(F.col(year)) + F.col("_n") - 1
    return (
        stepped.withColumn("valid_days", valid)
        .withColumn(day, F.when(F.col("valid_days"), F.col("_d")).otherwise(renumbered).cast("int"))
        .drop("_d", "_step", "_n")
    )


def canonical_days(years: DataFrame, year: str = "year", through_august: bool = False) -> DataFrame:
    """The expected days of each year: 92 from June 1st, or 152 .. 243/244."""
    start = season_start(F.col(year))
    first = F.lit(152) if through_august else start
    last = start + 91
    return years.select(year, F.explode(F.sequence(first, last)).alias("day"))


def panel_keys(df: DataFrame, panel: Panel, label: str | None = LABEL, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Drop rows without keys (or label), integer keys, 0/1 label, all features present."""
    required = [*panel.columns, *([label] if label else [])]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Data must contain the columns {required}; missing: {missing}")
    columns = {c: half_even_int(F.col(c)) for c in panel.columns if not isinstance(df.schema[c].dataType, T.StringType)}
    if label:
        columns[label] = binary_half_even(F.col(label)).cast("int")
    columns.update({c: F.lit(None).cast("double") for c in features if c not in df.columns})
    return add_columns(df.dropna(subset=required), columns)


def read_year_files(
    spark: SparkSession, path: str, rule: str = "strict", row_cap: int | None = SEASON_ROWS, clean: str = "repair"
) -> DataFrame:
    """Daily panel ``(year, day)`` of the disease workload from per-year files."""
    raw = scan_year_files(spark, path, rule)
    capped = raw if row_cap is None else cap_rows(raw, ["_file"], FILE_ORDER, row_cap)
    cells = add_columns(capped, {c: _CLEANERS[clean](F.col(c)) for c in SOURCE_COLUMNS[1:]})
    numbered = season_days(cells, ["_file"], FILE_ORDER) if row_cap is not None else cells
    return panel_keys(numbered.select(*SOURCE_COLUMNS), Panel())


# Header spellings that mean an existing column.
_RENAMES = {"t_10": "t_gt_10", "t_10_": "t_gt_10"}


def named_columns(df: DataFrame, style: str = "plain") -> DataFrame:
    """Normalise header names: ``plain``, ``weather`` (spells out >) or ``snake``."""
    spell = {
        "plain": normalize_name,
        "weather": lambda n: normalize_name(n, gt_word=True),
        "snake": snake_name,
    }[style]
    names = [spell(c) for c in df.columns]
    if style != "snake":
        names = [_RENAMES.get(n, n) for n in names]
    if "year" not in names:
        names = ["year" if n == "unnamed_0" else n for n in names]
    # pandas spells an empty first header "Unnamed: 0", Spark "_c0"
    if "year" not in names:
        names = ["year" if n == "c0" else n for n in names]
    return df.toDF(*names)


def _scan_table(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


def read_named(
    spark: SparkSession, path: str, fmt: str = "csv", style: str = "plain", clean: str = "repair", panel: Panel = Panel()
) -> DataFrame:
    """Daily panel of the disease workload from a flat table, by header name."""
    df = named_columns(_scan_table(spark, path, fmt), style)
    numbers = {c: _CLEANERS[clean](F.col(c)) for c in df.columns if c not in panel.keys or c == "year"}
    return panel_keys(add_columns(df, numbers), panel)


def weather_panel(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """Keys and the six weather variables; a missing rain flag means no rain."""
    required = [*panel.columns, *WEATHER_VARIABLES]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Weather data requires the columns {required}; missing: {missing}")
    cells = df.select(
        *[k for k in panel.keys if k != "year"],
        *[repair_numeric(F.col(c)).alias(c) for c in required if c not in panel.keys or c == "year"],
    )
    keyed = panel_keys(cells, panel, label=None, features=[])
    return keyed.withColumn(RAIN, rain_flag(F.col(RAIN))).select(*required)


def read_weather(
    spark: SparkSession, path: str, fmt: str = "csv", year_files: bool = False, panel: Panel = Panel(), row_cap: int | None = SEASON_ROWS
) -> DataFrame:
    """Weather panel from a flat table, or from per-year files with any 4-digit name.

    Rows of a year file after the first ``row_cap`` are not part of its season; None reads all.
    """
    if year_files:
        raw = scan_year_files(spark, path, "digits")
        return weather_panel(raw if row_cap is None else cap_rows(raw, ["_file"], FILE_ORDER, row_cap), panel)
    return weather_panel(named_columns(_scan_table(spark, path, fmt), "weather"), panel)


def read_simple(spark: SparkSession, path: str) -> DataFrame:
    """Per-year files by header name, no row cap, plain numbers only.

    All files share one header; a file with another one raises instead of
    shifting its cells into wrong columns.
    """
    names = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        .option("pathGlobFilter", "*.csv").csv(path)
        .select(*names, F.col("_metadata.file_name").alias("_file"))
        .withColumn("_file_year", _year_of_file("strict"))
        .where(F.col("_file_year").isNotNull())
    )
    named = named_columns(raw.drop("_file", "_file_year"), "snake").columns
    table = raw.toDF(*named, "_file", "_file_year")
    if "year" not in named:
        table = table.withColumn("year", F.col("_file_year"))
    table = table.drop("_file", "_file_year")
    cells = add_columns(table, {c: coerce_numeric(F.col(c)) for c in table.columns})
    if LABEL not in cells.columns:
        raise ValueError(f"Expected a {LABEL} column")
    # The simple workload truncates keys and keeps rows without a label.
    return add_columns(
        cells.dropna(subset=["year", "day"]),
        {"year": F.col("year").cast("int"), "day": F.col("day").cast("int")},
    )


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; absent columns are null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
