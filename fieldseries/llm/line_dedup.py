"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded with their positions, their normalised keys are hashed, distinct
documents are counted for each key, and documents are put together again from the
positions that stay. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def drop_common_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key is at least ``min_chars`` long and stands in ``min_docs`` documents or more.

    The document with the largest id among those that hold a key keeps all its lines of
    that key. Returns all columns of ``docs`` with the kept text in ``text_col``, plus
    ``n_lines`` and ``n_dropped``.

    A null or empty text is one empty line; it comes back as an empty text. A row
    whose id is null is not counted and comes back whole. Rows that repeat an id count
    as one document. An empty table gives an empty table. Other columns pass through.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    # a repeated id may come with another text; positions belong to one text
    row_text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keys = (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("_id"), row_text.alias("_row"), F.posexplode(lines).alias("_pos", "_line"))
        .where(F.length("_line") >= min_chars)
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )
    # one row for each key and document first, so that a key in most documents is summed in parts
    common = (
        keys.groupBy("_h1", "_h2", "_id")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_h1", "_h2")
        .agg(F.count("*").alias("_docs"), F.max("_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
    )
    dropped = (
        keys.join(common, ["_h1", "_h2"])
        .where(F.col("_id") != F.col("_keeper"))
        .groupBy("_id", "_row")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    joined = docs.withColumns({"_row": row_text, "_id": F.col(id_col)}).join(dropped, ["_id", "_row"], "left").withColumn("_lines", lines)
    kept = F.array_join(F.transform(F.array_except(every, F.col("_drop")), lambda p: F.get(F.col("_lines"), p)), "\n")
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")],
        F.when(F.col("_drop").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept).alias(text_col),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
