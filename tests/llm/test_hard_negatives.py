"""Hard negatives against the SQL of the query, on the given table and on awkward rows in small tiles."""

import math
import random

import duckdb
import pandas as pd
import pytest

from fieldseries.llm import hard_negatives
from fieldseries.llm.queries import NEGATIVES_SQL

COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_sql(embeddings: pd.DataFrame):
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    return sorted(tuple(r) for r in con.execute(NEGATIVES_SQL).fetchall())


def by_spark(spark, embeddings: pd.DataFrame):
    rows = [
        (int(i), None if v is None else [None if x is None else float(x) for x in v], None if pd.isna(lab) else int(lab))
        for i, v, lab in zip(embeddings["vec_id"], embeddings["embedding"], embeddings["label"], strict=True)
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r) for r in hard_negatives.mine(df).select(*COLS).collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_table_against_sql(spark, sf):
    emb = pd.read_parquet(f"{sf}/embeddings.parquet")
    got = by_spark(spark, emb)
    assert got == by_sql(emb) and got


def test_awkward_rows_in_small_tiles(spark, monkeypatch):
    """Nulls, NaN and infinity, short vectors, ties, repeated rows, few labels; many tiles."""
    monkeypatch.setattr(hard_negatives, "ROWS_PER_BLOCK", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_BLOCK", 3)
    rng = random.Random(3)
    rows = []
    for i in range(700):
        v = [round(rng.uniform(-1, 1), 2) for _ in range(6)]
        rows.append((i, v, rng.randint(0, 2)))
    rows += [(700, None, 1), (800, [0.1] * 6, None), (900, [0.1, None, 0.2, 0, 0, 0], 1), (1000, [math.nan] * 6, 1), (1100, [math.inf] + [0.0] * 5, 2)]
    rows += [(1200, [0.5] * 6, 1), (1201, [0.5] * 6, 1), (1300, [0.5] * 6, 2), (1301, [0.5] * 6, 2), (1400, [0.25] * 3, 0), (1500, [], 0), (1600, [-1.0] * 6, 0)]
    rows += [(1700 + k, [0.5] * 6, 0) for k in range(8)]
    emb = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])
    emb["label"] = emb["label"].astype("Int32")
    got = by_spark(spark, emb)
    assert got == by_sql(emb) and len(got) > 100


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [0.1], 1)], "vec_id long, embedding array<float>, label int").withColumn("_id", hard_negatives.F.lit("x"))
    assert hard_negatives.mine(df).count() == 0
    assert hard_negatives.mine(df.limit(0)).count() == 0
