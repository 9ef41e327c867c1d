"""Substring dedup by relative Lempel-Ziv parsing against the rule itself and the SQL of the query."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldseries.llm import rlz_dedup
from fieldseries.llm.queries import RLZ_SQL

SCHEMA = "doc_id long, text string"


def run(spark, rows):
    out = rlz_dedup.drop_repeats(spark.createDataFrame(rows, SCHEMA))
    return {(r.doc_id, r.text): (r.n_words, r.n_removed, r.kept) for r in out.collect()}, out


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)]
    base = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(40):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 50))]
        cut = rng.randint(0, 40)
        ws[cut:cut] = base[rng.randint(0, 20) : rng.randint(30, 60)]  # shared passages of differing extent
        sep = rng.choice([" ", "\t", "\n", "  \r\n"])
        rows.append((rng.randint(0, 30), sep.join(ws)))
    return rows


AWKWARD = [(1, None), (2, ""), (3, " \t\n\x0b\f\r"), (None, " ".join(["a"] * 30)), (4, " ".join(["a"] * 30)), (5, "a " * 20_000), (6, "é😀 ﬁ " * 40), (7, "é😀 ﬁ " * 40), (7, "é😀 ﬁ " * 40), (8, "x y")]


def test_against_the_rule(spark):
    rows = corpus() + AWKWARD
    got, out = run(spark, rows)
    assert got == rlz_dedup.brute_force(rows)
    assert sum(v[1] for v in got.values()) > 0


def test_factors_are_copies(spark):
    rows = corpus(2)
    got, out = run(spark, rows)
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(rlz_dedup.re_words(t))
    n = 0
    for r in out.collect():
        ws = rlz_dedup.re_words(r.text)
        for f in r.factors:
            assert f.length >= rlz_dedup.WINDOW and f.ref_id < r.doc_id
            n += 1
            assert any(ws[f.start : f.start + f.length] == ref[f.ref_start : f.ref_start + f.length] for ref in text[f.ref_id])
    assert n > 10


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 3), (2, "c", 4)], "doc_id long, text string, n_removed int").withColumns({"_id": F.lit("z"), "_m": F.lit(1), "extra": F.lit("e")})
    out = rlz_dedup.drop_repeats(df)
    assert out.count() == 2 and "extra" in out.columns and out.schema["n_removed"].dataType.typeName() == "long"
    assert rlz_dedup.drop_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_table_against_sql(spark, sf):
    from fieldseries.llm.queries import op11_rlz_dedup

    got = sorted(tuple(r) for r in op11_rlz_dedup(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(tuple(r) for r in con.execute(RLZ_SQL).fetchall())
    assert got == want and any(r[2] for r in got)


def test_small_chunks_and_other_columns(spark, monkeypatch):
    """Matches between many chunks, over several buckets; columns of any type stay."""
    monkeypatch.setattr(rlz_dedup, "CHUNK_BYTES", 300)
    monkeypatch.setattr(rlz_dedup, "BUCKET_BYTES", 500)
    rows = corpus(3) + AWKWARD
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"nothing": F.lit(None), "more": F.array(F.struct("doc_id"))})
    out = rlz_dedup.drop_repeats(df).collect()
    assert {(r.doc_id, r.text): (r.n_words, r.n_removed, r.kept) for r in out} == rlz_dedup.brute_force(rows)
    assert len(out) == len(rows) and all(r.nothing is None and r.more[0].doc_id == r.doc_id for r in out)


def test_a_window_travels_once_a_chunk(spark):
    """A block sends each distinct window of a chunk once, however often it occurs."""
    import pyarrow as pa

    df = spark.createDataFrame([(i, "a " * 2000) for i in range(50)], "_id long, text string")
    chunks = df.coalesce(1).mapInArrow(lambda b: rlz_dedup._chunks("text", b), "_chunk long, _bytes long, _docs array<struct<_id: long, text: string>>").toArrow()
    assert chunks.num_rows == 1
    sent = [b for k in range(rlz_dedup.SLICES) for b in rlz_dedup._send(k, 5, "text", chunks.to_batches())]
    seen = [rlz_dedup.np.frombuffer(x.as_buffer(), rlz_dedup._SEEN) for b in sent for x in b.column("_seen")]
    assert [[tuple(w)[2:] for w in s] for s in seen] == [[(0, 0)]]
    assert rlz_dedup._answer(pa.Table.from_batches(sent)).num_rows == 0
    again = pa.Table.from_batches([*sent, *(b.set_column(1, "_chunk", pa.array([7])) for b in sent)])
    assert rlz_dedup._answer(again).num_rows == 0


def test_first_keys_may_be_equal():
    """Windows of equal first key and other second key stay apart, in a chunk and in a bucket."""
    import numpy as np
    import pyarrow as pa

    seen = np.array([(5, 1, 0, 1), (5, 2, 1, 1), (5, 1, 2, 1), (4, 9, 3, 1)], dtype=rlz_dedup._SEEN)
    order, heads = rlz_dedup._by_key(seen)
    assert [tuple(w) for w in seen[order[heads]]] == [(4, 9, 3, 1), (5, 1, 0, 1), (5, 2, 1, 1)]
    parts = [np.array(x, dtype=rlz_dedup._SEEN).tobytes() for x in ([(5, 1, 3, 8), (5, 2, 4, 8)], [(5, 2, 6, 3)], [(5, 2, 1, 3)])]
    got = rlz_dedup._answer(pa.table({"_chunk": [1, 2, 3], "_at": pa.array([10, 0, 0], pa.int32()), "_seen": pa.array(parts, pa.binary())}))
    found = [np.frombuffer(x.as_buffer(), rlz_dedup._FIRST).tolist() for x in got.column("_first")]
    assert got.column("_chunk").to_pylist() == [1, 2] and found == [[(11, 1, 3)], [(0, 1, 3)]]
