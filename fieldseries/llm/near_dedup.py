"""MinHash near-dedup by tensored banding.

Two collections of ``halves`` half keys, each of ``rows`` min-hashes, are joined into
``halves * halves`` table keys, so the number of min-hashes grows with the square root
of the number of tables. A pair at similarity s is missed with a chance of at most
``2 * (1 - s**rows)**halves``: 2e-5 at 0.75 for the defaults. Candidates of the tables
are confirmed on full shingle sets, and links are closed to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseries.operators.materialize import materialize

from .graph import components
from .textvec import mix, shingle_hashes, slices, word_hashes

#: Classes of hashes in the bits of a set.
BITS = 512
#: Members of a bucket that are compared with each other at once; larger buckets are split first.
SMALL_BUCKET = 8


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)


def signatures(docs: DataFrame, words: int = 5, rows: int = 2, halves: int = 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n`` (size of the shingle set), ``a`` and ``b`` (128-bit hash of the set), ``halves`` (half keys)."""
    times, plus = _coefficients(2 * halves * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, bounds = shingle_hashes(*word_hashes(batch.column("text")), words)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            at = bounds[some]
            a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            keys = np.zeros((len(some), 2 * halves), np.uint64)
            if len(some):
                a[some] = np.add.reduceat(mix(values + np.uint64(1)), at)
                b[some] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
                for k in range(2 * halves):
                    for j in range(rows):
                        low = np.minimum.reduceat(values * times[k * rows + j] + plus[k * rows + j], at)
                        keys[:, k] = mix(keys[:, k] * np.uint64(3) + low)
            sizes = np.where(n > 0, 2 * halves, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], names=["id", "n", "a", "b", "halves"])

    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, a long, b long, halves array<long>")


def shingle_sets(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``shingles`` (sorted 64-bit hashes of the distinct shingles of the whole text) and ``bits``.

    ``bits`` tells, for each of 512 classes of hashes, whether the set has an odd number
    of them: two sets differ in at least as many shingles as their bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, bounds = shingle_hashes(*word_hashes(batch.column("text")), words)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            rows_of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            odd = np.bincount(rows_of * BITS + (values >> np.uint64(55)).astype(np.int64), minlength=batch.num_rows * BITS) & 1
            packed = np.packbits(odd.astype(np.uint8)).view(np.int64)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(0, len(packed) + 1, BITS // 64).astype(np.int32)), pa.array(packed))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, bits], names=["id", "shingles", "bits"])

    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, shingles array<long>, bits array<long>")


def table_members(nodes: DataFrame, halves: int) -> DataFrame:
    """``key``, ``node`` for all table keys that could be shared: both half keys stand in two nodes or more."""
    each = nodes.select("node", F.posexplode("halves").alias("pos", "half"))
    shared = each.groupBy("pos", "half").agg(F.count("*").alias("c")).where("c > 1").select("pos", "half")
    lists = each.join(shared, ["pos", "half"]).groupBy("node").agg(F.collect_list(F.struct("pos", "half")).alias("live"))
    first = F.filter("live", lambda x: x["pos"] < halves)
    second = F.filter("live", lambda x: x["pos"] >= halves)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["pos"], x["half"], y["pos"], y["half"]))))
    return lists.select(F.explode(keys).alias("key"), "node")


def _may_link(n: Column, n_2: Column, bits: Column, bits_2: Column, percent: int) -> Column:
    """False only for sets that differ in too many shingles, as their bits already tell."""
    apart = sum((F.bit_count(F.get(bits, F.lit(k)).bitwiseXOR(F.get(bits_2, F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (n + n_2) * (100 - percent)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u``, ``v`` whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"), F.col("bits").alias("bu"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    sizes = sets.select(F.col("id").alias("v"), F.size("shingles").alias("nv"), F.col("bits").alias("bv"))
    both = F.size(F.array_intersect("su", "sv"))
    nu = F.size("su")
    return (
        pairs.join(sizes, "v")
        .join(left, "u")
        .where((F.least(nu, "nv") * 100 >= F.greatest(nu, "nv") * percent) & _may_link(nu, F.col("nv"), F.col("bu"), F.col("bv"), percent))
        .drop("bu", "bv")
        .join(right, "v")
        .where(both * 100 >= (nu + F.size("sv") - both) * percent)
        .select("u", "v")
    )


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``nodes`` (``node``, ``comp``) in different components that could be linked; none that is linked is left out.

    With shingles in one order, rarest first, two sets at the bound share a shingle among
    their first ``n - ceil(percent * n / 100) + 1``; what follows the first shared one
    limits the intersection. Shingles of one node only take part in the count alone.
    """
    own = nodes.join(sets.select(F.col("id").alias("node"), "shingles", "bits"), "node")
    token = own.select("node", F.explode("shingles").alias("token"))
    common = token.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    lists = token.join(common, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    n = F.size("shingles")
    single = n - F.size("tokens")
    length = n - F.ceil(n * percent / 100).cast("int") + 1 - single
    first = (
        own.select("node", "comp", "shingles", "bits")
        .join(lists, "node")
        .where(length > 0)
        .select("node", "comp", "bits", n.alias("n"), single.alias("single"), F.posexplode(F.slice("tokens", F.lit(1), length)).alias("i", "t"))
        .select("node", "comp", "bits", "n", (F.col("n") - F.col("single") - F.col("i")).alias("rest"), F.col("t.token").alias("token"))
    )
    first = materialize(first)
    # pairs of a token's largest component are closed: one side is always outside it
    largest = first.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("largest"), F.sum("c").alias("all"), F.max("c").alias("most"))
    outside = first.join(largest.where(F.col("all") > F.col("most")).drop("all", "most"), "token").where("comp <> largest")
    outside = outside.select("token", *[F.col(c).alias(f"{c}_2") for c in ("node", "comp", "bits", "n", "rest")])
    bound = F.least("rest", "rest_2") * (100 + percent) >= (F.col("n") + F.col("n_2")) * percent
    # the sets' bits refuse most of what the places of shared shingles let through
    close = _may_link(F.col("n"), F.col("n_2"), F.col("bits"), F.col("bits_2"), percent)
    pairs = first.join(outside, "token").where((F.col("comp") != F.col("comp_2")) & bound & close)
    return pairs.select(F.least("node", "node_2").alias("u"), F.greatest("node", "node_2").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 75, rows: int = 2, halves: int = 14, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``.

    Rows whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more are
    linked; ``component_id`` is the least id reachable, ``kept`` marks that row. Equal
    sets are one node from the start. Buckets are closed without comparing all pairs:
    every member is compared with the bucket's least node; then only pairs that are
    still in different components are left, in small buckets directly and in larger
    ones through their rarest shingles. All candidates are confirmed on full sets.

    A null, empty or white text has no shingles and is linked with nothing. A row whose
    id is null gets a null ``component_id`` and is kept. Rows that repeat an id count as
    one document. An empty table gives an empty table; other columns are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(plain, words, rows, halves))
    nodes = materialize(
        signed.where("n > 0 and id is not null").groupBy("a", "b", "n").agg(F.min("id").alias("node"), F.first("halves").alias("halves"))
    )
    members = table_members(nodes, halves)
    members = materialize(members)
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("center")).where("size > 1")
    members = materialize(members.join(buckets, "key"))
    sets = materialize(shingle_sets(plain.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), words))

    star = members.where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    links = materialize(confirm(star, sets, percent))
    labelled = members.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled = materialize(labelled.select("key", "node", "size", "comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    still = materialize(labelled.join(mixed, "key"))
    small = still.where(F.col("size") <= SMALL_BUCKET).select("key", "node", "comp")
    other = small.select("key", F.col("node").alias("node_2"), F.col("comp").alias("comp_2"))
    within = small.join(other, "key").where("node < node_2 and comp <> comp_2").select(F.col("node").alias("u"), F.col("node_2").alias("v"))
    large = still.where(F.col("size") > SMALL_BUCKET).select("node", "comp").distinct()
    rest = within.union(prefix_pairs(large, sets, percent)).distinct()
    # what the star has refused needs no second look
    rest = materialize(rest.join(star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"))
    comps = components(links.union(confirm(rest, sets, percent)))

    classes = nodes.select("a", "b", "n", "node").join(comps, "node", "left").select("a", "b", "n", F.coalesce("comp", "node").alias("component"))
    out = signed.select("id", "n", "a", "b").join(classes, ["a", "b", "n"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
