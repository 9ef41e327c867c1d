"""Merkle manifest of a table, built over concatenated-level strings.

Each aligned block of ``FAN ** DEPTH`` consecutive nodes of a group keeps every level of
its subtree as one hex string: digests of 64 characters side by side. A parent is the
sha256 of a fixed-width substring (``FAN`` digests), so a whole level comes from the one
below it by ``transform`` over substring offsets; a node's siblings are the two substrings
that flank it inside its run. The blocks' top digests are the nodes of the next round,
and the group roots (subroots) are the nodes of the root tree, so large groups recurse by
rounds and never sit in one task: a block holds at most ``FAN ** DEPTH`` nodes.

Digests are lowercase hex sha256 of the concatenated hex text of their inputs. A run is
``FAN`` consecutive nodes of a level; the last run may be shorter, even a single node,
and is hashed all the same. Hashing stops when one node remains; a group with a single
leaf has that leaf as its root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseries.operators.materialize import materialize

FAN = 3
DEPTH = 6
BLOCK = FAN**DEPTH
HEX = 64
#: Per-group roots are broadcast to their leaves up to this many groups; beyond it they are joined.
BROADCAST_GROUPS = 200_000
#: Rows per range when positions are counted: the number of ranges grows with the table.
ROWS_PER_RANGE = 2_000_000


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value (integers in decimal)."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(*columns: Column) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def _up(level: Column) -> Column:
    """The level above: one digest per run of ``FAN`` digests (the last run may be shorter)."""
    width = FAN * HEX
    runs = F.sequence(F.lit(0), (F.ceil(F.length(level) / width) - 1).cast("int"))
    return F.array_join(F.transform(runs, lambda r: digest(F.substr(level, r * width + 1, F.lit(width)))), "")


def _segment(level: Column, p: Column) -> Column:
    """Siblings of node ``p`` of ``level``: the digests left and right of it in its run."""
    count = F.floor(F.length(level) / HEX)
    start = p - p % FAN
    stop = F.least(start + FAN, count)
    return F.struct(
        F.substr(level, (start * HEX + 1).cast("int"), ((p - start) * HEX).cast("int")).alias("left"),
        F.substr(level, ((p + 1) * HEX + 1).cast("int"), ((stop - p - 1) * HEX).cast("int")).alias("right"),
    )


def _round(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``_g, _pos, _n, _d, _c`` of one round: their sibling levels inside their block, and the blocks' tops.

    ``_n`` is the size of the group at this round. Where the group spans one block only,
    levels are hashed until one node remains; otherwise every block hashes ``DEPTH`` levels,
    so that its runs line up with those of the whole group.
    """
    placed = nodes.select("_g", F.floor(F.col("_pos") / BLOCK).alias("_blk"), (F.col("_pos") % BLOCK).cast("int").alias("_i"), "_n", "_d", "_c")
    blocks = placed.groupBy("_g", "_blk").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_d", "_c"))).alias("_items"),
        F.max("_n").alias("_n"),
    )
    many = F.col("_n") > BLOCK
    level0 = F.array_join(F.transform("_items", lambda x: x["_d"]), "")
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(DEPTH)),
        F.array(level0),
        lambda acc, _: F.when(many | (F.length(F.element_at(acc, -1)) > HEX), F.concat(acc, F.array(_up(F.element_at(acc, -1))))).otherwise(acc),
    )
    blocks = blocks.select("_g", "_blk", "_n", "_items", levels.alias("_levels"))
    m = F.size("_levels") - 1

    def proof(x: Column) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)))
        each = F.transform(steps, lambda j: _segment(F.element_at("_levels", j + 1), F.floor(x["_i"] / F.pow(F.lit(FAN), j)).cast("long")))
        return F.struct(x["_c"].alias("_c"), F.slice(each, 1, m).alias("_sib"))

    tops = blocks.select("_g", "_blk", "_n", F.element_at("_levels", -1).alias("_top"), F.transform("_items", proof).alias("_items"))
    tops = materialize(tops)
    below = tops.select("_g", "_blk", "_top", F.inline("_items"))
    upper = tops.select(
        "_g",
        F.col("_blk").alias("_pos"),
        F.ceil(F.col("_n") / BLOCK).alias("_n"),
        F.col("_top").alias("_d"),
        F.struct(F.col("_blk").alias("_blk")).alias("_c"),
    )
    return below, upper


def tree(nodes: DataFrame) -> DataFrame:
    """``_g, _c, _sib, _root`` for nodes ``_g, _pos, _n, _d, _c``: sibling segments leaf to root, and the group's root.

    ``_pos`` runs from 0 to ``_n - 1`` within each group ``_g``; ``_c`` is carried through.
    """
    below, upper = _round(nodes)
    if upper.where("_n > 1").isEmpty():
        return below.select("_g", "_c", "_sib", F.col("_top").alias("_root"))
    above = tree(upper)
    above = above.select("_g", F.col("_c._blk").alias("_blk"), F.col("_sib").alias("_up"), "_root")
    joined = below.join(above, ["_g", "_blk"])
    return joined.select("_g", "_c", F.concat("_sib", "_up").alias("_sib"), "_root")


def positions(nodes: DataFrame, key: list[Column]) -> DataFrame:
    """Add ``_pos`` (0-based order of ``key`` within ``_g``) and ``_n`` (size of ``_g``).

    Rows are dealt by ranges of ``(_g, key)`` and written once, so a group that holds most
    rows spans many tasks; each range counts its own rows, and the counts of earlier ranges
    of a group, one row per range, are added.
    """
    keyed = nodes.withColumn("_k", F.struct(*key))
    ranges = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // ROWS_PER_RANGE))
    placed = materialize(keyed.repartitionByRange(ranges, "_g", "_k").withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_g", "_part").count()
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_off"), F.sum("count").over(Window.partitionBy("_g")).alias("_n"))
    inside = Window.partitionBy("_g", "_part").orderBy("_k")
    ranked = placed.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, ["_g", "_part"])
    return ranked.withColumn("_pos", F.col("_off") + F.col("_in")).drop("_k", "_part", "_in", "_off")


def manifest(docs: DataFrame, columns: list[str], id_col: str, group_col: str, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A row's leaf is the digest of ``field`` of each of ``columns`` in order. Within each value of
    ``group_col`` (null is a group of its own) leaves ascend by ``id_col`` (nulls first; equal ids
    by leaf, so repeated rows give equal results) and fold to the group's subroot; subroots
    ordered by ``group_col`` (null first, then UTF-8 bytes) fold to the root. ``proof_sha256`` is
    the digest of the sibling digests, level by level from the leaf to the root, left to right
    (of the empty text when a table has one row). ``tampered`` (a struct of ``columns``, or
    None for none) is the row as it was found later; ``folded_root`` recomputes the root from
    its leaf and the original siblings, and ``verified`` is whether that equals ``root``.
    An empty table gives no rows; other columns of ``docs`` are not returned.
    """
    found = tampered if tampered is not None else F.struct(*[F.col(c) for c in columns])
    leaves = docs.select(
        F.struct(F.col(group_col).alias("g")).alias("_g"),
        F.col(id_col).alias("_id"),
        leaf_of(*[F.col(c) for c in columns]).alias("_d"),
        found.alias("_t"),
    )
    leaves = leaves.withColumn("_t", leaf_of(*[F.col("_t").getField(c) for c in columns]))
    ranked = positions(leaves, [F.col("_id"), F.col("_d")])
    inner = tree(ranked.select("_g", "_pos", "_n", "_d", F.struct("_id", F.col("_d").alias("_leaf"), "_t").alias("_c")))
    inner = materialize(inner)

    subroots = inner.select("_g", F.col("_root").alias("_d")).distinct()
    top = positions(subroots.select(F.struct(F.lit(0).alias("g")).alias("_all"), "_g", "_d").withColumnRenamed("_g", "_src").withColumnRenamed("_all", "_g"), [F.col("_src.g")])
    outer = tree(top.select("_g", "_pos", "_n", "_d", F.struct("_src", F.col("_d").alias("_sub")).alias("_c")))
    outer = materialize(outer.select(F.col("_c._src").alias("_g"), F.col("_c._sub").alias("subroot"), F.col("_sib").alias("_up"), F.col("_root").alias("root")))
    if outer.count() <= BROADCAST_GROUPS:
        outer = F.broadcast(outer)
    rows = inner.join(outer, "_g")
    sib = F.concat("_sib", "_up")
    folded = F.aggregate(sib, F.col("_c._t"), lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))
    out = rows.select(
        F.col("_c._id").alias(id_col),
        F.col("_c._leaf").alias("leaf"),
        "subroot",
        "root",
        digest(F.array_join(F.transform(sib, lambda s: F.concat(s["left"], s["right"])), "")).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def deleted_newlines(doc_id: str = "doc_id") -> Column:
    """Where 2 divides the unsigned crc32 of the decimal id, the text without its ``\\n`` (null stays null)."""
    chosen = F.crc32(F.col(doc_id).cast("string")) % 2 == 0
    return F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text"))
