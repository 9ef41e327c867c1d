"""Mutual nearest neighbours of different classes, and their removal.

The search is exact. Every row looks for its nearest other row (Euclidean,
ties to the lower id); no pair leaves a task, only the best one per row:

1. identical vectors are grouped first. Only their two lowest ids can be each
   other's neighbour, so a third of all rows being copies costs one vector;
2. the distinct vectors form a metric tree of balls (centre, radius), kept as
   tables: a node is split by two far-apart pivots, or where that leaves less
   than a quarter on one side at the median between them, until leaves are of
   bounded size; inner balls cover their children's;
3. inside its leaf each row finds a first neighbour, an upper bound;
4. leaves are bundled by subtree. Bundles descend the tree, and the balls of
   the leaves of two bundles that are left are compared in one task: pairs of
   leaves are counted, never written. Two bundles with leaves that the triangle
   inequality cannot rule out meet in one task, which prunes by each row's own
   bound. A row travels once for each bundle, not for each leaf, and a task
   never holds more than two bundles. Bundles meet in rounds: a round's rows
   are a few times the table, and go when it ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseries.operators.materialize import discard, materialize, short_lived_shuffles

BLOCK_ROWS = 4096
VISITOR_ROWS = 8192
#: Most rows of a bundle of leaves: a share of all rows, so that rows travel equally often at any size, within bounds.
#: Halves of halves make eighths, which a sixth leaves whole; rows then travel about eight times.
BUNDLE_SHARE = 6
BUNDLE_ROWS = (1024, 131_072)
#: Distances computed at once are visitors times so many rows.
TILE_ROWS = 4096
TILE_VISITORS = 256
MAX_DEPTH = 60
#: Most tasks of a round of the search between bundles.
MAX_TASKS = 2000
#: Rows that travel in a round: so many times the table, or so many rows if that is more.
ROUND_COPIES = 3
ROUND_ROWS = 65_536
#: Node tables up to this many rows are broadcast to the points (about 10 MB at 64 dimensions).
BROADCAST_NODES = 20_000
# Distances are compared on squared values rounded to this many places.
PLACES = 9
# Slack of the pruning bound, far above the rounding of projections.
SLACK = 1e-6


def _nearest(rows: np.ndarray, other_ids: np.ndarray, others: np.ndarray, bound: np.ndarray, skip=None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of ``others`` for each row: (squared distance, id); inf and -1 if none within ``bound``. ``skip`` marks pairs left out."""
    best = np.full(len(rows), np.inf)
    near = np.full(len(rows), -1, dtype=np.int64)
    norms = np.einsum("ij,ij->i", others, others)
    # one product gives |y|^2 - 2 x y
    lifted = np.concatenate((-2.0 * others, norms[:, None]), axis=1).T
    own = np.einsum("ij,ij->i", rows, rows)
    rough = np.concatenate((rows, np.ones((len(rows), 1))), axis=1) @ lifted
    if skip is not None:
        rough[skip] = np.inf
    floor = rough.min(axis=1)
    # the product form is inexact; recompute everything close to the minimum
    margin = 1e-9 * (own + norms.max()) + 10.0**-PLACES
    some = np.flatnonzero(np.isfinite(floor) & (floor + own <= bound + margin))
    at, who = np.nonzero(rough[some] <= (floor + margin)[some, None])
    at = some[at]
    exact = np.round(((rows[at] - others[who]) ** 2).sum(axis=1), PLACES)
    order = np.lexsort((other_ids[who], exact, at))
    first = order[np.concatenate(([True], np.diff(at[order]) > 0))] if len(order) else order
    best[at[first]] = exact[first]
    near[at[first]] = other_ids[who[first]]
    return best, near


def _better(best: np.ndarray, near: np.ndarray, at: np.ndarray, d: np.ndarray, nn: np.ndarray) -> None:
    """Take over what is nearer, or as near with a lower id."""
    gain = (nn >= 0) & ((d < best[at]) | ((d == best[at]) & ((near[at] < 0) | (nn < near[at]))))
    best[at[gain]], near[at[gain]] = d[gain], nn[gain]


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group; vectors of floats are read as the same doubles."""
    ids = group.column("_id").to_numpy()
    flat = group.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.astype(np.float64, copy=False).reshape(len(ids), -1)


def _found(ids: np.ndarray, best: np.ndarray, near: np.ndarray) -> pa.Table:
    return pa.table({"_id": pa.array(ids, pa.int64()), "_d": pa.array(best, pa.float64()), "_nn": pa.array(near, pa.int64())})


def _leaf_search(group: pa.Table) -> pa.Table:
    """The rows of one leaf among themselves: the group with ``_d`` and ``_nn``."""
    ids, rows = _columns(group)
    best, near = np.full(len(ids), np.inf), np.full(len(ids), -1, dtype=np.int64)
    for lo in range(0, len(ids), TILE_VISITORS):
        part = np.arange(lo, min(lo + TILE_VISITORS, len(ids)))
        best[part], near[part] = _nearest(rows[part], ids, rows, best[part], (part - lo, part))
    return group.append_column("_d", pa.array(best)).append_column("_nn", pa.array(near))


def _meeting(group: pa.Table) -> pa.Table:
    """How many leaves of two bundles, or of one, may hold a neighbour of a leaf of the other."""
    group = group.sort_by([("_bundle", "ascending"), ("_a", "ascending")])
    centres = group.column("_ca").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
    radius, bound, bundle = (group.column(c).to_numpy() for c in ("_ra", "_u", "_bundle"))
    square = np.einsum("ij,ij->i", centres, centres)
    cut = int(np.searchsorted(bundle, bundle[0], side="right"))
    one, two = np.arange(cut), np.arange(cut, len(bundle))
    pairs = 0
    for mine, theirs in [(one, one)] if not len(two) else [(one, two), (two, one)]:
        for lo in range(0, len(mine), TILE_VISITORS):
            at = mine[lo : lo + TILE_VISITORS]
            both = square[at][:, None] + square[theirs][None, :]
            # rounding of the product may only widen the reach of a leaf
            gap = np.sqrt(np.maximum(both - 2.0 * centres[at] @ centres[theirs].T - 1e-9 * both, 0.0)) - radius[at][:, None] - radius[theirs][None, :]
            pairs += int(((gap <= (bound[at] * (1 + SLACK) + SLACK)[:, None]) & (at[:, None] != theirs[None, :])).sum())
    return pa.table({"_one": group.column("_one")[:1], "_two": group.column("_two")[:1], "_pairs": pa.array([pairs], pa.int64())})


def _visit(best: np.ndarray, near: np.ndarray, rows: np.ndarray, leaf: np.ndarray, ids: np.ndarray, hosts: np.ndarray, host_leaf: np.ndarray, visitor_rows: int) -> None:
    """Rows visit the leaves of a bundle whose balls are within their bound; hosts are sorted by leaf."""
    names, starts = np.unique(host_leaf, return_index=True)
    ends = np.append(starts[1:], len(hosts))
    centres = np.stack([hosts[s:e].mean(axis=0) for s, e in zip(starts, ends, strict=True)])
    radius = np.array([np.sqrt(((hosts[s:e] - c) ** 2).sum(axis=1).max()) for s, e, c in zip(starts, ends, centres, strict=True)])
    reach = np.einsum("ij,ij->i", centres, centres)
    tile = starts // TILE_ROWS
    step = min(visitor_rows, TILE_VISITORS)
    for lo in range(0, len(rows), step):
        at = np.arange(lo, min(lo + step, len(rows)))
        part = rows[at]
        own = np.einsum("ij,ij->i", part, part)
        square = own[:, None] + reach[None, :] - 2.0 * part @ centres.T
        # rounding of the product may only widen the reach of a row
        gap = np.sqrt(np.maximum(square - 1e-9 * (own[:, None] + reach[None, :]), 0.0)) - radius[None, :]
        away = leaf[at][:, None] != names[None, :]
        for t in np.unique(tile):
            inside = np.flatnonzero(tile == t)
            open_ = away[:, inside] & (gap[:, inside] <= (np.sqrt(best[at]) * (1 + SLACK) + SLACK)[:, None])
            who, balls = np.flatnonzero(open_.any(axis=1)), inside[open_.any(axis=0)]
            if not len(who):
                continue
            some = np.concatenate([np.arange(starts[k], ends[k]) for k in balls])
            own_leaf = leaf[at[who]][:, None] == host_leaf[some][None, :] if np.isin(leaf[at[who]], names[balls]).any() else None
            d, nn = _nearest(part[who], ids[some], hosts[some], best[at[who]], own_leaf)
            _better(best, near, at[who], d, nn)


def _bundle_search(visitor_rows: int, group: pa.Table) -> pa.Table:
    """Two bundles, each visiting the other, or one visiting itself."""
    group = group.sort_by([("_bundle", "ascending"), ("_node", "ascending"), ("_id", "ascending")])
    ids, rows = _columns(group)
    leaf, bundle = group.column("_node").to_numpy(), group.column("_bundle").to_numpy()
    best, near = group.column("_d").to_numpy().copy(), np.full(len(ids), -1, dtype=np.int64)
    cut = int(np.searchsorted(bundle, bundle[0], side="right"))
    one, two = slice(0, cut), slice(cut, len(ids))
    for mine, theirs in [(one, one)] if cut == len(ids) else [(one, two), (two, one)]:
        _visit(best[mine], near[mine], rows[mine], leaf[mine], ids[theirs], rows[theirs], leaf[theirs], visitor_rows)
    hit = near >= 0
    return _found(ids[hit], best[hit], near[hit])


_FOUND = "_id long, _d double, _nn long"


def _dist(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length, of floats or doubles."""

    def difference(u: Column, v: Column) -> Column:
        d = u.cast("double") - v.cast("double")
        return d * d

    return F.sqrt(F.aggregate(F.zip_with(a, b, difference), F.lit(0.0), lambda acc, t: acc + t))


def _attach(big: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join a table of nodes to the rows: broadcast while it is counted below ``BROADCAST_NODES`` rows.

    Upper nodes hold many rows each (the root all of them) and are few; when nodes are many
    they are small on average, and the join is an ordinary one of two written tables.
    """
    small = materialize(small)
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_NODES else small, on, how)


def _split_here(leaf_rows: int, group: pa.Table) -> pa.Table:
    """The subtree of one node, split further in its task: ``_id, _x, _node``."""
    ids, rows = _columns(group)
    node = np.zeros(len(ids), dtype=np.int64)
    todo = [(group.column("_node")[0].as_py(), np.argsort(ids))]
    while todo:
        k, at = todo.pop()
        if len(at) <= leaf_rows:
            node[at] = k
            continue
        a = ((rows[at] - rows[at[0]]) ** 2).sum(axis=1)
        b = ((rows[at] - rows[at[np.argmax(a)]]) ** 2).sum(axis=1)
        right = np.sqrt(b) < np.sqrt(a)
        if not len(at) <= 4 * right.sum() <= 3 * len(at):
            right = np.zeros(len(at), dtype=bool)
            right[np.argsort(np.sqrt(a) - np.sqrt(b), kind="stable")[len(at) // 2 :]] = True
        todo += [(2 * k, at[~right]), (2 * k + 1, at[right])]
    return pa.table({"_id": pa.array(ids), "_x": group.column("_x"), "_node": pa.array(node)})


def build_tree(points: DataFrame, leaf_rows: int = BLOCK_ROWS, task_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """A ball tree of ``(_id, _x)`` as two tables: ``(_id, _x, _node)`` per point and ``(_node, _c, _r, _n, _leaf)`` per node.

    Nodes are numbered as in a heap (root 1, children 2k and 2k+1). A node of more than
    ``leaf_rows`` points is split by two pivots: the point of least hash, and the point
    farthest from it; each point goes to the nearer pivot (ties to the first). Where that
    leaves less than a quarter of the points on one side (outliers), they are split at the
    median of the difference of their distances instead, points at the median by
    hash: depth grows with the logarithm of the number of points. Nodes of at most
    ``task_rows`` points are split further in one task each. A node's ball is
    the mean of its points and a radius covering them all (for inner nodes from the
    balls of their leaves). Vectors must be distinct and of one length. A level's
    points are written and the level above is deleted.
    """
    kind = points.schema["_x"].dataType.simpleString()
    pts = points.select("_id", "_x", F.lit(1).cast("long").alias("_node"))
    depth = 0

    def replaced(by: DataFrame) -> DataFrame:
        by = materialize(by)
        if hasattr(pts, "_written_to"):
            discard(pts)
        return by

    while True:
        first = pts.groupBy("_node").agg(F.min_by("_x", F.struct(F.xxhash64("_id"), F.col("_id"))).alias("_a"), F.count(F.lit(1)).alias("_n"))
        first = materialize(first.where(F.col("_n") > max(leaf_rows, task_rows)))
        if first.isEmpty():
            break
        if depth >= MAX_DEPTH:
            raise ValueError(f"The tree is deeper than {MAX_DEPTH} levels")
        with_a = _attach(pts, first.select("_node", "_a"), "_node")
        far = with_a.groupBy("_node").agg(F.max_by("_x", F.struct(_dist("_x", "_a"), F.col("_id"))).alias("_b"))
        pivots = materialize(first.join(far, "_node"))
        side = _dist("_x", "_a") - _dist("_x", "_b")
        sided = _attach(pts, pivots, "_node").select("_node", "_n", side.alias("_side"))
        cuts = sided.groupBy("_node", "_n").agg(F.count_if(F.col("_side") > 0).alias("_right"), F.percentile_approx("_side", 0.5, 200).alias("_median"))
        even = F.col("_right").between(F.col("_n") / 4, F.col("_n") * 3 / 4)
        pivots = pivots.join(cuts.select("_node", F.when(~even, F.col("_median")).alias("_cut")), "_node").drop("_n")
        placed = _attach(pts, pivots, "_node", "left")
        by_hash = (side == F.col("_cut")) & (F.pmod(F.xxhash64(F.lit(depth), F.col("_id")), F.lit(2)) == 1)
        right = (side > F.coalesce("_cut", F.lit(0.0))) | F.coalesce(by_hash, F.lit(False))
        child = F.when(F.col("_a").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + right.cast("long"))
        pts = replaced(placed.select("_id", "_x", child.alias("_node")))
        depth += 1

    if task_rows > leaf_rows:
        pts = replaced(pts.groupBy("_node").applyInArrow(lambda group: _split_here(leaf_rows, group), f"_id long, _x {kind}, _node long"))
    elif not depth:
        pts = replaced(pts)
    vec = array_to_vector(F.col("_x").cast("array<double>"))
    leaves = pts.groupBy("_node").agg(Summarizer.mean(vec).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    leaves = materialize(leaves.select("_node", vector_to_array("_mean").alias("_c"), "_n"))
    radius = _attach(pts, leaves.select("_node", "_c"), "_node").groupBy("_node").agg(F.max(_dist("_x", "_c")).alias("_r"))
    leaves = materialize(leaves.join(radius, "_node"))
    # inner balls: weighted mean of the leaves below, radius over their balls
    level = F.floor(F.log2("_node")).cast("int")
    below = leaves.withColumn("_k", F.explode(F.when(level > 0, F.sequence(F.lit(1), level)))).withColumn("_up", F.expr("shiftright(_node, _k)"))
    mean = below.groupBy("_up").agg(Summarizer.mean(array_to_vector("_c"), F.col("_n").cast("double")).alias("_mean"), F.sum("_n").alias("_un"))
    mean = materialize(mean.select("_up", vector_to_array("_mean").alias("_uc"), "_un"))
    spread = _attach(below, mean.select("_up", "_uc"), "_up").groupBy("_up").agg(F.max(_dist("_c", "_uc") + F.col("_r")).alias("_ur"))
    inner = mean.join(spread, "_up").select(F.col("_up").alias("_node"), F.col("_uc").alias("_c"), F.col("_un").alias("_n"), F.col("_ur").alias("_r"))
    nodes = materialize(leaves.withColumn("_leaf", F.lit(True)).unionByName(inner.withColumn("_leaf", F.lit(False))))
    return pts, nodes


def leaf_pairs(nodes: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(_a, _b)``: leaves ``_b`` that may hold the neighbour of a point of leaf ``_a``.

    ``bounds`` gives each leaf ``_a`` a distance ``_u`` that none of its points' neighbours
    exceeds. Each leaf descends the tree from the root and keeps a node while the gap
    between the two balls, ``|c_a - c_n| - r_a - r_n``, is within ``_u``. Only the names of
    the two are written. A tree cut off above its leaves, at any nodes, is a tree.
    """
    children = nodes.select(F.floor(F.col("_node") / 2).alias("_node"), F.col("_node").alias("_child"), F.col("_c").alias("_cc"), F.col("_r").alias("_rc"), "_leaf")
    balls = bounds.select("_a", "_ca", "_ra", "_u")
    children, balls = materialize(children), materialize(balls)
    small = [F.broadcast(x) if x.count() <= BROADCAST_NODES else x for x in (children, balls)]
    frontier = bounds.select("_a", F.lit(1).cast("long").alias("_node"))
    found = []
    while True:
        step = frontier.join(small[0], "_node").join(small[1], "_a")
        gap = _dist("_ca", "_cc") - F.col("_ra") - F.col("_rc")
        step = materialize(step.where(gap <= F.col("_u") * (1 + SLACK) + SLACK).select("_a", "_child", "_leaf"))
        found.append(step.where("_leaf").select("_a", F.col("_child").alias("_b")))
        frontier = step.where(~F.col("_leaf")).select("_a", F.col("_child").alias("_node"))
        if frontier.isEmpty():
            break
    # a root that is a leaf has no children: one leaf, no pairs
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.where(F.col("_a") != F.col("_b"))


def bundles(nodes: DataFrame, rows: int) -> DataFrame:
    """``(_node, _bundle)``: each leaf with its highest ancestor (or itself) of at most ``rows`` points."""
    level = F.floor(F.log2("_node")).cast("int")
    up = F.explode(F.sequence(F.lit(0), level))
    above = nodes.where("_leaf").select("_node", up.alias("_k")).withColumn("_up", F.expr("shiftright(_node, _k)"))
    small = nodes.where((F.col("_n") <= rows) | F.col("_leaf")).select(F.col("_node").alias("_up"))
    return above.join(small, "_up").groupBy("_node").agg(F.max_by("_up", "_k").alias("_bundle"))


def bundle_pairs(nodes: DataFrame, named: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(_one, _two, _pairs)``: bundles, and how many of their leaves may hold a neighbour of a leaf of the other.

    ``bounds`` are those of leaves, as in ``leaf_pairs``. A bundle's bound is the largest of
    its leaves'; a ball of a bundle covers those of its leaves, so bundles that the tree
    rules out have no such leaves. Leaves of the others are compared in one task a pair.
    """
    leaves = materialize(bounds.join(named.select(F.col("_node").alias("_a"), "_bundle"), "_a"))
    tops = leaves.groupBy("_bundle").agg(F.max("_u").alias("_u"))
    tops = materialize(nodes.join(tops, nodes["_node"] == tops["_bundle"]).drop("_bundle"))
    level = F.floor(F.log2("_node")).cast("int")
    up = tops.select("_node", F.explode(F.when(level > 0, F.sequence(F.lit(1), level))).alias("_k"))
    above = nodes.join(up.select(F.expr("shiftright(_node, _k)").alias("_node")).distinct(), "_node")
    upper = above.select("_node", "_c", "_r", F.lit(False).alias("_leaf")).unionByName(tops.select("_node", "_c", "_r", F.lit(True).alias("_leaf")))
    apart = leaf_pairs(upper, tops.select(F.col("_node").alias("_a"), F.col("_c").alias("_ca"), F.col("_r").alias("_ra"), "_u"))
    apart = apart.select(F.least("_a", "_b").alias("_one"), F.greatest("_a", "_b").alias("_two")).distinct()
    met = materialize(apart.unionByName(tops.select(F.col("_node").alias("_one"), F.col("_node").alias("_two"))))
    groups = _attach(leaves, _sides(met), "_bundle").select("_one", "_two", "_bundle", "_a", "_ca", "_ra", "_u")
    groups = groups.repartition(max(1, min(MAX_TASKS, met.count())), "_one", "_two")
    return groups.groupBy("_one", "_two").applyInArrow(_meeting, "_one long, _two long, _pairs long").where("_pairs > 0")


def _sides(met: DataFrame) -> DataFrame:
    """Each pair of bundles with either bundle, or once with itself."""
    return met.select("_one", "_two", F.explode(F.array_distinct(F.array("_one", "_two"))).alias("_bundle"))


def _search(written: DataFrame, points: DataFrame, block_rows: int, visitor_rows: int, report: dict | None = None, bundle_rows: int | None = None) -> DataFrame:
    """``nearest_neighbors`` over points of a written table, which is deleted once the tree is written."""
    if bundle_rows is None:
        low, high = BUNDLE_ROWS
        bundle_rows = max(low, min(high, points.count() // BUNDLE_SHARE))
        block_rows = min(block_rows, bundle_rows)
    kind = points.schema["_x"].dataType.simpleString()
    pts, nodes = build_tree(points, block_rows, bundle_rows)
    discard(written)
    named = materialize(bundles(nodes, bundle_rows))
    blocked = _attach(pts, named, "_node").select("_id", "_x", "_node", "_bundle")
    own = materialize(blocked.groupBy("_node").applyInArrow(_leaf_search, f"_id long, _x {kind}, _node long, _bundle long, _d double, _nn long"))
    discard(pts)
    balls = nodes.select("_node", "_c", "_r")
    # a leaf's bound: its points' largest first distance, or the farthest reach of its sibling's ball
    within = own.groupBy(F.col("_node").alias("_a")).agg(F.max(F.sqrt("_d")).alias("_own"))
    leaves = nodes.where("_leaf").select(F.col("_node").alias("_a"), F.col("_c").alias("_ca"), F.col("_r").alias("_ra"))
    sib = balls.select(F.col("_node").bitwiseXOR(F.lit(1)).alias("_a"), F.col("_c").alias("_cs"), F.col("_r").alias("_rs"))
    bounds = leaves.join(within, "_a", "left").join(sib, "_a", "left")
    reach = F.when(F.col("_cs").isNotNull(), _dist("_ca", "_cs") + F.col("_ra") + F.col("_rs"))
    bounds = materialize(bounds.select("_a", "_ca", "_ra", F.least(F.coalesce("_own", F.lit(float("inf"))), F.coalesce(reach, F.lit(float("inf")))).alias("_u")))
    met = materialize(bundle_pairs(nodes, named, bounds))
    if report is not None:
        report["leaves"] = bounds.count()
        report["pairs"] = met.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0]
    sizes = named.select("_bundle").distinct().join(nodes.select(F.col("_node").alias("_bundle"), "_n"), "_bundle")
    travelling = _sides(met).join(sizes, "_bundle").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rows = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rounds = max(1, math.ceil(travelling / max(ROUND_ROWS, ROUND_COPIES * rows)))
    # bundles of a level are numbered in a row: in each round a bundle meets as many others
    turn = F.pmod(F.col("_one") + F.col("_two"), F.lit(rounds)).alias("_turn")
    best = materialize(own.where("_nn >= 0").select("_id", "_d", "_nn"))
    for k, n in sorted(map(tuple, met.groupBy(turn).count().collect())):
        groups = _attach(own.drop("_nn"), _sides(met.where(turn == k)), "_bundle").select("_one", "_two", "_bundle", "_node", "_id", "_x", "_d")
        # a group is much work in few bytes: as many tasks as groups, within a bound
        groups = groups.repartition(max(1, min(MAX_TASKS, n)), "_one", "_two")
        away = groups.groupBy("_one", "_two").applyInArrow(lambda group: _bundle_search(visitor_rows, group), _FOUND)
        nearer = best.unionByName(away.where("_nn >= 0")).groupBy("_id").agg(F.min(F.struct("_d", "_nn")).alias("m"))
        before, best = best, materialize(nearer.select("_id", F.col("m._d").alias("_d"), F.col("m._nn").alias("_nn")))
        discard(before)
    discard(own)
    return best


def nearest_neighbors(
    points: DataFrame, block_rows: int = BLOCK_ROWS, visitor_rows: int = VISITOR_ROWS, report: dict | None = None, bundle_rows: int | None = None
) -> DataFrame:
    """Nearest other row of each row of ``(_id long, _x array<double>)``, exact, over a ball tree.

    The vectors must be distinct; they may be arrays of floats, which are compared as doubles
    and travel as floats. Result: ``_id, _d`` (squared distance) and ``_nn``, the id
    of the neighbour (ties to the lower id); a single row has no neighbour. Each leaf of at
    most ``block_rows`` points searches itself first. Leaves are bundled by subtree into at
    most ``bundle_rows`` points (default: a sixth of all, within bounds, and leaves no
    larger, so that small tables make as many bundles as large ones); bundles with
    leaves that the triangle inequality cannot rule out for each other meet in one task,
    where batches of at most ``visitor_rows`` points visit only the leaves within their
    own bounds. They meet in rounds, in each of which rows travel ``ROUND_COPIES`` times;
    shuffle files and tables go as soon as what follows is written. ``report``, if given,
    receives the number of leaves and of leaf pairs.
    """
    with short_lived_shuffles(points.sparkSession):
        points = materialize(points)
        return _search(points, points, block_rows, visitor_rows, report, bundle_rows)


def tomek_links(
    df: DataFrame, vector: str, label: str, row_id: str, block_rows: int = BLOCK_ROWS, visitor_rows: int = VISITOR_ROWS
) -> DataFrame:
    """Both members of every link: ``(row_id, label, partner_id)``."""
    # floats stay floats: half the bytes of the same doubles
    floats = df.schema[vector].dataType.simpleString() == "array<float>"
    vectors = F.col(vector) if floats else F.col(vector).cast("array<double>")
    rows = df.select(F.col(row_id).alias("_id"), vectors.alias("_x"), F.col(label).cast("int").alias("_y"))
    first = F.min(F.struct("_id", "_y"))
    with short_lived_shuffles(df.sparkSession):
        # Lowest and second lowest id of each distinct vector, both from partial aggregates.
        lowest = materialize(rows.groupBy("_x").agg(first.alias("a"), F.count(F.lit(1)).alias("n")))
        repeated = lowest.where("n > 1").select("_x", F.col("a._id").alias("_first"))
        second = (
            rows.join(repeated, "_x").where(F.col("_id") != F.col("_first")).groupBy("_x").agg(first.alias("b"))
        )
        twins = materialize(
            lowest.where("n > 1").join(second, "_x").select(
                F.col("a._id").alias("_id"), F.col("a._y").alias("_y"), F.col("b._id").alias("_nn"), F.col("b._y").alias("_y2")
            )
        )
        single = materialize(lowest.where("n = 1").select(F.col("a._id").alias("_id"), F.col("a._y").alias("_y")))
        near = _search(lowest, lowest.select(F.col("a._id").alias("_id"), "_x"), block_rows, visitor_rows)
    seen = near.join(single, "_id").select("_id", "_y", "_nn")
    back = seen.select(F.col("_id").alias("_nn"), F.col("_nn").alias("_id"), F.col("_y").alias("_y2"))
    mutual = seen.join(back, ["_id", "_nn"]).select("_id", "_y", "_nn", "_y2")
    both = twins.unionByName(twins.select(F.col("_nn").alias("_id"), F.col("_y2").alias("_y"), F.col("_id").alias("_nn"), F.col("_y").alias("_y2")))
    return (
        mutual.unionByName(both)
        .where(F.col("_y") != F.col("_y2"))
        .select(F.col("_id").alias(row_id), F.col("_y").alias(label), F.col("_nn").alias("partner_id"))
    )


def majority_class(df: DataFrame, label: str) -> int:
    """The larger of the two classes; on a tie class 1."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    return 1 if counts.get(1, 0) >= counts.get(0, 0) else 0


def remove_tomek_links(df: DataFrame, vector: str, label: str, row_id: str, **blocking: int) -> DataFrame:
    """Drop the majority-class member of every link."""
    links = tomek_links(df, vector, label, row_id, **blocking)
    surplus = links.where(F.col(label) == majority_class(df, label)).select(row_id)
    return df.join(surplus, row_id, "left_anti")
