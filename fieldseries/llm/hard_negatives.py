"""Hard negatives by a BOND vertical scan (branch and bound over decomposed vectors).

Anchors are a stated query set; they meet all rows in tiles: rows are dealt into row
blocks and anchors into anchor blocks, and each task holds one (anchor block, row block)
pair, so no task holds more than ``ROWS_PER_BLOCK`` rows and ``ANCHORS_PER_BLOCK``
anchors whatever the table size. Inside a task the block is kept by dimension (one
array per dimension, "vertical"). For each anchor the dimensions are read in the order
of the anchor's descending magnitudes; after each step every candidate has an exact
partial score and, from the per-dimension minimum and maximum of the block, the least
and most the remaining dimensions can add. Candidates whose bounds rule them out leave
the candidate set (the bitmap); what remains when all dimensions are read has exact
scores.

Two passes over the tiles: the first keeps, per anchor and block, the best
``POSITIVES`` same-label rows, merged over blocks into the positives; the second
keeps, per positive and block, the best ``NEGATIVES`` rows of other labels in the
positive's score window, merged likewise. Merges are keyed by anchor, never by label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldseries.operators.materialize import materialize

# Fixed values of the mining rule.
SCALE = 256
ANCHOR_EVERY = 100
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # LOW * positive_score <= HIGH * negative_score <= HIGH * positive_score

#: Size bounds of one task's tile.
ROWS_PER_BLOCK = 50_000
ANCHORS_PER_BLOCK = 2_000
#: Dimensions read between two prunings of the candidate set.
STEP = 8

_POS_SCHEMA = "anchor_id long, other_id long, score long"
_NEG_SCHEMA = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def prepared(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``_id, _label, _v``: rows that take part, label moved where the id is divisible by ``RELABEL_EVERY``, components as integers.

    Rows with a null id, label or vector, or with a null, NaN or infinite component, take no part.
    A component ``x`` becomes ``floor(SCALE * x)`` with ``x`` as double.
    """
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & ~v.cast("double").isin(float("inf"), float("-inf")))
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite
    label = F.when(F.col(id_col) % RELABEL_EVERY == 0, (F.col(label_col) + 1) % LABELS).otherwise(F.col(label_col))
    return emb.where(ok).select(
        F.col(id_col).cast("long").alias("_id"),
        label.cast("long").alias("_label"),
        F.transform(x, lambda v: F.floor(F.lit(SCALE) * v.cast("double"))).alias("_v"),
    )


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of int64, zero-padded to ``width``: columns beyond a vector's length count as 0."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _scan(q: np.ndarray, cols: np.ndarray, low: np.ndarray, high: np.ndarray, cand: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
    """Vertical scan of ``cand`` (indices into the columns ``cols``, dimensions x rows) for anchor ``q``.

    ``low``/``high`` are per-dimension least and most values over the rows; ``prune(lb, ub, cand)``
    returns which candidates stay. Returns the remaining candidates and their exact scores.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    a, b = q * low, q * high
    lo_d, hi_d = np.minimum(a, b)[order], np.maximum(a, b)[order]
    rest_lo = np.concatenate([np.cumsum(lo_d[::-1])[::-1], [0]])
    rest_hi = np.concatenate([np.cumsum(hi_d[::-1])[::-1], [0]])
    partial = np.zeros(len(cand), dtype=np.int64)
    for t in range(0, len(order), STEP):
        for d in order[t : t + STEP]:
            if q[d]:
                partial += q[d] * cols[d, cand]
        done = min(t + STEP, len(order))
        if done < len(order):
            keep = prune(partial + rest_lo[done], partial + rest_hi[done], cand)
            cand, partial = cand[keep], partial[keep]
            if not len(cand):
                break
    return cand, partial


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` best: higher score first, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _kth_lower(lb: np.ndarray, k: int):
    return np.partition(lb, len(lb) - k)[len(lb) - k] if len(lb) >= k else None


def _tile(rows: pd.DataFrame, anchors: pd.DataFrame, positives: bool) -> pd.DataFrame:
    if rows.empty or anchors.empty:
        return pd.DataFrame(columns=(_POS_SCHEMA if positives else _NEG_SCHEMA).replace(" long", "").split(", "))
    width = max(max(map(len, rows["_v"]), default=0), max(map(len, anchors["_v"]), default=0))
    cols = _matrix(rows["_v"], width).T.copy()
    ids, labels = rows["_id"].to_numpy(np.int64), rows["_label"].to_numpy(np.int64)
    qs = _matrix(anchors["_v"], width)
    bounds = {}

    def limits(mask_key, mask):
        if mask_key not in bounds:
            part = cols[:, mask]
            bounds[mask_key] = (part.min(axis=1), part.max(axis=1)) if part.shape[1] else (np.zeros(width, np.int64),) * 2
        return bounds[mask_key]

    out = []
    for k, (aid, alabel) in enumerate(zip(anchors["_id"].to_numpy(np.int64), anchors["_label"].to_numpy(np.int64), strict=True)):
        q = qs[k]
        if positives:
            mask = (labels == alabel) & (ids != aid)
            cand = np.flatnonzero(mask)
            if not len(cand):
                continue
            low, high = limits(("same", alabel), labels == alabel)

            def prune(lb, ub, _c):
                kth = _kth_lower(lb, POSITIVES)
                return ub >= kth if kth is not None else np.ones(len(lb), bool)

            cand, score = _scan(q, cols, low, high, cand, prune)
            best = _top(score, ids[cand], POSITIVES)
            out.append(pd.DataFrame({"anchor_id": aid, "other_id": ids[cand][best], "score": score[best]}))
        else:
            ps = np.asarray(anchors["_ps"].iloc[k], dtype=np.int64)
            pid = np.asarray(anchors["_pid"].iloc[k], dtype=np.int64)
            live = ps >= 0  # a window is empty unless LOW * ps <= HIGH * ps
            ps, pid = ps[live], pid[live]
            if not len(ps):
                continue
            cand = np.flatnonzero(labels != alabel)
            if not len(cand):
                continue
            low, high = limits(("other", alabel), labels != alabel)

            def prune(lb, ub, _c, ps=ps):
                can = (HIGH * ub[:, None] >= LOW * ps[None, :]) & (lb[:, None] <= ps[None, :])
                sure = (HIGH * lb[:, None] >= LOW * ps[None, :]) & (ub[:, None] <= ps[None, :])
                for j in range(len(ps)):
                    kth = _kth_lower(lb[sure[:, j]], NEGATIVES)
                    if kth is not None:
                        can[:, j] &= ub >= kth
                return can.any(axis=1)

            cand, score = _scan(q, cols, low, high, cand, prune)
            for j in range(len(ps)):
                inside = (HIGH * score >= LOW * ps[j]) & (score <= ps[j])
                c, s = cand[inside], score[inside]
                best = _top(s, ids[c], NEGATIVES)
                out.append(pd.DataFrame({"anchor_id": aid, "positive_id": pid[j], "positive_score": ps[j], "negative_id": ids[c][best], "negative_score": s[best]}))
    if not out:
        return _tile(rows.iloc[:0], anchors.iloc[:0], positives)
    return pd.concat(out, ignore_index=True).astype("int64")


def _tiles(rows: DataFrame, anchors: DataFrame, positives: bool) -> DataFrame:
    """Each anchor against each row, a tile per (anchor block, row block)."""
    spark = rows.sparkSession
    n_rows, n_anchors = rows.count(), anchors.count()
    r = max(1, -(-n_rows // ROWS_PER_BLOCK))
    a = max(1, -(-n_anchors // ANCHORS_PER_BLOCK))
    dealt_rows = rows.select("*", F.pmod(F.xxhash64("_id"), F.lit(r)).alias("_rb"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("_ab"))
    dealt_anchors = anchors.select("*", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(a)).alias("_ab"), F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("_rb"))
    schema = _POS_SCHEMA if positives else _NEG_SCHEMA
    del spark
    return (
        dealt_rows.groupBy("_ab", "_rb")
        .cogroup(dealt_anchors.groupBy("_ab", "_rb"))
        .applyInPandas(lambda left, right: _tile(left, right, positives), schema)
    )


def mine(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors of ``emb``.

    Anchors: rows (that take part, see ``prepared``) whose id is divisible by ``ANCHOR_EVERY``.
    A row's score is its integer inner product with the anchor (vectors of other lengths
    are padded with zeros); higher first, ties by smaller id. Positives: the first
    ``POSITIVES`` rows of the anchor's label other than rows with the anchor's id (all, if
    fewer). Per positive, negatives: the first ``NEGATIVES`` rows of other labels whose score
    lies in ``[LOW/HIGH * positive_score, positive_score]`` (an anchor or positive without
    any gives no rows); ``rank`` counts from 1. Repeated rows take part as often as they
    occur. Scores are 64-bit: components must keep ``|SCALE * x| < 2**27`` for 64
    dimensions to stay exact. Empty input gives no rows; other columns are not returned.
    """
    rows = materialize(prepared(emb, id_col, vec_col, label_col))
    anchors = rows.where(F.col("_id") % ANCHOR_EVERY == 0)
    local = _tiles(rows, anchors, positives=True)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    chosen = local.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= POSITIVES)
    pos = materialize(
        chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_r"), F.col("other_id"), F.col("score")))).alias("_p"))
    )
    with_pos = anchors.join(pos, anchors["_id"] == pos["anchor_id"]).select(
        "_id", "_label", "_v", F.col("_p.other_id").alias("_pid"), F.col("_p.score").alias("_ps")
    )
    found = _tiles(rows, materialize(with_pos), positives=False)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
