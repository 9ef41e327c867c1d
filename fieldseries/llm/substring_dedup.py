"""Exact substring dedup: later copies of long byte strings go, the first ones stay.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document of smaller
id: if the longest previous factor at that start, among smaller documents, reaches
``LENGTH``. The suffix order that tells is sparse and distributed: suffixes are taken at
anchors, which equal strings have at equal places, and brought next to those that agree
in the anchor and its surroundings; the previous smaller document in that order gives
the earlier match. Where surroundings differ, the strings over the anchor are ordered
themselves. Anchors and strings are dealt out in passes by their hash; what a pass
shuffles goes when it ends. Joins leave the text in place or stream it past a table of
lists or ids: it is never sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseries.operators.materialize import discard, materialize

from .lifetime import short_lived_shuffles
from .textvec import mix, slices, span_hash, span_sums, text_bytes

#: Bytes of a string that counts as a copy, and of an anchor.
LENGTH, ANCHOR = 50, 16
_REACH = LENGTH - ANCHOR  # an anchor is in the strings that start up to so many bytes before it
#: Of a string over an anchor, so many bytes lie before it, or else as many or more after it.
_HALF = _REACH // 2
LEFT, RIGHT = 1, 2
#: Bytes of text, and anchors, that a task holds as number arrays at once.
_SLICE, _FLUSH = 500_000, 250_000
#: Passes over the anchors, and over the strings.
TURNS = 2
#: Ids of equal texts up to this many are broadcast (about 25 MB); more are joined.
BROADCAST_COPIES = 300_000


def _sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """``choose`` over each run of ``width`` values, by doubling; the result is shorter by ``width - 1``."""
    have, out = 1, values
    while have * 2 <= width:
        out = choose(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return choose(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray, bounds: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: in each string of ``LENGTH`` bytes its ``ANCHOR`` bytes of least hash."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(n - ANCHOR + 1)
    hashes = span_hash(sums, place, place + ANCHOR)
    whole = np.zeros(n - LENGTH + 1, bool)  # strings that lie in one document
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            whole[a : b - LENGTH + 1] = True
    least = np.where(whole, _sliding(hashes, _REACH + 1, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(_REACH, np.uint64), least, np.zeros(_REACH, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, _REACH + 1, np.maximum)[: len(hashes)] == hashes)
    return chosen, hashes[chosen]


def _anchor_rows(batches: Iterator[pa.RecordBatch], turn: int = 0, turns: int = 1) -> Iterator[pa.RecordBatch]:
    """Anchors of a turn, by their hash, with a hash of their surroundings; ``full`` where a smaller document of this task has the same."""
    held: list[list[np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        h, c, sides, doc, row, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, c, h))
        a, b, d = h[order], c[order], doc[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        full = np.zeros(len(h), bool)
        full[order] = d > d[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        # what is settled needs no company: it is dealt out evenly
        h = np.where(full, mix(pos.astype(np.uint64) * np.uint64(31) + doc.view(np.uint64)).astype(np.uint32), h)
        # rows stay in the order of documents, whose ids then compress
        arrays = [h.view(np.int32), c, np.where(full, 0, sides), doc, row, pos, full]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["h", "c", "sides", "doc", "row", "pos", "full"])

    for batch in slices(batches, most=_SLICE):
        raw, bounds = text_bytes(batch.column("text"))
        sums = span_sums(raw.astype(np.uint64) + np.uint64(1))
        at, h = anchors(raw, bounds, sums)
        # the lower bits: anchors are those of least hash
        mine = (h & np.uint64(0xFFFFFFFF)) % np.uint64(turns) == turn
        at, h = at[mine], h[mine]
        k = np.searchsorted(bounds, at, side="right") - 1
        left, right = np.maximum(at - _REACH, bounds[k]), np.minimum(at + LENGTH, bounds[k + 1])
        # all of c is kept, for it settles anchors unseen; half of h is enough to bring them together.
        # Its lower half: anchors are those of least hash
        c = mix(span_hash(sums, left, right) + (at - left).astype(np.uint64))
        # hashes of the anchor with half the reach on either side; where a side is cut off, of what is there
        before = span_hash(sums, np.maximum(at - _HALF, left), at + ANCHOR) >> np.uint64(49)
        after = span_hash(sums, at, np.minimum(at + ANCHOR + _HALF, right)) >> np.uint64(48)
        sides = (before << np.uint64(16) | after).astype(np.int32)
        doc, row = batch.column("doc").to_numpy()[k], batch.column("row").to_numpy()[k]
        held.append([h.astype(np.uint32), c.view(np.int64), sides, doc, row, (at - bounds[k]).astype(np.int32)])
        if sum(len(x[0]) for x in held) > _FLUSH:
            yield flush()
    if held:
        yield flush()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from anchors in the order (h, c, doc): settled ones, and those that need their strings compared.

    An anchor with a smaller document before it in its class (h, c) is settled: all
    strings over it are copies. The first of a class has to be looked at where another
    class of the same anchor has another document and agrees on one side: strings over an
    anchor reach half of what is left on one side or on the other. ``side`` says on
    which. Only the first ones of an anchor seen with one document so far are held over
    from batch to batch; an anchor that goes on in the next batch is looked at on both.
    """
    h0, c0, first0 = None, None, 0  # the class that is open
    low0, high0, classes0, held = 0, 0, 0, None  # the anchor that is open

    def out(doc, row, pos, side) -> pa.RecordBatch:
        sides = np.broadcast_to(np.asarray(side, np.int32), len(doc))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(pos), pa.array(np.ascontiguousarray(sides))], names=["doc", "row", "pos", "side"])

    def agreeing(group, half, doc) -> np.ndarray:
        """Which rows share their anchor and a side of it with another document."""
        order = np.lexsort((doc, half, group))
        g, x, d = group[order], half[order], doc[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])))
        at = np.flatnonzero(new)
        some = d[np.append(at[1:], len(d)) - 1] > d[at]
        result = np.zeros(len(d), bool)
        result[order] = some[np.cumsum(new) - 1]
        return result

    for batch in batches:
        h, c, sides, doc, row, pos, full = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("h", "c", "sides", "doc", "row", "pos", "full"))
        if full.any():
            yield out(doc[full], row[full], pos[full], 0)
            h, c, sides, doc, row, pos = (x[~full] for x in (h, c, sides, doc, row, pos))
        if not len(h):
            continue
        new_h = np.concatenate(([h0 is None or h[0] != h0], h[1:] != h[:-1]))
        new_c = new_h | np.concatenate(([c0 is None or c[0] != c0], c[1:] != c[:-1]))
        start = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
        first = np.where(start < 0, first0, doc[start])
        later = doc > first
        if later.any():
            yield out(doc[later], row[later], pos[later], 0)
        # per anchor: how many classes and which documents the first ones have
        group = np.cumsum(new_h) - (0 if not new_h[0] else 1)
        n = group[-1] + 1
        head = ~later
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, group[head], doc[head])
        np.maximum.at(high, group[head], doc[head])
        classes = np.bincount(group, weights=new_c, minlength=n).astype(np.int64)
        if not new_h[0]:
            low[0], high[0], classes[0] = min(low[0], low0), max(high[0], high0), classes[0] + classes0
        mixed = (classes > 1) & (low < high)
        if held is not None and not new_h[0] and mixed[0]:
            yield out(*held, LEFT | RIGHT)
            held = None
        show = head & mixed[group]
        if show.any():
            g, x = group[show], sides[show]
            side = LEFT * agreeing(g, x >> 16, doc[show]) + RIGHT * agreeing(g, x & 0xFFFF, doc[show])
            open_ends = (g == n - 1) | ((g == 0) & (not new_h[0]))
            side = np.where(open_ends, LEFT | RIGHT, side)
            some = side > 0
            yield out(doc[show][some], row[show][some], pos[show][some], side[some])
        last = head & (group == n - 1)
        if mixed[-1]:
            held = None
        else:
            keep = [doc[last], row[last], pos[last]]
            held = [np.concatenate(x) for x in zip(held, keep, strict=True)] if held is not None and n == 1 and not new_h[0] else keep
        h0, c0, first0 = h[-1], c[-1], first[-1]
        low0, high0, classes0 = low[-1], high[-1], classes[-1]


def _starts(n: int, marks: np.ndarray, side: int = LEFT | RIGHT) -> np.ndarray:
    """Which strings of a text of n bytes lie over one of the anchors, and reach ``_HALF`` bytes to that side of it."""
    edge = np.zeros(max(0, n - LENGTH + 1) + 1, np.int32)
    if len(edge) > 1 and len(marks):
        low = np.maximum(marks - (_REACH if side & LEFT else _HALF), 0)
        high = np.minimum(marks - (0 if side & RIGHT else _HALF), n - LENGTH)
        fits = low <= high
        np.add.at(edge, low[fits], 1)
        np.add.at(edge, high[fits] + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def _lists(column: pa.Array, k: int) -> np.ndarray:
    value = column[k]
    return np.array(value.as_py(), np.int64) if value.is_valid else np.zeros(0, np.int64)


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings over unsettled anchors that no settled one covers: hashes, document, start."""
    for batch in slices(batches, most=_SLICE):
        raw, bounds = text_bytes(batch.column("text"))
        sums = span_sums(raw.astype(np.uint64) + np.uint64(1))
        found, rows = [], []
        for k in range(batch.num_rows):
            n = int(bounds[k + 1] - bounds[k])
            unsettled = np.zeros(max(0, n - LENGTH + 1), bool)
            for side in (LEFT, RIGHT):
                unsettled |= _starts(n, _lists(batch.column(f"open_{side}"), k), side)
            open_ = unsettled & ~_starts(n, _lists(batch.column("full"), k))
            at = np.flatnonzero(open_)
            found.append(at + bounds[k])
            rows.append(np.full(len(at), k))
        at, k = np.concatenate(found), np.concatenate(rows)
        w = span_hash(sums, at, at + LENGTH)
        for i in range(0, len(at), 200_000):
            s = slice(i, i + 200_000)
            doc, row = batch.column("doc").to_numpy()[k[s]], batch.column("row").to_numpy()[k[s]]
            yield pa.RecordBatch.from_arrays([pa.array(w[s].view(np.int64)), pa.array(doc), pa.array(row), pa.array((at[s] - bounds[k[s]]).astype(np.int32))], names=["w", "doc", "row", "start"])


def _removal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=_SLICE):
        raw, bounds = text_bytes(batch.column("text"))
        columns = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        copies = batch.column("copy").to_pylist()
        for k in range(batch.num_rows):
            text = raw[bounds[k] : bounds[k + 1]]
            n = len(text)
            start = _starts(n, _lists(batch.column("full"), k))
            more = _lists(batch.column("found"), k)
            start[more[more < len(start)]] = True
            if copies[k]:
                start[:] = True
            edge = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(start)
            edge[at] += 1
            edge[at + LENGTH] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            kept = text[~gone].tobytes()
            columns["n_bytes"].append(n)
            columns["n_removed"].append(int(gone.sum()))
            columns["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum() + (n > 0 and gone[0])))
            columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            columns["kept"].append(kept)
        out = [pa.array(columns[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *out, pa.array(columns["kept_sha256"]), pa.array(columns["kept"], pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _copied(strings: DataFrame) -> DataFrame:
    """Strings that a smaller document has too: the least document of equal strings keeps them."""
    parts = []
    for turn in range(TURNS):
        some = strings.where(F.pmod("w", F.lit(TURNS)) == turn)
        least = some.groupBy("w").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("w", "least")
        parts.append(materialize(some.join(least, "w").where("doc > least").select("doc", "row", "start")))
    return reduce(DataFrame.unionByName, parts)


def _settled(by_doc: DataFrame, copied: DataFrame) -> DataFrame:
    """Settled anchors and copied strings of each document."""
    found = copied.groupBy("doc", "row").agg(F.collect_list("start").alias("found"))
    return by_doc.select("doc", "row", "full").where(F.size("full") > 0).join(found, ["doc", "row"], "full_outer")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (binary) of each row.

    Strings are judged on the input, may overlap, and never cross documents. Of equal
    texts only the one with the least id is searched; the others go whole if they have
    ``LENGTH`` bytes. A null text is empty. Repeats within one document, and between rows
    of one id, stay. A null id counts as smaller than all others. An empty table gives an
    empty table; other columns are not read. Ids must be integers.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    lowest = -(1 << 63)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    first = rows.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.count("*").alias("c")).where("c > 1").select("t1", "t2", "first")
    later = rows.select("doc", "t1", "t2").join(first, ["t1", "t2"]).where("doc > first").select("doc", "t1").distinct()
    later = materialize(later.withColumn("copy", F.lit(True)))
    later = F.broadcast(later) if later.count() <= BROADCAST_COPIES else later.hint("shuffle_hash")
    row = F.pmod("t1", F.lit(1 << 31)).cast("int").alias("row")
    texts = rows.select("doc", row, "text")
    rows = rows.join(later, ["doc", "t1"], "left").select("doc", "text", row, F.coalesce("copy", F.lit(False)).alias("copy"))
    searched = rows.where(~F.col("copy")).select("doc", "row", "text")

    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with short_lived_shuffles(spark):
        marks = []
        for turn in range(TURNS):
            found = searched.mapInArrow(partial(_anchor_rows, turn=turn, turns=TURNS), "h int, c long, sides int, doc long, row int, pos int, full boolean")
            ordered = found.repartition(ranges, "h").sortWithinPartitions("h", "c", "doc")
            marks.append(materialize(ordered.mapInArrow(_classes, "doc long, row int, pos int, side int")))
        side = F.col("side")
        by_doc = reduce(DataFrame.unionByName, marks).groupBy("doc", "row").agg(
            F.collect_list(F.when(side == 0, F.col("pos"))).alias("full"),
            *[F.collect_list(F.when(side.bitwiseAND(k) > 0, F.col("pos"))).alias(f"open_{k}") for k in (LEFT, RIGHT)],
        )
        unsettled = by_doc.where((F.size(f"open_{LEFT}") > 0) | (F.size(f"open_{RIGHT}") > 0))
        # only what was searched has marks
        strings = materialize(texts.join(unsettled.hint("shuffle_hash"), ["doc", "row"]).mapInArrow(_string_rows, "w long, doc long, row int, start int"))
        copied = _copied(strings)
        discard(strings)
        settled = materialize(_settled(by_doc, copied)).hint("shuffle_hash")
    out = rows.join(settled, ["doc", "row"], "left").select("doc", "text", "copy", "full", "found").mapInArrow(_removal_rows, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.nullif(F.col("doc"), F.lit(lowest)).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
