"""Language identification by rank-order profiles and out-of-place distance."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import slices

UNKNOWN = "und"
#: More label values than this are taken for an error in the labels, not for languages.
MAX_LANGUAGES = 1_000
_FLUSH = 500_000


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all other code points."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalpha():
            table[i] = ord(ch.lower()[0])
    return table


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of one to three letters of blank-padded words: codes, and each text's offsets at each n."""
    raw = "\n".join(["", *[t or "" for t in texts], ""])
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[points]
    lengths = np.array([len(t or "") + 1 for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[starts] = True  # the blank between two texts
    place = np.concatenate(([0], np.cumsum(keep)))[starts]
    c = codes[keep].astype(np.uint64)
    one = c[:-1]
    two = (c[:-1] << np.uint64(21)) | c[1:] | np.uint64(1 << 63)
    three = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    # a gram starts at its text's leading blank or later and ends at the blank that closes the text
    has = [one != 0, (c[:-1] != 0) | (c[1:] != 0), c[1:-1] != 0]
    grams, bounds = [], []
    for values, ok in zip((one, two, three), has, strict=True):
        grams.append(values[ok])
        bounds.append(np.concatenate(([0], np.cumsum(ok)))[np.minimum(place, len(ok))])
    shift = np.cumsum([0, len(grams[0]), len(grams[1])])
    return np.concatenate(grams), np.array([b + s for b, s in zip(bounds, shift, strict=True)]), lengths


def _counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    return values[edge[:-1]], np.diff(edge)


def _of(grams: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([grams[b[k] : b[k + 1]] for b in bounds])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            codes = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            codes, where = np.unique(codes, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes.view(np.int64)), "n": pa.array(np.bincount(where, weights=counts).astype(np.int64))})
        held.clear()

    for batch in slices(batches):
        langs = batch.column("lang").to_pylist()
        grams, bounds, _ = _grams(batch.column("text").to_pylist())
        by: dict[str, list] = {}
        for k, lang in enumerate(langs):
            by.setdefault(lang, []).append(_of(grams, bounds, k))
        for lang, parts in by.items():
            values = np.concatenate(parts)
            if len(values):
                held.setdefault(lang, []).append(_counts(values))
                size += len(held[lang][-1][0])
        if size > _FLUSH:
            yield from flush()
            size = 0
    yield from flush()


def fit_profiles(labelled: DataFrame, size: int = 400, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each language, most frequent first; equal counts by code.

    Counts cover all rows with a text and a label. Only the profiles, ``size`` codes for
    each of at most ``MAX_LANGUAGES`` labels, come to the driver.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank")
    found = top.limit(MAX_LANGUAGES * size + 1).toPandas()
    if len(found) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    return {lang: g.sort_values("rank")["gram"].to_numpy(np.int64).view(np.uint64) for lang, g in found.groupby("lang", sort=True)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 400, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of each row, from its text alone; columns of these names are replaced.

    The distance to a language sums, over the document's ``size`` most frequent n-grams,
    how far each is out of place in the profile; an absent one costs ``size``. The
    nearest language wins, equal ones by name. ``score`` is 1 less the distance's share
    of the largest one. A text that is null, empty or without letters, or a model
    without profiles, gives ``und`` and 0. Repeated rows give repeated rows.
    """
    names = sorted(profiles)
    known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
    ranks = np.full((len(known) + 1, len(names)), -1, np.int64)
    for j, name in enumerate(names):
        ranks[np.searchsorted(known, profiles[name]), j] = np.arange(len(profiles[name]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            grams, bounds, lengths = _grams(batch.column(text_col).to_pylist())
            best, score = [], []
            for k in range(len(lengths)):
                values = _of(grams, bounds, k)
                if not len(values) or not names:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                codes, counts = _counts(values)
                codes = codes[np.argsort(-counts, kind="stable")[:size]]
                at = np.searchsorted(known, codes)
                at[at < len(known)] = np.where(known[at[at < len(known)]] == codes[at < len(known)], at[at < len(known)], len(known))
                place = ranks[at]
                away = np.where(place < 0, size, np.minimum(size, np.abs(place - np.arange(len(codes))[:, None]))).sum(axis=0)
                j = int(np.argmin(away))
                best.append(names[j])
                score.append(1.0 - float(away[j]) / (size * len(codes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(kept)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
