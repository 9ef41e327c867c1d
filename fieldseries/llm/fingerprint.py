"""Document fingerprints from prefix polynomial hashes.

Modular prefix arrays answer the hash of any span in constant time. Spans of fixed
width give a bottom-k sketch, whole texts give an exact part, and longest common
extensions are found by binary search over span equality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textvec import mix, slices

#: Two primes below 2**31 and their bases: products of two residues fit 64 bits.
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (1103515245, 1299709421)
WIDTH, SKETCH = 16, 64
#: Bytes of text in one set of prefix arrays, which take some twenty times as much.
_SLICE = 200_000
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64) for _ in range(4)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses, modulo their primes."""
    bases = [(p, base) for p, base in zip(_PRIMES, _BASES, strict=True)]
    bases += [(p, pow(base, -1, int(p))) for p, base in bases]
    for k, (p, base) in enumerate(bases):
        while len(_POWERS[k]) < n:
            step = np.uint64(pow(base, len(_POWERS[k]), int(p)))
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * step % p])
    return [x[:n] for x in _POWERS]


class Prefixes:
    """Prefix hashes of the code points of several texts, laid end to end."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        *powers, self.down1, self.down2 = _powers(len(points) + 1)
        self.sums = []
        for p, power in zip(_PRIMES, powers, strict=True):
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(points * power[:-1] % p, out=sums[1:])
            self.sums.append(sums % p)

    def spans(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Both residues of the spans [start, end), divided by the power of their start: equal spans have equal residues."""
        down = (self.down1, self.down2)
        return [(s[end] + p - s[start]) % p * d[start] % p for p, s, d in zip(_PRIMES, self.sums, down, strict=True)]

    def common_extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of positions ``i`` and ``j``, up to ``most``: one binary search for all."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64).copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            a, b = self.spans(i, i + mid), self.spans(j, j + mid)
            same = (a[0] == b[0]) & (a[1] == b[1])
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def fingerprints(self) -> tuple[list[str], list[np.ndarray]]:
        """Text form and sketch of each text: length, hash of the whole, and its least distinct span hashes."""
        start, end = self.bounds[:-1], self.bounds[1:]
        whole = self.spans(start, end)
        p, s = _PRIMES[0], self.sums[0]
        n = max(0, len(s) - WIDTH)
        windows = (s[WIDTH:] + p - s[:n]) % p * self.down1[:n] % p
        windows = mix(windows + np.uint64(1)) >> np.uint64(32)
        forms, sketches = [], []
        for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            if b - a >= WIDTH:
                own = np.sort(windows[a : b - WIDTH + 1])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))][:SKETCH]
            elif b > a:
                own = mix(whole[0][k : k + 1] + np.uint64(1)) >> np.uint64(32)
            else:
                own = windows[:0]
            own = own.astype(">u4")
            sketches.append(own)
            forms.append(f"{b - a:x}.{int(whole[0][k]):08x}{int(whole[1][k]):08x}.{own.tobytes().hex()}")
        return forms, sketches


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common spans, estimated from two sketches: of the least hashes of both, how many stand in both."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.union1d(a, b)[:SKETCH]
    return float(np.isin(both, np.intersect1d(a, b)).mean())


def sketch_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.rpartition(".")[2]), ">u4")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], following: list[int]) -> dict:
    """Result columns of the documents ``ids``, which are the first of ``texts``; ``following`` says which text follows each."""
    n = len(ids)
    edited = [_edited(texts[k], texts[following[k]]) for k in range(n)]
    table = Prefixes([*texts, *edited])
    forms, sketches = table.fingerprints()
    own, other = table.bounds[:n], table.bounds[len(texts) :]
    shared = table.common_extension(own, other[:n], np.minimum(np.diff(table.bounds)[:n], np.diff(other)))
    return {
        "id": ids,
        "n_chars": [len(texts[k]) for k in range(n)],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": forms[:n],
        "edited_fingerprint": forms[len(texts) :],
        "near_edited": [likeness(sketches[k], sketches[len(texts) + k]) for k in range(n)],
        "near_next": [likeness(sketches[k], sketches[following[k]]) for k in range(n)],
        "common_prefix": shared.tolist(),
    }


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_chars``, ``fingerprint`` of each whole text; null is empty, equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(Prefixes(texts).fingerprints()[0])], names=[id_col, "n_chars", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    The edited text has its second half replaced by the start of the next document in
    the order of ids; the last is followed by the first. ``common_prefix`` is the
    longest common extension of both texts at their starts.

    The order is by ranges: tasks read their range in order, and what follows a range's
    last document is looked up among the ranges' first ones. A null text is empty; a null
    id comes first; equal ids are ordered by text. One document is followed by itself.
    An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rest = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange(ranges, "id").sortWithinPartitions("id", "text")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for batch in slices(batches, most=_SLICE):
            ids += batch.column("id").to_pylist()
            texts += batch.column("text").to_pylist()
            if len(ids) > 1:
                yield pa.RecordBatch.from_pydict(_rows(ids[:-1], texts, range(1, len(ids))), schema=arrow)
                ids, texts = ids[-1:], texts[-1:]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or (batch.column("id")[0].as_py(), batch.column("text")[0].as_py())
                last = (batch.column("id")[-1].as_py(), batch.column("text")[-1].as_py())
        if first:
            yield pa.RecordBatch.from_pydict({"first": [first[0]], "head": [first[1]], "id": [last[0]], "text": [last[1]]}, schema=edge)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_SLICE):
            ids, texts, heads = (batch.column(c).to_pylist() for c in ("id", "text", "head"))
            yield pa.RecordBatch.from_pydict(_rows(ids, [*texts, *heads], range(len(ids), 2 * len(ids))), schema=arrow)

    own = pa.array([], pa.int64()).type if kind == "bigint" else {"int": pa.int32(), "string": pa.string()}[kind]
    fields = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())]
    arrow = pa.schema([("id", own), *fields])
    edge = pa.schema([("first", own), ("head", pa.string()), ("id", own), ("text", pa.string())])
    ends = ordered.mapInArrow(edges, f"first {kind}, head string, id {kind}, text string").withColumn("first", F.struct("first"))
    # one small row for each range, and the texts are looked up by the range's first id
    starts = ends.select("first")
    chain = starts.select("first", F.coalesce(F.lead("first").over(Window.orderBy("first")), F.min("first").over(Window.partitionBy())).alias("next"))
    heads = ends.select(F.col("first").alias("next"), "head")
    last = ends.drop("head").join(chain, "first").join(heads, "next").select("id", "text", "head")
    schema = f"id {kind}, {rest}"
    out = ordered.mapInArrow(inner, schema).union(last.mapInArrow(outer, schema))
    return out.withColumnRenamed("id", id_col)
