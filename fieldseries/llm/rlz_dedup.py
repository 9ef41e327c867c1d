"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

Words are runs of non-white-space (``[^\\x20\\x09-\\x0D]+``), taken unchanged, and
hashed to 64 bits (once for each distinct word of a chunk). A window is ``WINDOW`` consecutive words of one document; it
is keyed by two polynomials of its word hashes modulo 2**64 (128 bits). A false match
needs two distinct words of equal 64-bit hash (for 10**9 distinct words a chance of
about 3 %, each such pair touching only windows that differ in just those words) or a
coincidence of both keys.

Rows are written once in chunks of about ``CHUNK_BYTES`` of text, the units that are read
again and answered.

1. Index: the windows are split by key into ``SLICES`` reference blocks, each built and
   probed in a pass of its own whose shuffle files go when it ends. A chunk sends every
   distinct window of a block once, with its first occurrence there (least document id,
   then position), packed 24 bytes each into one row a bucket: a very common window
   travels once a chunk.
2. Parse: a bucket finds the first occurrence of each window over all chunks and answers
   the chunks that know a later one. A window whose first occurrence is in a document
   with a smaller id is a match, pointing at (reference document, position).
3. Factor: per document, greedily from the left, a factor is the longest run of
   matches whose pointers continue in the same reference document word by word, so
   it copies ``WINDOW - 1 + run`` words. Every factor is at least ``WINDOW`` words long,
   so all become duplicate spans. Windows that straddle a factor's end are checked at
   the boundary: if they match they start the next factor, so spans that overlap in
   the input are all found. The words covered by factors are removed; windows are
   judged on the input, not on what is left.

A document is parsed in one task: the work and memory of a task grow with the length
of its longest document (and a bucket's by at most one entry a chunk), never with the
number of copies of a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, NullType, StringType, StructField, StructType

from fieldseries.operators.materialize import materialize

from .lifetime import large_rows, short_lived_shuffles

# Fixed values of the rule.
WINDOW = 13
WORD = r"[^\x20\x09-\x0D]+"
#: Reference blocks of the window index (slices of its keys), each built and probed in a pass of its own.
SLICES = 3
#: Bases of the two polynomial window keys over 64-bit word hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Text of a chunk, and of all chunks for each bucket of a block; small tables have ``LEAST_BUCKETS``.
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
#: Windows as chunks send them (32 bits of the second key) and as buckets answer (``at``: place among the chunk's distinct windows of the block).
_SEEN = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("pos", "<i4"), ("id", "<i8")])
_FIRST = np.dtype([("at", "<i4"), ("pos", "<i4"), ("id", "<i8")])

_FACTOR = ArrayType(
    StructType([StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("ref_id", LongType()), StructField("ref_start", IntegerType())])
)


def _chunks(text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows gathered in chunks of bounded text, by ascending ``_id`` (null last): ``_chunk, _bytes, _docs``."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not len(batch):
            continue
        order = pc.sort_indices(batch.column("_id"))
        size = pc.fill_null(pc.binary_length(batch.column(text_col).take(order)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], np.diff((np.cumsum(size) - size) // CHUNK_BYTES) > 0)))
        for lo, hi in zip(starts, np.append(starts[1:], len(size)), strict=True):
            rows = batch.take(order[lo:hi]).to_struct_array()
            docs = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([size[lo:hi].sum()]), docs], names=["_chunk", "_bytes", "_docs"])
            chunk += 1


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and where each text's words start and end in it."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = lists.values
    real = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty word
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return flat.filter(real), before[lists.offsets.to_numpy()].astype(np.int64)


def _window_keys(wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two polynomial keys (mod 2**64, bases ``BASES``) of every run of ``WINDOW`` word hashes."""
    n = len(wh) - WINDOW + 1
    keys = []
    for base in BASES:
        h = np.zeros(max(n, 0), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                h *= np.uint64(base)
                h += wh[j : j + n]
        keys.append(h)
    return keys[0], keys[1]


def _windows(ids: pa.Array, flat: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a chunk's rows with an id, by id and position: as ``_SEEN``, and where they start in ``flat``."""
    if len(flat) < WINDOW:
        return np.empty(0, dtype=_SEEN), np.empty(0, dtype=np.int64)
    words = flat.dictionary_encode()
    h1, h2 = _window_keys(hash_array(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), categorize=False)[words.indices.to_numpy()])
    doc = np.repeat(np.arange(len(ids)), np.diff(ends))[: len(h1)]
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    start = np.flatnonzero((np.arange(WINDOW, len(h1) + WINDOW) <= ends[1:][doc]) & known[doc])
    doc = doc[start]
    seen = np.empty(len(start), dtype=_SEEN)
    seen["h1"], seen["h2"], seen["pos"] = h1[start], h2[start] & np.uint64(0xFFFFFFFF), start - ends[doc]
    seen["id"] = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[doc]
    rows = pc.drop_null(ids).to_numpy(zero_copy_only=False)
    if (np.diff(rows) <= 0).any():  # rows with equal ids: their positions interleave
        order = np.lexsort((seen["pos"], seen["id"]))
        return seen[order], start[order]
    return seen, start


def _by_key(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by key, else as they came, and where each distinct key starts in it."""
    h1, h2 = seen["h1"].copy(), seen["h2"].copy()
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    return order, np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])


def _bucket(h1: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the first key; ``SLICES`` times ``buckets`` of them, block after block."""
    return ((h1 >> np.uint64(32)) * np.uint64(SLICES * buckets)) >> np.uint64(32)


def _send(block: int, buckets: int, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of one reference block in each chunk: ``_bucket, _chunk, _at`` (place of the first of them) and ``_seen``."""
    for batch in batches:
        for chunk, docs in zip(batch.column("_chunk").to_pylist(), batch.column("_docs"), strict=True):
            rows = pa.RecordBatch.from_struct_array(docs.values)
            seen, _ = _windows(rows.column("_id"), *_split(rows.column(text_col)))
            seen = seen[_bucket(seen["h1"], buckets) // np.uint64(buckets) == block]
            if not len(seen):
                continue
            order, heads = _by_key(seen)
            seen = seen[order[heads]]
            names, at = np.unique(_bucket(seen["h1"], buckets), return_index=True)
            packed = [seen[lo:hi].tobytes() for lo, hi in zip(at, np.append(at[1:], len(seen)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int32)), pa.array(np.full(len(at), chunk)), pa.array(at.astype(np.int32)), pa.array(packed, pa.binary())],
                names=["_bucket", "_chunk", "_at", "_seen"],
            )


def _answer(group: pa.Table) -> pa.Table:
    """For the chunks of a bucket, the windows that occur earlier in another chunk: ``_chunk, _first``."""
    parts = [np.frombuffer(x.as_buffer(), dtype=_SEEN) for x in group.column("_seen")]
    ends = np.cumsum([len(x) for x in parts])
    seen = np.concatenate(parts)
    order, heads = _by_key(seen)
    many = np.diff(np.append(heads, len(seen))) > 1
    some = order[np.repeat(many, np.diff(np.append(heads, len(seen))))]
    sub = seen[some]
    by = np.lexsort((sub["pos"], sub["id"], sub["h2"], sub["h1"]))
    some, sub = some[by], sub[by]
    head = np.concatenate(([True], (sub["h1"][1:] != sub["h1"][:-1]) | (sub["h2"][1:] != sub["h2"][:-1])))[: len(sub)]
    least = sub[np.flatnonzero(head)][np.cumsum(head) - 1]
    later = np.flatnonzero((least["id"] != sub["id"]) | (least["pos"] != sub["pos"]))
    later = later[np.argsort(some[later])]
    entry, least = some[later], least[later]
    part = np.searchsorted(ends, entry, side="right")
    first = np.empty(len(entry), dtype=_FIRST)
    first["at"] = entry - (ends - [len(x) for x in parts])[part] + group.column("_at").to_numpy()[part]
    first["pos"], first["id"] = least["pos"], least["id"]
    names, lo = np.unique(part, return_index=True)
    packed = [first[i:j].tobytes() for i, j in zip(lo, np.append(lo[1:], len(first))[: len(lo)], strict=True)]
    return pa.table({"_chunk": pa.array(group.column("_chunk").to_numpy()[names]), "_first": pa.array(packed, pa.binary())})


def first_occurrences(chunks: DataFrame, buckets: int, text_col: str) -> DataFrame:
    """``_chunk, _block, _first``: for each chunk, the windows whose first occurrence is in another chunk, with its document and position (packed as ``_FIRST``)."""
    answers = []
    with short_lived_shuffles(chunks.sparkSession), large_rows(chunks.sparkSession):
        for k in range(SLICES):
            sent = chunks.select("_chunk", "_docs").mapInArrow(partial(_send, k, buckets, text_col), "_bucket int, _chunk long, _at int, _seen binary")
            answer = sent.groupBy("_bucket").applyInArrow(_answer, "_chunk long, _first binary")
            answers.append(materialize(answer.withColumn("_block", F.lit(k))))
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    return found


_FACTOR_ARROW = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())])


def _parse(own: list[str], buckets: int, text_col: str, chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """Greedy factors of a chunk's rows from their matches, and the kept words."""
    docs = chunk.column("_docs").combine_chunks()
    rows = pa.RecordBatch.from_struct_array((docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs).flatten())
    flat, ends = _split(rows.column(text_col))
    seen, start = _windows(rows.column("_id"), flat, ends)
    order, heads = _by_key(seen)
    first = seen[order[heads]]
    begins = np.searchsorted(_bucket(first["h1"], buckets), np.arange(SLICES, dtype=np.uint64) * np.uint64(buckets))
    for block, packed in zip(answers.column("_block").to_pylist(), answers.column("_first"), strict=True):
        other = np.frombuffer(packed.as_buffer(), dtype=_FIRST)
        at = other["at"] + begins[block]
        first["id"][at], first["pos"][at] = other["id"], other["pos"]
    first = np.repeat(first, np.diff(np.append(heads, len(seen))))
    hit = first["id"] < seen["id"][order]
    p, first = start[order[hit]], first[hit]
    by = np.argsort(p)
    p, ref, rp = p[by], first["id"][by], first["pos"][by]
    # a factor goes on while the next window is the next one of the same reference
    go_on = np.zeros(len(p), dtype=bool)
    go_on[1:] = (np.diff(p) == 1) & (ref[1:] == ref[:-1]) & (np.diff(rp) == 1)
    head = np.flatnonzero(~go_on)
    last = np.append(head[1:], len(p))[: len(head)] - 1
    cover = np.bincount(p[head], minlength=len(flat) + 1) - np.bincount(p[last] + WINDOW, minlength=len(flat) + 1)
    gone = np.cumsum(cover)[:-1] > 0
    left = np.concatenate(([0], np.cumsum(~gone)))[ends]
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(~gone))), " ")
    doc = np.searchsorted(ends, p[head], side="right") - 1
    values = (p[head] - ends[doc], p[last] - p[head] + WINDOW, ref[head], rp[head])
    factors = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, _FACTOR_ARROW, strict=True)], fields=list(_FACTOR_ARROW))
    factors = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(rows) + 1)), pa.int32()), factors)
    n_words = np.diff(ends)
    made = [kept, pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(left), pa.int64()), factors]
    return pa.Table.from_arrays([*(rows.column(c) for c in own), *made], names=[*own, "kept", "n_words", "n_removed", "factors"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (its kept words joined by one space), ``n_words``, ``n_removed`` and ``factors``.

    A word is removed if a window of ``WINDOW`` words covering it also starts in a document
    with a smaller id (windows judged on the input). ``factors`` are the parse's duplicate
    spans: ``start`` and ``length`` in words, and where the copy starts in the earliest
    reference document. Null text has no words; a row with a null id keeps all its words
    and is no reference; rows with equal ids are no reference for each other. One row out
    per row in, other columns unchanged (names starting with ``_`` are the operator's and
    are dropped, as are earlier ``kept``, ``n_words``, ``n_removed``, ``factors``); an empty
    table gives an empty table.
    """
    mine = {"kept", "n_words", "n_removed", "factors"}
    own = [c for c in docs.columns if not c.startswith("_") and c not in mine]
    if id_col not in own or text_col not in own:
        raise ValueError(f"{id_col} and {text_col} must be columns of their own")
    # no file holds a column without a type; texts of another type are read as strings
    stored = [c for c in own if docs.schema[c].dataType != NullType()]
    read = text_col if docs.schema[text_col].dataType == StringType() else "_text"
    base = docs.select(*stored, F.col(id_col).cast("long").alias("_id"), *([F.col(text_col).cast("string").alias(read)] if read == "_text" else []))
    schema = StructType().add("_chunk", "long").add("_bytes", "long").add("_docs", ArrayType(base.schema))
    chunks = materialize(base.mapInArrow(partial(_chunks, read), schema))
    size = chunks.agg(F.sum("_bytes")).first()[0] or 0
    buckets = max(-(-size // (SLICES * BUCKET_BYTES)), min(LEAST_BUCKETS, 1 + (size >> 20)))
    found = first_occurrences(chunks, buckets, read)
    kinds = chunks.schema["_docs"].dataType.elementType
    out = StructType([kinds[c] for c in stored]).add("kept", "string").add("n_words", "long").add("n_removed", "long").add("factors", _FACTOR)

    def parse(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        return _parse(stored, buckets, read, chunk, answers)

    parsed = chunks.select("_chunk", "_docs").groupBy("_chunk").cogroup(found.groupBy("_chunk")).applyInArrow(parse, out)
    return parsed.select(*(F.col(c) if c in stored else F.lit(None).alias(c) for c in own), "kept", "n_words", "n_removed", "factors")


def re_words(text: str | None) -> list[str]:
    """Words of a text in Python, as the rule takes them."""
    import re

    return re.findall(WORD, text or "")


def brute_force(rows: list[tuple[int | None, str | None]]) -> dict:
    """The rule itself, for tests: ``{(id, text): (n_words, n_removed, kept)}``."""
    import re

    split = re.compile(WORD)
    first: dict[tuple, int] = {}
    for i, t in rows:
        if i is None:
            continue
        ws = split.findall(t or "")
        for s in range(len(ws) - WINDOW + 1):
            key = tuple(ws[s : s + WINDOW])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        ws = split.findall(t or "")
        gone = [False] * len(ws)
        if i is not None:
            for s in range(len(ws) - WINDOW + 1):
                if first[tuple(ws[s : s + WINDOW])] < i:
                    gone[s : s + WINDOW] = [True] * WINDOW
        out[i, t] = (len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
