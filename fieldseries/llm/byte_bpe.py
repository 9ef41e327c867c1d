"""Byte-level BPE: texts to token ids and back, by ranked merges over the bytes of distinct words.

Two forms of the same fold. ``encode_words`` is DataFrame functions only: higher-order
functions fold the merges of each distinct word over an array of byte pieces, with the
ranks as a literal. ``tokens`` runs the fold in Arrow batches, once for each distinct
word that a task meets; it is the form for whole corpora (see the README for why).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import slices

#: Distinct words that a task keeps; beyond this it forgets them all and encodes them anew.
WORDS_KEPT = 300_000
#: Vocabularies are small tables; a larger one is refused rather than broadcast.
MAX_VOCABULARY = 2_000_000
_UNRANKED = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank from a vocabulary file on the driver, base64 pieces and ranks; the rank is the token id."""
    with open(path, "rb") as file:
        lines = file.read(100 * MAX_VOCABULARY).splitlines()
    if len(lines) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary of more than {MAX_VOCABULARY} pieces")
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: join the adjacent pair of lowest rank, leftmost first, until none is ranked."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 500:
        return _merge_long(word, ranks)
    get = ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], _UNRANKED) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != _UNRANKED:
        i = pairs.index(low)
        piece = pieces[i] + pieces.pop(i + 1)
        pieces[i] = piece
        del pairs[i]
        if i:
            pairs[i - 1] = get(pieces[i - 1] + piece, _UNRANKED)
        if i < len(pairs):
            pairs[i] = get(piece + pieces[i + 1], _UNRANKED)
    return [ranks[p] for p in pieces]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and linked pieces: n log n for very long words."""
    import heapq

    end = list(range(1, len(word) + 1))  # end[i]: where the piece that starts at i ends; 0 if none starts there
    before = list(range(-1, len(word) - 1))
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= len(word) or not end[mid] or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < len(word):
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Words(dict):
    """Word -> its ids as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = np.array(merge_word(word.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


#: The words of this worker process, for the vocabulary that it last used.
_WORKER: dict[int, _Words] = {}


def _words(key: int, ranks: dict[bytes, int]) -> _Words:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = _Words(ranks)
    return _WORKER[key]


def tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of each row's whole text: ``id_col``, ``n_tokens``, ``ids``, ``ids_sha256``, ``decoded_sha256``.

    Each match of ``pattern`` is encoded separately, without special tokens, as the fold
    of ranked merges over its bytes. ``ids_sha256`` is of the ids as little-endian 32-bit
    integers, ``decoded_sha256`` of the bytes that the ids decode to. A null or empty
    text has no tokens. Repeated rows give repeated rows, an empty table an empty one;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hash(tuple(ranks.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        words, split = _words(key, known), regex.compile(pattern).findall
        piece = dict(zip(known.values(), known.keys(), strict=True))
        for batch in slices(batches):
            arrays, first, second = [], [], []
            for text in batch.column("text").to_pylist():
                raw = b"".join(map(words.__getitem__, split(text))) if text else b""
                arrays.append(np.frombuffer(raw, "<u4"))
                first.append(hashlib.sha256(raw).hexdigest())
                second.append(hashlib.sha256(b"".join(map(piece.__getitem__, arrays[-1].tolist()))).hexdigest())
            counts = np.array([len(a) for a in arrays], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.concatenate(arrays).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), ids, pa.array(first), pa.array(second)], names=[id_col, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the pieces of the ids, concatenated. Null ids give no bytes; an unknown id is an error."""
    pieces = tokens.sparkSession.sparkContext.broadcast({i: p for p, i in ranks.items()})

    @F.pandas_udf(T.BinaryType())
    def join(ids):
        table = pieces.value
        return ids.map(lambda row: b"" if row is None else b"".join(table[int(i)] for i in row))

    return tokens.withColumn("decoded", join(F.col(ids_col)))


#: Buckets of the literal rank map: a look-up scans one bucket, a dozen pieces on average.
_BUCKETS = 4096


def _rank_literal(ranks: dict[bytes, int], spark: SparkSession) -> DataFrame:
    """One row with the ranks as an array of small maps, by ``crc32`` of the piece."""
    import zlib

    table: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        table[zlib.crc32(piece.hex().encode()) % _BUCKETS][piece.hex()] = rank
    return spark.createDataFrame([(table,)], "_table array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """Add ``ids`` to a table of distinct words, with higher-order functions only.

    The word's bytes are an array of hexadecimal pieces. Each step of the fold ranks all
    adjacent pairs through the rank map, and joins the leftmost pair of lowest rank.
    A null word has null ids; an empty one has none.
    """
    table = F.col("_table")

    def rank(piece: Column) -> Column:
        bucket = F.get(table, (F.crc32(piece.cast("binary")) % _BUCKETS).cast("int"))
        return F.try_element_at(bucket, piece)

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(pieces) - 2),
            lambda i: F.struct(rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1))).alias("r"), i.alias("i")),
        )
        best = F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))
        joined = F.concat(
            F.slice(pieces, F.lit(1), best["i"]),
            F.array(F.concat(F.get(pieces, best["i"]), F.get(pieces, best["i"] + 1))),
            F.slice(pieces, best["i"] + 3, F.size(pieces)),
        )
        return F.when((F.size(pieces) < 2) | best.isNull(), pieces).otherwise(joined)

    hexed = F.lower(F.hex(F.encode(F.col(word_col), "utf-8")))
    start = F.filter(F.split(hexed, "(?<=\\G..)"), lambda p: p != "")
    steps = F.sequence(F.lit(1), F.greatest(F.size(start), F.lit(1)))
    pieces = F.aggregate(steps, start, step)
    whole = rank(hexed)
    ids = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(pieces, rank))
    return words.crossJoin(F.broadcast(_rank_literal(ranks, words.sparkSession))).withColumn("ids", ids).drop("_table")
