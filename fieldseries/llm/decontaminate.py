"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are weighted by TF-IDF over the benchmark's terms, a
distributed randomised SVD gives a latent space, windows near an item there are
candidates, and so are documents that share enough of an item's words, which no leak
can lack. Word-level longest common subsequences and answer checks decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseries.operators.materialize import materialize

from .textvec import slices, word_hashes

#: A benchmark is a small table that every task holds; a larger one is refused.
MAX_BENCHMARK_CHARS = 200_000_000
#: Words of a window, and the step between windows.
WINDOW, STEP = 32, 16
#: Words of a document in one row of the token table; the next row repeats the overlap.
SEGMENT = 8192
_TOKENS_AT_ONCE = 30_000
_PAIRS_HELD = 4_000_000
_PAIRS_IN_TASK = 500_000
_CHUNK = 256


@dataclass
class Benchmark:
    """Items as sequences of term numbers, and the sorted hashes of all terms."""

    ids: list
    items: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray


def read_benchmark(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str = "answer", min_words: int = 5, answer_words: int = 5) -> Benchmark:
    """Items of at least ``min_words`` words; without an answer column the last ``answer_words`` words are the answer.

    Items with a null id or text are left out.
    """
    has = answer_col in benchmark.columns
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    chars = rows.agg(F.sum(F.length(text_col))).first()[0] or 0
    if chars > MAX_BENCHMARK_CHARS:
        raise ValueError(f"benchmark of more than {MAX_BENCHMARK_CHARS} characters")
    found = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), (F.col(answer_col) if has else F.lit(None)).cast("string").alias("a")).collect()
    words, bounds = word_hashes(pa.array([r.t for r in found], pa.large_string()))
    own, own_bounds = word_hashes(pa.array([r.a for r in found], pa.large_string()))
    vocabulary = np.unique(np.concatenate([words, own]))
    keep = [k for k in range(len(found)) if bounds[k + 1] - bounds[k] >= min_words]
    items = [np.searchsorted(vocabulary, words[bounds[k] : bounds[k + 1]]) for k in keep]
    answers = [np.searchsorted(vocabulary, own[own_bounds[k] : own_bounds[k + 1]]) for k in keep]
    answers = [a if len(a) else item[-answer_words:] for a, item in zip(answers, items, strict=True)]
    return Benchmark([found[k].i for k in keep], items, answers, vocabulary)


def token_table(docs: DataFrame, bench: Benchmark, id_col: str, text_col: str) -> DataFrame:
    """Where the benchmark's terms stand in each document: ``id``, ``words`` and ``own`` of the segment, ``pos``, ``term``.

    Words of other kinds change neither a subsequence nor a weight, so they are not kept.
    A segment owns its first ``own`` words; the rest is the overlap with the next one.
    """
    vocabulary = bench.vocabulary
    overlap = WINDOW + 2 * max((len(x) for x in bench.items), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(1 << 20, bool)
        near[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch in slices(batches):
            hashes, bounds = word_hashes(batch.column("text"))
            at = np.flatnonzero(near[(hashes >> np.uint64(44)).astype(np.int64)])
            term = np.searchsorted(vocabulary, hashes[at])
            same = vocabulary[np.minimum(term, len(vocabulary) - 1)] == hashes[at]
            at, term = at[same], term[same]
            row, lo, hi, own = [], [], [], []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                for start in range(a, b, SEGMENT):
                    row.append(k)
                    lo.append(start)
                    hi.append(min(b, start + SEGMENT + overlap))
                    own.append(min(b, start + SEGMENT) - start)
            first, last = np.searchsorted(at, lo), np.searchsorted(at, hi)
            sizes = last - first
            take = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)
            start = np.array(lo, np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            pos = (at[take] - np.repeat(start, sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(np.array(hi, np.int32) - start.astype(np.int32)), pa.array(np.array(own, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(pos)), pa.ListArray.from_arrays(offsets, pa.array(term[take].astype(np.int32)))],
                names=["id", "words", "own", "pos", "term"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, words int, own int, pos array<int>, term array<int>")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of segments with their tokens: each token's segment, position and term."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("pos").value_lengths().to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + _TOKENS_AT_ONCE, side="right")))
            part = batch.slice(start, stop - start)
            pos, term = part.column("pos").flatten().to_numpy().astype(np.int64), part.column("term").flatten().to_numpy()
            yield part, np.repeat(np.arange(stop - start), sizes[start:stop]), pos, term
            start = stop


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _sums(table: np.ndarray, term: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the terms' rows over the runs that begin at ``starts``: the first terms of all runs, then the second ones."""
    out = np.empty((len(starts), table.shape[1]), table.dtype)
    length = np.diff(np.append(starts, len(term)))
    for k in range(0, len(starts), 1000):
        s, n, part = starts[k : k + 1000], length[k : k + 1000], out[k : k + 1000]
        np.take(table, term[s], axis=0, out=part)
        more, i = np.flatnonzero(n > 1), 1
        while len(more):
            part[more] += table[term[s[more] + i]]
            i += 1
            more = more[n[more] > i]
    return out


def document_frequencies(tokens: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages, over the whole table; partial counts are made in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(terms + 1, np.int64), 0
        for part, segment, pos, term in _parts(batches):
            own = part.column("own").to_numpy()
            n += int((-(-own // WINDOW)).sum())
            mine = pos < own[segment]
            key = np.unique((segment[mine] * (SEGMENT // WINDOW + 1) + pos[mine] // WINDOW) * terms + term[mine])
            df += np.bincount(key % terms, minlength=terms + 1)
        df[terms] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    found = tokens.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(terms + 1, np.int64)
    for r in found:
        df[r.term] = r.n
    return df[:terms], int(df[terms])


def cooccurrences(tokens: DataFrame, use: np.ndarray) -> DataFrame:
    """``a``, ``b`` (a <= b) and ``n``: how often two terms of ``use`` stand in one passage, over all passages.

    With the terms' weights this is the upper half of X'X, the rows of X being the
    TF-IDF vectors of the passages. Tasks add up pairs before they are shuffled.
    """
    terms = len(use)

    def compact(held: list) -> list:
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return [(keys, np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for part, segment, pos, term in _parts(batches):
            mine = (pos < part.column("own").to_numpy()[segment]) & use[term]
            passage = segment[mine] * (SEGMENT // WINDOW + 1) + pos[mine] // WINDOW
            t = term[mine].astype(np.int64)
            at, keys = np.arange(len(t)), []
            for lag in range(WINDOW):
                at = at[at < len(t) - lag]
                at = at[passage[at] == passage[at + lag]]
                if not len(at):
                    break
                x, y = t[at], t[at + lag]
                keys.append(np.minimum(x, y) * terms + np.maximum(x, y))
                if lag:  # a pair of equal terms counts in both orders
                    keys.append(keys[-1][x == y])
            if keys:
                sorted_keys = np.sort(np.concatenate(keys))
                starts = _runs(sorted_keys)
                held.append((sorted_keys[starts], np.diff(np.append(starts, len(sorted_keys)))))
            if sum(len(k) for k, _ in held) > _PAIRS_HELD:
                held = compact(held)
                if len(held[0][0]) > _PAIRS_HELD // 2:
                    yield batch_of(held.pop())
        if held:
            yield batch_of(compact(held)[0])

    def batch_of(found: tuple) -> pa.RecordBatch:
        keys, n = found
        return pa.RecordBatch.from_arrays([pa.array((keys // terms).astype(np.int32)), pa.array((keys % terms).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    return tokens.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _times(pairs: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """X'X basis from the pair table.

    Each task adds up its rows; the sums, in chunks of terms, are added in two rounds.
    Only the terms x rank matrix comes to the driver.
    """
    terms, rank = basis.shape
    shared = pairs.sparkSession.sparkContext.broadcast((weights, basis.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = shared.value
        total = np.zeros((terms, rank), np.float64)
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                a, b, n = (batch.column(c).slice(k, 20_000).to_numpy() for c in ("a", "b", "n"))
                value = (n * weight[a] * weight[b]).astype(np.float32)
                for x, y, keep in ((a, b, slice(None)), (b, a, a != b)):
                    order = np.argsort(x[keep], kind="stable")
                    into, source, v = x[keep][order], y[keep][order], value[keep][order]
                    if len(into):
                        at = _runs(into)
                        total[into[at]] += np.add.reduceat(q[source] * v[:, None], at, axis=0)
        chunks = range(0, terms, _CHUNK)
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array([c // _CHUNK for c in chunks], pa.int32()), pa.array([salt] * len(chunks), pa.int32()), pa.array([total[c : c + _CHUNK].tobytes() for c in chunks], pa.binary())],
            names=["chunk", "salt", "sums"],
        )

    def add(pdf):
        total = sum(np.frombuffer(x, np.float64) for x in pdf["sums"])
        return pdf.head(1).assign(sums=[total.tobytes()])

    schema = "chunk int, salt int, sums binary"
    parts = pairs.mapInArrow(run, schema).groupBy("chunk", "salt").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
    out = np.zeros((terms, rank))
    for r in parts.collect():
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.sums, np.float64).reshape(-1, rank)
    return out


def latent_space(tokens: DataFrame, df: np.ndarray, n: int, rank: int = 128, oversample: int = 16, max_df: float = 0.05, seed: int = 7) -> np.ndarray:
    """Terms x rank: each term's place in the latent space, times its inverse document frequency.

    Randomised SVD of the TF-IDF vectors of all passages: a random range, one power step,
    then the small problem on that range. Dimensions are divided by their singular values,
    so that what most passages of a language share does not outweigh the rest. Terms of
    more than ``max_df`` of all passages are stop words and weigh nothing here;
    shared words and subsequences count them.
    """
    terms = len(df)
    weights = np.where((df > 0) & (df <= max(1.0, max_df * n)), np.log((1.0 + n) / (1.0 + df)), 0.0)
    pairs = materialize(cooccurrences(tokens, weights > 0))
    # each task that multiplies sends a whole matrix of sums, so as few as the pairs need
    pairs = pairs.coalesce(pairs.count() // _PAIRS_IN_TASK + 1)
    width = min(terms, rank + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    q = np.linalg.qr(_times(pairs, weights, q))[0]
    small = q.T @ _times(pairs, weights, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = [k for k in np.argsort(values)[::-1][:rank] if values[k] > 1e-9 * max(values.max(), 1e-9)]
    return weights[:, None] * (q @ vectors[:, top]) / np.sqrt(values[top])


def common_subsequence(item: np.ndarray, sequence: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of the item's positions at a time."""
    masks: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for t in sequence.tolist():
        m = masks.get(t)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


@dataclass
class SharedWords:
    """Items by term: a segment that leaks item j holds at least ``least[j]`` of the words of j listed here.

    ``items[bounds[t] : bounds[t + 1]]`` are the items with term t, and ``counts`` how often they have it.
    """

    bounds: np.ndarray
    items: np.ndarray
    counts: np.ndarray
    least: np.ndarray


def shared_words(bench: Benchmark, df: np.ndarray, share: float) -> SharedWords:
    """Lists of terms for the bound: whoever has ``share`` of an item's words lacks few of them.

    The item's most common terms are not listed, as long as they are less than half of the
    words needed; a segment may have all of them, so they are taken off the bound.
    """
    terms, owners, counts, least = [], [], [], []
    for j, item in enumerate(bench.items):
        own, n = np.unique(item, return_counts=True)
        order = np.argsort(-df[own], kind="stable")
        own, n = own[order], n[order]
        need = int(np.ceil(share * len(item) - 1e-9))
        skip = int(np.searchsorted(np.cumsum(n), need / 2, side="left"))
        terms.append(own[skip:])
        counts.append(n[skip:])
        owners.append(np.full(len(own) - skip, j))
        least.append(need - int(n[:skip].sum()))
    term, owner, count = (np.concatenate(x) for x in (terms, owners, counts))
    order = np.argsort(term, kind="stable")
    bounds = np.searchsorted(term[order], np.arange(len(bench.vocabulary) + 1))
    return SharedWords(bounds, owner[order], count[order], np.array(least))


def sharing(words: SharedWords, segment: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments and items that meet the bound of shared words."""
    n_terms, n_items = len(words.bounds) - 1, len(words.least)
    key, n = np.unique(segment * np.int64(n_terms) + term, return_counts=True)
    t = key % n_terms
    size = words.bounds[t + 1] - words.bounds[t]
    at = np.repeat(words.bounds[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
    pair = np.repeat(key // n_terms, size) * n_items + words.items[at]
    common = np.minimum(np.repeat(n, size), words.counts[at])
    pairs, where = np.unique(pair, return_inverse=True)
    pairs = pairs[np.bincount(where, weights=common, minlength=len(pairs)) >= words.least[pairs % n_items]]
    return pairs // n_items, pairs % n_items


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_cosine: float = 0.5,
    min_common: float = 0.8,
    min_paraphrase: float = 0.6,
    rank: int = 128,
    max_df: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document and item that it leaks: ``id_col``, ``item_id``, ``cosine``, ``common``, ``answer_found``, ``kind``.

    A document is a candidate for an item if the latent vector of one of its windows has
    a cosine of ``min_cosine`` or more with the item's, or if it shares so many of the
    item's words that it may leak it; the second route misses nothing that the decision
    accepts, however common or long the item is. ``common`` is the share of the item's
    words in the longest common subsequence with a window and as many words around it as
    the item has. From ``min_common`` on it is a copy; from ``min_paraphrase`` on, with
    all answer words in order, a paraphrase. ``cosine`` is the largest one of the
    document's windows; it is 0 for an item of stop words only. A null or empty text
    leaks nothing; an empty table or benchmark gives an empty result. Rows that repeat an
    id give one row an item; rows with a null id are reported under null. Other columns
    are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item_kind}, cosine double, common double, answer_found boolean, kind string"
    bench = read_benchmark(benchmark)
    if not bench.items:
        return spark.createDataFrame([], schema)
    tokens = materialize(token_table(docs, bench, id_col, text_col))
    df, n = document_frequencies(tokens, len(bench.vocabulary))
    space = latent_space(tokens, df, n, rank, max_df=max_df).astype(np.float32)
    vectors = np.stack([space[item].sum(axis=0) for item in bench.items])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast((space, vectors, bench, shared_words(bench, df, min_paraphrase)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, vectors, bench, words = shared.value
        heavy = np.abs(space).sum(axis=1) > 0
        in_item = np.zeros(len(bench.vocabulary), bool)
        for part, segment, pos, term in _parts(batches):
            ids, own = part.column("id"), part.column("own").to_numpy()
            bounds = np.searchsorted(segment, np.arange(part.num_rows + 1))
            use = heavy[term]
            block = segment[use] * np.int64(4 * SEGMENT) + pos[use] // STEP
            starts = _runs(block)
            sums = _sums(space, term[use], starts)
            at, seg, first = block[starts], segment[use][starts], pos[use][starts] // STEP * STEP
            windows = sums.copy()
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)
            windows[follows] += sums[follows + 1]
            windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-12)
            likeness = windows @ vectors.T
            w, item = np.nonzero(likeness >= min_cosine)
            mine = first[w] < own[seg[w]]
            near = seg[w[mine]], item[mine]
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(near, sharing(words, segment, term), strict=True)], axis=1), axis=0)
            rows = []
            for k, j in pairs.tolist():
                item, answer = bench.items[j], bench.answers[j]
                size = len(item)
                # words that neither the item nor its answer has change no subsequence
                in_item[item] = in_item[answer] = True
                a, b = bounds[k], bounds[k + 1]
                keep = in_item[term[a:b]]
                in_item[item] = in_item[answer] = False
                place, t = pos[a:b][keep], term[a:b][keep]
                # no window has a longer one than the whole segment
                if common_subsequence(item, t) < min_paraphrase * size:
                    continue
                window = np.arange(0, own[k], STEP)
                low, high = np.searchsorted(place, window - size), np.searchsorted(place, window + WINDOW + size)
                best, has = 0.0, False
                for x, y in np.unique(np.stack([low, high], axis=1)[high - low >= min_paraphrase * size], axis=0).tolist():
                    common = common_subsequence(item, t[x:y]) / size
                    if common < min_paraphrase:
                        continue
                    found = common_subsequence(answer, t[x:y]) == len(answer)
                    if common >= min_common or found:
                        best, has = max(best, common), has or found
                if best:
                    x, y = np.searchsorted(seg, [k, k + 1])
                    cosine = likeness[x:y, j][first[x:y] < own[k]]
                    rows.append((k, j, float(cosine.max(initial=0.0)), best, has))
            if rows:
                k, j, *values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(k, pa.int64())), pa.array([bench.ids[x] for x in j]), *[pa.array(v) for v in values], pa.array(["copy" if x >= min_common else "paraphrase" for x in values[1]])],
                    names=[id_col, "item_id", "cosine", "common", "answer_found", "kind"],
                )

    found = tokens.mapInArrow(run, schema)
    best = F.max(F.struct("common", "cosine", "answer_found", "kind")).alias("b")
    return found.groupBy(id_col, "item_id").agg(best).select(id_col, "item_id", "b.cosine", "b.common", "b.answer_found", "b.kind")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that leak no item; rows with a null id stay."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, **options).select(id_col).distinct()
    return docs.join(leaks, id_col, "left_anti").select(docs.columns)
