"""Each corpus operator against a brute-force version, and on awkward rows."""

import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from fieldseries.llm import byte_bpe, decontaminate, fingerprint, language, line_dedup, main_text, near_dedup, pii, substring_dedup, warc
from fieldseries.llm.graph import components
from fieldseries.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in WORDS.findall(text or "")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(sample):
    return {r.doc_id: r.text for r in sample.select("doc_id", "text").collect()}


AWKWARD = [(1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "x"), (5, "x"), (6, "é😀  ﬁ" * 3), (None, None), (None, "one two three four five six"), (7, "w " * 30_000)]


def test_awkward_rows_and_empty_tables(spark):
    """Nulls, empty and long texts, equal rows and clashing columns: one row out for each row in."""
    docs = table(spark, [*AWKWARD, AWKWARD[3]])
    n = docs.count()
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "item_id long, text string")
    profiles = language.fit_profiles(docs)
    assert profiles == {}
    clash = docs.withColumns({"score": F.lit("q"), "lang_pred": F.lit(1), "n_lines": F.lit("z"), "key": F.lit(1), "n": F.lit(2), "h": F.lit(3), "row": F.lit(4), "id": F.lit("i")})
    runs = {
        "language": lambda d: language.predict(d, profiles),
        "lines": line_dedup.drop_common_lines,
        "near": near_dedup.near_duplicates,
        "substring": substring_dedup.drop_repeats,
        "fingerprint": fingerprint.compare_edits,
        "pii": pii.find_private,
        "bpe": lambda d: byte_bpe.tokens(d, {bytes([k]): k for k in range(256)}, r"\s+|\S+"),
    }
    for name, run in runs.items():
        assert run(clash).count() == n, name
        assert run(docs.limit(0)).count() == 0, name
    assert decontaminate.find_leaks(clash, bench).count() == 0
    assert {r.lang_pred for r in runs["language"](docs).collect()} == {"und"}
    near = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_duplicates(docs).collect()}
    assert near[5, 1].component_id == 4 and not near[5, 1].kept and near[1, 0].component_id == 1 and near[None, 2].kept


def jaccard_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {i: (len(sets[i]), comp[i]) for i in ids}


def test_near_duplicates_of_a_large_group_of_near_copies(spark):
    """Buckets above the small size, similarities on both sides of the bound, and exact copies."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"u{rng.randint(0, 10_000)}" for _ in range(60))) for i in range(20)]
    rows += [(300 + i, rows[3][1].upper()) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == jaccard_components(rows)


def test_components_of_a_long_path(spark):
    n = 200
    order = random.Random(2).sample(range(n), n)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(900, 901), (5, 5)], "u long, v long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(n)}, 900: 900, 901: 900}


def brute_removal(rows, size=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            first = seen.setdefault(b[s : s + size], i)
            if first < i:
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(40, 120))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(pieces)[rng.randint(0, 30) :] if rng.random() < 0.7 else "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(500, "a" * 300), (501, "a" * 120), (502, None), (503, "a" * 49), (504, "a" * 300)]
    found = substring_dedup.drop_repeats(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_removal(rows)


def _text_with_copies(rng, n):
    pieces = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(40, 120))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 4)))) for i in range(n)]
    return rows + [(n + i, t) for i, t in rows[::3]]


def test_substring_dedup_of_many_copies_never_sorts_the_text(spark, monkeypatch):
    """Ids of copies and lists too large to broadcast: results stay, and the text streams past tables of ids and lists."""
    rows, plans = _text_with_copies(random.Random(7), 60), []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    materialize = substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda df: plans.append(plan(df)) or materialize(df))
    monkeypatch.setattr(substring_dedup, "BROADCAST_COPIES", 0, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substring_dedup.drop_repeats(table(spark, rows))
        plans.append(plan(out))
        found = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_removal(rows)
    reading = [p for p in plans if "MapInArrow" in p]
    assert len(reading) >= 3 and not [p for p in reading if "SortMergeJoin" in p]


def test_anchors_are_dealt_out_in_passes():
    """Each pass has its share of the anchors, all anchors of a hash are in one, and together they are all."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(np.zeros(40, np.int32)), pa.array(texts)], names=["doc", "row", "text"])
    names = ["h", "c", "sides", "doc", "row", "pos"]
    read = lambda **of: [tuple(r[c] for c in names) for b in substring_dedup._anchor_rows(iter([batch]), **of) for r in b.to_pylist()]
    every, parts = sorted(read()), [read(turn=k, turns=substring_dedup.TURNS) for k in range(substring_dedup.TURNS)]
    assert substring_dedup.TURNS >= 2 and sorted(sum(parts, [])) == every
    assert max(map(len, parts)) < 0.6 * len(every)
    assert sum(len({r[0] for r in x}) for x in parts) == len({r[0] for r in every})


def test_surroundings_of_one_anchor_are_told_apart():
    """300,000 different surroundings of one anchor make as many classes: 32 bits of hash are too few."""
    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    some = letters[rng.integers(0, 26, 1_000_000)]
    sums = substring_dedup.span_sums(some.astype(np.uint64) + np.uint64(1))
    place = np.arange(len(some) - 16)
    least = int(np.argmin(substring_dedup.span_hash(sums, place, place + 16)))
    raw = letters[rng.integers(0, 26, (300_000, 84))]
    raw[:, 34:50] = some[least : least + 16]
    texts = [x.tobytes().decode() for x in raw]
    assert len(set(texts)) == 300_000
    ids = pa.array(np.arange(300_000))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(np.zeros(300_000, np.int32)), pa.array(texts)], names=["doc", "row", "text"])
    found = pa.Table.from_batches(substring_dedup._anchor_rows(iter([batch])))
    over = found.filter(pc.equal(found["pos"], 34))
    assert over.num_rows > 299_000 and len(pc.unique(over["c"])) == over.num_rows


def test_fingerprints_of_edits(spark, sample, texts):
    ids = sorted(texts)
    found = {r.doc_id: r for r in fingerprint.compare_edits(sample).collect()}
    assert sorted(found) == ids
    for k, i in enumerate(ids):
        text, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == fingerprint.Prefixes([text]).fingerprints()[0] + fingerprint.Prefixes([edited]).fingerprints()[0]
        assert r.common_prefix == next((j for j in range(len(text)) if j >= len(edited) or text[j] != edited[j]), len(text))
        assert 0 <= r.near_next <= 1 and fingerprint.likeness(fingerprint.sketch_of(r.fingerprint), fingerprint.sketch_of(r.edited_fingerprint)) == r.near_edited
    assert len({r.fingerprint for r in found.values()}) == len(set(texts.values()))


def test_language_held_out_accuracy(sample):
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    profiles = language.fit_profiles(sample.where(part != 0))
    found = language.predict(sample.where(part == 0), profiles).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95 and all(0 <= r.score <= 1 for r in found)


def test_byte_bpe_equals_the_library(spark, sample, texts):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(10**6 + k, t) for k, t in enumerate(["x" * 3000, "ab" * 700, "\r\n\t end  ", "日本語😀", "’s 's"])]
    docs = sample.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    for r in byte_bpe.tokens(docs, ranks, tokenizers.PATTERN).collect():
        text = texts.get(r.doc_id) or dict(extra).get(r.doc_id, "")
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.tokens(docs.limit(3), ranks, tokenizers.PATTERN), ranks).collect()
    assert all(hashlib.sha256(r.decoded).hexdigest() == r.decoded_sha256 for r in back)


def test_words_by_higher_order_functions(spark):
    """The fold in DataFrame functions gives the same ids as the fold in batches."""
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    some = [" the", "onenerth", " Ofanthedin", "é", " 日本", "", "zzzz", None]
    got = byte_bpe.encode_words(spark.createDataFrame([(w,) for w in some], "word string"), ranks).collect()
    assert {r.word: r.ids for r in got} == {w: None if w is None else byte_bpe.merge_word(w.encode(), ranks) if w else [] for w in some}


def test_leaks_copies_paraphrases_and_clean_documents(spark):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(20)]
    def doc(middle):
        return " ".join([rng.choice(vocabulary) for _ in range(150)] + middle + [rng.choice(vocabulary) for _ in range(150)])
    def reworded(item, share):
        return [w if rng.random() > share or k >= 25 else "new" + w for k, w in enumerate(item)]
    rows = [(k, doc(items[k])) for k in range(20)] + [(100 + k, doc(reworded(items[k], 0.3))) for k in range(20)] + [(200 + k, doc([])) for k in range(60)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(table(spark, rows), bench, max_df=1.0).collect()}
    assert {(k, k) for k in range(20)} <= set(found) and all(found[k, k].kind == "copy" for k in range(20))
    assert not [d for d, _ in found if d >= 200]
    assert sum((100 + k, k) in found for k in range(20)) >= 12


def test_leaks_of_an_item_in_a_third_of_the_documents(spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(35)] for _ in range(10)]
    rows = [(k, " ".join([rng.choice(vocabulary) for _ in range(12)] + (items[0] if k % 3 == 0 else []) + [rng.choice(vocabulary) for _ in range(13)])) for k in range(300)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.find_leaks(table(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in found) == [(k, 0, "copy") for k in range(0, 300, 3)]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def brute_leaks(rows, items):
    out = {}
    for d, text in rows:
        doc = text.split()
        for j, item in enumerate(items):
            for w in range(0, len(doc), 16):
                region = doc[max(0, w - len(item)) : w + 32 + len(item)]
                if sum(x in item for x in region) < 0.6 * len(item):
                    continue
                common = subsequence(item, region) / len(item)
                if common >= 0.8 or common >= 0.6 and subsequence(item[-5:], region) == 5:
                    out[d, j] = max(out.get((d, j), 0), common)
    return out


def test_leaks_equal_those_of_all_windows(spark):
    """Short, long and thinned items in texts of uneven words: nothing that the decision accepts is missed."""
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(3000)]
    def text(n):
        return rng.choices(vocabulary, [1 / (k + 3) for k in range(3000)], k=n)
    items = [text(rng.randint(15, 59)) for _ in range(12)] + [text(300) for _ in range(4)]
    rows = []
    for item in items:
        for share in (1.0, 0.75, 0.65):
            middle = [w if k >= len(item) - 5 or rng.random() < share else "new" + w for k, w in enumerate(item)]
            rows.append((len(rows), " ".join(text(rng.randint(20, 80)) + middle + text(rng.randint(20, 80)))))
    rows += [(1000 + k, " ".join(text(200))) for k in range(30)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.common for r in decontaminate.find_leaks(table(spark, rows), bench).collect()}
    expected = brute_leaks(rows, items)
    assert {(3 * k, k) for k in range(len(items))} <= set(expected)
    assert found == pytest.approx(expected)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a), np.array(b)) == best[-1][-1]


def test_minimum_cut_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        def cost(labels):
            return sum(abs(x) for x, one in zip(costs, labels) if (x > 0) != one) + sum(w for a, b, w in edges if labels[a] != labels[b])
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(main_text.minimum_cut(costs, edges)) == pytest.approx(best, abs=1e-6)


def test_main_text_of_pages(spark, sf_small):
    def expected(page):
        article = re.search(r"<article>(.*?)</article>", page, re.S)
        parts = re.split(r"</?(?:h1|p)>", article[1]) if article else []
        return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", q)).split()) for q in parts) if x)

    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in main_text.extract(pages).collect():
        assert r.text == expected(source[r.page_id]) and r.n_chars == len(r.text)
    page = "<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies.</div><article><header><h1>A &amp; b</h1></header><p>First&nbsp;text of it, long enough.<aside>Related</aside><p>Second<br>line.<form>Mail</form></article><section id=comments><p>I liked this article a lot, really.</p></section><footer>(c)</footer>"
    assert main_text.main_text(page) == "A & b\nFirst text of it, long enough.\nSecond line."
    odd = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p", "t"), (4, "<" * 50_000, "t")], "page_id long, html string, text string")
    assert main_text.extract(odd).columns == ["page_id", "text", "n_chars"] and main_text.extract(odd).count() == 4


def test_main_text_after_unseen_elements_without_end_tags():
    article = "<article><p>First text of it, long enough.</p><p>Second text of it, long enough.</p></article>"
    expected = "First text of it, long enough.\nSecond text of it, long enough."
    for page in (
        f"<html><head><title>x</title><body>{article}</body></html>",
        f"<html><head><title>x<body>{article}</body></html>",
        f"<body><svg viewBox='0 0 1 1'/>{article}</body>",
        f"<body><math/>{article}</body>",
        f"<body><div><button>Menu</div>{article}</body>",
        f"<body><div><button>Menu</div>{article}<div><button>More</button></div></body>",
        f"<body><div><video src=a></div>{article}</body>",
        f"<body><svg><g><path d='M0 0'/><text>No</text></g></svg><video><p>Your browser plays no video, sadly for all.</p></video>{article}</body>",
    ):
        assert main_text.main_text(page) == expected, page


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def rule_spans(text):
    out = []
    for kind, pattern in RULES.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if good:
                out.append((pii.KINDS.index(kind), m.start(), m.end()))
    return out


def test_private_spans_equal_the_plain_rules(spark, sample, texts):
    tricky = ["a@b.c_d@e.f x@y..z @@ a@b.c.d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1.2 0001.02.3.255", "+1 (234) 555-0000 +12 +1234567( +1-2-3-4-5-6-7-8.", "4111 1111 1111 1111-4111-1111-1111-1111 4111111111111111", "é@é.com 日本a@b.co", "a" * 5000 + "@", "x@" + "a.b" * 3000, "1 " * 4000]
    every = {**texts, **{10**6 + k: t for k, t in enumerate(tricky)}}
    docs = sample.select("doc_id", "text").union(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string"))
    for r in pii.find_private(docs).collect():
        assert [(b.kind, b.s, b.e) for b in r.base] == rule_spans(every[r.doc_id]), r.doc_id
        assert all(not (x.s < b.e and b.s < x.e) for x in r.extra for b in r.base)


def test_private_query_counts_each_kind(spark, tmp_path):
    rows = [(1, "a@b.co c@d.org +1 (234) 555-0000"), (2, "1.2.3.4 5.6.7.8 4539578763621486"), (3, "x@y.z 1.2.3.4, 4539578763621486 +49 30 1234567 e@f.gh"), (4, None), (None, "a@b.co"), (4, "9.9.9.9")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in QUERIES["op8_private"](spark, str(tmp_path)).collect())

    def expected(i, text):
        spans = rule_spans(text or "")
        written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        return (i or 0, *(sum(x[0] == k for x in spans) for k in range(4)), hashlib.sha256(written.encode()).hexdigest())

    assert found == sorted(expected(*r) for r in rows)
    assert (1, 2, 0, 0, 1) in {r[:5] for r in found} and (3, 2, 1, 1, 1) in {r[:5] for r in found}


def test_trees_learn_from_every_labelled_row(spark):
    """Rows of one label that all have larger hashes than 20,000 others still count."""
    labelled = spark.range(20_200).select("id", F.lit(0).alias("s"), F.lit(0).alias("kind"), F.lit(5).alias("e"), F.lit("m").alias("m"))
    ranked = labelled.withColumn("h", F.xxhash64("id", "s", "kind"))
    cut = sorted((r.h for r in ranked.collect()), reverse=True)[150]
    bad = F.col("h") > cut
    features = {f: F.lit(1.0) for f in pii.FEATURES} | {"size": F.when(bad, 2.0).otherwise(9.0), "digits": (F.col("id") % 3).cast("double")}
    learned = pii.fit(ranked.select("*", F.when(bad, 0.0).otherwise(1.0).alias("label")).withColumns(features).drop("h"))
    assert learned is not None
    assembler, model, threshold = learned
    some = spark.createDataFrame([(9.0, 1.0), (2.0, 1.0)], "size double, digits double").withColumns({f: F.lit(1.0) for f in pii.FEATURES if f not in ("size", "digits")})
    assert [r.prediction for r in model.transform(assembler.transform(some)).orderBy("size").collect()] == [0.0, 1.0] and 0.5 <= threshold <= 1


def test_boosted_candidates_add_spelled_out_addresses(spark):
    rows = [(i, f"words tel +1 ({200 + i}) 555-{i * 7 % 10000:04d} and mail u{i}.x@host{i}.org at ip 10.{i % 256}.3.{i % 200} card 4539578763621486") for i in range(200)]
    rows += [(1000, "write to u1 (at) host (dot) com now"), (2000, "only prose in 1999 and 3.14")]
    found = {r.doc_id: r for r in pii.find_private(table(spark, rows)).collect()}
    assert [(x.kind, x.s, x.e) for x in found[1000].extra] == [(0, 9, 31)] and not found[2000].extra and not found[2000].base
    text = table(spark, rows).where("doc_id = 1000").withColumn("x", F.array(F.struct(F.lit(0).alias("kind"), F.lit(9).alias("s"), F.lit(31).alias("e"))))
    assert text.select(pii.redact(F.col("text"), F.col("x")).alias("t")).first().t == "write to [email] now"


def test_lines_common_to_many_documents(spark):
    line = "This Line is longer than forty characters, surely."
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\nend\n{line}") for i in range(6)] + [(9, None), (10, "short\nshort")]
    found = {r.doc_id: r for r in line_dedup.drop_common_lines(table(spark, rows)).collect()}
    assert all(found[i].text == f"own {i}\nend" and found[i].n_dropped == 2 and found[i].n_lines == 4 for i in range(5))
    assert found[5].text == rows[5][1] and found[9].text == "" and found[9].n_lines == 1


def test_second_hashes_do_not_follow_from_the_first(spark):
    """Spark seeds each column's hash with the one before: a constant has to come first."""
    for fn in (line_dedup.drop_common_lines, substring_dedup.drop_repeats):
        plan = fn(table(spark, [(1, "x" * 60)]))._jdf.queryExecution().analyzed().toString()
        assert "xxhash64(1, " in plan and not re.search(r"xxhash64\([^()]*(\([^()]*\))?[^()]*, 1, 42", plan)


def test_archives_round_trip_and_pushed_predicates(spark, tmp_path):
    big = "<p>" + "ä\r\n\r\nWARC/1.1\r\n" * 5000
    rows = [(1, "http://a/x y", big), (2, "http://b/", None), (3, None, big), (4, "http://c/\n", ""), (5, "http://d/", "short"), (6, "http://e/", "short"), (None, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_pages(pages, f"{tmp_path}/w")
    every = warc.read_archives(spark, f"{tmp_path}/w")
    found = {r.record_id: r for r in every.collect()}
    assert len(found) == 7 and every.count() == 7
    assert found["<urn:page:3>"].record_type == "revisit" and found["<urn:page:3>"].refers_to == "<urn:page:1>" and not found["<urn:page:3>"].payload
    assert bytes(found["<urn:page:1>"].payload).decode() == big and found["<urn:page:>"].record_type == "response"
    assert found["<urn:page:6>"].record_type == "response" and found["<urn:page:1>"].target_uri == "http://a/x%20y"
    some = every.where("record_type = 'revisit'")
    assert some.count() == 1 and [r.record_id for r in some.collect()] == ["<urn:page:3>"]
    heads = warc.read_archives(spark, f"{tmp_path}/w", payload=False).where("target_uri like 'http://a%'").collect()
    assert len(heads) == 1 and heads[0].payload is None and heads[0].content_length == len(big.encode())
