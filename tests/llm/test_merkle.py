"""The Merkle manifest against a plain fold in Python."""

import hashlib
import zlib

import pytest

from fieldseries.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return h("".join(field(v) for v in row))


def fold(nodes):
    """Root and, per node, its (left, right) siblings level by level."""
    where, proofs, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        for k, p in enumerate(where):
            s = p - p % 3
            proofs[k].append(("".join(level[s:p]), "".join(level[p + 1 : s + 3])))
            where[k] = p // 3
        level = [h("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], proofs


def tamper(row):
    d, s, lang, n, t = row
    if d is not None and (zlib.crc32(str(d).encode()) & 0xFFFFFFFF) % 2 == 0 and t is not None:
        t = t.replace("\n", "")
    return (d, s, lang, n, t)


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, leaf(r)))
    order = lambda g: (g is not None, (g or "").encode())
    subs, inner = {}, {}
    for g, members in groups.items():
        members.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs[g], proofs = fold([m[1] for m in members])
        inner[g] = [(m, p) for m, p in zip(members, proofs, strict=True)]
    names = sorted(groups, key=order)
    root, outer = fold([subs[g] for g in names])
    out = []
    for g, upper in zip(names, outer, strict=True):
        for (row, lf), p in inner[g]:
            sib = p + upper
            acc = leaf(tamper(row))
            for left, right in sib:
                acc = h(left + acc + right)
            out.append((row[0], lf, subs[g], root, h("".join(a + b for a, b in sib)), acc, acc == root))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.F.struct(*[merkle.F.col(c) for c in FIELDS[:-1]], merkle.deleted_newlines().alias("text"))
    got = merkle.manifest(docs, FIELDS, "doc_id", "source", found).collect()
    return sorted((tuple(r) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


ROWS = [
    (1, "a", "en", 3, "x\ny"),
    (2, "a", None, None, None),
    (None, "a", "de", 0, ""),
    (4, None, "en", 5, "hello\n\n"),
    (5, "é", "fr", 1, "é\nz" * 1000),
    (6, "b", "en", 2, "\n"),
    (6, "b", "en", 2, "\n"),
    (7, "a", "en", 4, "ab\ncd"),
    (8, "Z", "en", 1, "q"),
]


def test_awkward_rows(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_one_row_and_empty(spark):
    one = [(3, None, None, None, "a\nb")]
    got = run(spark, one)
    assert got == brute(one) and got[0][4] == h("") and got[0][2] == got[0][3] == got[0][1]
    assert run(spark, []) == []


@pytest.mark.parametrize("depth", [1, 2])
def test_groups_over_many_blocks(spark, monkeypatch, depth):
    """Small blocks: groups recurse over several rounds, and runs line up across blocks."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 3**depth)
    rows = [(i, "hot" if i % 4 else f"s{i % 3}", "en", i, f"line {i}\nnext") for i in range(130)]
    rows += [(500, None, None, None, None)]
    assert run(spark, rows) == brute(rows)


def test_sample_documents(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select(*FIELDS).collect()]
    got = run(spark, rows)
    assert got == brute(rows)
    assert not all(r[6] for r in got) and any(r[6] for r in got)
