"""Operator 12 against a plain tree in Python."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pyarrow.parquet as pq
import pytest

import docsluice.llm.merkle as merkle
from docsluice.llm.merkle import merkle_manifest, op12_merkle_manifest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((level[i ^ 1] if (i ^ 1) < len(level) else None, i % 2 == 1))
        i //= 2
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: levels([leaf(r) for r in own[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(own[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for sib, left in path:
                node = H(*([sib, node] if left else [node, sib] if sib else [node]))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*(s for s, _ in path if s)), node, node == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def documents():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "source", "lang", "n_chars", "text"])
    return list(zip(*(t[c].to_pylist() for c in t.column_names)))


@pytest.mark.parametrize("width", [2, 8])
def test_documents(spark, monkeypatch, width):
    monkeypatch.setattr(merkle, "WIDTH", width)
    assert got(op12_merkle_manifest(spark, DATA)) == brute(documents())


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "WIDTH", 1)
    rows = [(None, None, None, None, None), (7, "s", None, None, ""), (7, "s", None, None, ""), (2**63 - 1, "é", "ü", 2**63 - 1, "é\n"), (-4, "", "", 0, "x" * 300_000), (None, "a", "", 1, "b")]
    rows += [(5, "s", "many", 3, "same")] * 40 + [(i, "s", f"l{i % 9}", i, str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as idx", "2 as hash", "3 as total", "'x' as name", "4 as leaf")
    assert got(merkle_manifest(df)) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(3, "s", "en", 1, "a")]
    assert got(merkle_manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert got(merkle_manifest(spark.createDataFrame([], SCHEMA))) == []
