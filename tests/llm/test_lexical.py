"""Operator 11 against scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import docsluice.llm.lexical as lexical
from docsluice.llm.lexical import Treaps, op11_ranked_search, terms_of, top_documents

DATA = "/root/testdata/sf0.001"


def brute_terms(text):
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute(docs, items, k=10):
    tf = [(d, brute_terms(t)) for d, t in docs]
    N = sum(1 for _, c in tf if c)
    L = sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in tf:
            n = sum(c.values())
            score = sum(q * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * N // L))) for t, q in brute_terms(text).items() if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def rows_of(name, key):
    t = pq.read_table(f"{DATA}/{name}.parquet", columns=[key, "text"])
    return list(zip(t[key].to_pylist(), t["text"].to_pylist()))


@pytest.mark.parametrize("shard,block", [(2_000_000, 4_000_000), (500, 1_000)])
def test_documents(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "FRONT", 64)
    assert got(op11_ranked_search(spark, DATA)) == brute(rows_of("documents", "doc_id"), rows_of("benchmark", "item_id"))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 50)
    r = random.Random(3)
    word = lambda: r.choice(["alpha", "Beta", "gämma", "δ", "x1", "the", "Of"])
    docs = [(i % 40, " ".join(word() for _ in range(r.randrange(60)))) for i in range(120)]
    docs += [(None, "alpha Beta"), (None, None), (500, None), (501, ""), (502, "?!\x7f"), (3, "the the the"), (3, "the the the"), (503, "the" * 300)]
    items = [(1, "alpha the"), (1, "δ"), (2, None), (3, ""), (4, "unknown"), (None, "ALPHA_beta gämma gämma"), (5, "the " * 30)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as terms", "3 as often")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as number", "2 as query", "3 as doc_id")
    assert got(top_documents(d, q)) == brute(docs, items)
    assert got(top_documents(d.limit(0), q)) == got(top_documents(d, q.limit(0))) == []


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    for text in ("", "a", "Abc def" * 9, "é" * 40 + " x-y_z " * 9, "one-very-long" + "q" * 50):
        assert terms_of(text.encode()) == {t.encode(): n for t, n in brute_terms(text).items()}


def test_treaps_hold_order_and_heap():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 1000):
        term = r.integers(0, 3, n)
        doc = np.concatenate([r.permutation((term == t).sum()) for t in range(3)])[np.argsort(np.argsort(term, kind="stable"), kind="stable")]
        impact = r.integers(0, 6, n)
        treaps = Treaps(term, doc, impact, 3)
        seen = []

        def walk(node, low, high, most):
            if node >= 0:
                d, left, right = treaps.nodes[node].tolist()
                assert low <= d < high and treaps.impact[node] <= most
                walk(left, low, d, treaps.impact[node])
                seen.append(node)
                walk(right, d + 1, high, treaps.impact[node])

        for t in range(3):
            walk(int(treaps.root[t]), 0, n, 99)
        assert sorted(seen) == list(range(n))
