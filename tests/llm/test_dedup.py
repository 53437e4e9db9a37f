"""Operators 1 and 2 against brute force, and their corner cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from docsluice.llm.ngram_join import least_matches, ngram_jaccard_join, one_of_each, op1_ngram_jaccard_join
from docsluice.llm.substring_dedup import SuffixAutomaton, op2_substring_dedup, substring_dedup
import docsluice.llm.ngram_join as ngram_join
import docsluice.llm.substring_dedup as passages

DATA = "/root/testdata/sf0.001"


def shingles(text: str | None) -> frozenset:
    words = re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() else " ", (text or "").lower()).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows):
    """(links of each row, the rows that it reaches)."""
    sets = [shingles(t) for _, t in rows]
    links = [[j for j, b in enumerate(sets) if j != i and a and len(a & b) >= 0.8 * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    reach = []
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        reach.append(seen)
    return links, reach


def brute_join(rows):
    links, reach = brute_groups(rows)
    label = [min((rows[j][0] for j in seen if rows[j][0] is not None), default=None) for seen in reach]
    return sorted(((rows[i][0], label[i], len(links[i])) for i in range(len(rows))), key=str)


def brute_one_of_each(rows, left):
    """Whether `left` holds one row of each group, of its smallest doc_id, and all texts without words."""
    left = Counter(left)
    for group in {frozenset(s) for s in brute_groups(rows)[1]}:
        own = [rows[i] for i in group]
        ids = [d for d, _ in own if d is not None]
        heads = {r for r in own if r[0] == (min(ids) if ids else None)}
        kept = {r: left[r] for r in set(own) if left[r]}
        if shingles(own[0][1]):
            assert sum(kept.values()) == 1 and set(kept) <= heads, own[0]
    wordless = Counter(r for r in rows if not shingles(r[1]))
    assert all(left[r] == n for r, n in wordless.items())


def words_of(text):
    return (text or "").encode().split()


def brute_cut(rows):
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w, gone = words_of(t), set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def made_rows(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(4))
    rows = []
    base = [word() for _ in range(150)]
    shared = [word() for _ in range(70)]
    for i in range(60):
        text = list(base)
        for _ in range(r.randrange(4)):
            text[r.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    for i in range(60, 100):
        a, b = r.randrange(10), 50 + r.randrange(20)
        rows.append((i, " ".join([word() for _ in range(r.randrange(40))] + shared[a:b] + [word() for _ in range(r.randrange(40))])))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "One, two!"), (104, " ".join(["x"] * 300)), (105, " ".join(["x"] * 200)), (106, "..."), (7, rows[7][1]), (None, rows[3][1]), (107, " ".join(word() for _ in range(30000)))]
    return rows


def documents(dir_):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{dir_}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def test_join_on_documents(spark):
    got = op1_ngram_jaccard_join(spark, DATA).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_join(documents(DATA))


@pytest.mark.parametrize("block", [7, 512])
def test_join_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "ROUGH_BLOCK", block)
    monkeypatch.setattr(ngram_join, "EXACT_BLOCK", block)
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as node", "2 as root", "3 as size")
    got = ngram_jaccard_join(df).select("doc_id", "class_id", "n_links").collect()
    want = brute_join(rows)
    assert sorted((tuple(r) for r in got), key=str) == want


def changed(text, at, word="changed"):
    words = text.split()
    words[at] = word
    return " ".join(words)


def odd_ids():
    """Texts whose rows have no id, share one, or are there more than once."""
    r = random.Random(9)
    one, two, three, four = (" ".join("".join(r.choice("abcde") for _ in range(6)) for _ in range(60)) for _ in range(4))
    return [(7, one), (None, changed(one, 3)), (5, two), (5, three), (5, changed(three, 9)), (None, four), (None, four), (None, changed(four, 0)), (8, two), (8, two), (None, None), (None, None), (9, ""), (9, "")]


def test_join_of_odd_ids(spark):
    rows = odd_ids()
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_join(rows)


@pytest.mark.parametrize("block", [2, 512])
def test_one_of_each(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "EXACT_BLOCK", block)
    for rows in (made_rows(), odd_ids()):
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as node", "2 as links", "'x' as `row`")
        left = one_of_each(df)
        assert left.columns == df.columns
        brute_one_of_each(rows, [(r.doc_id, r.text) for r in left.collect()])
    assert one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sizes_that_just_reach_the_threshold(spark):
    """Sets of n and 1.25 n shingles, one in the other, are linked; their classes of sizes differ by one at most."""
    names = [f"w{i}" for i in range(1300)]
    rows = [(i, " ".join(names[: n + 4])) for i, n in enumerate((4, 5, 8, 10, 64, 80, 81, 100, 125, 400, 500, 800, 1000))]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_join(rows)


def test_posterior():
    assert least_matches(0.8, 1e-6, 128) < 0.8 * 128 and least_matches(0.8, 1e-6, 16) > 0


def test_cut_documents(spark):
    got = op2_substring_dedup(spark, DATA).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = brute_cut(documents(DATA))
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("limit,piece", [(300, 64), (300, 8_192), (100_000, 51), (100_000, 8_192)])
def test_cut_in_shards(spark, monkeypatch, limit, piece):
    monkeypatch.setattr(passages, "SHARD_WORDS", limit)
    monkeypatch.setattr(passages, "PIECE_WORDS", piece)
    rows = made_rows(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' as lang", "1 as spans")
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(b" ".join(words_of(r.text))).hexdigest()) for r in substring_dedup(df).collect()]
    assert sorted(got, key=str) == brute_cut(rows)
    assert substring_dedup(df.limit(0)).count() == 0


def test_long_shared_document(spark):
    """Two million words that a second document holds too, but for one word: automata of bounded size do it."""
    words = [f"{i * 7919 % 1_000_003:x}" for i in range(2_000_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:1_000_000], "new", *words[1_000_000:]]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][:2] == (2_000_000, 0) and got[2] == (2_000_001, 2_000_000, "new")


def test_words_over_segments(monkeypatch):
    import pyarrow as pa

    import docsluice.llm.words as words

    column = pa.array(["one two  three", None, "", "x" * 500 + " é漢字 " + "yz" * 300, " a b "])
    whole = words.Words(column).hash
    monkeypatch.setattr(words, "SEGMENT_BYTES", 7)
    assert (words.Words(column).hash == whole).all() and len(whole) == 8


def test_automaton():
    r = random.Random(5)
    texts = [[r.randrange(3) for _ in range(40)] for _ in range(6)]
    a = SuffixAutomaton()
    for t in texts:
        a.add(t)
    for _ in range(50):
        q = [r.randrange(3) for _ in range(30)]
        covered = set()
        for i in range(len(q) - 5):
            if any(t[j : j + 6] == q[i : i + 6] for t in texts for j in range(len(t) - 5)):
                covered.update(range(i, i + 6))
        spans, _ = a.spans(q, 6)
        assert Counter(x for s, e in spans for x in range(s, e)) == Counter(covered)
