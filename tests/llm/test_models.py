"""Operators 3, 5, 6, 8, 9, 10 and the pipeline: held-out accuracy, brute force, SQL, corner cases."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docsluice.llm import language_model, quality, toxicity, vector_search
from docsluice.llm.html_text import main_texts, op5_html_text, page_texts, trained
from docsluice.llm.mixing import OP6_SQL, exponent, mixed, op6_mixing
from docsluice.llm.vector_search import nearest, op8_vector_search

DATA = "/root/testdata/sf0.01"
ODD = [(0, None, "a"), (1, "", None), (2, "x", ""), (3, "one two " * 30000, "a"), (3, "one two " * 30000, "a"), (None, "null id", "b")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", "1D as score", "2 as n_words", "3 as copy")


def accuracy(spark, scored, label):
    rows = scored.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    return (rows[label] == rows.predicted).mean(), len(rows)


def test_quality_held_out(spark):
    right, n = accuracy(spark, quality.op9_quality(spark, DATA), "quality")
    assert n > 50 and right > 0.95


def test_toxicity_held_out(spark):
    right, n = accuracy(spark, toxicity.op10_toxicity(spark, DATA), "toxic")
    assert n > 50 and right > 0.93


def test_scores_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon, neighbours = toxicity.learn(odd(spark), none), quality.learn(odd(spark), none)
    assert toxicity.measured_texts(odd(spark), lexicon).count() == len(ODD)
    assert {r.score for r in quality.scored_texts(odd(spark), neighbours).collect()} == {0.5}
    some = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.scored_texts(odd(spark), quality.learn(odd(spark), some)).where("score between 0 and 1").count() == len(ODD)
    rows = {r.doc_id: r for r in language_model.scored_texts(odd(spark), language_model.learn(odd(spark))).collect()}
    assert rows[0].log_likelihood == 0 and rows[0].mean_log_likelihood is None and rows[2].n_words == 1 and rows[3].n_words == 60000


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 4.0})
    for text in ("You IDIOT!", "1d10t", "іdiоt", "i​diot", "ⅰdiot".replace("ⅰ", "і"), "id!ot"):
        assert lexicon.measure(text)[1] == 1, text
    assert lexicon.measure("2010 was fine")[1] == 0
    assert toxicity.Lexicon({"trash": 3.0}).measure("put it in the trash can now")[1] == 0
    assert toxicity.Lexicon({"trash": 3.0}).measure("this trash")[1] == 1


def test_language_model_prefers_its_order(spark):
    """The driver's prose has no word order, so the corpus here is made of chains of words."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    names = [f"w{chr(97 + i)}" for i in range(12)]
    texts = []
    for _ in range(200):
        at, out = int(r.integers(12)), []
        for _ in range(60):
            out.append(names[at])
            at = (at + (1 if r.random() < 0.8 else 5)) % 12
        texts.append(" ".join(out))
    model = language_model.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(np.exp(model.middle).sum(axis=1), 1, atol=1e-3)
    sums, n = model.score(pa.array([texts[0], " ".join(r.permutation(texts[0].split()))]))
    assert n[0] == n[1] and sums[0] > sums[1] + 20


def test_triples_cover_every_word(spark):
    docs = odd(spark).select("text")
    classes = language_model.WordClasses(np.zeros(language_model.BUCKETS, np.int64))
    n = docs.where("text is not null").mapInArrow(language_model._count_triples(classes), "triple long, n long").agg(F.sum("n")).first()[0]
    assert n == sum(len(re.findall(r"\w+", t or "")) for _, t, _ in ODD)


def many_words(spark, n=70_000):
    """More distinct words than slots: 70 frequent ones, then n that occur once or three times."""
    lines = [" ".join(f"top{i}" for i in range(70)) for _ in range(20)]
    lines += [" ".join(w for j in range(i, i + 500) for w in [f"x{j:06d}"] * (3 if j % 2 else 1)) for i in range(0, n, 500)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string"), Counter(w for t in lines for w in t.split())


def test_words_of_one_slot_are_told_apart(spark):
    import pyarrow as pa

    names = [f"x{j:06d}" for j in range(70_000)]
    found = language_model.Words(pa.array([" ".join(names)]), language_model.MARKS, lower=True).hash
    seen, pair = {}, None
    for name, h in zip(names, (found >> np.uint64(48)).tolist()):
        if (other := seen.setdefault((h, name[-2:]), name)) != name and int(other[1:]) % 2 == int(name[1:]) % 2:
            pair = (other, name)
            break
    docs, counts = many_words(spark)
    often = " ".join([pair[0]] * 9)
    corpus = docs.union(spark.createDataFrame([(-1, often)], docs.schema))
    two = spark.createDataFrame([(0, pair[0]), (1, pair[1])], docs.schema)
    model = language_model.learn(corpus)
    got = {r.doc_id: r.log_likelihood for r in language_model.scored_texts(two, model).collect()}
    n = counts[pair[1]]
    assert got[0] - got[1] == pytest.approx(np.log((n + 8.5) / (n - 0.5)), abs=1e-6)
    assert model.counts.count() == len(counts) - language_model.COMMON


def test_shares_of_a_class_add_up_to_one(spark):
    """Over all words and the unseen one, whether a text's own words are taken off or not."""
    import pyarrow as pa

    docs, _ = many_words(spark)
    model = language_model.learn(docs)
    n_of = {r["hash"]: r["n"] for r in model.counts.collect()}
    names = sorted(many_words(spark)[1])
    found, kind = language_model.classified(pa.array([" ".join(names)]))
    rare = np.array([h in n_of for h in found.hash.view(np.int64).tolist()])
    names, kind = [w for w, r in zip(names, rare) if r], kind[rare]
    n = np.array([n_of[h] for h in found.hash.view(np.int64)[rare].tolist()])
    assert len(kind) == len(n_of) > language_model.BUCKETS
    text = docs.where("doc_id = 25").first().text.split()
    own = np.array([Counter(text)[w] for w in names])
    for taken in (np.zeros(len(names)), own):
        sums = np.bincount(kind, n - taken + language_model.SMOOTHING, minlength=language_model.CLASSES) + language_model.SMOOTHING
        shares = sums / (model.mass - np.bincount(kind, taken, minlength=language_model.CLASSES))
        assert np.allclose(shares[1 + language_model.COMMON :], 1, atol=1e-9)
    assert np.allclose(np.exp(model.middle.astype(float)).sum(axis=1), 1, atol=1e-3)


def test_scores_by_hand(spark):
    """Each text's score from the definition: class by both sides, word by its count in the other texts."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    names = [f"w{i}{'x' * (i % 9)}" for i in range(300)]
    texts = [" ".join(names[int(300 * r.random() ** 3)] for _ in range(r.integers(0, 60))) for _ in range(60)]
    texts += [texts[0], texts[1].upper() + " !", None, "", "one", "Ünknown wörds, é only here"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    model = language_model.learn(docs)
    got = {row.doc_id: row for row in language_model.scored_texts(docs, model).collect()}
    words = [re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() else " ", (t or "").lower()).split() for t in texts]
    total = Counter(w for ws in words for w in ws)
    flat = [w for ws in words for w in ws]
    found, other = language_model.classified(pa.array([" ".join(flat)]))
    signed = dict(zip(flat, found.hash.view(np.int64).tolist()))
    hashes = dict(zip(flat, found.hash.tolist()))
    top = sorted(total, key=lambda w: (-total[w], signed[w]))[: language_model.COMMON]
    rank = {w: i + 1 for i, w in enumerate(sorted(top, key=hashes.get))}
    kind_of = {w: rank.get(w, k) for w, k in zip(flat, other.tolist())}
    mass = Counter()
    for w, n in total.items():
        if w not in rank:
            mass[kind_of[w]] += n + 0.5
    for i, ws in enumerate(words):
        kinds = [0, *(kind_of[w] for w in ws), 0]
        want, own = 0.0, Counter(ws)
        in_class = Counter(kind_of[w] for w in ws)
        for j, w in enumerate(ws):
            k = kind_of[w]
            want += float(model.middle[kinds[j] * language_model.CLASSES + kinds[j + 2], k])
            if w not in rank:
                want += np.log((total[w] - own[w] + 0.5) / (mass[k] + 0.5 - in_class[k]))
        assert got[i].n_words == len(ws) and got[i].log_likelihood == pytest.approx(want, abs=1e-4)
    assert got[60].log_likelihood == got[0].log_likelihood and got[61].log_likelihood == got[1].log_likelihood


def plain_article(html):
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1|li|ul)>", body)
    texts = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", q.replace("<br>", " ")))).strip() for q in parts)
    return "\n".join(t for t in texts if t)


def test_article_text(spark):
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    want = {p["page_id"]: plain_article(p["html"]) for p in pages}
    got = {r.page_id: (r.text, r.n_chars) for r in op5_html_text(spark, DATA).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_page_parts():
    article = "<h1>The title</h1><p>First words of the story, which go on for a while and end here.<p>Second&nbsp;part &amp; more of the\n story, again with some length to it.</p>"
    side = '<div class="sidebar"><ul><li><a href="/a">Other</a></li><li><a href="/b">Links</a></li></ul></div>'
    page = f'<html><body><nav><a href="/">Home</a></nav><div class="cookie-banner"><p>We use cookies on this site.</p></div><main><article>{article}</article></main>{side}<form><input><label>Search</label></form><section id="comments"><div class="comment"><b>Ann</b><p>I liked this story, it was good.</p></div></section><footer>&copy; us</footer><script>x</script>'
    assert main_texts([page, None, "", "<p"], trained()) == ["The title\nFirst words of the story, which go on for a while and end here.\nSecond part & more of the story, again with some length to it.", "", "", ""]


def test_attribute_tokens_are_learnt():
    tokens = trained().tokens
    assert tokens.of("content") > 1 and tokens.of("storybody") > 1 and tokens.of("qqq") == 0
    assert all(tokens.of(t) < -1 for t in ("sidebar", "comment", "commentlist", "newsletter", "footer"))
    assert tokens.best("post-text share") == (tokens.best("post-text")[0], tokens.best("share")[1])


def test_pages_without_rows(spark):
    assert page_texts(spark.createDataFrame([], "page_id long, html string, text string")).count() == 0


def test_mixing_is_its_sql(spark):
    got = op6_mixing(spark, DATA).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    names = ["doc_id", "source", "copy", "mix_block", "mix_pos"]
    want = db.execute(OP6_SQL).df()
    assert sorted(map(tuple, got[names].values.tolist())) == sorted(map(tuple, want[names].values.tolist()))


def test_mixing_budgets(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 4 else "small") for i in range(2000)]
    out = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), repetition_limit=2.5, block_words=100).toPandas()
    times = Counter(out.doc_id)
    assert set(times) == set(range(2000)) and all(times[i] == 1 for i, _, s in rows if s == "big")
    small = [(i, t) for i, t, s in rows if s == "small"]
    total, read = sum(len(t.split()) for _, t in small), sum(times[i] * len(t.split()) for i, t in small)
    assert 2.5 * total - 5 <= read <= 2.5 * total and {times[i] for i, _ in small} == {2, 3}
    assert mixed(odd(spark)).select("doc_id").distinct().count() == 5
    assert mixed(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("limit,entropy,want", [(2.0, None, 1 - np.log(2) / np.log(10)), (20.0, None, 0), (None, 9.0, 0), (None, 0.01, 1)])
def test_exponent(spark, limit, entropy, want):
    words = spark.createDataFrame([(100,), (50,), (10,)], "n long")
    assert exponent(words, limit, entropy).first()[0] == pytest.approx(want, abs=2e-6)


def brute_nearest(rows):
    """By each query's id and vector: (-score, vec_id) of its nearest among the rows of its width."""
    rows = sorted((i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v))
    out = {}
    for q, x in set(rows):
        if q % 20 == 0:
            others = list(rows)
            others.remove((q, x))
            others = [(i, v) for i, v in others if len(v) == len(x)]
            scores = vector_search.products(np.tile(x, (len(others), 1)), np.array([v for _, v in others]).reshape(len(others), len(x)))
            out[q, x] = sorted(zip((-scores).tolist(), (i for i, _ in others)))[:20]
    return out


def lists(found):
    """The lists of (score, vec_id) by query_id; a query_id of several vectors has as many."""
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    return {q: sorted(v) for q, v in out.items()}


def brute_lists(rows):
    out = {}
    for (q, _), best in brute_nearest(rows).items():
        out.setdefault(q, []).extend((k + 1, s, i) for k, (s, i) in enumerate(best))
    return {q: sorted(v) for q, v in out.items() if v}


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.1"])
def test_search_recall(spark, folder):
    table = pq.read_table(f"{folder}/embeddings.parquet", columns=["vec_id", "embedding"])
    want = {q: best for (q, _), best in brute_nearest(list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))).items()}
    got = op8_vector_search(spark, folder).toPandas()
    assert set(got.query_id) == set(want) and (got.groupby("query_id").size() == 20).all()
    exact = {(q, i): -s for q, best in want.items() for s, i in best}
    found = [exact[q, i] == s for q, i, s in zip(got.query_id, got.vec_id, got.score) if (q, i) in exact]
    assert all(found) and len(found) >= 0.9 * len(exact)


def test_search_in_a_deep_tree(spark, monkeypatch):
    """A sample too small for the table: large leaves get subtrees, and visits are dealt over parts."""
    for name, value in (("FIT_ROWS", 64), ("LEAF_ROWS", 16), ("DEEP_ROWS", 64), ("SUB_ROWS", 128), ("SUB_LEAF", 8), ("BLOCK_ROWS", 32), ("VISITS", 7)):
        monkeypatch.setattr(vector_search, name, value)
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 8)) * 4
    rows = [(i, (centres[i % 12] + r.standard_normal(8)).astype("float32").tolist()) for i in range(1500)]
    depths = []
    deepened = vector_search._deepened
    monkeypatch.setattr(vector_search, "_deepened", lambda placed, tree, full: (deepened(placed, tree, full), depths.append((len(full), int(tree.leaf.max()) + 1))))
    found = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=0.95).collect()
    want = brute_lists(rows)
    got = lists(found)
    assert depths and depths[0][1] > 2 * depths[0][0]
    hits = sum(len({i for _, _, i in got[q]} & {i for _, _, i in best}) for q, best in want.items())
    assert hits >= 0.9 * 20 * len(want) and all(len(v) == 20 for v in got.values())


def test_search_of_odd_rows(spark):
    r = np.random.default_rng(1)
    same = [1.0, 0.0, 0.5]
    rows = [(i, same if i % 3 == 0 else r.standard_normal(3).astype("float32").tolist()) for i in range(200)]
    rows += [(None, same), (300, None), (320, [0.0, 0.0, 0.0]), (340, [1.0, None, 2.0]), (360, [float("nan"), 1.0, 1.0]), (380, [])]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (40, [2.0, -0.0, 1.0]), (41, [3.0, 1.0, 1.0]), (41, [3.0, 1.0, 1.0])]
    rows += [(-5, [1.0, 2.0]), (-20, [1.0, 3.0]), (-40, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as leaf", "2 as v")
    assert lists(nearest(df, recall=1.0).collect()) == brute_lists(rows)
    assert nearest(df.limit(0)).count() == 0
    assert nearest(spark.createDataFrame([(20, same), (1, same)], "vec_id long, embedding array<float>")).collect()[0][:3] == (20, 1, 1)


def test_search_finds_twenty(spark):
    """Visits go on until they hold enough rows, whatever the recall that is asked for."""
    r = np.random.default_rng(3)
    rows = [(i, (np.eye(6)[i % 6] * 9 + r.standard_normal(6) * 0.01).tolist()) for i in range(120)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.01).toPandas()
    assert (got.groupby("query_id").size() == 20).all()


def test_pipeline(spark):
    """Every stage and run(), to the last token id, against brute force."""
    import hashlib

    import corpus_pipeline
    from tests.llm.test_codecs import library
    from tests.llm.test_dedup import brute_cut, brute_join, words_of

    documents = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = sorted(stages["toxicity"](spark, docs, DATA).collect())
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    keep = [d for d in documents if lexicon.score(*(np.array([v]) for v in plain_measure(lexicon, d["text"] or "")[::2]))[0] < toxicity.CUT]
    assert [tuple(r) for r in clean] == sorted(tuple(d[c] for c in docs.columns) for d in keep)
    one = sorted(stages["near copies"](spark, spark.createDataFrame(clean, docs.schema), DATA).collect())
    rows = [(r.doc_id, r.text) for r in clean]
    heads = {c for _, c, _ in brute_join(rows)}
    assert one == [r for r in clean if r.doc_id in heads]
    cut = {r.doc_id: r for r in stages["repeated passages"](spark, spark.createDataFrame(one, docs.schema), DATA).collect()}
    left = {d: (n, gone, sha) for d, n, gone, sha in brute_cut([(r.doc_id, r.text) for r in one])}
    for r in one:
        n, gone, sha = left[r.doc_id]
        text = cut[r.doc_id].text
        if gone:
            assert hashlib.sha256(b" ".join(words_of(text))).hexdigest() == sha and len(words_of(text)) == n - gone and cut[r.doc_id].n_chars == len(text)
        else:
            assert cut[r.doc_id] == r
    import pandas as pd

    db = duckdb.connect()
    db.register("documents", pd.DataFrame([r.asDict() for r in cut.values()]))
    copies = Counter(db.execute(OP6_SQL).df().doc_id)
    tool, want = library(), Counter()
    for d, r in cut.items():
        ids = tool.encode(r.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[d, r.source, len(ids), raw, hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()] = copies[d]
    got = Counter((r.doc_id, r.source, r.n_tokens, bytes(r.token_ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    names = ["score", "weight", "hits", "words", "node", "links", "row", "no_id", "text_hash", "_all", "spans", "text_key", "n_words", "removed", "copy", "mix_block", "_s", "_h"]
    docs = spark.createDataFrame([(i, f"some words number {i} " * 3, "en", "ab"[i % 2], 60) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and all(r[n] == f"{n} {r.doc_id}" for r in out.collect() for n in names), name


def plain_measure(lexicon, text):
    """(weight, hits, words) without an automaton."""
    words = toxicity.folded_words(text)
    line = f" {' '.join(words)} "
    excused = set()
    for phrase in lexicon.exceptions:
        p = f" {' '.join(toxicity.folded_words(phrase))} "
        at = line.find(p)
        while at >= 0:
            excused.update(range(at, at + len(p) - 1))
            at = line.find(p, at + 1)
    at, hits = 0, []
    for w in words:
        best = max((lexicon.weights[w[:k]] for k in range(1, len(w) + 1) if w[:k] in lexicon.weights), default=0)
        if best and at not in excused:
            hits.append(best)
        at += len(w) + 1
    return float(sum(hits)), len(hits), len(words)


def test_toxicity_by_hand(spark):
    """The learnt entries from plain counts, and every document's measure without an automaton."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.training_rows(docs, labels, "toxic", toxicity.LABELLED).collect()
    label = {r.doc_id: r.toxic for r in labels.collect()}
    assert rows and all(r.y == label[r.doc_id] for r in rows)
    import zlib

    assert not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    texts, total, seen = Counter(), Counter(), {}
    for r in rows:
        if r["pick"] >= 667:
            continue
        texts[r.y] += 1
        own = Counter(w[:k] for w in toxicity.folded_words(r.text) for k in range(3, 9) if len(w) >= k)
        total[r.y] += len(toxicity.folded_words(r.text))
        for e, n in own.items():
            c = seen.setdefault(e, Counter())
            c[r.y] += n
            c["texts", r.y] += 1
    learnt = {}
    for e, c in sorted(seen.items(), key=lambda x: (len(x[0]), x[0])):
        if c["texts", 1] < toxicity.SUPPORT or c[1] <= c[0] / 20:
            continue
        bound = np.log((c[1] + 0.5) / total[1]) - np.log((c[0] + 0.5) / total[0]) - np.sqrt(1 / (c["texts", 1] + 0.5) + 1 / (c["texts", 0] + 0.5))
        ratio = toxicity.likelihood_ratio(np.array([c["texts", 1]], float), np.array([c["texts", 0]], float), texts[1], texts[0])[0]
        if ratio >= toxicity.EVIDENCE and bound >= toxicity.LEAST_WEIGHT and all(bound > learnt[e[:k]] + 0.5 for k in range(3, 9) if e[:k] in learnt):
            learnt[e] = bound
    assert learnt and lexicon.weights == pytest.approx({**toxicity.BASE, **learnt})
    for r in toxicity.measured_texts(docs, lexicon, keep_text=True).collect():
        assert (r.weight, r.hits, r.words) == (pytest.approx(plain_measure(lexicon, r.text or "")[0]), *plain_measure(lexicon, r.text or "")[1:])


def test_quality_by_hand(spark):
    """Features from their definition, and votes from whole sorted lists of cosines."""
    import pyarrow as pa

    def plain_features(text):
        raw = (text or "").encode()
        out = np.zeros(quality.FEATURES)
        kinds = [int(quality.CLASSES[b]) for b in raw]
        kinds = [k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]]
        number = lambda key: int(quality.mix(np.array([key % 2**64], np.uint64))[0])
        for k in (2, 3, 4):
            for i in range(len(kinds) - k + 1):
                key = k
                for j in range(k):
                    key = key * 257 + kinds[i + j]
                out[number(key) % quality.FORM] += 1
        words = raw.split()
        n, some = len(words), max(len(words), 1)
        distinct, most = len(set(words)), max(Counter(words).values(), default=0)
        lines, size = raw.count(10), max(len(raw), 1)
        letters, capitals = sum(quality.CLASSES[b] <= 2 for b in raw), sum(quality.CLASSES[b] == 2 for b in raw)
        steps = [min(np.log2(n + 1), 15), 10 * distinct / some, 20 * most / some, min(10 * distinct / np.sqrt(some) / 3, 15), 12 * letters / size, 20 * capitals / size, min(len(raw) / some, 20), min(np.log2(lines + 1) * 2, 20), min(40 * lines / some, 20)]
        for i, m in enumerate(steps):
            for d, weight in ((-1, 2), (0, 6), (1, 2)):
                out[number(10_000 + 1000 * i + int(np.floor(m)) + d + 2) % quality.FORM] += weight
        plain = quality.Words(pa.array([text or ""]), quality.MARKS, lower=True)
        for h in plain.hash.tolist():
            out[quality.FORM + h % quality.WORDS] += 1
        return out

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    some = [None, "", "One two.  Three\nthree\n\nA1b2, é漢 x"] + [r.text for r in docs.orderBy("doc_id").limit(5).collect()]
    counts = quality.counted_features(pa.array(some, pa.string()))
    assert all((counts[i] == plain_features(t)).all() for i, t in enumerate(some))
    model = quality.learn(docs, labels)
    scores = model.score(counts)
    for i in range(len(some)):
        z = model.latent(counts[i : i + 1])[0]
        near = sorted(((float(z @ v), int(y)) for v, y in zip(model.vectors, model.labels)), key=lambda x: -x[0])
        cut = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
        assert len(near) <= quality.NEIGHBOURS or near[quality.NEIGHBOURS][0] <= cut
        votes = [(max(c, 0) ** quality.SHARPNESS + 1e-9, y) for c, y in near[: quality.NEIGHBOURS]]
        assert scores[i] == pytest.approx(sum(v * y for v, y in votes) / sum(v for v, _ in votes), abs=0.05)
    conflict = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.y) for r in toxicity.training_rows(docs, conflict, "quality", 100).collect()} <= {(2, 1)}


def test_stages_of_odd_rows(spark):
    import corpus_pipeline

    long = "many words here " * 20000
    rows = [(1, "some words that are kept", "en", "a", 24), (2, None, None, None, None), (3, "", "en", "", 0), (None, "no id at all", "en", "a", 12), (4, long, "en", "b", len(long)), (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)), (6, "an idiot and a moron and scum", "en", "a", 29)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs, want in ((spark.createDataFrame([], schema), {}), (spark.createDataFrame(rows, schema), {"toxicity": 7, "near copies": 5, "repeated passages": 5, "mixing": 5, "encoding": 5})):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            kept = out.collect()
            assert len(kept) >= want.get(name, 0) and (name == "mixing" or name == "encoding" or len(kept) == want.get(name, 0)), name
            docs = spark.createDataFrame(kept, out.schema)


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_words long")
    assert language_model.scored_texts(none, language_model.learn(none)).count() == 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.scored_texts(none, quality.learn(none, labels)).count() == 0
    assert toxicity.measured_texts(none, toxicity.learn(none, labels)).count() == 0
