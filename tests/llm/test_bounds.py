"""Repeated ids, clashing columns, very long texts and unclosed markup: cost and memory stay in proportion."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from docsluice.llm import quality, toxicity
from docsluice.llm.html_text import main_texts, trained
from docsluice.llm.mixing import mixed
from docsluice.llm.substring_dedup import substring_dedup


def seconds(work) -> float:
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


def test_one_id_in_many_rows(spark):
    """800 rows of one doc_id, each with 1,500 words of its own and a passage that a smaller document holds."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(60)]
    rows = [(1, " ".join([word(), *shared, word()]))] + [(7, " ".join([word() for _ in range(700)] + shared + [word() for _ in range(740)])) for _ in range(800)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 0)] + [(7, 60)] * 800


def test_labelled_rows_are_bounded_whatever_repeats(spark):
    docs = spark.range(20_000).select((F.col("id") % 3 + 1).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    for label in ("quality", "toxic"):
        rows = toxicity.training_rows(docs, labels, label, 100).collect()
        assert len(rows) == len({x.doc_id for x in rows}) <= 3
    assert len(quality.learn(docs, labels).vectors) <= 3


def test_long_text_of_hits_and_phrases():
    lexicon = toxicity.Lexicon({"stupid": 2.0, "loser": 1.0, "pond": 0.5})
    text = "stupid question I know, stupid loser, pond scum " * 40_000  # 1.9 MB
    assert seconds(lambda: lexicon.measure(text)) < 20
    weight, hits, words = lexicon.measure(text)
    assert (weight, hits, words) == (3.0 * 40_000, 80_000, 8 * 40_000)
    assert toxicity.merged([(5, 9), (1, 3), (8, 12), (3, 4), (20, 21)]) == ([1, 5, 20], [4, 12, 21])


def test_unclosed_markup():
    model = trained()
    for page in ("<b>" * 8_000 + "</i>" * 8_000, "<ul>" * 8_000, "<body>" * 5_000 + "x<p>" * 5_000, "<div>" * 20_000 + "</p>" * 20_000, "<b>x" * 100_000):
        assert seconds(lambda p=page: main_texts([p], model)) < 10


def test_mixing_keeps_columns_named_as_its_own(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y", f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string")
    names = ["passes", "_s", "_h", "_key", "_edge", "_last", "_blocks", "_block", "_own", "n", "s"]
    wide = docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    got = mixed(wide)
    assert got.columns == ["doc_id", "text", "source", *names, "copy", "mix_block", "mix_pos"]
    for r in got.collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in names)
    key = lambda rows: sorted((r["doc_id"], r["copy"], r["mix_block"]) for r in rows)
    assert key(got.collect()) == key(mixed(docs).collect())
