"""Registered queries beside their SQL where keys are large, texts are odd or tables are long."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from docsluice.sources import articles


def beside_sql(spark, folder, name: str, **tables: dict) -> list[tuple]:
    """The query's rows over tables of these columns, which its SQL gives too."""
    sql = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    rows = entry.queries()[name](spark, str(folder))
    want = sql.execute(f"SELECT {', '.join(f'"{c}"' for c in rows.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = list(map(tuple, rows.collect()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_page_numbers_of_six_digits(spark, tmp_path):
    ids = [4, 99_994, 123_460, 1_234_570, *range(100_000, 100_006)]
    got = beside_sql(spark, tmp_path, "url_identifier", pages={"page_id": ids, "url": ["https://a.org/x"] * len(ids)})
    assert (123_460, "arxiv", "2401.12346v2", True) in got


def test_references_without_their_semicolon(spark, tmp_path):
    html = ["<title>A &amp;&amp</title><article><h1>A &amp;&amp</h1><p>b &amp; c & d&copy;</p></article>", "<article><h1>T &quot</h1><p>x&middot;y</p><p>&copy</p></article>"]
    got = beside_sql(spark, tmp_path, "html_article_paragraphs", pages={"page_id": [1, 2], "url": ["u", "v"], "html": html})
    assert {r[2] for r in got} == {"A &&amp", "T &quot"}


def test_preprints_of_more_customers_than_five_digits(spark, tmp_path):
    ids = [8 * i + 3 + 100_000 * n for i in range(2) for n in (0, 1, 2, 9, 53)] + [100_000, 900_001, 200_002, 300_004, 123_461, 123_462, 7]
    customer = {"c_custkey": ids, "c_name": [f"N{i}" for i in ids], "c_nationkey": [i % 25 + i // 100_000 for i in ids], "c_mktsegment": ["M"] * len(ids)}
    got = beside_sql(spark, tmp_path, "resolved_papers", customer=customer)
    assert len({r[7] for r in got if r[6] == "2001.00003"}) > 2


def test_texts_in_runs_of_bounded_size():
    texts = ["é" * n for n in (400_000, 400_000, 0, 5, 3_000_000, 10, 10)] + [None] + ["x" * 300_000] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["paper_id", "text"])
    runs = list(articles.slices(iter([batch, batch.slice(0, 0)]), "text"))
    assert [t for r in runs for t in r.column("text").to_pylist()] == texts
    sizes = [[len(t or "") for t in r.column("text").to_pylist()] for r in runs]
    assert len(runs) > 5 and max(sum(s) - max(s) for s in sizes) <= articles.SLICE_CHARS


def customers(folder, n: int) -> None:
    ids = list(range(1, n + 1))
    pq.write_table(pa.table({"c_custkey": ids, "c_name": [f"N{i}" for i in ids], "c_nationkey": [i % 25 for i in ids], "c_mktsegment": ["M"] * n}), f"{folder}/customer.parquet")


def test_one_small_file_keeps_all_cores_at_work(spark, tmp_path):
    customers(tmp_path, 200)
    for name in ("pubmed_works", "jats_sections", "jats_reference_list"):
        parts = entry.queries()[name](spark, str(tmp_path)).rdd.glom().map(len).collect()
        assert sum(p > 0 for p in parts) >= spark.sparkContext.defaultParallelism, name


def test_rows_of_papers_are_dealt_by_paper(spark):
    for name in ("dimension_scores", "missing_items", "reviewer_payload"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "paper_id" in line]
        assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt), name
