"""Table functions, the document store, addresses, rounding and one-scan counts."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from docsluice.functions import scalars, tables
from docsluice.operators import grounding, lifecycle, text
from docsluice.sources import document_store

SCHEMA = "object_key string, title string, text string, parts array<struct<n:int,s:string>>"


def test_chunks_and_references_from_sql(spark):
    tables.register(spark)
    long = ("A sentence here. " * 300 + "\n\n") * 3
    papers = spark.createDataFrame([("a", long), ("b", "x\nReferences\nSmith J. A long title, 2001. doi:10.1000/ABC.1.\n\nshort\n\nDoe J. Another rather long title, 2002"), ("c", None), ("d", "")], "paper_id string, text string")
    got = spark.sql("SELECT p.paper_id, c.* FROM {p} AS p, LATERAL text_chunks(p.text) AS c", p=papers).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, text.chunks(papers).collect()))
    few = spark.sql("SELECT c.start, c.end FROM {p} AS p, LATERAL text_chunks(p.text, 100, 10) AS c WHERE paper_id = 'a'", p=papers).collect()
    assert [tuple(r) for r in few] == text.chunk_bounds(long, 100, 10)
    for how in ("", "PARTITION BY paper_id"):
        refs = spark.sql(f"SELECT * FROM paper_references(TABLE(SELECT *, 1 AS more FROM {{p}}) {how})", p=papers).collect()
        assert sorted(map(tuple, refs)) == sorted(map(tuple, text.references(papers).collect())) and len(refs) == 2
    with pytest.raises(Exception, match="paper_id and text"):
        spark.sql("SELECT * FROM paper_references(TABLE(SELECT 1 AS x))").collect()


def test_page_items_from_sql(spark):
    tables.register(spark)
    items = spark.createDataFrame([(p, g, i, s) for p in (1, 2) for g in (1, 2) for i, s in enumerate(["one", " ", "", "two three", "é"])], "paper_id long, page int, pos int, str string")
    got = spark.sql("SELECT * FROM page_text(TABLE(SELECT * FROM {i}) PARTITION BY paper_id ORDER BY (page, pos))", i=items).collect()
    want = text.page_items(items).select("paper_id", "page", "pos", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def names(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*"))


def test_document_store(spark, tmp_path):
    document_store.register(spark)
    root = tmp_path / "store"
    rows = spark.createDataFrame([(f"k{i}.json", f"T{i}", "é" * i, [(i, "s")]) for i in range(20)], SCHEMA).repartition(3)
    put = lambda df, **o: df.write.format("document_store").mode("append").options(**o).save(str(root))
    get = lambda: spark.read.format("document_store").schema(SCHEMA).load(str(root))
    assert get().count() == 0
    put(rows)
    assert sorted(map(tuple, get().collect())) == sorted(map(tuple, rows.collect()))
    assert names(root) == sorted(f"k{i}.json" for i in range(20))
    asked = get().where(F.col("object_key").isin("k1.json", "k5.json", "none.json")).where("title <> 'T5'")
    assert [r.title for r in asked.collect()] == ["T1"] and asked.rdd.getNumPartitions() == 1
    put(spark.createDataFrame([("k1.json", "new", None, None)], SCHEMA))
    assert get().where("object_key = 'k1.json'").first().title == "new"
    put(rows.drop("object_key"))  # new keys
    assert get().count() == 40
    gone = get().where("length(object_key) < 10").select("object_key").repartition(2)
    put(gone, action="delete")
    put(spark.createDataFrame([("k1.json",)], "object_key string"), action="delete")
    assert get().count() == 20


def test_failed_puts_leave_nothing(spark, tmp_path):
    document_store.register(spark)
    root = tmp_path / "store"
    outside = tmp_path / "x"
    outside.write_text("{}")
    root.mkdir()
    (root / "link.json").symlink_to(outside)
    write = lambda df, **o: df.write.format("document_store").mode("append").options(**o).save(str(root))
    good = spark.range(50).select(F.concat(F.lit("a"), "id").alias("object_key"), F.lit("t").alias("title"))
    for bad in ("../x", "a/b", "/etc/x", "..", ".hidden", "a\\b", "a\0"):
        with pytest.raises(Exception, match="invalid document object key"):
            write(good.union(spark.createDataFrame([(bad, "t")], "object_key string, title string")).repartition(4))
        with pytest.raises(Exception, match="invalid document object key"):
            write(spark.createDataFrame([(bad,)], "object_key string"), action="delete")
        assert names(root) == ["link.json"]
    with pytest.raises(Exception, match="invalid document object key"):
        write(spark.createDataFrame([("link.json",)], "object_key string"), action="delete")
    assert outside.exists()


def test_addresses_as_the_standard_library_has_them(spark):
    r = random.Random(1)
    addresses = []
    for network in map(ipaddress.ip_network, scalars.CLOSED_NETWORKS + scalars.OPEN_INSIDE + ["224.0.0.0/4", "ff00::/8"]):
        for k in (int(network[0]) - 1, int(network[0]), int(network[0]) + 1, int(network[-1]) - 1, int(network[-1]), int(network[-1]) + 1):
            if 0 <= k < 2**network.max_prefixlen:
                addresses.append(type(network[0])(k))
    addresses += [ipaddress.IPv4Address(r.getrandbits(32)) for _ in range(2000)] + [ipaddress.IPv6Address(r.getrandbits(128)) for _ in range(1000)] + [ipaddress.IPv6Address((0x2001 << 112) + r.getrandbits(112)) for _ in range(300)]
    mapped = [ipaddress.IPv6Address((0xFFFF << 32) + r.getrandbits(32)) for _ in range(300)]

    def forms(a):
        v = int(a)
        return [str(a), str(v), hex(v), f"0{v:o}", f"{v >> 24}.{v & 0xFFFFFF}"] if a.version == 4 else [f"[{a}]", f"[{a.exploded}]:8080"]

    late = ipaddress.ip_network("3fff::/20")  # older versions of the library don't know this network as closed
    rows = [(f"http://{h}/x", a.is_global) for a in addresses if a.version == 4 or a not in late for h in forms(a)]
    rows += [(f"http://{h}/", a.ipv4_mapped.is_global) for a in mapped for h in (f"[{a}]", f"[::ffff:{a.ipv4_mapped}]")]
    assert len(rows) > 10_000
    assert spark.createDataFrame(rows, "u string, want boolean").where(F.col("want") != scalars.is_public_url("u")).collect() == []
    other = {"http://a.b": True, "https://u:p@a.b": False, "http://localhost.": False, "http://x.local/": False, "ftp://a.b": False, "http://": False, "http://[1::2::3]/": False, "http://1.2.3.4.5/": False, "http://999.1.1.1/": False, "http://a.b:80?x": True, "http://[fe80::1%25eth0]/": False}
    got = spark.createDataFrame([(u,) for u in other], "u string").select("u", scalars.is_public_url("u")).collect()
    assert dict(map(tuple, got)) == other


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_rounding_by_the_binary_value(spark, digits):
    values = [100 * (0.35 * c / 1000 + 0.25 * m / 7 + 0.25 * g / 16 + 0.15 * q) for c in range(0, 1001, 50) for m in range(8) for g in range(17) for q in (1.0, 0.9, 0.85, 0.65, 0.45)]
    values += [k / 2000 for k in range(4000)] + [k / 20 for k in range(2000)] + [p / q for q in range(1, 90) for p in range(q + 1)] + [0.25, 0.75, 16.55, 0.0625, 0.0375]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", scalars.python_round("x", digits).alias("y")).collect()
    assert [(r.x, r.y) for r in rows if r.y != round(r.x, digits)] == []


def test_cleanup_reads_each_table_once(spark):
    a = spark.createDataFrame([(1, "completed", 10, 1), (2, "running", 10, 1), (3, "failed", 11, 1), (4, None, 12, 1), (5, "completed", None, 1), (6, "completed", 13, None), (7, "completed", 14, 9)], "analysis_id long, state string, document_id long, t int")
    times = lambda df, name: df.withColumn(name, F.timestamp_seconds(F.col("t") * 86_400)).drop("t")
    a = times(a, "expires_at")
    d = times(spark.createDataFrame([(i, t) for i, t in ((10, 1), (11, 1), (12, 1), (13, 1), (14, 1), (15, 1), (16, 5))], "document_id long, t int"), "created_at")
    r = times(spark.createDataFrame([(1, 1), (2, 9)], "resolution_id long, t int"), "expires_at")
    now = F.timestamp_seconds(F.lit(5 * 86_400))
    kept, stay, fresh = lifecycle.retention(a, d, r, now)
    assert sorted(x.analysis_id for x in kept.collect()) == [2, 4, 6, 7]
    counts = lifecycle.cleanup_counts(a, d, r, now)
    assert dict(map(tuple, counts.collect())) == {"analyses": a.count() - kept.count(), "documents": d.count() - stay.count(), "resolutions": 1}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3
    seen_rows, seen = lifecycle.observed(a, "gone", gone=lifecycle.over(now), all=F.lit(True))
    assert seen_rows.where("analysis_id > 3").count() == 4 and seen.get == {"gone": 3, "all": 7}


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("paper_id"), "text")


@pytest.mark.parametrize("limit", [text.TERM_BYTES, 20_000])
def test_ten_thousand_terms_in_one_pass(spark, limit, monkeypatch):
    monkeypatch.setattr(text, "TERM_BYTES", limit)
    monkeypatch.setattr(text.term_blocks, "__defaults__", (limit,))
    r = random.Random(2)
    docs = documents(spark)
    rows = [(d, (t or "").lower()) for d, t in docs.collect()]
    terms = {"aa", "aaa", "e", "é"}
    while len(terms) < 10_000:
        _, t = r.choice(rows)
        at = r.randrange(max(1, len(t)))
        terms.add(t[at : at + r.randrange(1, 12)])
    terms.discard("")
    listed = [(f"m{k % 7}", t) for k, t in enumerate(sorted(terms))]
    chunks = docs.where("paper_id % 10 = 0").select("paper_id", F.lit(1).alias("idx"), F.lit("").alias("section"), "text")
    scored = text.route_scores(chunks, spark.createDataFrame(listed + [("empty", ""), (None, "x")], "module_key string, term string")).collect()
    want = {}
    for d, t in rows:
        if d % 10 == 0:
            for m, term in listed:
                if n := ("\n" + t).count(term):
                    want[d, m] = want.get((d, m), 0) + n
    assert {(x.paper_id, x.module_key): x.score for x in scored} == want


def test_terms_in_titles_and_first_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "Data Use", "data data use"), (1, 1, None, "aaa Data"), (2, 0, "", ""), (3, 1, "x", None)], "paper_id long, idx int, section string, text string")
    got = text.route_scores(chunks, {"m": ["data", "aa"], "n": [], "o": ["Data", "data"]}).collect()
    assert {(x.paper_id, x.idx, x.module_key): x.score for x in got} == {(1, 0, "m"): 6, (1, 0, "n"): 2, (1, 0, "o"): 10, (1, 1, "m"): 2, (1, 1, "o"): 2, (2, 0, "m"): 2, (2, 0, "n"): 2, (2, 0, "o"): 2}


@pytest.mark.parametrize("limit", [grounding.PASSAGE_BYTES, 300])
def test_passages_without_a_known_paper(spark, limit):
    r = random.Random(6)
    word = lambda: r.choice(["a", "é"])
    passages = [(i, " ".join(word() for _ in range(r.randrange(0, 14)))) for i in range(40)] + [(99, None), (None, "a " * 20), (41, "a " * 30)]
    papers = [(i, "\n ".join(word() for _ in range(r.randrange(0, 400)))) for i in range(30)] + [(50, None), (51, ""), (None, "a " * 9)]
    got = grounding.shared_passages(spark.createDataFrame(papers, "paper_id long, text string"), spark.createDataFrame(passages, "passage_id int, text string"), limit=limit).collect()
    runs = lambda t: [tuple((t or "").split()[i : i + 8]) for i in range(len((t or "").split()) - 7)]
    want = []
    for d, t in papers:
        own = runs(t)
        for p, q in passages:
            if p is not None and (both := set(own) & set(runs(q))):
                want.append((d, p, min(own.index(x) for x in both)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 20
    empty = spark.createDataFrame([], "passage_id int, text string")
    assert grounding.shared_passages(documents(spark), empty).count() == 0
