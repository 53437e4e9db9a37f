"""Review operators: published golden values, literals of the reference behaviour, SQL twins."""

from __future__ import annotations

import json
import math

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsluice import catalog, catalog_records, dims  # noqa: F401
from docsluice.functions import scalars as S
from docsluice.operators import grounding, lifecycle, reporting, resolution, scoring, text, validate
from docsluice.plans import review
from docsluice.sources import articles, stores

DATA = "/root/testdata/sf0.001"


def values(spark, expression, *rows):
    """The expression over one-column rows."""
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").orderBy("i").select(expression).collect()]


def scored(spark, grades, profile="general_empirical", level="full_text", **kind):
    rubric = dims.rubric_rows()
    papers = spark.createDataFrame([(1, profile, level, kind.get("reviewer_done", True), kind.get("failures", []))], "paper_id int, profile string, level string, reviewer_done boolean, failures array<string>")
    module_of = {item: m for p, m, _, item in rubric if p == profile}
    rows = [(1, i, module_of[item], item, grade, "accepted") for i, (item, grade) in enumerate(grades)]
    findings = spark.createDataFrame(rows, "paper_id int, pos int, category string, rubric_item string, grade string, critic_disposition string")
    return scoring.review_scores(papers, findings, dims.modules(spark), dims.rubric(spark)).first()


def items(profile="general_empirical"):
    return [item for p, _, _, item in dims.rubric_rows() if p == profile]


def test_all_items_without_concern(spark):
    r = scored(spark, [(i, "no_concern") for i in items()])
    assert (r.review_score, r.available, r.full_review, r.weighted_coverage, r.provisional) == (100.0, 1.0, 1.0, 1.0, False) and r.limitations == []


def test_one_critical_item(spark):
    r = scored(spark, [(i, "critical_concern" if i == "study_question_design" else "no_concern") for i in items()])
    assert r.review_score == pytest.approx(94, abs=0.1)


def test_one_item_only(spark):
    r = scored(spark, [("study_question_design", "no_concern")])
    assert (r.review_score, r.weighted_coverage, r.provisional) == (100.0, 0.06, True)


def test_abstract_level(spark):
    r = scored(spark, [(i, "no_concern") for p, m, _, i in dims.rubric_rows() if p == "general_empirical" and m in ("claims", "disclosures")], level="abstract")
    assert r.available == 1.0 and r.full_review < 0.7 and r.limitations[0] == "The analysis used abstract content, not the full paper."


def test_stored_report(spark):
    claims = [i for p, m, _, i in dims.rubric_rows() if p == "common_core" and m == "claims"][:4]
    r = scored(spark, list(zip(claims, ["no_concern", "no_concern", "no_concern", "minor_concern"])), "common_core", "abstract")
    assert (r.review_score, r.available, r.full_review, r.weighted_coverage) == (93.8, 0.444, 0.2, 0.64)


def test_failures_and_missing_reviewer(spark):
    r = scored(spark, [(i, "no_concern") for i in items()], failures=["design"], reviewer_done=False)
    assert r.provisional and len(r.limitations) == 3


def test_rubric_sizes():
    sizes = {p: sum(1 for q, *_ in dims.rubric_rows() if q == p) for p in dims.PROFILE_ITEMS}
    assert sizes.pop("common_core") == 20 and set(sizes.values()) == {24}


def test_methodology_rules(spark):
    grades = dims.lookup(spark, dims.GRADE_SCORES, "grade", "score")
    assert dims.methodology_faults(dims.modules(spark), grades).count() == 0
    assert {r.rule for r in dims.methodology_faults(dims.modules(spark).where("module_pos > 0"), grades.where("score > 0"), 100, 100).collect()} == {"weights sum to 100", "four grades have scores", "overlap is less than the chunk"}


def test_identifiers(spark):
    assert values(spark, S.normalize_doi("v"), "See 10.5555/ABC(2024).7.", "none", "https://doi.org/10.1000/X).") == ["10.5555/abc(2024).7", None, "10.1000/x"]
    kinds = values(spark, S.identifier("v")["kind"], "10.1/x", "10.1000/x", "PMC123", "12345678", "https://pubmed.ncbi.nlm.nih.gov/123456/", "2401.00001v2", "https://arxiv.org/pdf/2401.00001.pdf", "https://a.org/b", "words")
    assert kinds == ["unknown", "doi", "pmcid", "pmid", "pmid", "arxiv", "arxiv", "url", "unknown"]
    assert values(spark, S.is_public_url("v"), "https://a.org/x", "http://localhost/x", "https://u:p@a.org", "ftp://a.org", "http://10.0.0.1/") == [True, False, False, False, False]


def test_scalars(spark):
    assert values(spark, S.fingerprint("v"), "A  b c") == values(spark, S.fingerprint("v"), "a b c")
    assert values(spark, S.summary_text("v", 12), "short", "one two three four", "one two, three") == ["short", "one two…", "one two…"]
    assert values(spark, S.display_title("v", F.lit("missing_data")), "", "Power: major concern", "Power") == ["Missing Data", "Power", "Power"]
    assert values(spark, S.unfenced("v"), "```json\n{}\n```", " {} ") == ["{}", "{}"]
    assert values(spark, S.last_within("v", ". ", F.lit(2), F.lit(9)), "a. b. c. d", "abc") == [7, -1]
    assert values(spark, S.redacted("v"), "api_key: abc end, Token=x", "x" * 600) == ["api_key=[redacted] end, Token=[redacted]", "x" * 500]
    assert values(spark, S.has_secret("v"), "MY_API_KEY = 1", "Authorization: Bearer x", "api-key: abcdefghijklmnop", "cookie=short", "sk-abcdefghijklmnopqrst", "plain") == [True, True, True, False, True, False]
    assert values(spark, S.duration_text(F.col("v").cast("double")), "125.9") == ["2m 05s"]
    assert values(spark, S.header_map("v"), "a=1, b=2=3,, =x") == [{"a": "1", "b": "2=3"}]
    assert values(spark, S.author_line(F.split("v", ";")), "a;b", "a;b;c;d;e") == ["a, b", "a, b, c, d et al."]
    assert values(spark, S.meta_content("v", "citation_doi"), '<meta content="10.1/x" name="citation_doi">', '<meta name="citation_doi" content="10.1/y">') == ["10.1/x", "10.1/y"]
    assert values(spark, S.telemetry(F.create_map(F.lit("a"), F.col("v"), F.lit("b"), F.col("v")), ["a"], 3), "12345") == [{"a": "123"}]


def test_profiles(spark):
    got = values(spark, text.profile("v"), "A systematic review of randomized trials", "Randomized trials in a systematic review", "a neural network", "a cohort", "our methods", "poem", "cohort and meta-analysis")
    assert got == ["systematic_review_meta_analysis", "randomized_experiment", "computational_ml_modeling", "observational_study", "general_empirical", "common_core", "systematic_review_meta_analysis"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=600), st.integers(20, 80), st.integers(0, 9))
def test_chunks_cover_the_text(value, size, overlap):
    got = text.chunk_bounds(value, size, overlap)
    assert "".join(value[a if i == 0 else max(a, got[i - 1][1]) : b] for i, (a, b) in enumerate(got)) == value
    assert all(b - a <= size for a, b in got) and all(c >= a + size // 2 - overlap for (a, _), (c, _) in zip(got, got[1:]))


def test_eleven_pages(spark):
    pages, at = [], 0
    body = ""
    for k in range(1, 12):
        t = f"Page {k} methods results discussion. " * 145
        pages.append((1, k, at, at + len(t), k))
        body, at = body + t, at + len(t)
    papers = spark.createDataFrame([(1, body)], "paper_id int, text string")
    spans = spark.createDataFrame(pages, "paper_id int, pos int, start int, end int, page int")
    rows = text.containing(text.chunks(papers).withColumn("at", F.col("start")), spans, "page", "first").collect()
    least = math.ceil(len(body) / 3850)
    assert least <= len(rows) <= least + 2 and {1, 5, 11} <= {r.page for r in rows}


def test_disclosures_come_first(spark):
    body = "Front matter with authors.\n" + "Methods text here. " * 180 + "\nFunding: grants paid for it.\nConflict of interest: none. "
    papers = spark.createDataFrame([(1, body)], "paper_id int, text string")
    rows = text.chunks(papers, 1200, 100).withColumns({"page": F.lit(1), "section": F.lit(None).cast("string")})
    picks = text.disclosure_picks(rows, papers)
    chosen = text.routed(text.route_scores(rows, review.module_terms()), picks, 4).where("module_key = 'disclosures'").orderBy("turn").collect()
    last = rows.agg(F.max("idx")).first()[0]
    assert chosen[0].idx in (last, last - 1) and len({r.idx for r in chosen}) == len(chosen) <= 4
    prompt = review.prompts(papers).where("module_key = 'disclosures'").first().prompt
    assert prompt.startswith("<CHUNK id=chunk-") and "Funding" in prompt


def test_page_markers(spark):
    papers = spark.createDataFrame([(1, "[Page 1]aa[Page 12]bb[Page 3]")], "paper_id int, text string")
    assert [(r.at, r.page) for r in text.page_markers(papers).orderBy("at").collect()] == [(0, 1), (10, 12), (21, 3)]


def raw_notes(spark, *contents):
    raw = spark.createDataFrame([(i, "claims", c) for i, c in enumerate(contents)], "paper_id int, module_key string, content string")
    papers = spark.createDataFrame([(i, "common_core", "We  found a\nclear effect. It held.", 1.0) for i in range(len(contents))], "paper_id int, profile string, text string, source_quality double")
    return raw, papers


def note(item="claim_strength", quotes=("found a clear effect",), state="observed", observation="o"):
    return {"rubric_item": item, "observation": observation, "quotes": list(quotes), "evidence_state": state}


def test_worker_notes(spark):
    good = json.dumps({"evidence": [note(observation="x" * 700), note("results_support", ["never said"]), note("causal_language", ["held"], "not_found")]})
    bad = ["no json", json.dumps({"evidence": [note("other")]}), json.dumps({"evidence": [note(), note()]}), json.dumps({"evidence": [note(quotes=["a"] * 9)]}), json.dumps({"evidence": [note(state="maybe")]})]
    raw, papers = raw_notes(spark, f"```json\n{good}\n```", *bad)
    notes, evidence, failures = grounding.worker_notes(raw, papers, dims.rubric(spark))
    assert [r.paper_id for r in failures.orderBy("paper_id").collect()] == [1, 2, 3, 4, 5]
    rows = {r.rubric_item: r for r in notes.collect()}
    assert len(rows) == 5 and len(rows["claim_strength"].observation) == 700 and rows["claim_strength"].quotes == ["found a\nclear effect"]
    assert rows["results_support"].evidence_state == "ambiguous" and rows["causal_language"].evidence_ids == [] and rows["generalization"].observation == grounding.NO_NOTE
    e = evidence.collect()
    assert len(e) == 1 and e[0].evidence_id.startswith("span-") and len(e[0].evidence_id) == 21 and e[0].start == 4


def test_final_findings(spark):
    raw, papers = raw_notes(spark, json.dumps({"evidence": [note()]}))
    _, evidence, _ = grounding.worker_notes(raw, papers, dims.rubric(spark))
    known = evidence.first().evidence_id
    decisions = [("claim_strength", "minor_concern", [known]), ("claim_strength", "no_concern", [known]), ("unheard_of", "no_concern", []), ("results_support", "major_concern", [known]), ("causal_language", "no_concern", ["span-x"])]
    content = json.dumps({"assessments": [{"rubric_item": i, "grade": g, "explanation": "e", "evidence_ids": e} for i, g, e in decisions]})
    reviewer = spark.createDataFrame([(0, "initial", "broken"), (0, "schema_repair", content)], "paper_id int, attempt string, content string")
    rows = grounding.reviewer_decisions(reviewer)
    assert rows.first().repaired
    findings, run = grounding.final_findings(rows, papers, dims.rubric(spark), evidence)
    got = {r.rubric_item: r for r in findings.collect()}
    assert {k: v.grade for k, v in got.items()} == {"claim_strength": "minor_concern", "results_support": "not_assessed", "causal_language": "not_assessed"}
    assert got["claim_strength"].confidence == 1.0 and got["claim_strength"].paper_spans[0].quote == "found a\nclear effect" and got["results_support"].limitations
    r = run.first()
    assert (r.attempts, r.grounded, r.unknown_ids, r.unknown_items, r.repeated_items) == (3, 1, 1, ["unheard_of"], ["claim_strength"])
    whole = review.reviewed(papers.withColumns({"level": F.lit("full_text"), "source_format": F.lit("jats")}), raw, reviewer)
    assert whole["scores"].first().review_score == 75.0 and "assessed 1 of 20" in whole["summaries"].first().summary[-1]
    assert whole["confidence"].count() == 1 and whole["groups"].count() == 5


def test_payload_budget(spark):
    """An entry for each expected item; the literal shape of the contract."""
    papers = spark.createDataFrame([(1, "p"), (2, "p")], "paper_id int, profile string")
    modules = spark.createDataFrame([(f"m{m}", m) for m in range(2)], "module_key string, module_pos int")
    rubric = spark.createDataFrame([("p", f"m{m}", i, f"item{m}{i}") for m in range(2) for i in range(3)], "profile string, module_key string, item_pos int, rubric_item string")
    rows = [(1, f"m{m}", f"item{m}{i}", "observed", "o" * 600, ["q" * 50], ["span-1"]) for m in range(2) for i in range(3) if (m, i) != (1, 1)]
    rows += [(2, "m0", "item00", "not_found", "gone", ["q"], ["span-1"]), (2, "m0", "item01", "observed", "uncited", [], []), (2, "m1", "item10", "observed", 'say "so"', ["q" * 300], ["span-2"])]
    notes = spark.createDataFrame(rows, "paper_id int, module_key string, rubric_item string, evidence_state string, observation string, quotes array<string>, evidence_ids array<string>")
    of = lambda limit: {r.paper_id: r for r in grounding.reviewer_payload(papers, modules, rubric, notes, limit).collect()}
    full, small = of(10_000), of(1900)
    entries = json.loads(full[2].payload)
    assert [e["rubric_item"] for e in entries] == ["item00", "item01", "item02", "item10", "item11", "item12"] and entries[0] == {"module": "m0", "rubric_item": "item00", "evidence": []} == {**entries[1], "rubric_item": "item00"}
    assert entries[3] == {"module": "m1", "rubric_item": "item10", "evidence": [{"id": "span-2", "quote": "q" * 280}], "observation": 'say "so"'} and list(entries[3]) == ["module", "rubric_item", "evidence", "observation"]
    assert full[2].payload == json.dumps(entries) and full[1].dropped == 0 and len(json.loads(full[1].payload)[0]["observation"]) == 500
    assert len(json.loads(small[1].payload)) == 6 and 1200 < len(small[1].payload) <= 1900 and small[1].dropped == 3
    least = len(json.dumps([{"module": f"m{m}", "rubric_item": f"item{m}{i}", "evidence": []} for m in range(2) for i in range(3)]))
    assert of(least)[1].dropped == 5
    with pytest.raises(Exception, match="bare entries"):
        grounding.reviewer_payload(papers, modules, rubric, notes, least - 1).collect()


def test_candidates(spark):
    locations = [{"url_for_pdf": "https://a/p", "version": "publishedVersion", "license": None}, {"url_for_pdf": None, "version": "x", "license": None}, {"url_for_pdf": "https://a/s", "version": "submittedVersion", "license": None}]
    pdfs = resolution.open_access(spark.createDataFrame([("r", json.dumps({"oa_locations": locations}))], "resolution_id string, payload string"))
    ids = resolution.id_records(spark.createDataFrame([("r", json.dumps({"records": [{"pmid": "1", "pmcid": "PMC9", "doi": "d"}]}))], "resolution_id string, payload string"))
    rows = resolution.ranked_candidates(pdfs.unionByName(resolution.archive_candidates(ids)))
    assert [r.format for r in rows.orderBy("rank", "first_pos").collect()] == ["pdf", "jats", "html", "pdf"]
    levels = resolution.content_levels(spark.createDataFrame([("r", "")], "resolution_id string, abstract string"), rows.withColumn("id", F.col("id")))
    assert levels.first().content_level == "full_text" and levels.first().versions == ["publishedVersion", "submittedVersion"]
    first = rows.orderBy("rank").first().id
    failed = spark.createDataFrame([("r", 0, first), ("r", 1, "zz")], "resolution_id string, pos int, id string")
    used = rows.where("format = 'jats'").select("resolution_id", "id", F.lit("").alias("abstract"))
    w = sorted(tuple(r[1:]) for r in resolution.fallback_warnings(used, failed, rows).collect())
    assert w == [(0, True, "PDF · Unpaywall · publishedVersion could not be used; analysis used JATS · PMC · publishedVersion instead."), (1, False, None)]


def test_works_and_context(spark):
    payload = {"message": {"title": ["T"], "container-title": ["J"], "published": {"date-parts": [[2017, 3]]}, "author": [{"given": "A", "family": "B"}, {"given": "", "family": "C"}], "abstract": "<p>x &amp; y</p>", "update-to": []}}
    r = resolution.works(spark.createDataFrame([("d", json.dumps(payload)), ("e", "no")], "doi string, payload string")).orderBy("doi").collect()
    assert (r[0].title, r[0].journal, r[0].authors, r[0].published_at, r[0].abstract) == ("T", "J", ["A B", "C"], "2017", "x & y") and r[1].title is None
    flags = resolution.context_flags(spark.createDataFrame([(1, ["Retraction of", "Correction: x"]), (2, None)], "paper_id int, records array<string>")).orderBy("paper_id").collect()
    assert flags[0].retracted and flags[0].corrections == ["correction: x"] and not flags[1].retracted
    assert len(scoring.status_banners(spark.createDataFrame([(1, True, False, ["x"])], "paper_id int, retracted boolean, expression_of_concern boolean, corrections array<string>")).first().banners) == 2


JATS = """<oai xmlns="y"><article xmlns:xlink="x"><front><journal-meta><journal-title-group><journal-title>J</journal-title></journal-title-group></journal-meta><article-meta><article-id pub-id-type="doi">10.1/A</article-id><article-id>7</article-id>
<title-group><article-title>Title <i>two</i></article-title></title-group><aff>Dept</aff><aff>Dept</aff><abstract><p>Short.</p></abstract><abstract>Plain.</abstract><funding-group>Paid by us</funding-group><author-notes><fn><p>None to declare</p></fn><corresp>mail</corresp></author-notes>
<custom-meta-group><custom-meta><meta-name>Data availability</meta-name><meta-value>On request</meta-value></custom-meta><custom-meta><meta-name>Other</meta-name></custom-meta></custom-meta-group></article-meta></front>
<body><sec><title>Methods</title><p>We did.</p><p>We did.</p><sec><p>More.</p></sec></sec><fig><label>Fig 1</label><caption>A plot</caption></fig><table-wrap><caption>A table</caption></table-wrap></body>
<back><ack><p>Thanks.</p></ack><sec><p>End.</p></sec><fn fn-type="COI-statement">No conflict</fn><fn>other</fn><supplementary-material xlink:href="a"><label>S1</label><caption>Data</caption></supplementary-material><ref-list><ref id="r9">Someone 2001 10.1000/ABC.</ref><ref>Else</ref></ref-list></back></article></oai>"""


def test_jats(spark):
    df = spark.createDataFrame([(1, JATS), (2, "<x"), (3, None)], "paper_id int, xml string")
    rows = [(r.section, r.span_id, r.text) for r in articles.jats_paragraphs(df).orderBy("pos").collect()]
    assert rows == [
        ("Article metadata", "front-metadata-p-0", "Title: Title two"), ("Article metadata", "front-metadata-p-1", "Journal: J"), ("Article metadata", "front-metadata-p-2", "DOI: 10.1/A"), ("Article metadata", "front-metadata-p-3", "IDENTIFIER: 7"),
        ("Abstract", "front-abstract-p-0", "Short."), ("Abstract", "front-abstract-p-1", "Plain."), ("Affiliations", "front-affiliations-p-0", "Dept"), ("Funding", "front-funding-p-0", "Paid by us"), ("Author notes and conflicts", "front-author-notes-p-0", "None to declare"),
        ("Additional disclosures", "front-disclosures-p-0", "Data availability On request"), ("Methods", "body-sec-0-p-0", "We did."), ("Section 2", "body-sec-1-p-0", "More."), ("Back matter 1", "back-sec-0-p-0", "End."), ("Acknowledgments", "back-acknowledgments-p-0", "Thanks."),
        ("Conflicts of interest", "back-conflicts-p-0", "No conflict"), ("Figure and table captions", "captions-p-0", "Fig 1: A plot"), ("Figure and table captions", "captions-p-1", "A table"), ("Supplementary material", "supplements-p-0", "S1 Data"),
    ]
    assert [(r.id, r.doi) for r in articles.jats_references(df).orderBy("pos").collect()] == [("r9", "10.1000/abc"), ("ref-1", None)]
    assert {r.paper_id: r.warning[:19] for r in articles.jats_warnings(df).collect()} == {1: "Supplementary files", 2: "no JATS full text", 3: "no JATS full text"}
    runs = text.paragraph_runs(articles.jats_paragraphs(df)).orderBy("run").collect()
    assert all(a.end == b.start for a, b in zip(runs, runs[1:])) and runs[2].text == "[Affiliations]\nDept\n\n"
    both = spark.createDataFrame([(1, "PMC", "jats", JATS), (2, "PMC", "html", "<article><p>a<br>b"), (3, "PMC", "html", "<article><p>a<br>b</p></article>"), (4, "Other", "jats", JATS), (5, "PMC", "pdf", "x")], "paper_id int, provider string, format string, body string")
    assert {(r.paper_id, r.n) for r in articles.article_paragraphs(both).groupBy("paper_id").agg(F.count("*").alias("n")).collect()} == {(1, 18), (3, 1)}


def test_html_blocks(spark):
    page = "<nav><p>no</p></nav><article><p>first<br>line</p><h1>T</h1><p>one <b>two</b></p><h2>S</h2><p>three<li>four</p></article><p>out</p>"
    assert articles.html_blocks(page) == [("Article", "first line"), ("T", "one two"), ("S", "three four")] and articles.html_blocks(None) == []
    assert articles.html_blocks("<article><p>a &amp; b</p><article><li>c</li></article><figcaption>d</figcaption></article>") == [("Article", "a & b"), ("Article", "c"), ("Article", "d")]


def test_pubmed(spark):
    author = "<Author><LastName>{}</LastName><ForeName>{}</ForeName></Author>"
    xml = f"<PubmedArticleSet><PubmedArticle><MedlineCitation><Article><Journal><Title>J</Title></Journal><ArticleTitle>A <i>b</i>\n c</ArticleTitle><Abstract><AbstractText>One <b>two</b></AbstractText><AbstractText>three</AbstractText></Abstract><AuthorList>{author.format('B', 'A')}<Author><LastName>C</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"
    rows = resolution.pubmed_records(spark.createDataFrame([("1", xml), ("2", "<x/>")], "pmid string, xml string")).orderBy("pmid").collect()
    assert tuple(rows[0]) == ("1", "A b c", ["A B", "C"], "J", "One two three") and rows[1].title is None


def test_pdf_items(spark):
    items = spark.createDataFrame([(1, 1, 0, "Results"), (1, 1, 1, " "), (1, 1, 2, "x" * 27)], "paper_id int, page int, pos int, str string")
    assert [(r.start, r.end) for r in text.page_items(items).orderBy("pos").collect()] == [(0, 7), (8, 35)]


def test_references(spark):
    papers = spark.createDataFrame([(1, "Body\nReferences\nFirst entry long enough 10.1000/Q.\n\nshort\n\nSecond entry that is long enough")], "paper_id int, text string")
    rows = text.references(papers).orderBy("id").collect()
    assert [r.id for r in rows] == ["ref-1", "ref-2"] and rows[0].doi == "10.1000/q"


def test_publication_and_retention(spark):
    now = F.expr("TIMESTAMP '2024-01-10 00:00:00'")
    rows = [(1, "completed", None, "2024-01-11", None, False), (2, "completed", "2024-01-01", "2024-01-31", "s", False), (3, "running", None, "2024-01-09", None, None), (4, "failed", None, "2024-01-09", None, False), (5, "queued", None, "2024-01-20", None, None)]
    a = spark.createDataFrame(rows, "analysis_id int, state string, published_at string, expires_at string, public_slug string, cancel_requested boolean").withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "expires_at")}).withColumns({"document_id": F.col("analysis_id"), "error": F.lit(None).cast("string")})
    chosen = spark.createDataFrame([(1,), (2,)], "analysis_id int")
    p = {r.analysis_id: r for r in lifecycle.published(a, chosen, now).collect()}
    assert str(p[1].expires_at) == "2024-02-09 00:00:00" and str(p[2].expires_at) == "2024-01-31 00:00:00" and p[2].public_slug == "s" and len(p[1].public_slug) == 16
    u = {r.analysis_id: r for r in lifecycle.unpublished(a, chosen, now).collect()}
    assert u[2].published_at is None and str(u[2].expires_at) == "2024-01-11 00:00:00"
    c = {r.analysis_id: r for r in lifecycle.cancelled(a, a.select("analysis_id")).collect()}
    assert c[5].state == "cancelled" and c[3].state == "running" and c[3].cancel_requested and not c[1].cancel_requested
    assert {r.state for r in lifecycle.recovered(a).where("analysis_id in (3, 5)").collect()} == {"failed"}
    docs = spark.createDataFrame([(i, "2024-01-01") for i in range(1, 8)], "document_id int, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    kept, stay, fresh = lifecycle.retention(a, docs, spark.createDataFrame([(1, "2024-01-09")], "resolution_id int, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp")), now)
    assert sorted(r.analysis_id for r in kept.collect()) == [1, 2, 3, 5] and sorted(r.document_id for r in stay.collect()) == [1, 2, 3, 5] and fresh.count() == 0


def test_progress(spark):
    rows = [(1, i, "module", f"m{i}", "completed") for i in range(5)]
    e = spark.createDataFrame(rows, "analysis_id int, pos int, kind string, key string, state string")
    assert [r.progress for r in lifecycle.module_progress(e).orderBy("pos").collect()] == [42, 48, 55, 61, 68]


def test_reports_and_ledger(spark, tmp_path):
    (tmp_path / "reports.json").write_text(json.dumps({"a": {"profile": "p", "composite_score": 5.0, "coverage": {"overall": 0.5}}, "b": {"review_score": 7.0}}))
    rows = {r.case_id: r for r in stores.upgraded_reports(stores.reports_by_case(spark, str(tmp_path / "reports.json"))).collect()}
    assert rows["a"].review_score == 5.0 and rows["a"].coverage.available == 0.5 and rows["b"].coverage.full_review == 0.0
    (tmp_path / "l.jsonl").write_text('{"case_id":"a","outcome":"completed","started_at":"2024-01-01T00:00:00Z"}\n{"case_id":"z","outcome":"failed","started_at":"2024-01-01T00:00:00+00:00","token_usage":{}}\n')
    ledger = stores.attempts(spark, str(tmp_path / "l.jsonl"))
    assert ledger.where("started_at is null").count() == 0
    assert [(r.case_id, r.side) for r in stores.completed_cases_differ(ledger, spark.createDataFrame([("a",), ("b",)], "case_id string")).collect()] == [("b", "manifest")]
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "a", "expected_evidence": [{"id": "e", "terms": ["x"]}]}]}))
    assert stores.evaluation_cases(spark, str(tmp_path / "cases.json")).first().expected_evidence[0].module_key is None
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_text("cookie: abcdefghijklmnopqrstuvwx")
    (tmp_path / "f" / "y.pdf").write_bytes(b"%PDF-1.7 x")
    assert stores.files_with_secrets(spark, str(tmp_path / "f")).count() == 1
    assert sorted(str(r.fault) for r in stores.pdf_files(spark, str(tmp_path / "f")).collect()) == ["None", "not a PDF"]


def test_methodology_files(spark, tmp_path):
    import hashlib

    parts = {"m.json": json.dumps({"modules": [{"key": "a", "label": "A", "weight": 60.0, "minimum_content_level": "abstract", "required_sections": ["methods"], "keywords": ["x"], "items": ["i"]}, {"key": "b", "label": "B", "weight": 40.0, "minimum_content_level": "metadata", "required_sections": [], "keywords": [], "items": []}]}), "w.md": "Worker é", "r.md": "Reviewer"}
    for name, body in parts.items():
        (tmp_path / name).write_text(body)
    paths = [str(tmp_path / n) for n in parts]
    assert stores.bundle_hash(spark, paths) == hashlib.sha256("".join(parts.values()).encode()).hexdigest()
    assert stores.bundle_hash(spark, paths[::-1]) == hashlib.sha256("".join([*parts.values()][::-1]).encode()).hexdigest()
    rows = stores.methodology_modules(spark, paths[0]).orderBy("module_pos").collect()
    assert [(r.module_key, r.min_level, r.terms) for r in rows] == [("a", "abstract", ["methods", "x"]), ("b", "metadata", [])]
    assert dims.methodology_faults(stores.methodology_modules(spark, paths[0]), dims.lookup(spark, dims.GRADE_SCORES, "grade", "score")).count() == 0
    stores.write_reports(spark.createDataFrame([("a", 1.0)], "case_id string, review_score double"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().case_id == "a"


def test_access_and_sessions(spark):
    assert lifecycle.session_seconds(24, 30) == 30 * 86_400 and lifecycle.session_seconds(1000, 1) == 3_600_000
    rows = spark.createDataFrame([(1, "me"), (2, "other"), (3, ""), (4, None)], "analysis_id int, owner string")
    assert [r.analysis_id for r in lifecycle.authorized(rows, F.lit("me"), F.lit(False)).collect()] == [1] and lifecycle.authorized(rows, F.lit(""), F.lit(False)).count() == 0
    assert lifecycle.authorized(rows, F.lit("me"), F.lit(True)).count() == 4


def test_compatibility_hash_is_of_sorted_json(spark):
    import hashlib

    values_ = {f: f"v{i} é" if f == "profile" else f"v{i}" for i, f in enumerate(dims.COMPATIBILITY_FIELDS)}
    got = spark.createDataFrame([tuple(values_.values())], ", ".join(f"{f} string" for f in values_)).select(S.compatibility_key(dims.COMPATIBILITY_FIELDS)).first()[0]
    assert len(values_) == 12 and got == hashlib.sha256(json.dumps(values_, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_rules(spark):
    spans = spark.createDataFrame([(1, 0, 4, "abcd"), (1, 5, 3, "x"), (1, 0, 99, "short")], "paper_id int, start int, end int, text string")
    assert validate.broken(spans, validate.SPAN_RULES).count() == 1 and validate.sound(spans, validate.SPAN_RULES).count() == 2
    assert validate.anchors_outside(spans, spark.createDataFrame([(1, "short")], "paper_id int, text string")).count() == 1
    assert validate.unknown_fields(spark.createDataFrame([('{"a":1,"b":2}',)], "j string"), "j", ["a"]).first().unknown == ["b"]


def test_groups_view(spark):
    findings = spark.createDataFrame([(1, 0, "design", "a", "minor_concern", "accepted"), (1, 1, "design", "b", "critical_concern", "accepted"), (1, 2, "design", "c", "critical_concern", "discarded"), (1, 3, "old_group", "d", "not_assessed", "accepted")], "paper_id int, pos int, category string, rubric_item string, grade string, critic_disposition string")
    statuses = spark.createDataFrame([(1, "design", 0, "Design", "completed", 50.0, 2, 5), (1, "claims", 2, "Claims", "completed", 0.0, 0, 5)], "paper_id int, module_key string, module_pos int, label string, state string, score double, assessed_items int, expected_items int")
    rows = {r.module_key: r for r in reporting.assessment_groups(findings, statuses).collect()}
    assert rows["design"].items == ["b", "a"] and rows["design"].gap_count == 3 and rows["claims"].score is None and rows["old_group"].label == "Old Group" and rows["old_group"].gap_count == 1


def key(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return ""
    return f"{float(v):.6f}" if not isinstance(v, (bool, str)) and hasattr(v, "__float__") and not hasattr(v, "year") and str(v) not in ("True", "False") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    db = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents pages benchmark conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(map(key, r)) for r in got[columns].itertuples(index=False)) == sorted(tuple(map(key, r)) for r in want[columns].itertuples(index=False))


def views(tables):
    db = duckdb.connect()
    for t in tables.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def test_prompts_of_late_chunks(spark, tmp_path):
    """The best chunks of the whole text, in the order of their turns; here they stand after the eighth."""
    filler = "Lorem ipsum. " * 4000
    long = filler + "idiot eau ch and und tion the der. " * 600
    spark.createDataFrame([(1, long), (2, "the der and idiot."), (3, filler)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert db.execute(f"SELECT max(idx) FROM ({catalog.ROUTE_SQL})").fetchone()[0] > 12
    want = db.execute(catalog.ORACLE_SQL["module_prompts"]).df()
    got = {(r.paper_id, r.module_key): r.digest for r in catalog.QUERIES["module_prompts"](spark, str(tmp_path)).collect()}
    assert got == {(r.paper_id, r.module_key): r.digest for r in want.itertuples()}
