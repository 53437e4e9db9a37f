"""Requests resolved against tables of providers' answers."""

from __future__ import annotations

import hashlib
import json

from docsluice.plans import resolver


def tables(spark, **given):
    keys = {"crossref": "doi", "unpaywall": "doi", "ncbi": "asked", "pubmed": "pmid", "arxiv": "arxiv_id", "publisher": "item", "pages": "url"}
    values = {"pubmed": "xml", "arxiv": "xml", "pages": "html"}
    return resolver.Answers(**{n: spark.createDataFrame(given.get(n, []), f"{k} string, {values.get(n, 'payload')} string") for n, k in keys.items()})


def resolve(spark, requests, **given):
    rows = spark.createDataFrame(list(enumerate(requests)), "request_id long, raw string")
    return {r.request_id: r for r in resolver.resolved(rows, tables(spark, **given)).collect()}


WORK = {"message": {"title": ["On Tea"], "container-title": ["J"], "author": [{"given": "A", "family": "B"}], "published": {"date-parts": [[2001, 2]]}, "abstract": "<p>Hot &amp; cold</p>", "update-to": [{"type": "Retraction", "DOI": "10.1/x"}, {"type": "Correction", "DOI": "10.1/y"}]}}
OPEN = {"oa_locations": [{"url_for_pdf": "https://r.org/s.pdf", "version": "submittedVersion"}, {"url_for_pdf": None, "version": "acceptedVersion"}, {"url_for_pdf": "https://r.org/p.pdf", "version": "publishedVersion", "license": "cc-by"}, {"url_for_pdf": "https://r.org/s.pdf", "version": None}]}


def test_doi_with_all_its_providers(spark):
    got = resolve(
        spark, ["10.1000/ABC.", " https://doi.org/10.1000/abc ", "doi:10.1000/none"],
        crossref=[("10.1000/abc", json.dumps(WORK)), ("10.1000/abc", "broken {")], unpaywall=[("10.1000/abc", json.dumps(OPEN))],
        ncbi=[("10.1000/abc", json.dumps({"records": [{"pmid": "123456", "pmcid": "PMC77", "doi": "10.1000/abc"}]}))],
    )
    a = got[0]
    assert got[1][1:] == a[1:]
    assert (a.route, a.doi, a.pmid, a.pmcid, a.title, a.authors, a.journal, a.published_at, a.abstract) == ("doi", "10.1000/abc", "123456", "PMC77", "On Tea", ["A B"], "J", "2001", "Hot & cold")
    assert a.versions == ["acceptedVersion", "publishedVersion", "submittedVersion"] and a.limitations == [] and a.content_level == "full_text"
    assert a.retracted and not a.expression_of_concern and a.corrections == ['{"type": "correction", "doi": "10.1/y"}']
    # of equal ids the last counts: the submitted version's rank is that of the location without a version
    assert [(c["rank"], c.format, c.provider, c.version, c.license) for c in a.candidates] == [(10, "pdf", "Unpaywall", "publishedVersion", "cc-by"), (25, "jats", "PMC", "publishedVersion", None), (26, "html", "PMC", "publishedVersion", None), (35, "pdf", "Unpaywall", None, None)]
    jats = "https://pmc.ncbi.nlm.nih.gov/api/oai/v1/mh/?verb=GetRecord&identifier=oai:pubmedcentral.nih.gov:77&metadataPrefix=pmc"
    assert a.candidates[1].url == jats and a.candidates[1].id == hashlib.sha1(f"PMC:{jats}:jats".encode()).hexdigest()[:16]
    n = got[2]
    assert (n.doi, n.title, n.content_level, n.limitations, n.candidates, n.refused) == ("10.1000/none", None, "metadata", ["Crossref metadata unavailable."], [], None)


def test_archive_numbers_and_preprints(spark):
    article = "<S><PubmedArticle><MedlineCitation><Article><Journal><Title>J</Title></Journal><ArticleTitle>T <i>x</i></ArticleTitle><Abstract><AbstractText>ab</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></S>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>P</title><summary>s</summary><published>2020</published><author><name>N</name></author></entry></feed>'
    got = resolve(
        spark, ["12345678", "PMC5", "https://pubmed.ncbi.nlm.nih.gov/87654321/", "arXiv:2001.00001v3", "2001.00002", "2001.00003"],
        ncbi=[("12345678", json.dumps({"records": [{"pmid": "12345678", "pmcid": "PMC9"}]}))], pubmed=[("12345678", article), ("87654321", "<S><unclosed>")],
        arxiv=[("2001.00001", atom), ("2001.00002", '<feed xmlns="http://www.w3.org/2005/Atom"></feed>'), ("2001.00003", "not XML")],
    )
    assert (got[0].pmcid, got[0].title, got[0].journal, got[0].abstract, [c.format for c in got[0].candidates]) == ("PMC9", "T x", "J", "ab", ["jats", "html"])
    assert (got[1].pmcid, got[1].pmid, got[1].limitations, got[1].content_level) == ("PMC5", None, [], "full_text")
    assert (got[2].pmid, got[2].limitations, got[2].content_level) == ("87654321", ["PubMed metadata unavailable."], "metadata")
    assert (got[3].arxiv_id, got[3].title, got[3].authors, got[3].candidates[0].url, got[3].candidates[0].version) == ("2001.00001", "P", ["N"], "https://arxiv.org/pdf/2001.00001", "submittedVersion")
    for k in (4, 5):
        assert (got[k].limitations, got[k].candidates) == (["arXiv metadata unavailable."], [])


def test_addresses(spark):
    base = "https://journal.org/"
    meta = lambda **m: "<html>" + "".join(f'<meta name="{k}" content="{v}">' for k, v in m.items()) + "</html>"
    asked = [base + "a.PDF", base + "pdf/1", base + "doi", base + "own", base + "bare", base + "gone", base + "big", "http://127.0.0.1/x.pdf", "https://www.sciencedirect.com/science/article/pii/S1234", "tea", "", None, base + "text"]
    got = resolve(
        spark, asked, crossref=[("10.1000/abc", json.dumps(WORK)), ("10.1000/pii", json.dumps(WORK))],
        publisher=[("S1234", json.dumps({"full-text-retrieval-response": {"coredata": {"prism:doi": "10.1000/PII"}}}))],
        pages=[(base + "doi", meta(citation_doi="10.1000/ABC")), (base + "own", meta(citation_title="Own", citation_pdf_url="/f.pdf")), (base + "bare", "<p>x</p>"), (base + "big", meta(citation_title="x" * 2_000_000)), (base + "text", meta(description="Some text"))],
    )
    one = [(c["rank"], c.provider, c.url) for k in (0, 1, 3) for c in got[k].candidates]
    assert one == [(40, "journal.org", base + "a.PDF"), (40, "journal.org", base + "pdf/1"), (40, "journal.org", base + "f.pdf")]
    assert (got[2].route, got[2].doi, got[2].title) == ("doi", "10.1000/abc", "On Tea") and (got[8].doi, got[8].title) == ("10.1000/pii", "On Tea")
    assert (got[3].title, got[3].content_level, got[12].content_level, got[12].abstract) == ("Own", "full_text", "abstract", "Some text")
    assert {k: got[k].refused for k in (4, 5, 6, 7, 9, 10, 11)} == {4: resolver.NO_RECORD, 5: resolver.NO_PAGE, 6: resolver.TOO_LARGE, 7: resolver.CLOSED, 9: resolver.UNKNOWN, 10: resolver.UNKNOWN, 11: resolver.UNKNOWN}
    assert all(got[k].candidates is None and got[k].route == "refused" for k in (4, 5, 6, 7, 9))


def test_repeated_requests_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "PMC5")] * 300 + [(2, "10.1000/a")], "request_id long, raw string")
    got = resolver.resolved(rows, tables(spark)).groupBy("request_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 300), (2, 1)]
    assert resolver.resolved(rows.limit(0), tables(spark)).count() == 0
