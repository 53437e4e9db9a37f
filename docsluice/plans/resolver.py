"""What readers type, resolved against tables of providers' answers: one row a request.

The kind of an identifier chooses its providers: a DOI those of works, open access and identifiers,
a PMID or PMCID the archive's, an arXiv number the preprint server; an address may stand for a DOI
(by a publisher's item number or the page's own elements), be a PDF itself, or give its page's record.

Equal requests and equal keys are resolved once: both are made distinct before any answer is joined,
so a paper that a third of all requests ask for costs one lookup, and only the join that hands results
back meets its rows (Spark splits such a join at run time).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import candidate_id, identifier, is_public_url
from ..operators import resolution
from ..sources.articles import entry_identity

#: Largest publisher page, in bytes.
PAGE_BYTES = 2_000_000
#: What one paper is known by, and what is known of it.
IDENTITY = "doi string, arxiv_id string, pmid string, pmcid string, title string, authors array<string>, journal string, published_at string, updated_at string, abstract string, versions array<string>, retracted boolean, expression_of_concern boolean, corrections array<string>, limitations array<string>"
CANDIDATE = ["id", "format", "url", "version", "license", "provider", "content_level", "rank"]
# fixed values: sentences that callers show
UNKNOWN = "Enter a DOI, arXiv ID, PMID, PMCID, or absolute scholarly URL"
CLOSED = "The address is not public."
TOO_LARGE = "Publisher page is too large"
NO_PAGE = "The publisher page could not be accessed. Enter the paper's DOI, PMID, or PMCID instead."
NO_RECORD = "The publisher page did not expose a canonical paper record. Enter its DOI, PMID, or PMCID instead."


@dataclass(frozen=True)
class Answers:
    """Providers' answers by what was asked. No row, or null, or what does not parse, is no answer; of several, the least text counts."""

    crossref: DataFrame  # doi, payload
    unpaywall: DataFrame  # doi, payload
    ncbi: DataFrame  # asked (a DOI, PMID or PMCID), payload
    pubmed: DataFrame  # pmid, xml
    arxiv: DataFrame  # arxiv_id, without a version, xml
    publisher: DataFrame  # item, payload
    pages: DataFrame  # url, html


def _one(answers: DataFrame, key: str, value: str) -> DataFrame:
    return answers.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def _json(answers: DataFrame, key: str) -> DataFrame:
    """One answer a key, of those that are JSON."""
    return _one(answers.where(F.try_parse_json("payload").isNotNull()), key, "payload")


def _xml(answers: DataFrame, key: str) -> DataFrame:
    """One answer a key; null if it is not well formed, which XPath would stop the job for."""
    broken = F.from_xml("xml", "_corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()
    return _one(answers, key, "xml").withColumn("xml", F.when(F.startswith(F.ltrim("xml"), F.lit("<")) & ~F.coalesce(broken, F.lit(False)), F.col("xml")))


def _shaped(rows: DataFrame) -> DataFrame:
    """key and all columns of IDENTITY; flags that rows lacks are false, lists empty, the rest null."""
    kinds = [c.split(" ", 1) for c in IDENTITY.split(", ")]
    unset = {"boolean": F.lit(False), "array<string>": F.array()}
    return rows.select("key", *[F.coalesce(F.col(n) if n in rows.columns else F.lit(None), unset.get(t, F.lit(None))).cast(t).alias(n) for n, t in kinds])


def _candidates(rows: DataFrame) -> DataFrame:
    """(key, candidates): each id once, by rank, then by place."""
    whole = rows.select(F.col("key").alias("resolution_id"), "pos", *CANDIDATE)
    ranked = resolution.ranked_candidates(whole)
    listed = ranked.groupBy(F.col("resolution_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("rank", "first_pos", *[c for c in CANDIDATE if c != "rank"]))).alias("_c"))
    return listed.select("key", F.transform("_c", lambda c: F.struct(*[c[n].alias(n) for n in CANDIDATE])).alias("candidates"))


def _pdf(key: Column, url: Column, provider: Column, version: str | None, rank: int) -> list[Column]:
    none = F.lit(None).cast("string")
    return [key.alias("key"), F.lit(0).alias("pos"), candidate_id(provider, url, F.lit("pdf")).alias("id"), F.lit("pdf").alias("format"), url.alias("url"), (none if version is None else F.lit(version)).alias("version"), none.alias("license"), provider.alias("provider"), F.lit("full_text").alias("content_level"), F.lit(rank).alias("rank")]


def _archive(records: DataFrame) -> DataFrame:
    return resolution.archive_candidates(records.withColumnRenamed("key", "resolution_id"), base=1_000_000).withColumnRenamed("resolution_id", "key").select("key", "pos", *CANDIDATE)


def _dois(keys: DataFrame, a: Answers) -> tuple[DataFrame, DataFrame]:
    works = resolution.works(_json(a.crossref, "doi"))
    works = resolution.context_flags(works.select(F.struct("*").alias("paper_id"), resolution.update_texts("updates").alias("records"))).select("paper_id.*", "retracted", "expression_of_concern", "corrections")
    free = _json(a.unpaywall, "doi").withColumnRenamed("doi", "resolution_id")
    ids = resolution.id_records(_json(a.ncbi, "asked").withColumnRenamed("asked", "resolution_id")).where("pmcid is not null").select(F.col("resolution_id").alias("key"), "pmid", "pmcid")
    known = keys.join(works.withColumnRenamed("doi", "key").withColumn("_there", F.lit(True)), "key", "left").join(resolution.open_access_versions(free).withColumnRenamed("resolution_id", "key"), "key", "left").join(ids, "key", "left")
    lacking = F.when(F.col("_there").isNull(), F.array(F.lit("Crossref metadata unavailable."))).otherwise(F.array().cast("array<string>"))
    found = known.withColumns({"doi": F.col("key"), "limitations": lacking})
    open_pdf = resolution.open_access(free).withColumnRenamed("resolution_id", "key").select("key", "pos", *CANDIDATE).join(keys, "key", "left_semi")
    return _shaped(found), open_pdf.union(_archive(keys.join(ids, "key")))


def _archive_numbers(keys: DataFrame, a: Answers) -> tuple[DataFrame, DataFrame]:
    ids = resolution.id_records(_json(a.ncbi, "asked").withColumnRenamed("asked", "resolution_id")).withColumnsRenamed({"resolution_id": "key", "pmid": "_pmid", "pmcid": "_pmcid"})
    numbered = keys.join(ids, "key", "left").select(
        "key", "doi", F.coalesce("_pmid", F.when(F.col("key").rlike(r"^\d+$"), F.col("key"))).alias("pmid"), F.coalesce("_pmcid", F.when(F.startswith("key", F.lit("PMC")), F.col("key"))).alias("pmcid")
    )
    works = resolution.pubmed_records(_xml(a.pubmed, "pmid").where("xml is not null")).withColumn("_there", F.lit(True))
    lacking = F.when(F.col("_there").isNull() & F.col("pmid").isNotNull(), F.array(F.lit("PubMed metadata unavailable."))).otherwise(F.array().cast("array<string>"))
    return _shaped(numbered.join(works, "pmid", "left").withColumn("limitations", lacking)), _archive(numbered.select("key", "pmid", "pmcid", "doi"))


def _preprints(keys: DataFrame, a: Answers) -> tuple[DataFrame, DataFrame]:
    """An answer without any field of an entry is none."""
    entries = entry_identity(_xml(a.arxiv, "arxiv_id").where("xml is not null"))
    there = F.coalesce("title", "abstract", "published_at", "doi").isNotNull() | (F.size("authors") > 0)
    known = keys.withColumn("arxiv_id", F.regexp_replace("key", r"v\d+$", "")).join(entries.withColumn("_there", there), "arxiv_id", "left")
    lacking = F.when(F.coalesce("_there", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("arXiv metadata unavailable.")))
    url = F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id")
    return _shaped(known.withColumn("limitations", lacking)), known.where("_there").select(*_pdf(F.col("key"), url, F.lit("arXiv"), "submittedVersion", resolution.ARXIV_RANK))


def _addresses(urls: DataFrame, a: Answers) -> DataFrame:
    """urls(value) to their routes, with the page's own record where it counts."""
    items = resolution.publisher_records(_json(a.publisher, "item")).withColumnRenamed("doi", "_doi")
    numbered = resolution.publisher_dois(urls.select(F.col("value").alias("id"), F.col("value").alias("url"))).join(items, "item", "left").select(F.col("id").alias("value"), F.coalesce("doi", "_doi").alias("doi"))
    large = F.octet_length("html") > PAGE_BYTES
    pages = _one(a.pages, "url", "html").where("html is not null").select(F.struct("url", large.alias("large")).alias("page_id"), "url", F.when(~large, F.col("html")).alias("html"))
    records = resolution.page_metadata(pages).select(F.col("page_id.url").alias("value"), "page_id.large", F.col("doi").alias("page_doi"), "title", "abstract", "pdf_url")
    path = F.lower(F.coalesce(F.try_parse_url("value", F.lit("PATH")), F.lit("")))
    is_pdf = F.endswith(path, F.lit(".pdf")) | F.contains(path, F.lit("/pdf/"))
    route = F.when(F.col("doi").isNotNull(), "doi").when(is_pdf, "pdf").when(F.col("large").isNull() | F.col("large"), "refused").when(F.col("page_doi").isNotNull(), "doi").when(F.coalesce("title", "abstract", "pdf_url").isNull(), "refused").otherwise("page")
    seen = numbered.join(records, "value", "left").withColumn("route", route)
    why = F.when(F.col("route") == "refused", F.when(F.col("large").isNull(), NO_PAGE).when(F.col("large"), TOO_LARGE).otherwise(NO_RECORD))
    key = F.when(F.col("route") == "doi", F.coalesce("doi", "page_doi")).when(F.col("route") != "refused", F.col("value"))
    return seen.select("value", "route", key.alias("key"), why.alias("refused"), "title", "abstract", F.when(F.col("route") == "pdf", F.col("value")).otherwise(F.col("pdf_url")).alias("pdf_url"))


def _own_records(addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identities and candidates of addresses that are a PDF or have no more than their page's record."""
    own = addresses.where("route IN ('pdf', 'page')")
    host = F.coalesce(F.lower(F.try_parse_url("key", F.lit("HOST"))), F.lit("URL"))
    identities = own.select("key", *[F.when(F.col("route") == "page", F.col(c)).alias(c) for c in ("title", "abstract")])
    return _shaped(identities), own.where("pdf_url is not null").select(*_pdf(F.col("key"), F.col("pdf_url"), host, None, resolution.DIRECT_RANK))


def resolved(requests: DataFrame, answers: Answers) -> DataFrame:
    """requests(request_id, raw) to one row a request: route, identity, context, candidates, content level, limitations.

    A request that cannot be resolved has the reason in `refused` and nulls elsewhere; null and empty
    texts are such. Repeated request ids keep a row each. The best candidate comes first.
    """
    asked = requests.select("request_id", F.trim(F.coalesce("raw", F.lit(""))).alias("value"))
    kinds = asked.select("value").distinct().withColumn("_i", identifier("value")).select("value", F.col("_i.kind").alias("kind"), F.col("_i.key").alias("key"))
    addresses = _addresses(kinds.where("kind = 'url'").select("value"), answers)
    none = F.lit(None).cast("string")
    route = F.when(F.col("kind").isin("pmid", "pmcid"), "ncbi").when(F.col("kind") == "unknown", "refused").otherwise(F.col("kind"))
    closed = F.struct(F.lit("refused").alias("route"), none.alias("key"), F.lit(CLOSED).alias("refused"))
    open_only = addresses.select("value", F.when(is_public_url("value"), F.struct("route", "key", "refused")).otherwise(closed).alias("_r")).select("value", "_r.*")
    routes = kinds.where("kind <> 'url'").select("value", route.alias("route"), "key", F.when(F.col("kind") == "unknown", UNKNOWN).otherwise(none).alias("refused")).union(open_only)

    typed = lambda *names: kinds.where(F.col("kind").isin(*names)).select("key")
    keys = {"doi": typed("doi").union(addresses.where("route = 'doi'").select("key")), "ncbi": typed("pmid", "pmcid"), "arxiv": typed("arxiv")}
    parts = [(kind, *work(keys[kind].distinct(), answers)) for kind, work in (("doi", _dois), ("ncbi", _archive_numbers), ("arxiv", _preprints))]
    parts.append(("own", *_own_records(addresses)))
    named = lambda rows, kind: rows.withColumn("key", F.concat(F.lit(kind + " "), "key"))  # noqa: E731, keys of different routes are never equal
    identities = reduce(DataFrame.unionByName, [named(i, k) for k, i, _ in parts])
    candidates = _candidates(reduce(DataFrame.unionByName, [named(c, k) for k, _, c in parts]))

    level = F.when(F.size("candidates") > 0, "full_text").when(F.length("abstract") > 0, "abstract").otherwise("metadata")
    papers = identities.join(candidates, "key", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(candidates.schema["candidates"].dataType))).withColumn("content_level", level)
    prefix = F.when(F.col("route").isin("pdf", "page"), "own").otherwise(F.col("route"))
    by_value = routes.select("value", "route", "refused", F.concat(prefix, F.lit(" "), F.col("key")).alias("key")).join(papers, "key", "left").drop("key")
    return asked.join(by_value, "value").drop("value")
