"""Scalar functions of the review engine as column expressions; Python runs on the executors only for character references."""

from __future__ import annotations

import html
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it.
BLANK = r"(?U)\s+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _found(c: str | Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit(""))


def collapsed(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(c), BLANK, " "))


#: 2 * 10**digits as powers of two, so chosen that all partial differences below are exact.
_DOUBLED = {1: (16, 4), 2: (256, -64, 8), 3: (2048, -32, -16)}


def python_round(c: str | Column, digits: int) -> Column:
    """round(x, digits) of a double from 0 to 2**40 by its exact binary value, halves to the even digit.

    Rounding by the decimal digits that a double prints goes wrong where they are a half and the
    double is not. n / (2 * 10**digits) is the half above the lower candidate; x is on the side of it
    that x * 2 * 10**digits - n says, a sum of exact products and differences.
    """
    x, scale = _col(c).cast("double"), 10**digits
    low = F.floor(x * scale)
    first, *others = _DOUBLED[digits]
    side = x * first - (low * 2 + 1)
    for power in others:
        side = side + x * power
    up = (side > 0) | (side == 0) & (low % 2 == 1)
    return (low + up.cast("long")) / F.lit(float(scale))


# identifiers (fixed values: the patterns by which identifiers are known)

DOI = r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"


def normalize_doi(c: str | Column) -> Column:
    """The first DOI in a text, lower case, without closing marks; null if none."""
    return F.lower(F.regexp_replace(_found(c, DOI), r"[.,;)\]]+$", ""))


def arxiv_id(c: str | Column) -> Column:
    """A bare arXiv identifier, or the one in an arxiv.org abstract or PDF address."""
    number = r"(?:\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z\-]+)?/\d{7})(?:v\d+)?"
    bare = _found(F.trim(_col(c)), rf"(?i)^(?:arxiv:\s*)?({number})$")
    return F.coalesce(bare, _found(c, rf"(?i)^https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/({number})(?:\.pdf)?/?(?:[?#].*)?$"))


def pmcid(c: str | Column) -> Column:
    return F.concat(F.lit("PMC"), _found(c, r"(?i)\bPMC(\d+)\b"))


def pmid(c: str | Column) -> Column:
    """6 to 9 digits: the whole value, or in a value that names PubMed."""
    digits = _found(c, r"\b(\d{6,9})\b")
    return F.when(F.trim(_col(c)).rlike(r"^\d{6,9}$") | F.contains(F.lower(_col(c)), F.lit("pubmed")), digits)


def publisher_item(c: str | Column) -> Column:
    """An S-number of a publisher's article, without marks."""
    return F.upper(F.regexp_replace(_found(c, r"(?i)\b(S\d{4}-?\d{3}[\dX]\(?\d{2}\)?\d{5}-?[\dX])(?![0-9A-Za-z])"), r"[-()]", ""))


def is_resolvable(c: str | Column) -> Column:
    v = F.trim(_col(c))
    return v.rlike(r"(?i)^https?://\S+$") | v.rlike(r"(?i)^(?:doi:\s*)?10\.\d{4,9}/\S+$") | v.rlike(r"(?i)^PMC\d+$") | v.rlike(r"^\d{6,9}$") | arxiv_id(v).isNotNull()


def identifier(c: str | Column) -> Column:
    """(kind, key): the first of DOI (not inside other addresses), PMCID, PMID, arXiv, URL that applies."""
    v = F.trim(_col(c))
    is_url = v.rlike(r"(?i)^https?://")
    host = F.lower(F.try_parse_url(v, F.lit("HOST")))
    doi, pmc, pm, ax = normalize_doi(v), pmcid(v), pmid(v), arxiv_id(v)
    own_doi = doi.isNotNull() & (~is_url | F.coalesce(host.rlike(r"(^|\.)doi\.org$"), F.lit(False)))

    def found(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    return F.when(own_doi, found("doi", doi)).when(pmc.isNotNull(), found("pmcid", pmc)).when(pm.isNotNull(), found("pmid", pm)).when(ax.isNotNull(), found("arxiv", ax)).when(is_url, found("url", v)).otherwise(found("unknown", F.lit(None).cast("string")))


def canonical_identifier(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(c))), r"^(?:https://doi\.org/|doi:|arxiv:)", "")


# Networks whose addresses are not reachable from everywhere, and those inside them that are.
CLOSED_NETWORKS = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 "
    "::/128 ::1/128 ::ffff:0:0/96 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 3fff::/20 fc00::/7 fe80::/10"
).split()
OPEN_INSIDE = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
LOCAL_NAMES = ("localhost", "localhost.localdomain")


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv4_digits(host: Column) -> Column:
    """Eight hexadecimal digits of an IPv4 address; parts may be decimal, octal or hexadecimal, the last one fills what is left. Null if it is none."""
    part = lambda x: F.when(x.rlike(r"^0x[0-9a-f]{1,8}$"), F.conv(F.substr(x, F.lit(3)), 16, 10)).when(x.rlike(r"^0[0-7]{0,11}$"), F.conv(x, 8, 10)).when(x.rlike(r"^[1-9]\d{0,9}$"), x).cast("long")

    def joined(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        room = F.pow(F.lit(256.0), 5 - n).cast("long")
        good = n.between(1, 4) & F.forall(F.slice(parts, 1, n - 1), lambda x: x <= 255) & (last < room)
        value = F.aggregate(F.slice(parts, 1, n - 1), F.lit(0).cast("long"), lambda v, x: v * 256 + x) * room + last
        return F.when(F.coalesce(good, F.lit(False)), F.lpad(F.lower(F.hex(value)), 8, "0"))

    return _let(F.transform(F.slice(F.split(host, r"\."), 1, 5), part), joined)


def ipv6_digits(host: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address (its last four bytes may be written as IPv4); null if it is none."""
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def joined(sides: Column) -> Column:
        left, right = groups(sides[0]), F.when(F.size(sides) == 2, groups(F.get(sides, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        n = F.size(left) + F.size(right)
        fits = F.when(F.size(sides) == 1, n == 8).otherwise((F.size(sides) == 2) & (n <= 7))
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
        return F.when(fits, F.array_join(F.transform(every, lambda x: F.when(x.rlike("^[0-9a-f]{1,4}$"), F.lpad(x, 4, "0")).otherwise("?")), ""))

    def plain(tail: Column) -> Column:
        own = _let(F.when(~tail.rlike(r"(^|\.)0\d"), ipv4_digits(tail)), lambda d: F.concat(F.left(d, F.lit(4)), F.lit(":"), F.right(d, F.lit(4))))
        return F.when(tail == "", host).otherwise(F.concat(F.regexp_replace(host, r"[^:]+$", ""), own))

    whole = _let(F.regexp_extract(host, r":(\d+\.\d+\.\d+\.\d+)$", 1), plain)
    return _let(_let(F.split(whole, "::"), joined), lambda digits: F.when(digits.rlike("^[0-9a-f]{32}$"), digits))


def _inside(digits: Column, networks: list[str]) -> Column:
    """Whether an address is in one of the networks: its digits lie between their first and last ones."""
    ranges = [(f"{int(n[0]):0{n.max_prefixlen // 4}x}", f"{int(n[-1]):0{n.max_prefixlen // 4}x}") for n in map(ipaddress.ip_network, networks)]
    table = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in sorted(ranges)])
    return F.exists(table, lambda r: (F.length(r["low"]) == F.length(digits)) & digits.between(r["low"], r["high"]))


def is_open_address(digits: Column) -> Column:
    """Whether 8 or 32 digits are an address that can be reached from everywhere; an IPv4 address inside an IPv6 one counts itself."""
    own = F.when(F.startswith(digits, F.lit("0" * 20 + "ffff")), F.right(digits, F.lit(8))).otherwise(digits)
    return _let(own, lambda d: ~_inside(d, CLOSED_NETWORKS) | _inside(d, OPEN_INSIDE))


def is_public_url(c: str | Column) -> Column:
    """http(s), no credentials, and a host that is no local name nor a closed address in any notation; addresses behind names need the network."""

    def named(host: Column) -> Column:
        name = (host != "") & ~host.isin(*LOCAL_NAMES) & ~host.rlike(r"\.local(host)?$") & ~host.rlike(r":|^[\d.]+$")
        return _let(ipv4_digits(host), lambda four: F.when(four.isNotNull(), is_open_address(four)).otherwise(name))

    def judged(authority: Column) -> Column:
        literal = F.regexp_extract(authority, r"^\[([^\]%]*)(?:%25[^\]]+)?\](?::\d*)?$", 1)
        host = F.rtrim(F.regexp_replace(authority, r":\d*$", ""), F.lit("."))
        return F.when(F.startswith(authority, F.lit("[")), is_open_address(ipv6_digits(literal))).otherwise(_let(host, named))

    authority = F.lower(F.regexp_extract(_col(c), r"(?i)^https?://([^/?#@\\\s]+)(?:[/?#]|$)", 1))
    return F.coalesce(_let(authority, judged), F.lit(False))


# texts

def fingerprint(c: str | Column) -> Column:
    """SHA-256 of the lower-cased text with its white space collapsed."""
    return F.sha2(collapsed(F.lower(_col(c))), 256)


def quote_key(c: str | Column) -> Column:
    """What audits compare: lower case, no soft hyphens, white space collapsed."""
    return collapsed(F.regexp_replace(F.lower(_col(c)), "­", ""))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def character_references(c: str | Column) -> Column:
    """All character references decoded; texts without an ampersand reach Python as nulls."""
    v = _col(c)
    return F.coalesce(_unescaped(F.when(F.contains(v, F.lit("&")), v)), v)


def stripped_markup(c: str | Column) -> Column:
    """Tags become blanks and all character references are decoded; null if nothing is left."""
    return F.nullif(collapsed(character_references(F.regexp_replace(_col(c), r"<[^>]+>", " "))), F.lit(""))


def summary_text(c: str | Column, limit: int = 280) -> Column:
    """At most `limit` characters and an ellipsis, cut at a word's end if there is one; marks before the ellipsis go."""
    v = collapsed(c)
    cut = F.regexp_replace(F.left(v, F.lit(limit + 1)), r" [^ ]*$", "")
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.regexp_replace(cut, r"[.,;:]+$", ""), F.lit("…")))


def label(c: str | Column) -> Column:
    v = F.left(F.regexp_replace(_col(c), r"[^A-Za-z0-9_.:\-]+", "_"), F.lit(80))
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("n/a"))


def title_case(c: str | Column) -> Column:
    """Underscores as blanks, and every run of letters with a capital first."""
    runs = F.regexp_extract_all(F.lower(F.replace(_col(c), F.lit("_"), F.lit(" "))), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))), "")


def display_title(title: str | Column, item: str | Column) -> Column:
    """The title without a grade at its end; the item's name where there is none."""
    v = F.regexp_replace(F.trim(_col(title)), r"(?i)\s*[:–—-]\s*(?:no|minor|major|critical)[ _]concern$|\s*[:–—-]\s*not[ _]assessed$", "")
    return F.coalesce(F.nullif(v, F.lit("")), title_case(item))


def occurrences(text: str | Column, term: str | Column) -> Column:
    """How often a term occurs without overlap."""
    text, term = _col(text), _col(term)
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")).otherwise(0)


def last_within(text: str | Column, term: str, low: Column, high: Column) -> Column:
    """Offset (from 0) of the last occurrence wholly in [low, high); -1 if none."""
    part = F.substring(_col(text), low + 1, high - low)
    back = F.instr(F.reverse(part), term[::-1])
    return F.when(back > 0, low + F.length(part) - back - len(term) + 1).otherwise(-1)


# What counts as a credential in published files, and what is cut from error texts.
SECRETS = [r"(?i)[A-Z0-9_]*API_KEY\s*=", r"(?i)authorization\s*[:=]\s*bearer", r"(?i)(?:api[_-]?key|cookie)\s*[:=]\s*[A-Za-z0-9_-]{16,}", r"\bsk-[A-Za-z0-9_-]{20,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"]
CREDENTIAL = r"(?i)(api[_ -]?key|authorization|cookie|token)\s*[:=]\s*\S+"


def has_secret(c: str | Column) -> Column:
    return _col(c).rlike("|".join(f"(?:{p})" for p in SECRETS))


def redacted(c: str | Column, limit: int = 500) -> Column:
    """An error text with the values of credentials cut, at most `limit` characters."""
    return F.left(F.regexp_replace(_col(c), CREDENTIAL, "$1=[redacted]"), F.lit(limit))


def unfenced(c: str | Column) -> Column:
    """Model output without code fences around it."""
    v = F.trim(_col(c))
    return F.when(F.startswith(v, F.lit("```")), F.regexp_replace(v, r"(?i)^```(?:json)?\s*|\s*```$", "")).otherwise(v)


def content_text(text: str | Column, structured: str | Column | None = None) -> Column:
    """A model's content as text: its text without white space around it, else its structure as JSON, else nothing."""
    plain = F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")
    return F.coalesce(plain, F.to_json(_col(structured)), F.lit("")) if structured is not None else F.coalesce(plain, F.lit(""))


def url_join(base: str | Column, link: str | Column) -> Column:
    """A link of a page as an address: absolute ones stay, others stand below the page's scheme, host or folder."""
    base, link = _col(base), F.trim(_col(link))
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    page = F.concat(root, path)
    steps = F.split(F.concat(folder, F.regexp_extract(link, r"^([^?#]*)", 1)), "/")
    # '..' takes back the step before it; a closing '.' or '..' leaves its folder
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda out, s: F.when(s == ".", out).when(s == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(out)).otherwise(F.array_append(out, s)))
    closing = F.when(F.element_at(steps, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    relative = F.concat(root, F.array_join(closing, "/"), F.regexp_extract(link, r"^[^?#]*(.*)$", 1))
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link)).when(F.startswith(link, F.lit("/")), F.concat(root, link)).when(link == "", F.concat(page, query))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link)).when(F.startswith(link, F.lit("#")), F.concat(page, query, link)).otherwise(relative)
    )


# digests

def evidence_id(module: Column, item: Column, state: Column, start: Column, end: Column, quote: Column) -> Column:
    return F.concat(F.lit("span-"), F.left(F.sha1(F.concat_ws(":", module, item, state, start.cast("string"), end.cast("string"), quote).cast("binary")), F.lit(16)))


def finding_id(category: str | Column, item: str | Column) -> Column:
    return F.left(F.sha1(F.concat_ws(":", _col(category), _col(item)).cast("binary")), F.lit(12))


def candidate_id(provider: str | Column, url: str | Column, fmt: str | Column) -> Column:
    return F.left(F.sha1(F.concat_ws(":", _col(provider), F.coalesce(_col(url), F.lit("None")), _col(fmt)).cast("binary")), F.lit(16))


def cache_key(c: str | Column) -> Column:
    return F.sha2(F.concat(F.lit("2:"), F.lower(F.trim(_col(c)))).cast("binary"), 256)


def compatibility_key(fields: list[str]) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys; equal settings give equal keys."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


# numbers, times, names

def percent(c: str | Column) -> Column:
    return F.floor(_col(c) * 100 + 0.5).cast("int")


def duration_text(seconds: str | Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(_col(seconds)).cast("int"))
    return F.format_string("%dm %02ds", F.floor(s / 60).cast("int"), (s % 60).cast("int"))


def leading_year(c: str | Column) -> Column:
    return F.when(_col(c).rlike(r"^[0-9]{4}"), F.left(_col(c), F.lit(4)).cast("int"))


def year_within(c: str | Column) -> Column:
    return _found(c, r"\b((?:19|20)\d{2})\b").cast("int")


def author_line(authors: str | Column, shown: int = 4) -> Column:
    a = _col(authors)
    return F.concat(F.array_join(F.slice(a, 1, shown), ", "), F.when(F.size(a) > shown, F.lit(" et al.")).otherwise(F.lit("")))


def full_name(given: str | Column, family: str | Column) -> Column:
    return F.concat_ws(" ", F.nullif(F.trim(_col(given)), F.lit("")), F.nullif(F.trim(_col(family)), F.lit("")))


def source_label(fmt: str | Column, provider: str | Column, version: str | Column) -> Column:
    return F.concat_ws(" · ", *[F.left(collapsed(x), F.lit(80)) for x in (F.upper(_col(fmt)), _col(provider), F.nullif(_col(version), F.lit("")))])


def paper_links(doi: Column, arxiv: Column, pubmed: Column, pmc: Column, source: Column) -> Column:
    """Addresses of a paper in fixed order, its source last if it is another."""
    known = F.array_compact(F.array(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://arxiv.org/abs/"), arxiv), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pubmed, F.lit("/")), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmc, F.lit("/"))))
    return F.array_distinct(F.when(source.isNotNull(), F.array_append(known, source)).otherwise(known))


# fixed values: the labels of states, of coverage and of concerns
def state_label(c: str | Column) -> Column:
    v = _col(c)
    return F.when(v == "completed", "Review completed").when(v == "module_failed", "Review failed").when(v == "ineligible_at_content_level", "Unavailable for this content").when(v == "unreviewed", "Review incomplete").otherwise("Review status unavailable")


def coverage_label(provisional: str | Column) -> Column:
    return F.when(_col(provisional), "Provisional coverage").otherwise("Final coverage")


def concern_label(n: str | Column, assessed: str | Column, expected: str | Column) -> Column:
    n, assessed, expected = _col(n), _col(assessed), _col(expected)
    return F.when(n == 1, "1 concern").when(n > 0, F.format_string("%d concerns", n)).when(assessed == 0, "No items assessed").when(assessed < expected, "No concerns in assessed items").otherwise("No concerns")


def telemetry(attributes: str | Column, allowed: list[str], limit: int = 160) -> Column:
    """Attributes with allowed names that have a value, cut to the limit."""
    kept = F.map_filter(_col(attributes), lambda k, v: k.isin(*allowed) & v.isNotNull())
    return F.transform_values(kept, lambda k, v: F.left(v, F.lit(limit)))


def header_map(c: str | Column) -> Column:
    """k=v,k2=v2 as a map; blanks and parts without a name are dropped."""
    parts = F.filter(F.split(_col(c), ","), lambda p: p.rlike(r"^\s*[^=\s][^=]*="))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.regexp_replace(p, r"^[^=]*=", "")))))


def meta_content(page: str | Column, name: str) -> Column:
    """content of the meta element of that name, whichever attribute comes first."""
    n = name.replace(".", r"\.")
    return F.coalesce(_found(page, rf"(?is)<meta[^>]+(?:name|property)=[\"']{n}[\"'][^>]+content=[\"']([^\"']*)[\"']"), _found(page, rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:name|property)=[\"']{n}[\"']"))
