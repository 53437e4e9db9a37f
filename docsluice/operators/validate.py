"""Rules that rows must keep; each gives the rows that break it with the rule's name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import GRADE_SCORES
from .grounding import GRADES, MAX_QUOTES, STATES

FINDING_RULES: dict[str, Column | str] = {
    "grade is known": f"grade in ({', '.join(repr(g) for g in GRADES)})",
    "confidence lies in 0..1": "confidence between 0 and 1",
    "a substantive finding has a span or a source": "severity = 'info' or size(paper_spans) > 0 or size(external_sources) > 0",
}
SPAN_RULES: dict[str, Column | str] = {"span ends after it starts": "end >= start", "span starts in the text": "start >= 0", "span has at most 10,000 characters": "length(text) <= 10000"}
DOCUMENT_RULES: dict[str, Column | str] = {"digest is 64 hexadecimal digits": "sha256 rlike '^[0-9a-f]{64}$'", "text has at most 8,000,000 characters": "length(text) <= 8000000", "upload has at most 25 MiB": "octet_length(text) <= 26214400"}
NOTE_RULES: dict[str, Column | str] = {"state is known": f"evidence_state in ({', '.join(repr(s) for s in STATES)})", "at most eight quotes": f"size(quotes) <= {MAX_QUOTES}"}
RATIO_RULES: dict[str, Column | str] = {"ratios lie in 0..1": "available between 0 and 1 and full_review between 0 and 1", "score lies in 0..100": "review_score between 0 and 100"}
assert len(GRADE_SCORES) == 4


def broken(rows: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """The rows that break rules, with the rules' names; null counts as broken."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r) if isinstance(r, str) else r, F.lit(False)), n) for n, r in rules.items()]))
    return rows.withColumn("broken", names).where(F.size("broken") > 0)


def sound(rows: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """The rows that keep all rules."""
    return rows.where(reduce(lambda a, b: a & b, [F.coalesce(F.expr(r) if isinstance(r, str) else r, F.lit(False)) for r in rules.values()]))


def anchors_outside(spans: DataFrame, papers: DataFrame) -> DataFrame:
    """Spans that end after their paper's text."""
    return spans.join(papers.select("paper_id", F.length("text").alias("_n")), "paper_id").where("end > _n").drop("_n")


def unknown_fields(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows of JSON objects that have other fields than the allowed ones."""
    extra = F.array_except(F.json_object_keys(column), F.array(*map(F.lit, allowed)))
    return rows.withColumn("unknown", extra).where(F.size("unknown") > 0)
