"""Views of findings: groups, takeaways, histograms, summaries, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import GRADE_RANK, mapped
from ..functions.scalars import concern_label, leading_year, summary_text, title_case

CONCERNS = ("minor_concern", "major_concern", "critical_concern")
SEVERITY_RANK = {"critical": 0, "major": 1, "minor": 2, "info": 3}


def standing(findings: DataFrame) -> DataFrame:
    """Findings that the critic did not discard."""
    return findings.where(~F.col("critic_disposition").eqNullSafe("discarded"))


def is_concern() -> Column:
    return F.col("grade").isin(*CONCERNS)


def assessment_groups(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """A row for each paper and group: the modules in order, then categories that no module has.

    statuses(paper_id, module_key, module_pos, label, state, score, assessed_items, expected_items).
    """
    counts = standing(findings).groupBy("paper_id", F.col("category").alias("module_key")).agg(
        F.count("*").alias("n"), F.count_if(F.col("grade") != "not_assessed").alias("graded"), F.count_if(is_concern()).alias("concerns"),
        F.array_sort(F.collect_list(F.struct(mapped("grade", GRADE_RANK).alias("rank"), "pos", "rubric_item", "grade"))).alias("ranked"),
    )
    both = statuses.join(counts, ["paper_id", "module_key"], "full_outer")
    known = F.col("module_pos").isNotNull()
    assessed = F.when(known, F.col("assessed_items")).otherwise(F.col("graded"))
    expected = F.when(known, F.col("expected_items")).otherwise(F.col("n"))
    concerns = F.coalesce("concerns", F.lit(0)).cast("int")
    return both.select(
        "paper_id", "module_key", known.alias("is_module"), F.coalesce("module_pos", F.lit(1000)).alias("place"), F.coalesce("label", title_case("module_key")).alias("label"), "state",
        assessed.cast("int").alias("assessed_items"), expected.cast("int").alias("expected_items"), F.greatest(F.lit(0), expected - assessed).cast("int").alias("gap_count"), concerns.alias("concern_count"),
        concern_label(concerns, assessed, expected).alias("concern_label"), F.when(known & (assessed > 0), F.col("score")).alias("score"), F.transform("ranked", lambda r: r["rubric_item"]).alias("items"),
    )


def takeaways(findings: DataFrame, most: int = 4) -> DataFrame:
    """The worst concerns of each paper; equal grades keep their order."""
    turn = F.row_number().over(Window.partitionBy("paper_id").orderBy(mapped("grade", GRADE_RANK), "pos"))
    return standing(findings).where(is_concern()).withColumn("turn", turn).where(F.col("turn") <= most)


def grade_histogram(findings: DataFrame) -> DataFrame:
    return standing(findings).where("grade <> 'not_assessed'").groupBy("paper_id", "grade").agg(F.count("*").alias("n"))


def summaries(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """counts(paper_id, assessed, expected) with summary lines: up to four grounded concerns, then what was assessed."""
    turn = F.row_number().over(Window.partitionBy("paper_id").orderBy(mapped("severity", SEVERITY_RANK), "category", "rubric_item"))
    lines = findings.where(is_concern() & (F.size("paper_spans") > 0)).withColumn("turn", turn).where("turn <= 4")
    lines = lines.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("title", F.lit(". "), summary_text("explanation")).alias("line")))).alias("_l"))
    none = F.array(F.lit("No evidence-grounded methodological concern was accepted in the assessed items."))
    last = F.array(F.format_string("The final review assessed %d of %d methodology items.", F.col("assessed").cast("int"), F.col("expected").cast("int")))
    return counts.join(lines, "paper_id", "left").select("paper_id", F.concat(F.coalesce(F.col("_l.line"), none), last).alias("summary"))


def concern_counts(findings: DataFrame) -> DataFrame:
    """Both counts that callers know: the public feed counts discarded concerns, the gallery does not."""
    return findings.groupBy("paper_id").agg(F.count_if(is_concern()).alias("feed_concerns"), F.count_if(is_concern() & ~F.col("critic_disposition").eqNullSafe("discarded")).alias("gallery_concerns"))


def public_feed(reports: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """The latest published, completed reports that have not expired (a top-k, no full sort)."""
    if not 1 <= limit <= 50:
        raise ValueError("limit lies in 1..50")
    shown = reports.where((F.col("state") == "completed") & F.col("published_at").isNotNull() & (F.col("expires_at") > now))
    return shown.orderBy(F.col("published_at").desc(), "analysis_id").limit(limit)


def public_summary(reports: DataFrame) -> DataFrame:
    return reports.select("analysis_id", "title", leading_year("published_text").alias("year"), "review_score", "published_at")


def reusable_cards(matches: DataFrame, reports: DataFrame) -> DataFrame:
    """matches(request_id, analysis_id, own) as what a caller is shown of a report: an id to its owner, a slug to others, a title always."""
    rows = matches.join(reports, "analysis_id")
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        "request_id", F.when(F.col("own"), "owned").otherwise("public").alias("access"), F.when(F.col("own"), F.col("analysis_id")).alias("analysis_id"), F.when(~F.col("own"), F.col("public_slug")).alias("slug"),
        F.coalesce(named("title"), named("doi"), F.lit("Untitled paper")).alias("title"), "review_score",
    )


def manifest_faults(manifest: DataFrame, reports: DataFrame, audits: DataFrame) -> DataFrame:
    """(case_id, fault) where a gallery's manifest, reports and audits disagree."""
    rows = manifest.join(reports.select("case_id", F.col("review_score").alias("r_score"), F.col("concern_count").alias("r_concerns")), "case_id", "left").join(audits.select("case_id", "checked", "mismatches"), "case_id", "left")
    faults = F.array_compact(F.array(
        F.when(F.col("r_score").isNull(), "no report"), F.when(F.col("checked").isNull(), "no audit"), F.when(F.col("r_score") != F.col("review_score"), "score differs"),
        F.when(F.col("r_concerns") != F.col("concern_count"), "concern count differs"), F.when(F.col("mismatches") > 0, "quotes that the source lacks"),
    ))
    return rows.select("case_id", F.explode(faults).alias("fault"))
