"""The whole review as one plan: papers and model outputs in, findings, scores and reports out.

Every step is a DataFrame function; nothing is collected. The only Python on the executors cuts
chunks, whose bounds depend on each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import MODULES, SOURCE_QUALITY, mapped, modules, rubric
from ..operators import grounding, reporting, scoring, text


def module_terms() -> dict[str, list[str]]:
    return {key: [*sections, *words] for key, _, _, _, sections, words, _ in MODULES}


def prepared(papers: DataFrame) -> DataFrame:
    """papers(paper_id, text, level, source_format) with profile and source quality."""
    return papers.withColumn("profile", text.profile("text")).withColumn("source_quality", F.coalesce(mapped("source_format", SOURCE_QUALITY), F.lit(SOURCE_QUALITY["metadata"])))


def prompts(papers: DataFrame, pages: DataFrame | None = None, sections: DataFrame | None = None, spans: DataFrame | None = None, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """What each module's worker is to read: (paper_id, module_key, prompt)."""
    rows = text.chunks(papers).withColumn("at", F.col("start"))
    rows = text.containing(rows, pages, "page", "first") if pages is not None else text.last_marker(rows, text.page_markers(papers), "page")
    rows = text.containing(rows, sections.withColumnRenamed("title", "section"), "section", "shortest") if sections is not None else rows.withColumn("section", F.lit(None).cast("string"))
    rows = rows.withColumn("section", text.chunk_section("section", "text"))
    picks = text.disclosure_picks(rows, papers, sections, spans)
    chosen = text.routed(text.route_scores(rows, terms or module_terms()), picks)
    return text.module_prompts(chosen, rows)


def reviewed(papers: DataFrame, worker_raw: DataFrame, reviewer_raw: DataFrame) -> dict[str, DataFrame]:
    """notes, evidence, failures, findings, run, dimensions, scores, confidence and summaries of prepared papers."""
    spark = papers.sparkSession
    dims, items = modules(spark), rubric(spark)
    notes, evidence, failures = grounding.worker_notes(worker_raw, papers, items)
    decisions = grounding.reviewer_decisions(reviewer_raw)
    findings, run = grounding.final_findings(decisions, papers, items, evidence)
    answered = decisions.select("paper_id").distinct().withColumn("_done", F.lit(True))
    # a worker's failure shows in warnings and confidence, not in the module's state
    state = papers.join(answered, "paper_id", "left").select("paper_id", "profile", "level", "source_format", F.coalesce("_done", F.lit(False)).alias("reviewer_done"), F.array().cast("array<string>").alias("failures"))
    baseline = scoring.baseline_findings(state.where(~F.col("reviewer_done")), dims, items)
    graded = findings.select("paper_id", "pos", "category", "rubric_item", "grade", "critic_disposition").unionByName(baseline)
    dimensions = scoring.dimension_scores(state, graded, dims, items)
    scores = scoring.review_scores(state, graded, dims, items)
    eligible = dimensions.where("eligible").groupBy("paper_id").agg(F.count("*").alias("modules_eligible"))
    lost = failures.groupBy("paper_id").agg(F.count("*").alias("_lost"))
    runs = scores.join(eligible, "paper_id", "left").join(lost, "paper_id", "left").join(run, "paper_id").join(state.select("paper_id", "source_format"), "paper_id")
    runs = runs.select("paper_id", F.col("weighted_coverage").alias("coverage"), (F.coalesce("modules_eligible", F.lit(0)) - F.coalesce("_lost", F.lit(0))).alias("modules_ok"), F.coalesce("modules_eligible", F.lit(0)).alias("modules_eligible"), "grounded", "attempts", "source_format")
    counts = dimensions.groupBy("paper_id").agg(F.sum("assessed_items").alias("assessed"), F.sum("expected_items").alias("expected"))
    return {"notes": notes, "evidence": evidence, "failures": failures, "findings": findings, "run": run, "dimensions": dimensions, "scores": scores, "confidence": scoring.confidence(runs), "summaries": reporting.summaries(findings, counts), "groups": reporting.assessment_groups(findings, dimensions)}
