"""The review methodology as small dimension tables. Rules are data: every operator takes them as DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the methodology: module key, label, weight, least content level, section terms, keywords, default items.
MODULES = [
    ("design", "Study design & risk of bias", 30.0, "full_text", ["methods", "participants", "design"], ["randomization", "selection", "confounding", "comparator", "blinding", "attrition", "exclusion", "sampling"], []),
    ("statistics", "Statistical & computational validity", 25.0, "full_text", ["methods", "results", "statistical analysis"], ["confidence interval", "p-value", "power", "missing data", "imputed", "imputation", "heterogeneity", "transitivity", "consistency", "multiplicity", "robustness", "leakage", "baseline"], []),
    ("claims", "Claim–evidence alignment", 20.0, "abstract", ["abstract", "methods", "results", "discussion", "conclusion"], ["conclude", "demonstrate", "evidence", "association", "cause", "significant", "generalize", "eligibility", "excluded", "treatment-resistant", "bipolar"], ["claim_strength", "results_support", "causal_language", "generalization", "limitations_alignment"]),
    ("transparency", "Transparency & reporting", 20.0, "full_text", ["methods", "data availability", "code availability", "ethics", "supplementary"], ["preregistration", "protocol", "ethics", "consent", "data availability", "code", "reproducibility"], ["registration", "ethics", "data_code", "reporting_completeness", "reproducibility"]),
    ("disclosures", "Disclosures & affiliations", 5.0, "metadata", ["funding", "conflicts of interest", "affiliations", "acknowledgements"], ["funding", "grant", "sponsor", "conflict", "competing interest", "affiliation"], ["funding_statement", "conflict_statement", "sponsor_role", "affiliations"]),
]
# The design and the statistics items of each profile.
PROFILE_ITEMS = {
    "general_empirical": (["study_question_design", "sampling_eligibility", "measurement_quality", "comparators_controls", "threats_to_validity"], ["analysis_specification", "effect_size_uncertainty", "missing_data", "robustness_checks", "claim_calibration"]),
    "randomized_experiment": (["randomization_process", "allocation_concealment", "deviations", "outcome_measurement", "attrition"], ["intention_to_treat", "power", "effect_size_interval", "multiplicity", "missing_data"]),
    "observational_study": (["selection", "exposure_measurement", "confounding", "comparators", "outcome_measurement"], ["model_specification", "overlap", "sensitivity_analysis", "missing_data", "uncertainty"]),
    "qualitative": (["sampling_rationale", "researcher_reflexivity", "data_collection", "information_power", "analytic_trace"], ["coding_process", "triangulation", "negative_cases", "participant_validation", "uncertainty_framing"]),
    "systematic_review_meta_analysis": (["protocol", "search_coverage", "duplicate_selection", "risk_of_bias_process", "excluded_studies"], ["effect_model", "heterogeneity", "response_imputation", "publication_bias", "sensitivity_analysis"]),
    "diagnostic_prediction": (["participant_spectrum", "index_test", "reference_standard", "flow_timing", "validation_split"], ["calibration", "discrimination", "threshold_selection", "optimism_correction", "external_validation"]),
    "computational_ml_modeling": (["dataset_provenance", "leakage", "baseline_choice", "ablation", "external_validity"], ["test_set_isolation", "hyperparameter_search", "uncertainty", "multiple_benchmarks", "replication_artifacts"]),
    "common_core": (["question_clarity", "argument_structure", "source_relevance"], ["quantitative_claims", "uncertainty", "internal_consistency"]),
}
# Scores and ranks of grades, ranks of content levels, quality of source formats.
GRADE_SCORES = {"no_concern": 100.0, "minor_concern": 75.0, "major_concern": 35.0, "critical_concern": 0.0}
GRADE_RANK = {"critical_concern": 0, "major_concern": 1, "minor_concern": 2, "no_concern": 3, "not_assessed": 4}
SEVERITY = {"no_concern": "info", "minor_concern": "minor", "major_concern": "major", "critical_concern": "critical", "not_assessed": "info"}
LEVELS = {"metadata": 0, "abstract": 1, "full_text": 2}
SOURCE_QUALITY = {"jats": 1.0, "pdf": 0.9, "html": 0.85, "abstract": 0.65, "metadata": 0.45}
CHUNK_CHARS, OVERLAP_CHARS, CHUNKS_PER_MODULE, MODULE_CHARS, REVIEWER_CHARS = 4200, 350, 8, 36_000, 120_000
PROVISIONAL_BELOW = 0.70
# What each profile is reported and appraised by, and a sentence of calibration for reviews.
PROFILE_REFERENCES = {
    "general_empirical": ("Relevant EQUATOR guideline when identifiable", "General empirical-design and risk-of-bias concepts"),
    "randomized_experiment": ("CONSORT / EQUATOR", "RoB 2 concepts (not a substituted RoB 2 assessment)"),
    "observational_study": ("STROBE / EQUATOR", "ROBINS-I concepts (not a substituted ROBINS-I assessment)"),
    "qualitative": ("Relevant EQUATOR qualitative guideline", "Method-specific qualitative appraisal"),
    "systematic_review_meta_analysis": ("PRISMA / EQUATOR", "AMSTAR 2 concepts (not a substituted AMSTAR 2 assessment)"),
    "diagnostic_prediction": ("STARD/TRIPOD as applicable", "QUADAS-3 concepts for diagnostic accuracy"),
    "computational_ml_modeling": ("Relevant EQUATOR/field reporting guideline", "Task- and domain-specific methodological appraisal"),
    "common_core": ("Relevant EQUATOR guideline when identifiable", "No specialist appraisal profile selected"),
}
REVIEW_CALIBRATION = " For systematic reviews, distinguish transparent reporting from risk: material outcome imputation and shared heterogeneity assumptions still require an impact assessment, even when the method is described or conventional. Imputing a substantial fraction of response outcomes, such as 17.7%, warrants at least minor concern even when the method is described as validated; transparency alone is not methodological reassurance. Explicit exclusion of clinically relevant populations, including bipolar or treatment-resistant depression, limits generalizability and warrants concern proportionate to the stated scope even when disclosed transparently."
# The version of reuse, and the settings that two runs must share for one to stand for the other.
COMPATIBILITY_VERSION = "1"
COMPATIBILITY_FIELDS = ["compatibility_version", "paper_sha256", "content_level", "source_format", "profile", "scoring_version", "methodology_hash", "parser_name", "parser_version", "provider_profile", "worker_model", "reviewer_model"]


def module_rows() -> list[tuple]:
    return [(key, pos, label, weight, level) for pos, (key, label, weight, level, *_) in enumerate(MODULES)]


def term_rows() -> list[tuple]:
    """(module, pos, term, counts): section terms first, then keywords; a term in both is there twice."""
    return [(key, pos, term.lower()) for key, _, _, _, sections, words, _ in MODULES for pos, term in enumerate([*sections, *words])]


def rubric_rows() -> list[tuple]:
    out = []
    for profile, (design, statistics) in PROFILE_ITEMS.items():
        for key, *_, items in MODULES:
            own = {"design": design, "statistics": statistics}.get(key, items)
            out += [(profile, key, pos, item) for pos, item in enumerate(own)]
    return out


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of a dimension, handed over as Arrow: Spark knows their size, and broadcasts them while it is below its threshold."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    fields = [part.split() for part in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array([row[i] for row in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields]))


def modules(spark: SparkSession) -> DataFrame:
    return small(spark, module_rows(), "module_key string, module_pos int, label string, weight double, min_level string")


def module_terms(spark: SparkSession) -> DataFrame:
    return small(spark, term_rows(), "module_key string, pos int, term string")


def rubric(spark: SparkSession) -> DataFrame:
    return small(spark, rubric_rows(), "profile string, module_key string, item_pos int, rubric_item string")


def rubric_prompts(rubric_df: DataFrame) -> DataFrame:
    """(profile, prompt): what a reviewer is told about each profile's items; a row for each of the few profiles."""
    of = lambda module: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("module_key") == module, F.struct("item_pos", "rubric_item")))), lambda i: i["rubric_item"]), ", ")
    report, appraise = ({k: v[i] for k, v in PROFILE_REFERENCES.items()} for i in (0, 1))
    more = F.when(F.col("profile") == "systematic_review_meta_analysis", REVIEW_CALIBRATION).otherwise("")
    items = rubric_df.groupBy("profile").agg(of("design").alias("design"), of("statistics").alias("analysis"))
    text = F.concat(F.lit("Reporting reference: "), mapped("profile", report), F.lit(". Appraisal reference: "), mapped("profile", appraise), F.lit(". Design items: "), "design", F.lit(". Analysis items: "), "analysis", F.lit("."), more)
    return items.select("profile", text.alias("prompt"))


def lookup(spark: SparkSession, values: dict, key: str, value: str) -> DataFrame:
    kind = {str: "string", int: "int", float: "double"}[type(next(iter(values.values())))]
    return small(spark, list(values.items()), f"{key} string, {value} {kind}")


def mapped(column, values: dict):
    """The value of a small fixed map, as an expression (no join)."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.col(column) if isinstance(column, str) else column)


def methodology_faults(modules_df: DataFrame, grades: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(rule, detail) for every rule that the dimensions break; empty for a sound methodology."""
    weights = modules_df.agg(F.sum("weight").alias("w")).where("abs(w - 100) > 0.001 or w is null").select(F.lit("weights sum to 100").alias("rule"), F.col("w").cast("string").alias("detail"))
    keys = modules_df.groupBy("module_key").count().where("count > 1").select(F.lit("module keys are unique"), "module_key")
    scores = grades.where("score < 0 or score > 100").select(F.lit("scores lie in 0..100"), "grade")
    known = grades.where(~F.col("grade").isin(*GRADE_SCORES)).select(F.lit("grades are the four known"), "grade")
    count = grades.agg(F.count("*").alias("n")).where(f"n <> {len(GRADE_SCORES)}").select(F.lit("four grades have scores"), F.col("n").cast("string"))
    out = weights.union(keys).union(scores).union(known).union(count)
    if overlap >= chunk_chars:
        out = out.union(modules_df.sparkSession.createDataFrame([("overlap is less than the chunk", str(overlap))], "rule string, detail string"))
    return out


def sql_values(rows: list[tuple], names: str) -> str:
    """A VALUES list for other engines: (SELECT * FROM (VALUES ...) AS t(names))."""

    def one(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names}))"
