"""Reports held against expected evidence and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(value: Column, terms: Column) -> Column:
    """Any of the terms occurs in the value, case aside."""
    return F.coalesce(F.exists(terms, lambda t: F.contains(F.lower(value), F.lower(t))), F.lit(False))


def evidence_hits(expectations: DataFrame, notes: DataFrame) -> DataFrame:
    """expectations(case_id, id, module_key, rubric_item, terms) with hit and false_absence; a null key matches all.

    notes(case_id, module_key, rubric_item, observation, quotes, evidence_state).
    """
    e = expectations.select("case_id", "id", F.col("module_key").alias("e_module"), F.col("rubric_item").alias("e_item"), "terms")
    fits = (F.col("e_module").isNull() | (F.col("e_module") == F.col("module_key"))) & (F.col("e_item").isNull() | (F.col("e_item") == F.col("rubric_item")))
    rows = e.join(notes, "case_id", "left").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    text = F.concat_ws(" ", "observation", F.array_join("quotes", " "))
    seen = F.col("_fits") & (F.col("evidence_state") == "observed")
    out = rows.groupBy("case_id", "id").agg(F.array_join(F.array_sort(F.collect_list(F.when(seen, text))), " ").alias("_text"), F.first("terms").alias("terms"), F.coalesce(F.bool_or(F.col("_fits") & (F.col("evidence_state") == "not_found")), F.lit(False)).alias("_absent"))
    hit = contains_any(F.col("_text"), F.col("terms"))
    return out.select("case_id", "id", hit.alias("hit"), (~hit & F.col("_absent")).alias("false_absence"))


def finding_hits(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """expectations(case_id, id, rubric_item, grades) with hit: any finding of the item with an allowed grade (none named: any)."""
    fits = (F.size(F.coalesce("grades", F.array().cast("array<string>"))) == 0) | F.array_contains("grades", F.col("grade"))
    rows = expectations.join(findings.select("case_id", "rubric_item", "grade"), ["case_id", "rubric_item"], "left")
    return rows.groupBy("case_id", "id").agg(F.coalesce(F.bool_or(F.col("grade").isNotNull() & fits), F.lit(False)).alias("hit"))


def _rate(part: Column, whole: Column, none: float) -> Column:
    return F.bround(F.when(whole > 0, part / whole).otherwise(none), 3)


def evaluate(cases: DataFrame, evidence: DataFrame, wanted: DataFrame, findings: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row a case: recalls, false absences, grounding, forbidden items, latency.

    evidence and wanted are evidence_hits and finding_hits; findings(case_id, rubric_item, grade,
    spans int); cases(case_id, forbidden array<string>, warnings array<string>).
    """
    e = evidence.groupBy("case_id").agg(F.count("*").alias("_e"), F.count_if("hit").alias("_eh"), F.count_if("false_absence").alias("_fa"))
    w = wanted.groupBy("case_id").agg(F.count("*").alias("_w"), F.count_if("hit").alias("_wh"))
    graded = findings.where("grade <> 'not_assessed'").join(cases.select("case_id", "forbidden"), "case_id")
    a = graded.groupBy("case_id").agg(F.count("*").alias("_a"), F.count_if(F.col("spans") > 0).alias("_g"), F.array_sort(F.collect_list(F.when(F.array_contains("forbidden", F.col("rubric_item")), F.col("rubric_item")))).alias("_bad"))
    out = cases.join(e, "case_id", "left").join(w, "case_id", "left").join(a, "case_id", "left").fillna(0, ["_e", "_eh", "_fa", "_w", "_wh", "_a", "_g"])
    if events is not None:
        out = out.join(latencies(events, "case_id"), "case_id", "left")
    else:
        out = out.withColumn("latency_seconds", F.lit(None).cast("double"))
    late = F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit("reviewer")) & F.contains(F.lower(t), F.lit("timeout")))
    return out.select(
        "case_id", _rate(F.col("_eh"), F.col("_e"), 1.0).alias("evidence_recall"), _rate(F.col("_wh"), F.col("_w"), 1.0).alias("finding_recall"), _rate(F.col("_fa"), F.col("_e"), 0.0).alias("false_absence_rate"),
        _rate(F.col("_g"), F.col("_a"), 0.0).alias("grounding_rate"), _rate(F.col("_a") - F.col("_g"), F.col("_a"), 0.0).alias("unsupported_rate"), F.coalesce("_bad", F.array().cast("array<string>")).alias("forbidden_assessed"), late.alias("reviewer_timed_out"), "latency_seconds",
    )


def latencies(events: DataFrame, key: str) -> DataFrame:
    """Seconds from the first to the last event whose time parses; null for fewer than two."""
    at = F.try_to_timestamp(F.col("at").cast("string"))
    seconds = F.bround((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6, 3)
    return events.groupBy(key).agg(F.when(F.count(at) >= 2, seconds).alias("latency_seconds"))
