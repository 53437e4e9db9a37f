"""Stores of documents, reports, ledgers and evaluation corpora as files that Spark reads and writes.

Paths may be of any file system that Spark knows (a local folder or an object store).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import has_secret

REPORT_SCHEMA = (
    "profile string, source_format string, evidence_notes array<struct<module_key:string,rubric_item:string,observation:string,quotes:array<string>,evidence_state:string>>, "
    "findings array<struct<rubric_item:string,grade:string,paper_spans:array<struct<quote:string>>>>, execution_warnings array<string>, coverage struct<full_review:double,available:double,overall:double>, review_score double, composite_score double"
)
CASE_SCHEMA = (
    "cases array<struct<id:string,profile:string,source_format:string,identifier:string,doi:string,expected_evidence:array<struct<id:string,module_key:string,rubric_item:string,terms:array<string>>>,"
    "expected_findings:array<struct<id:string,rubric_item:string,grades:array<string>>>,forbidden_assessed_items:array<string>>>"
)
ATTEMPT_SCHEMA = "case_id string, outcome string, started_at string, latency_seconds double, models map<string,string>, token_usage map<string,bigint>, reused_analysis_id string, error string"


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """A row for each case of a manifest."""
    return spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")


def reports_by_case(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of reports by case id, as rows."""
    text = spark.read.text(path, wholetext=True)
    nested = ", ".join(f"{n}:{t}" for n, t in (p.split(" ", 1) for p in REPORT_SCHEMA.split(", ")))
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{nested}>>")).alias("case_id", "r")).select("case_id", "r.*")


def upgraded_reports(reports: DataFrame) -> DataFrame:
    """Older reports: coverage ratios and the score under the names of newer ones."""
    full = F.coalesce("coverage.full_review", "coverage.overall", F.lit(0.0))
    return reports.withColumn("review_score", F.coalesce("review_score", "composite_score")).withColumn("coverage", F.struct(full.alias("full_review"), F.coalesce("coverage.available", full).alias("available")))


def append_attempts(attempts: DataFrame, path: str) -> None:
    attempts.write.mode("append").json(path)


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """A ledger of runs; times are read with either notation of UTC."""
    return spark.read.schema(ATTEMPT_SCHEMA).json(path).withColumn("started_at", F.try_to_timestamp("started_at"))


def completed_cases_differ(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    """(case_id, side): completed in the ledger but not in the manifest, or the other way round."""
    done, named = ledger.where("outcome = 'completed'").select("case_id").distinct(), manifest.select("case_id").distinct()
    return done.exceptAll(named).withColumn("side", F.lit("ledger")).union(named.exceptAll(done).withColumn("side", F.lit("manifest")))


def files_with_secrets(spark: SparkSession, path: str) -> DataFrame:
    """Text files below a path that hold what looks like a credential."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return files.where(has_secret("value")).select("file")


def pdf_files(spark: SparkSession, path: str, most: int = 25 * 1024 * 1024) -> DataFrame:
    """Files that begin as PDFs and are not too large; the rest by reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fault = F.when(F.col("length") > most, "too large").when(~F.startswith("content", F.lit(b"%PDF-")), "not a PDF")
    return files.select("path", "length", fault.alias("fault"))


def migrated_analyses(rows: DataFrame) -> DataFrame:
    """Rows of older versions: owner and mode out of the request's JSON, publication columns."""
    out = rows
    for name, value in (("owner", F.get_json_object("request", "$.owner_hash")), ("provider_mode", F.coalesce(F.get_json_object("request", "$.provider_mode"), F.lit("server")))):
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    for name, kind in (("published_at", "timestamp"), ("public_slug", "string")):
        if name not in rows.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def bundle_hash(spark: SparkSession, paths: list[str]) -> str:
    """SHA-256 of a methodology's files, its manifest and its prompts, one after the other."""
    order = F.array(*[F.lit(p.rsplit("/", 1)[-1]) for p in paths])
    files = spark.read.format("binaryFile").load(paths).select(F.array_position(order, F.element_at(F.split("path", "/"), -1)).alias("pos"), "content")
    listed = files.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("f"))  # a few small files
    return listed.select(F.sha2(F.aggregate("f.content", F.lit(b"").cast("binary"), lambda a, c: F.concat(a, c)), 256)).first()[0]


def methodology_modules(spark: SparkSession, path: str) -> DataFrame:
    """The modules of a methodology's manifest, given as JSON."""
    schema = "modules array<struct<key:string,label:string,weight:double,minimum_content_level:string,required_sections:array<string>,keywords:array<string>,items:array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("modules").alias("module_pos", "m")).select(F.col("m.key").alias("module_key"), "module_pos", "m.label", "m.weight", F.col("m.minimum_content_level").alias("min_level"), F.concat("m.required_sections", "m.keywords").alias("terms"), "m.items")


def report_latencies(reports: DataFrame) -> DataFrame:
    """reports(report_id, created_at, updated_at) with the seconds that each took."""
    return reports.withColumn("latency_seconds", F.bround((F.unix_micros("updated_at") - F.unix_micros("created_at")) / 1e6, 3))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports and audits as JSON lines, for a gallery."""
    reports.write.mode("overwrite").json(path)
