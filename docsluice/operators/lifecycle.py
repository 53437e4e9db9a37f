"""Analyses over time: progress, quotas, publication, retention, reuse. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import compatibility_key

TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("queued", "running")
PRIVATE_HOURS, PUBLIC_DAYS, RESOLUTION_SECONDS, DOCUMENT_HOURS = 24, 30, 900, 24


def _hours(n: float) -> Column:
    return F.make_dt_interval(hours=F.lit(int(n)))


def latest_per_key(events: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The last event of each key, with the place where the key first came up."""
    own = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*own), order).alias("_e"), F.min(order).alias("first_pos"))
    return last.select(*keys, "_e.*", "first_pos")


def closed_stages(events: DataFrame) -> DataFrame:
    """events(analysis_id, pos, kind, state): a running stage that a later stage follows is completed."""
    order = Window.partitionBy("analysis_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    later = F.max((F.col("kind") == "stage").cast("int")).over(order)
    done = (F.col("kind") == "stage") & (F.col("state") == "running") & (F.coalesce(later, F.lit(0)) == 1)
    return events.withColumn("state", F.when(done, "completed").otherwise(F.col("state")))


def module_progress(events: DataFrame, modules: int = 5, low: int = 35, span: int = 33) -> DataFrame:
    """Progress after each module's end, in order of arrival; it never falls."""
    order = Window.partitionBy("analysis_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.count_if((F.col("kind") == "module") & F.col("state").isin("completed", "failed", "skipped")).over(order)
    return events.withColumn("progress", (low + F.bround(F.least(ended, F.lit(modules)) / modules * span)).cast("int"))


def stage_started(events: DataFrame, analyses: DataFrame) -> DataFrame:
    """When each analysis's last stage began; its last update if it has no stage event."""
    last = events.where("kind = 'stage'").groupBy("analysis_id").agg(F.max_by("at", "pos").alias("_at"))
    return analyses.join(last, "analysis_id", "left").select("analysis_id", F.coalesce("_at", "updated_at").alias("stage_started_at"))


def upgraded_events(events: DataFrame) -> DataFrame:
    """Defaults for what older events lack."""
    defaults = {"kind": "stage", "key": "analysis", "label": "Analysis", "state": "completed"}
    out = events
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.col("stage"), F.lit(value)) if name in ("key", "label") and "stage" in events.columns else F.coalesce(F.col(name), F.lit(value)))
    return out.withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))


def token_usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """calls(..., usage map<string,bigint>): sums of every counter."""
    rows = calls.select(*keys, F.explode("usage").alias("counter", "n"))
    return rows.groupBy(*keys, "counter").agg(F.sum("n").alias("tokens"))


def quotas(analyses: DataFrame, now: Column, daily: int | None, concurrent: int, hours: int = 24) -> DataFrame:
    """Per owner: analyses active and of the last hours, what is left, and whether another may start."""
    out = analyses.groupBy("owner").agg(F.count_if(F.col("state").isin(*ACTIVE)).alias("active"), F.count_if((F.col("created_at") > now - _hours(hours)) & (F.col("created_at") <= now)).alias("recent"))
    left = F.lit(None).cast("bigint") if daily is None else F.greatest(F.lit(0), F.lit(daily) - F.col("recent"))
    return out.withColumn("remaining", left).withColumn("may_start", (F.col("active") < concurrent) & (F.coalesce("remaining", F.lit(1)) > 0))


def published(analyses: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """The chosen analyses published: the first time stays, and the expiry counts from it."""
    at = F.coalesce("published_at", now)
    mark = F.col("_pub").isNotNull() & (F.col("state") == "completed")
    rows = analyses.join(chosen.select("analysis_id", F.lit(True).alias("_pub")).distinct(), "analysis_id", "left")
    return rows.withColumns({
        "public_slug": F.when(mark, F.coalesce("public_slug", F.left(F.sha2(F.col("analysis_id").cast("string"), 256), F.lit(16)))).otherwise(F.col("public_slug")),
        "expires_at": F.when(mark, at + F.make_dt_interval(days=F.lit(PUBLIC_DAYS))).otherwise(F.col("expires_at")),
        "published_at": F.when(mark, at).otherwise(F.col("published_at")),
    }).drop("_pub")


def unpublished(analyses: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    rows = analyses.join(chosen.select("analysis_id", F.lit(True).alias("_un")).distinct(), "analysis_id", "left")
    mark = F.col("_un").isNotNull()
    return rows.withColumns({
        "public_slug": F.when(~mark, F.col("public_slug")), "published_at": F.when(~mark, F.col("published_at")), "expires_at": F.when(mark, now + _hours(PRIVATE_HOURS)).otherwise(F.col("expires_at")),
    }).drop("_un")


def cancelled(analyses: DataFrame, chosen: DataFrame) -> DataFrame:
    """Queued ones stop at once; running ones are asked to; ended ones stay."""
    rows = analyses.join(chosen.select("analysis_id", F.lit(True).alias("_c")).distinct(), "analysis_id", "left")
    mark = F.col("_c").isNotNull() & F.col("state").isin(*ACTIVE)
    return rows.withColumns({"cancel_requested": F.coalesce("cancel_requested", F.lit(False)) | mark, "state": F.when(mark & (F.col("state") == "queued"), "cancelled").otherwise(F.col("state"))}).drop("_c")


def recovered(analyses: DataFrame) -> DataFrame:
    """After a restart, analyses that were under way have failed."""
    lost = F.col("state").isin(*ACTIVE)
    return analyses.withColumns({"error": F.when(lost, "The service restarted during the analysis.").otherwise(F.col("error")), "state": F.when(lost, "failed").otherwise(F.col("state"))})


def over(now: Column) -> Column:
    """Whether an analysis has ended and is past its expiry; one without a state or an expiry is not."""
    return F.coalesce(F.col("state").isin(*TERMINAL) & (F.col("expires_at") <= now), F.lit(False))


def retention(analyses: DataFrame, documents: DataFrame, resolutions: DataFrame, now: Column, hours: int = DOCUMENT_HOURS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of each table: ended analyses go when expired, resolutions too, and old documents that no analysis needs."""
    kept = analyses.where(~over(now))
    fresh = resolutions.where(F.col("expires_at") > now)
    needed = documents.join(kept.select("document_id").where("document_id is not null").distinct(), "document_id", "left_semi")
    young = documents.where(F.col("created_at") > now - _hours(hours)).join(needed.select("document_id"), "document_id", "left_anti")
    return kept, needed.unionByName(young), fresh


def progress_view(events: DataFrame) -> DataFrame:
    """Per analysis: modules that have ended and the evidence that modules report, by each module's last event."""
    last = latest_per_key(events.where("kind = 'module' and key is not null"), ["analysis_id", "key"])
    return last.groupBy("analysis_id").agg(F.count_if(F.col("state").isin("completed", "failed", "skipped")).alias("finished_modules"), F.sum("evidence_count").alias("evidence_total"))


def cleanup_counts(analyses: DataFrame, documents: DataFrame, resolutions: DataFrame, now: Column, hours: int = DOCUMENT_HOURS) -> DataFrame:
    """(kind, n): how many rows of each table a cleanup drops, from one scan of each.

    Analyses are counted by their document, those that go and those that stay; documents meet these
    counts, and both totals are taken from what comes of that.
    """
    held = analyses.groupBy("document_id").agg(F.count_if(over(now)).alias("_gone"), F.count_if(~over(now)).alias("_held"))
    both = documents.select("document_id", (F.col("created_at") <= now - _hours(hours)).alias("_old")).join(held, "document_id", "full_outer")
    totals = both.agg(F.coalesce(F.sum("_gone"), F.lit(0)).alias("analyses"), F.count_if(F.col("_old") & (F.coalesce("_held", F.lit(0)) == 0)).alias("documents"))
    stale = resolutions.agg(F.count_if(F.col("expires_at") <= now).alias("n")).select(F.lit("resolutions").alias("kind"), "n")
    return totals.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("analyses", "documents"))))).union(stale)


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows, and counters that are filled by whatever job reads them: no scan of their own."""
    seen = Observation(name)
    return rows.observe(seen, *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items())), seen


def deletions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The rows that a rewrite dropped."""
    return before.join(after.select(key), key, "left_anti")


def cached_resolutions(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after new resolutions replace those of the same input; the latest of an input wins."""
    both = cache.unionByName(new)
    turn = F.row_number().over(Window.partitionBy("input_hash").orderBy(F.col("created_at").desc(), F.col("resolution_id").desc()))
    return both.withColumn("_t", turn).where("_t = 1").drop("_t")


def fresh(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(F.col("expires_at") > now)


def authorized(rows: DataFrame, caller: Column, admin: Column) -> DataFrame:
    """The rows that a caller may see: their own, or all for an administrator; rows without an owner are nobody's."""
    return rows.where(admin | F.coalesce((F.col("owner") != "") & (F.col("owner") == caller), F.lit(False)))


def session_seconds(report_hours: int, public_days: int) -> int:
    """How long a guest's session lasts: as long as its reports can."""
    return max(report_hours * 3600, public_days * 86_400)


def documents_after(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    """The documents that stay when analyses complete: an uploaded one goes with its analysis."""
    done = analyses.where("state = 'completed' and document_id is not null").select("document_id").distinct()
    return documents.join(done, "document_id", "left_anti")


def reusable(requests: DataFrame, reports: DataFrame, settings: list[str] | None, now: Column) -> DataFrame:
    """requests(request_id, caller, settings...) with the compatible report to reuse: the caller's latest, else the latest public one with an identifier.

    The latest report of each key and owner, and the latest public one of each key, are found
    first; a request then meets one row of either, so a common key makes no pairs. Without settings
    both tables have their digest as _key; bucketed by it, they are joined where they lie.
    """
    keyed = lambda rows: rows if settings is None else rows.withColumn("_key", compatibility_key(settings))
    asked = keyed(requests).select("request_id", "caller", "_key")
    live = keyed(reports.where((F.col("state") == "completed") & (F.col("expires_at") > now)))
    latest = F.max(F.struct("updated_at", "analysis_id"))["analysis_id"]
    own = live.where("owner is not null").groupBy("_key", F.col("owner").alias("caller")).agg(latest.alias("_own"))
    public = F.col("published_at").isNotNull() & F.col("public_slug").isNotNull() & (F.coalesce("doi", "arxiv_id", "pmid", "pmcid").isNotNull())
    shared = live.where(public).groupBy("_key").agg(latest.alias("_public"))
    found = asked.join(own, ["_key", "caller"], "left").join(shared, "_key", "left")
    return found.select("request_id", F.coalesce("_own", "_public").alias("analysis_id"), F.col("_own").isNotNull().alias("own")).where("analysis_id is not null")
