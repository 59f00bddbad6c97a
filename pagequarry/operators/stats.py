"""Job statistics over records (url, tier, duration_ms, failure_category, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.quality import is_reachable


def category() -> F.Column:
    return F.coalesce(F.nullif(F.col("failure_category"), F.lit("")), F.lit("uncategorized"))


def totals(records: DataFrame) -> DataFrame:
    ok = is_reachable(category())
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("reachable"), F.count_if(~ok).alias("unreachable"))


def by_tier(records: DataFrame) -> DataFrame:
    """tier, attempted, succeeded (success with a duration)."""
    r = records.where(F.coalesce(F.col("tier"), F.lit("")) != "")
    return r.groupBy("tier").agg(F.count(F.lit(1)).alias("attempted"), F.count_if((category() == "success") & (F.col("duration_ms") > 0)).alias("succeeded"))


def by_category(records: DataFrame) -> DataFrame:
    return records.groupBy(category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


def latency(records: DataFrame) -> DataFrame:
    """tier, n, avg_ms (whole number), min_ms, max_ms of successes."""
    r = records.where((category() == "success") & (F.col("duration_ms") > 0) & (F.coalesce(F.col("tier"), F.lit("")) != ""))
    return r.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(duration_ms) div count(1)").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"))


def escalation_rate(records: DataFrame, tier: str = "chromium") -> DataFrame:
    """Successes of the top tier among reachable records; 0 without any."""
    up = F.count_if((category() == "success") & (F.col("duration_ms") > 0) & (F.col("tier") == tier))
    ok = F.count_if(is_reachable(category()))
    return records.agg(F.when(ok > 0, up / ok).otherwise(F.lit(0.0)).alias("escalation_rate"))


def fallbacks(overlaid: DataFrame) -> DataFrame:
    """attempted, succeeded, no_link, unreachable of route.overlay_fallback's rows."""
    n = lambda s: F.count_if(F.col("fallback_state") == s)
    return overlaid.agg(F.count_if(F.col("fallback_state") != "not_tried").alias("attempted"), n("succeeded").alias("succeeded"), n("no_link").alias("no_link"), n("unreachable").alias("unreachable"))


def wall_clock(records: DataFrame, at: str = "fetched_at") -> DataFrame:
    return records.agg((F.unix_millis(F.max(at).cast("timestamp")) - F.unix_millis(F.min(at).cast("timestamp"))).alias("wall_clock_ms"))


def snapshot(records: DataFrame) -> DataFrame:
    """All statistics of a job in one row; the maps have a key a tier or category.

    One pass: totals, tiers and categories are grouping sets, whose few rows then make the maps."""
    r = records.select(F.coalesce("tier", F.lit("")).alias("tier"), category().alias("category"), "duration_ms")
    hit = (F.col("category") == "success") & (F.col("duration_ms") > 0)
    ms = F.when(hit, F.col("duration_ms"))
    g = r.groupingSets([[F.col("tier")], [F.col("category")], []], F.col("tier"), F.col("category")).agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).alias("n"), F.count_if(is_reachable("category")).alias("ok"), F.count_if(hit).alias("hits"),
        F.count_if(hit & (F.col("tier") == "chromium")).alias("up"), F.sum(ms).alias("ms"), F.min(ms).alias("lo"), F.max(ms).alias("hi"),
    )
    tier, cat, whole = (F.col("set") == 1) & (F.col("tier") != ""), F.col("set") == 2, F.col("set") == 3
    entries = lambda at, key, value: F.map_from_entries(F.sort_array(F.collect_list(F.when(at, F.struct(F.col(key).alias("key"), value.alias("value"))))))
    one = lambda c: F.coalesce(F.max(F.when(whole, F.col(c))), F.lit(0))
    latency_of = F.struct("hits", F.expr("ms div hits").alias("avg_ms"), F.col("lo").alias("min_ms"), F.col("hi").alias("max_ms"))
    return g.agg(
        one("n").alias("total"), one("ok").alias("reachable"), (one("n") - one("ok")).alias("unreachable"), F.when(one("ok") > 0, one("up") / one("ok")).otherwise(F.lit(0.0)).alias("escalation_rate"),
        entries(tier, "tier", F.col("n")).alias("tier_attempted"), entries(tier & (F.col("hits") > 0), "tier", F.col("hits")).alias("tier_succeeded"), entries(cat, "category", F.col("n")).alias("failures_by_category"), entries(tier & (F.col("hits") > 0), "tier", latency_of).alias("latency"),
    )


def cross_reference(without_ocr: DataFrame, with_ocr: DataFrame) -> DataFrame:
    """url, outcome_no_ocr, tier_no_ocr, outcome_ocr, tier_ocr of two runs (url, outcome, tier); a URL of one run alone has nulls."""
    a = without_ocr.select("url", F.col("outcome").alias("outcome_no_ocr"), F.col("tier").alias("tier_no_ocr"))
    return a.join(with_ocr.select("url", F.col("outcome").alias("outcome_ocr"), F.col("tier").alias("tier_ocr")), "url", "full")


def pdf_bench(runs: DataFrame) -> DataFrame:
    """tier_no_ocr, tier_ocr distributions and rescued of a comparison (url, outcome_no_ocr, tier_no_ocr, outcome_ocr, tier_ocr)."""
    return runs.agg(F.count_if(F.col("outcome_no_ocr") == "success").alias("success_no_ocr"), F.count_if(F.col("outcome_ocr") == "success").alias("success_ocr"), F.count_if((F.col("outcome_no_ocr") != "success") & (F.col("outcome_ocr") == "success")).alias("ocr_rescued"))
