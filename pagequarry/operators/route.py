"""Tiered routing over attempts: the first valid rung of a URL's ladder wins.

Attempts are rows (url, tier, ord, status_code, content_type, body, error, duration_ms). What a
loop over rungs would do is one window by URL; rows after the stop don't count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions.quality import Checker, classify_failure, is_html, maybe_shell, rotate_proxy, soft_block, validity
from pagequarry.functions.urls import host_of
from pagequarry.html.functions import parse_page


def check_attempts(attempts: DataFrame, checker: Checker = Checker(), shell: Column | None = None, missed: Column | None = None, rotate_codes: Sequence[int] = ()) -> DataFrame:
    """attempts with valid, reason, escalate, vendor, marker. An error is neither valid nor a stop; a status that
    rotates proxies always escalates. Shells are found in the page's tree; only pages that name a mount point are
    parsed for that."""
    if shell is None and checker.detect_shells:
        ok = F.col("status_code").between(200, 299) & is_html(F.coalesce("content_type", F.lit("")))
        mount = F.when(ok & maybe_shell("body"), F.col("body"))
        attempts = attempts.withColumn("__s", F.coalesce(parse_page(mount, F.lit(""), shell=True)["shell"], F.lit(False)))
        return check_attempts(attempts, checker, F.col("__s"), missed, rotate_codes).drop("__s")
    held = attempts.withColumn("__b", F.when(F.col("status_code").between(200, 299) & (F.octet_length("body") >= checker.min_bytes), soft_block("body", checker.soft_block_bytes)))
    v = F.when(F.coalesce(F.col("error"), F.lit("")) == "", validity("status_code", "content_type", "body", checker, shell, missed, F.col("__b")))
    out = held.withColumn("__v", v)
    rotates = rotate_proxy(F.col("status_code"), F.array(*[F.lit(c) for c in rotate_codes])) if rotate_codes else F.lit(False)
    failed = F.col("__v").isNull()
    return out.select(
        *attempts.columns, F.coalesce("__v.valid", F.lit(False)).alias("valid"), F.coalesce("__v.reason", F.lit("")).alias("reason"),
        (failed | F.coalesce("__v.escalate", F.lit(True)) | rotates).alias("escalate"), F.col("__v.vendor").alias("vendor"), F.col("__v.marker").alias("marker"),
    )


def reorder(attempts: DataFrame, preferred: DataFrame, host: Column | None = None) -> DataFrame:
    """attempts with ord renumbered so that a host's preferred tier comes first; the others keep their order.

    preferred: host, tier."""
    a = attempts.withColumn("__host", host_of("url") if host is None else host)
    p = preferred.select(F.col("host").alias("__host"), F.col("tier").alias("__tier"))
    by_url = W.partitionBy("url").orderBy((F.col("tier") != F.coalesce("__tier", F.lit(""))).cast("int"), "ord")
    return a.join(p, "__host", "left").withColumn("ord", F.row_number().over(by_url) - 1).select(attempts.columns)


def collapse_retries(tries: DataFrame, retries: int = 2) -> DataFrame:
    """One attempt for each rung of tries (attempts with try_no from 0): the first that isn't worth another try,
    else the last; tries beyond retries were never made. n_tries counts those made."""
    from pagequarry.functions.quality import is_retryable_error, is_retryable_status

    again = is_retryable_status("status_code") | is_retryable_error("error")
    rung = W.partitionBy("url", "tier", "ord")
    t = tries.where(F.col("try_no") <= retries).withColumn("__end", F.coalesce(F.min(F.when(~again, F.col("try_no"))).over(rung), F.max("try_no").over(rung)))
    return t.where(F.col("try_no") == F.col("__end")).withColumn("n_tries", F.col("try_no") + 1).drop("__end", "try_no")


def rotate_proxies(tries: DataFrame, codes: Sequence[int], retries: int = 2) -> DataFrame:
    """One attempt for each rung of tries (sub-attempts by proxy, try_no from 0): the first whose status doesn't
    call for another proxy, else the last within retries; rotated counts the proxies that were given up."""
    t = tries.where(F.col("try_no") <= retries)
    stays = ~F.col("status_code").isin(*codes) if codes else F.lit(True)
    rung = W.partitionBy("url", "tier", "ord")
    t = t.withColumn("__end", F.coalesce(F.min(F.when(stays, F.col("try_no"))).over(rung), F.max("try_no").over(rung)))
    return t.where(F.col("try_no") == F.col("__end")).withColumn("rotated", F.col("try_no")).drop("__end", "try_no")


def walk_ladder(checked: DataFrame) -> DataFrame:
    """Attempts that were made: up to the first that is valid or doesn't escalate."""
    stop = F.min(F.when(F.col("valid") | ~F.col("escalate"), F.col("ord"))).over(W.partitionBy("url"))
    return checked.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("ord") <= F.col("__stop"))).drop("__stop")


def attempt_text(cached: Column | None = None) -> Column:
    """``tier: error or reason``."""
    why = F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.col("error")).otherwise(F.col("reason"))
    return F.concat(F.col("tier"), F.when(cached, F.lit(" (cached)")).otherwise(F.lit("")) if cached is not None else F.lit(""), F.lit(": "), why)


def outcomes(checked: DataFrame) -> DataFrame:
    """One row a URL: the winner or, without one, the evidence of the last attempt that had a response, with what else
    it carries (final_url, redirects, from_cache, evasion, screenshot)."""
    made = walk_ladder(checked)
    responded = F.coalesce(F.col("error"), F.lit("")) == ""
    more = [c for c in ("final_url", "redirects", "from_cache", "evasion", "screenshot") if c in checked.columns]
    row = F.struct("ord", "tier", "status_code", "content_type", "body", "duration_ms", *more)
    text = F.concat(F.col("tier"), F.lit(":"), F.when(~responded, F.col("error")).otherwise(F.col("reason")))
    each = F.struct("ord", text.alias("text"), F.col("escalate"), F.col("valid"), F.col("vendor"), F.col("marker"), F.col("tier"))
    g = made.groupBy("url").agg(
        F.max(F.when(F.col("valid"), row)).alias("w"), F.max(F.when(responded, row)).alias("l"), F.max(F.struct("ord", "tier", "error", "reason", "escalate")).alias("t"),
        F.sort_array(F.collect_list(each)).alias("all"),
    )  # fmt: skip  at most one rung a tier
    won = F.col("w").isNotNull()
    got = F.coalesce("w", "l")
    blocks = F.filter("all", lambda x: x["vendor"].isNotNull())
    last_why = F.when(F.coalesce(F.col("t.error"), F.lit("")) != "", F.col("t.error")).otherwise(F.col("t.reason"))
    error = F.when(won, F.lit(None).cast("string")).when(~F.col("t.escalate"), F.concat(F.col("t.tier"), F.lit(": "), last_why)).otherwise(F.concat(F.lit("all tiers exhausted: ["), F.array_join(F.transform("all", lambda x: x["text"]), " "), F.lit("]")))
    out = g.select(
        "url", won.alias("valid"), F.when(won, F.col("w.tier")).otherwise(F.col("t.tier")).alias("tier"), F.coalesce(got["status_code"], F.lit(0)).alias("status_code"), got["content_type"].alias("content_type"),
        got["body"].alias("body"), F.coalesce(got["duration_ms"], F.lit(0)).alias("duration_ms"), F.size("all").alias("n_attempts"), error.alias("error"),
        F.when(F.size(blocks) > 0, F.struct(F.lit(True).alias("detected"), blocks[0]["vendor"].alias("vendor"), blocks[0]["marker"].alias("marker"), F.transform(blocks, lambda x: x["tier"]).alias("tiers"))).alias("soft_block"),
        *[got[c].alias(c) for c in more],
    )
    return out.withColumn("failure_category", F.when(F.col("valid"), F.lit("success")).otherwise(classify_failure("error", F.lit(""), "status_code")))


def with_cache(attempts: DataFrame, cache: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    """attempts answered from the content cache where it has (url, tier) stored within ttl_hours; from_cache says
    which. Cached answers are checked again like any other, but neither stored nor learned from."""
    hit = cache.where((F.lit(ttl_hours) > 0) & (F.col("stored_at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_hours * 3600))))
    c = hit.select("url", "tier", *[F.col(x).alias(f"__{x}") for x in ("status_code", "content_type", "body")], F.lit(True).alias("__hit"))
    j = attempts.join(c, ["url", "tier"], "left")
    here = F.col("__hit").isNotNull()
    swap = {"status_code", "content_type", "body"}
    cols = [F.when(here, F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in swap else F.when(here, F.lit(None)).otherwise(F.col(x)).alias(x) if x == "error" else F.col(x) for x in attempts.columns if x != "from_cache"]
    return j.select(*cols, here.alias("from_cache"))


def cache_puts(made: DataFrame, now: Column) -> DataFrame:
    """New entries of the content cache: valid answers that were fetched, latest rung of each (url, tier)."""
    live = made.where(F.col("valid") & ~F.coalesce(F.col("from_cache"), F.lit(False)) if "from_cache" in made.columns else F.col("valid"))
    return live.groupBy("url", "tier").agg(F.max_by(F.struct("status_code", "content_type", "body"), "ord").alias("r")).select("url", "tier", "r.*", now.alias("stored_at"))


def tier_observations(made: DataFrame, now: Column) -> DataFrame:
    """(host, tier, updated_at) learned from valid answers that were fetched."""
    live = made.where(F.col("valid") & ~F.coalesce(F.col("from_cache"), F.lit(False)) if "from_cache" in made.columns else F.col("valid"))
    return live.select(host_of("url").alias("host"), "tier", now.alias("updated_at"))


def latest_tier(observed: DataFrame, at: str = "updated_at", tie: str | None = None) -> DataFrame:
    """Latest tier of each host."""
    order = F.struct(at, *([tie] if tie else []))
    return observed.groupBy("host").agg(F.max_by("tier", order).alias("tier"), F.max(at).alias(at))


def overlay_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary outcomes (url, fallback_url, failure_category, ...) with a failed one replaced by its fallback's answer.

    fallback: url (the primary's), followed (link found, or null), tier, status_code, failure_category.
    discovery is primary or fallback; a fallback that fails leaves the primary record."""
    f = fallback.select("url", F.col("followed").alias("__followed"), *[F.col(c).alias(f"__{c}") for c in ("tier", "status_code", "failure_category")])
    j = primary.join(f, "url", "left")
    tried = F.col("failure_category").isin("http_4xx", "dns_failure") & (F.coalesce(F.col("fallback_url"), F.lit("")) != "")
    won = F.coalesce(tried & (F.col("__failure_category") == "success"), F.lit(False))
    state = F.when(~tried, "not_tried").when(won, "succeeded").when(F.col("__followed").isNull() & (F.coalesce(F.col("__failure_category"), F.lit("")) == "no_link"), "no_link").otherwise("unreachable")
    return j.select(
        *[F.when(won, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in ("tier", "status_code", "failure_category") else F.col(c) for c in primary.columns],
        F.when(won, "fallback").otherwise("primary").alias("discovery"), F.when(won, F.col("__followed")).alias("followed_url"), state.alias("fallback_state"),
    )
