"""What the command line of a crawler offers, as functions on DataFrames of stored responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.quality import is_html, is_reachable, should_try_fallback
from pagequarry.functions.urls import canonicalize_url, url_host
from pagequarry.html.functions import parse_page
from pagequarry.html.spec import Schema, parse_field_spec
from pagequarry.operators import crawl as _crawl
from pagequarry.operators import frontier, politeness, records, route, stats
from pagequarry.sources.config import JobConfig, duration_ms, parse_status_codes


@dataclass(frozen=True)
class Job:
    """What a batch leaves behind."""

    records: DataFrame
    dead_letters: DataFrame
    stats: DataFrame
    #: attempted, succeeded, no_link, unreachable
    fallbacks: DataFrame
    #: New entries of the content cache and of the tier cache.
    cache_puts: DataFrame
    tiers: DataFrame


def _routed(urls: DataFrame, fetches: DataFrame, config: JobConfig, now: Column, content_cache: DataFrame | None, tier_cache: DataFrame | None) -> DataFrame:
    """Checked attempts of urls (url): retries made, cached answers put in, the host's known tier first. They are
    written down, as outcomes, cache entries and tiers are all made of them."""
    a = fetches.where(F.col("tier").isin(*config.ladder)).join(urls.select("url").distinct(), "url", "left_semi")
    if "try_no" in a.columns:
        a = route.collapse_retries(a, config.retries).drop("n_tries")
    if content_cache is not None and config.cache_enabled:
        a = route.with_cache(a, content_cache, now, duration_ms(config.cache_ttl) / 3.6e6)
    if tier_cache is not None and not config.no_tier_learning:
        a = route.reorder(a, tier_cache)
    return _crawl.held(route.check_attempts(a, rotate_codes=parse_status_codes(config.rotate_on_status)), "attempts")


def batch_job(seeds: DataFrame, fetches: DataFrame, config: JobConfig, now: Column, schema: Schema | None = None, robots: DataFrame | None = None, content_cache: DataFrame | None = None, tier_cache: DataFrame | None = None, pdf_texts: DataFrame | None = None) -> Job:
    """The distinct seeds (pos, url, fallback) of a job, from stored answers to records.

    fetches: url (canonical), tier, ord, status_code, content_type, body, error, duration_ms, and if there is more
    than one try a rung try_no; only the configured tiers count. robots: rules of politeness.parse_robots. A seed
    that robots rules bar has a record of its own; one without any stored answer has none. Where the first answer is
    a client error or its host is unknown, the seed's fallback page is read, and the first link there that
    fallback_selector finds and whose page is reachable takes its place, under the seed's url."""
    config.check()
    queue = frontier.enqueue(seeds, now).select("url", "fallback")
    barred = None
    if robots is not None and not config.ignore_robots:
        checked = politeness.robots_allowed(queue.withColumn("host", url_host("url")), robots)
        barred, queue = checked.where("NOT allowed").select("url"), checked.where("allowed").select("url", "fallback")
    made = _routed(queue, fetches, config, now, content_cache, tier_cache)
    primary = route.outcomes(made).join(queue, "url").withColumn("seed_url", F.col("url"))
    here = primary.sparkSession.createDataFrame([], "fallback_state string")
    if config.fallback_selector:
        primary, here, more = _with_fallback(primary, fetches, config, now, content_cache, tier_cache)
        made = made.unionByName(more, allowMissingColumns=True)
    chosen = primary.drop("fallback")
    if pdf_texts is not None:
        chosen = records.apply_pdf(chosen, pdf_texts, config.ocr)
    fields = [parse_field_spec(s) for s in config.selectors]
    built = records.build(chosen, now, fields, schema, config.format, not config.no_metadata, config.readability, config.screenshot_dir)
    if barred is not None:
        built = built.unionByName(records.blocked(barred, built, now, config.ladder[0]))
    built = _crawl.held(built, "records")
    return Job(built, records.dead_letters(built), stats.snapshot(built), stats.fallbacks(here), route.cache_puts(made, now), route.latest_tier(route.tier_observations(made, now)))


def _with_fallback(primary: DataFrame, fetches: DataFrame, config: JobConfig, now: Column, content_cache: DataFrame | None, tier_cache: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """primary with discovery, failed ones replaced; fallback_state of each seed; the attempts made for it."""
    has = F.coalesce("fallback", F.lit("")) != ""
    want = primary.where(has & should_try_fallback("failure_category")).select("seed_url", F.col("fallback").alias("fallback_url"), canonicalize_url("fallback").alias("url"))
    pages = _routed(want.select("url"), fetches, config, now, content_cache, tier_cache)
    page = route.outcomes(pages).where("valid").select("url", first_of("body", F.coalesce("final_url", "url") if "final_url" in fetches.columns else F.col("url"), config.fallback_selector).alias("link"))
    found = want.join(page.select("url", F.lit(True).alias("read"), canonicalize_url("link").alias("link")), "url", "left")
    found = _crawl.held(found.select("seed_url", "fallback_url", F.coalesce("read", F.lit(False)).alias("read"), "link"), "fallbacks")
    links = _routed(found.where("link IS NOT NULL").select(F.col("link").alias("url")), fetches, config, now, content_cache, tier_cache)
    answer = route.outcomes(links).where(is_reachable("failure_category"))
    state = F.when(F.col("won").isNotNull(), "succeeded").when(F.col("read") & F.col("link").isNull(), "no_link").otherwise("unreachable")
    answer = _crawl.held(answer, "fallback-answers")
    tried = found.join(answer.select(F.col("url").alias("link"), F.lit(True).alias("won")), "link", "left").select("seed_url", "fallback_url", "link", state.alias("fallback_state"))
    won = tried.where("fallback_state = 'succeeded'")
    told = lambda path: F.struct(F.lit(path).alias("path"), F.col("seed_url").alias("primary_url"), F.col("fallback").alias("fallback_url"))
    kept = primary.join(won.select("seed_url"), "seed_url", "left_anti").withColumn("discovery", F.when(has, told("primary")))
    put = answer.join(won.select(F.col("link").alias("url"), "seed_url", F.col("fallback_url").alias("fallback")), "url").withColumn("discovery", told("fallback"))
    here = primary.select("seed_url").join(tried.select("seed_url", "fallback_state"), "seed_url", "left").select(F.coalesce("fallback_state", F.lit("not_tried")).alias("fallback_state"))
    return kept.unionByName(put, allowMissingColumns=True), here, pages.unionByName(links)


def first_of(html: str, base: Column, selector: str) -> Column:
    """First link of the page that selector finds, on the page's own domain."""
    return parse_page(html, base, first=selector, same_domain=True)["first"]


def batch(seeds: DataFrame, fetches: DataFrame, config: JobConfig, now: Column, schema: Schema | None = None, **tables: DataFrame) -> DataFrame:
    """Records of a batch; tables are those of batch_job."""
    return batch_job(seeds, fetches, config, now, schema, **tables).records


def write_job(job: Job, config: JobConfig, folder: str) -> None:
    """Records to config.output, dead letters and statistics as JSON lines beside each other under folder."""
    records.write(job.records, config.output if "/" in config.output else f"{folder}/{config.output}", config.csv_columns or None)
    records.write(job.dead_letters, f"{folder}/dead_letter.jsonl")
    job.stats.write.mode("overwrite").json(f"{folder}/stats.json")


def scrape(url: str, fetches: DataFrame, config: JobConfig, now: Column, schema: Schema | None = None, **tables: DataFrame) -> DataFrame:
    """The record of one URL, which is kept as it was given."""
    one = fetches.sparkSession.createDataFrame([(0, url, "")], "pos long, url string, fallback string")
    return batch(one, fetches, config, now, schema, **tables).withColumn("url", F.lit(url))


def links_of(fetches: DataFrame, same_domain: bool = True) -> DataFrame:
    """Edges (src, dst, ord) between canonical URLs of valid HTML answers."""
    ok = route.outcomes(route.check_attempts(fetches)).where("valid AND (coalesce(content_type, '') = '' OR lower(content_type) LIKE '%html%')")
    e = ok.select(F.col("url").alias("src"), F.posexplode(parse_page("body", "url", links=True, same_domain=same_domain)["links"]).alias("ord", "to"))
    return e.select("src", canonicalize_url("to").alias("dst"), "ord").where("dst IS NOT NULL")


def links_for_map(fetches: DataFrame, same_domain: bool = True) -> DataFrame:
    """Edges (src, dst, ord) of the http tier's HTML answers, whatever their status and validity: a map only looks for links."""
    http = fetches.where("tier = 'http' AND coalesce(error, '') = ''").where(is_html(F.coalesce("content_type", F.lit(""))))
    base = F.coalesce("final_url", "url") if "final_url" in fetches.columns else F.col("url")
    one = http.groupBy("url").agg(F.min_by(F.struct("body", base.alias("base")), "ord").alias("a")).select("url", "a.*")
    e = one.select(F.col("url").alias("src"), F.posexplode(parse_page("body", "base", links=True, same_domain=same_domain)["links"]).alias("ord", "to"))
    return e.select("src", canonicalize_url("to").alias("dst"), "ord").where("dst IS NOT NULL")


def crawl(seed: DataFrame, fetches: DataFrame, config: JobConfig) -> DataFrame:
    """url, depth, rank of the pages that a crawl from seed (url) would visit."""
    start = seed.select(canonicalize_url("url").alias("url")).where("url IS NOT NULL")
    return _crawl.crawl(start, links_of(fetches, config.same_domain), config.depth, config.limit)


def site_map(seed: DataFrame, fetches: DataFrame, sitemaps: DataFrame, starts: DataFrame, config: JobConfig) -> DataFrame:
    """url, source, pos of a site: its sitemaps' pages, then the crawl's."""
    pages, _ = _crawl.walk_sitemaps(sitemaps, starts, max_urls=config.sitemap_max)
    start = seed.select(canonicalize_url("url").alias("url")).where("url IS NOT NULL")
    found = _crawl.crawl(start, links_for_map(fetches, config.same_domain), config.depth, config.limit)
    return _crawl.map_union(pages.select(canonicalize_url("url").alias("url"), "pos").where("url IS NOT NULL"), found.select("url", F.col("rank").alias("pos")), config.limit, config.sources)


def resume(queue: DataFrame) -> DataFrame:
    """What is left of a job: interrupted URLs are queued again, behind the others."""
    return frontier.recover(queue).where("state = 'queued'")
