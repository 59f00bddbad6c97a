"""Breadth-first crawls, site maps and sitemap walks as rounds of joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators.frontier import sorted_rank


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local master has one of its own; on a cluster
    that would be a folder on each machine, so there it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def held(df: DataFrame, name: str = "crawl") -> DataFrame:
    """df cut from its lineage: a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagequarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int = 2, limit: int = 1000) -> DataFrame:
    """url, depth, rank (order of discovery) of a breadth-first crawl.

    seeds: url. edges: src, dst, ord (links of pages that can be followed). limit caps the URLs that are
    enqueued, seeds included; 0 is none. Order is by depth, the parent's rank, then ord, so the cap is
    deterministic. Each round joins the new URLs to the edges, drops known ones by an anti-join and
    stops when nothing is new."""
    cap = (lambda d, done: d.where(F.col("rank") < limit)) if limit else (lambda d, done: d)
    first = sorted_rank(seeds.select("url").distinct(), ["url"], "rank")
    seen = held(cap(first, 0).select("url", F.lit(0).alias("depth"), F.col("rank").cast("long").alias("rank")))
    new, n = seen, seen.count()
    for depth in range(1, max_depth + 1):
        if not n or limit and n >= limit:
            break
        links = new.select(F.col("url").alias("src"), "rank").join(edges.select("src", "dst", "ord"), "src")
        order = F.struct("rank", "ord", "dst")
        found = links.groupBy("dst").agg(F.min(order).alias("at")).withColumnRenamed("dst", "url").join(seen.select("url"), "url", "left_anti")
        if limit:
            found = found.orderBy("at").limit(max(limit - n, 0))
        at = found.select("url", F.col("at.rank").alias("r"), F.col("at.ord").alias("o"))
        ranked = sorted_rank(at, ["r", "o", "url"], "i")
        new = held(ranked.select("url", F.lit(depth).alias("depth"), (F.lit(n) + F.col("i")).cast("long").alias("rank")))
        k = new.count()
        if not k:
            break
        seen, n = seen.unionByName(new), n + k
    return seen


def map_union(sitemap: DataFrame, pages: DataFrame, limit: int = 0, sources: str = "both") -> DataFrame:
    """Distinct URLs of a site: the sitemap's first, then the crawl's. Inputs: url, pos. Out: url, source, pos."""
    parts = []
    if sources in ("both", "sitemap"):
        parts.append(sitemap.select("url", "pos", F.lit(0).alias("p")))
    if sources in ("both", "crawl"):
        parts.append(pages.select("url", "pos", F.lit(1).alias("p")))
    if not parts:
        raise ValueError(f"sources {sources!r}: both, sitemap or crawl expected")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = every.groupBy("url").agg(F.min(F.struct("p", "pos")).alias("at"))
    if limit:
        out = out.orderBy("at", "url").limit(limit)
    return out.select("url", F.when(F.col("at.p") == 0, "sitemap").otherwise("crawl").alias("source"), F.col("at.pos").alias("pos"))


LOCS = "xpath({}, '//*[local-name()=\"{}\"]/*[local-name()=\"loc\"]/text()')"


def parse_sitemap(docs: DataFrame, body: str = "body") -> DataFrame:
    """docs with urls and children: the locations of a urlset and of a sitemap index, trimmed, blank ones off."""
    clean = lambda kind: F.filter(F.transform(F.expr(LOCS.format(body, kind)), lambda x: F.trim(x)), lambda x: x != "")
    return docs.withColumn("urls", clean("url")).withColumn("children", clean("sitemap"))


def walk_sitemaps(docs: DataFrame, starts: DataFrame, max_depth: int = 3, max_urls: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(url, pos) of all pages, and (url, depth, urlset_count, index_count, truncated) of the sitemaps walked; truncated
    says of the whole walk that locations were left once max_urls pages were found.

    docs: url, body. starts: url, pos. Each sitemap is read once, however often it is named; indexes go
    max_depth levels down; of more than max_urls pages the first by position stay (0: 50000)."""
    parsed = held(parse_sitemap(docs).select("url", "urls", "children"))
    seen = new = held(starts.groupBy("url").agg(F.min("pos").alias("pos")).select("url", F.lit(0).alias("depth"), F.array("pos").cast("array<bigint>").alias("path")))
    for depth in range(1, max_depth + 1):
        kids = new.join(parsed, "url").select("path", F.posexplode("children").alias("i", "child"))
        found = kids.groupBy(F.col("child").alias("url")).agg(F.min(F.array_append("path", F.col("i").cast("bigint"))).alias("path")).join(seen.select("url"), "url", "left_anti")
        new = held(found.select("url", F.lit(depth).alias("depth"), "path"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    walked = seen.join(parsed, "url")
    locs = walked.select("depth", "path", F.posexplode("urls").alias("i", "loc"))
    at = F.struct("depth", "path", "i")
    cap = max_urls or 50_000
    pages = held(sorted_rank(locs.groupBy(F.col("loc").alias("url")).agg(F.min(at).alias("at")), ["at", "url"], "pos").where(F.col("pos") < cap))
    n, last = pages.agg(F.count(F.lit(1)), F.max("at")).first()
    truncated = n >= cap and n > 0 and locs.select(at.alias("at")).where(F.col("at") > F.struct(F.lit(last["depth"]).alias("depth"), F.lit(list(last["path"])).cast("array<bigint>").alias("path"), F.lit(last["i"]).alias("i"))).limit(1).count() > 0
    trace = walked.select("url", "depth", F.size("urls").alias("urlset_count"), F.size("children").alias("index_count"), F.lit(truncated).alias("truncated"))
    return pages.select("url", F.col("pos").cast("long").alias("pos")), trace
