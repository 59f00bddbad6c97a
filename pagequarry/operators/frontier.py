"""The work queue as tables: first-seen dedup, sequence numbers, states, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions.urls import canonicalize_url

STATES = ("queued", "in_flight", "done", "failed")


def first_seen(seeds: DataFrame, pos: str = "pos", url: str = "url") -> DataFrame:
    """seeds with canonical_url, one row each: the first by position; invalid URLs go.

    A grouped minimum (which combines before the shuffle) picks the row, so a URL that many seeds share
    costs no more than another."""
    s = seeds.withColumn("canonical_url", canonicalize_url(url)).where("canonical_url IS NOT NULL")
    rest = [c for c in s.columns if c != "canonical_url"]
    return s.groupBy("canonical_url").agg(F.min_by(F.struct(*rest), pos).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in rest], "canonical_url")


def global_rank(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with name, the row's rank by the distinct long column by, from 0, without sorting all rows in one task:
    counts of ranges of by give each range's offset, and ranks are taken within ranges."""
    width = 1 << 16
    ranged = df.withColumn("__r", F.floor(F.col(by) / width).cast("long"))
    offsets = ranged.groupBy("__r").agg(F.count(F.lit(1)).alias("n")).withColumn("__o", F.coalesce(F.sum("n").over(W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(W.partitionBy("__r").orderBy(by)) - 1
    return ranged.withColumn("__i", inner).join(offsets, "__r").withColumn(name, F.col("__o") + F.col("__i")).drop("__r", "__i", "__o")


def sorted_rank(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with name, the row's rank by the columns, from 0: a range sort, written down, whose partitions' row counts
    (a row each reaches the driver) shift the places within them. No task sees more than a range."""
    from pagequarry.operators.crawl import held

    t = held(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)
    sizes = sorted((r["p"], r["n"]) for r in t.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    at, shifts = 0, []
    for p, n in sizes:
        shifts.append((p, at))
        at += n
    shift = F.broadcast(df.sparkSession.createDataFrame(shifts, "__p long, __o long"))
    return t.withColumn("__p", part).join(shift, "__p").withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__o", "__m")


def enqueue(seeds: DataFrame, now: Column) -> DataFrame:
    """Frontier rows of new seeds (pos, url, fallback), in order of first sight."""
    q = global_rank(first_seen(seeds), "pos", "seq")
    fallback = F.col("fallback") if "fallback" in seeds.columns else F.lit("")
    return q.select(F.col("canonical_url").alias("url"), F.lit("queued").alias("state"), F.lit(0).alias("attempts"), F.lit("").alias("last_tier"), F.lit("").alias("last_error"), now.alias("enqueued_at"), now.alias("updated_at"), "seq", fallback.alias("fallback"), F.lit(0).alias("depth"))


def enqueue_summary(seeds: DataFrame) -> DataFrame:
    """added, dupes, skipped (no URL), with_fallback."""
    s = seeds.withColumn("c", canonicalize_url("url"))
    fallback = F.coalesce(F.col("fallback"), F.lit("")) if "fallback" in seeds.columns else F.lit("")
    by_url = s.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min_by(fallback, "pos").alias("f"))
    known = F.col("c").isNotNull()
    total = lambda v: F.coalesce(F.sum(v), F.lit(0))
    return by_url.agg(F.count_if(known).alias("added"), total(F.when(known, F.col("n") - 1)).alias("dupes"), total(F.when(~known, F.col("n"))).alias("skipped"), F.count_if(known & (F.col("f") != "")).alias("with_fallback"))


def replay(events: DataFrame) -> DataFrame:
    """State of each URL from a log (url, op, tier, err, ts, n): enqueue, next, done, failed, recover.

    attempts counts the nexts; the latest operation gives the state."""
    state = F.when(F.col("op").isin("enqueue", "recover"), "queued").when(F.col("op") == "next", "in_flight").when(F.col("op") == "done", "done").otherwise("failed")
    at = F.struct("ts", "n")
    e = events.withColumn("s", state)
    g = e.groupBy("url").agg(
        F.max_by("s", at).alias("state"), F.count_if(F.col("op") == "next").cast("int").alias("attempts"), F.coalesce(F.max_by(F.when(F.col("op").isin("done", "failed"), F.col("tier")), F.when(F.col("op").isin("done", "failed"), at)), F.lit("")).alias("last_tier"),
        F.coalesce(F.max_by(F.when(F.col("op") == "failed", F.col("err")), F.when(F.col("op") == "failed", at)), F.lit("")).alias("last_error"), F.min("ts").alias("enqueued_at"), F.max("ts").alias("updated_at"),
    )
    return g


def recover(frontier: DataFrame) -> DataFrame:
    """What was in flight is queued again, behind all others, in its old order."""
    top = frontier.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top")).first()["top"]
    flight = global_rank(frontier.where("state = 'in_flight'"), "seq", "__k")
    moved = flight.withColumn("seq", F.lit(top + 1) + F.col("__k")).withColumn("state", F.lit("queued"))
    return frontier.where("state <> 'in_flight'").unionByName(moved.select(frontier.columns))


def counts(frontier: DataFrame) -> DataFrame:
    """queued, in_flight, done, failed, total, success_rate (done of done and failed)."""
    by = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    out = frontier.agg(*by, F.count(F.lit(1)).alias("total"))
    ended = F.col("done") + F.col("failed")
    return out.withColumn("success_rate", F.when(ended > 0, F.col("done") / ended).otherwise(F.lit(0.0)))


def next_urls(frontier: DataFrame, n: int) -> DataFrame:
    """The n oldest queued URLs."""
    return frontier.where("state = 'queued'").orderBy("seq").limit(n)


def unseen(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Links whose URL isn't known yet."""
    return links.join(seen.select("url").distinct(), "url", "left_anti")


def resolve_pointers(pointers: DataFrame, frontier: DataFrame) -> DataFrame:
    """Queue pointers (seq, url) with their records; dangling says that there is none."""
    f = frontier.drop("seq").withColumn("__found", F.lit(True))
    return pointers.join(f, "url", "left").withColumn("dangling", F.col("__found").isNull()).drop("__found")
