"""Host rules, robots rules and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions.quality import jitter_bound
from pagequarry.functions.urls import match_host_pattern, part, trim_ws


def host_rules(hosts: DataFrame, rules: DataFrame, rate: float = 1.0, concurrency: int = 4, jitter: float = 0.0) -> DataFrame:
    """host, rule_idx, rate, concurrency, jitter of the first matching rule; what it leaves open is the default.

    rules (rule_idx, match, rate, concurrency, jitter) is a configuration file's content. A host meets the
    patterns by equality: its own name and ``*.`` with each of its suffixes."""
    labels = F.split(F.lower(F.col("host")), r"\.")
    suffixes = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(F.lower(F.col("host"))), suffixes)
    h = hosts.select("host").distinct()
    met = h.select("host", F.explode(keys).alias("k")).join(rules.withColumn("k", F.lower("match")), "k").where(match_host_pattern(F.col("host"), F.col("match")))
    best = met.groupBy("host").agg(F.min_by(F.struct("rule_idx", "rate", "concurrency", "jitter"), "rule_idx").alias("r"))
    return h.join(best, "host", "left").select("host", F.col("r.rule_idx").alias("rule_idx"), F.coalesce("r.rate", F.lit(rate)).alias("rate"), F.coalesce("r.concurrency", F.lit(concurrency)).alias("concurrency"), F.coalesce("r.jitter", F.lit(jitter)).alias("jitter"))


def parse_robots(docs: DataFrame, agent: str = "*") -> DataFrame:
    """host, type (allow or disallow), path, n (its place) for the group of agent, else of ``*``.

    docs: host, status, body. A 4xx answer has no rules; any other body is read."""
    line = F.explode(F.transform(F.split("body", "\n"), lambda x, i: F.struct(i.alias("n"), trim_ws(F.regexp_replace(x, "#.*$", "")).alias("t"))))
    rows = docs.where(~F.col("status").between(400, 499)).select("host", line.alias("l")).select("host", "l.n", F.lower(trim_ws(F.regexp_extract("l.t", r"^([^:]+):", 1))).alias("k"), trim_ws(F.regexp_extract("l.t", r"^[^:]+:(.*)$", 1)).alias("v")).where("k IN ('user-agent', 'allow', 'disallow')")
    order = W.partitionBy("host").orderBy("n")  # the lines of one file
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("g", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    names = rows.where("k = 'user-agent'").select("host", "g", F.lower("v").alias("agent"))
    mine = names.withColumn("s", F.when(F.lit(agent.lower()).contains(F.col("agent")) & (F.col("agent") != "*"), 2).when(F.col("agent") == "*", 1).otherwise(0)).where("s > 0")
    chosen = mine.join(mine.groupBy("host").agg(F.max("s").alias("s")), ["host", "s"]).select("host", "g").distinct()
    return rows.where("k <> 'user-agent' AND v <> ''").join(chosen, ["host", "g"]).select("host", F.col("k").alias("type"), F.col("v").alias("path"), "n")


def rule_pattern(path: Column) -> Column:
    """What a rule's path stands for: a regular expression where it has ``*`` or ``$``, else null (it is a prefix)."""
    quoted = F.regexp_replace(path, r"([\\.+?()|\[\]{}^])", r"\\$1")
    return F.when(path.rlike(r"[*$]"), F.replace(quoted, F.lit("*"), F.lit(".*")))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, host) with allowed. The longest rule that fits the path decides, of equals the first in the file; a
    pattern is as long as its expression. Only the path counts, decoded and without the query.

    rules: host, type, path and, if the order matters, n. A path that begins with neither / nor * gets a /; stars at
    its end say nothing; ``*`` stands for any characters and ``$`` for the end."""
    raw = F.when(part(F.col("url"), 3) == "", "/").otherwise(part(F.col("url"), 3))
    path = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    given = F.when(F.col("path").rlike(r"^[/*]"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))
    n = F.col("n") if "n" in rules.columns else F.lit(0)
    r = rules.where("path <> ''").select("host", "type", n.alias("__n"), F.regexp_replace(given, r"[*]+$", "").alias("__r"))
    r = r.withColumn("__x", rule_pattern(F.col("__r")))
    fits = F.when(F.col("__x").isNull(), F.startswith("__p", "__r")).otherwise(F.rlike("__p", "__x"))
    met = urls.select("url", "host", path.alias("__p")).join(r, "host").where(fits)
    size = F.length(F.coalesce("__x", "__r"))
    best = met.groupBy("url").agg(F.min(F.struct((-size).alias("size"), F.col("__n"), (F.col("type") != "allow").alias("no"))).alias("b"))
    return urls.join(best, "url", "left").withColumn("allowed", ~F.coalesce(F.col("b.no"), F.lit(False))).drop("b")


def sitemap_directives(docs: DataFrame) -> DataFrame:
    """host, pos, url of the Sitemap lines of robots files."""
    return docs.select("host", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("pos", "url"))


def pacing(queue: DataFrame, rate: Column, burst: int = 1, jitter: float = 0.0) -> DataFrame:
    """queue (host, seq) with start_s, the earliest start in seconds of a token bucket for each host. A jitter of j
    puts up to j intervals on top of a start, by a hash of host and seq; the bucket itself keeps its pace."""
    n = F.row_number().over(W.partitionBy("host").orderBy("seq"))
    start = F.when(rate > 0, F.greatest(n - F.lit(burst), F.lit(0)) / rate).otherwise(F.lit(0.0))
    if jitter:
        part = F.pmod(F.xxhash64("host", "seq"), F.lit(1 << 20)) / float(1 << 20)
        start = start + jitter_bound(rate, F.lit(jitter)) * part
    return queue.withColumn("start_s", start)
