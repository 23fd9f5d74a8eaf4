"""URL filters: a sort-merge range join of reversed-host keys with a stack of nested rules. DataFrame operations only.

The key of a host is its labels in reverse, each ended by a dot ("www.a.com" -> "com.a.www."), so a rule's host and all its subdomains are one interval of keys. The key of a url below a rule's host is that host's key with the url's path behind it, so a rule is again one interval: all keys that begin with its own.
Two sweeps find the intervals that hold a key. The first sorts distinct hosts and rule hosts together and gives each host the rule hosts above it, at most one for each of its labels. The second sorts the distinct pairs of a rule host and a path of the urls below it, and the rules themselves; the urls join what it finds, where Spark can split a pair that many hosts have.
In both, range partitions are gone through in order, and the top of the stack is the last interval that began. Intervals nest, so what is active below it is known beforehand: the chain of those that hold it, no longer than the nesting is deep. Those that began before a partition are carried in at its lowest key.
Only distinct hosts and urls are sorted; the pages themselves join them on host and path, where Spark can split a url that holds a third of all rows.

Nulls: a null url has the host '' and the path '', and no rule. Rows that repeat, very long urls, and extra columns of any name, change nothing. Of equal rules one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

#: Fixed values of the query: (host, path, action).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Rows of a range partition.
ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def chain_keys(key: Column) -> Column:
    """The keys of a host and of all that it is a subdomain of."""
    labels = F.split(F.regexp_replace(key, r"\.$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))


def sweep(points: DataFrame, chains: DataFrame, begun) -> DataFrame:
    """points with `chain`, that of the last interval at or before their key which began before them or at them.

    points: key and more; chains: key, chain, one for each interval; begun: from (bucket, low), the lowest key of each bucket, to (bucket, low, chain) of the intervals that hold it.
    """
    spark, kind = points.sparkSession, chains.schema["chain"].dataType
    cols = [c for c in points.columns if c != "key"]
    events = points.select("key", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("chain"), F.struct(*cols).alias("point"))
    point = events.schema["point"].dataType
    events = saved(events.unionByName(chains.select("key", F.lit(0).alias("kind"), "chain", F.lit(None).cast(point).alias("point"))), "events")
    n = max(2 * spark.sparkContext.defaultParallelism, -(-events.count() // ROWS))
    events = saved(events.repartitionByRange(n, "key").withColumn("bucket", F.spark_partition_id()), "ranges")
    carried = begun(events.groupBy("bucket").agg(F.min("key").alias("low"))).select(F.col("low").alias("key"), F.lit(-1).alias("kind"), "chain", F.lit(None).cast(point).alias("point"), "bucket")
    top = F.last("chain", ignorenulls=True).over(Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return events.unionByName(carried).withColumn("top", top).where("kind = 1").select("key", "point.*", F.col("top").alias("chain"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (its host and path) and verdict to every row of pages.

    rules: host, path, action, a table of its own. Of the rules that fit, the longest (host, then path) wins; default judges a url that none fits.
    """
    rules = saved(rules.select(F.translate("host", UPPER, LOWER).alias("rh"), F.col("path").alias("rp"), "action").dropDuplicates(["rh", "rp"]).withColumn("hk", key_of(F.col("rh"))), "rules")
    judged = pages.withColumn("_url", F.col(url)).withColumn("_h", host_of(F.col("_url"))).withColumn("_p", path_of(F.col("_url")))
    urls = saved(judged.select(F.col("_h").alias("h"), F.col("_p").alias("p")).distinct(), "urls")

    # first sweep: the rule hosts above each host
    rule_hosts = rules.select("hk", "rh").distinct()

    def holders(keys: DataFrame, key: str) -> DataFrame:
        """The chain of rule hosts, longest first, that hold each key of a host."""
        up = keys.select("*", F.explode(chain_keys(F.col(key))).alias("hk")).join(rule_hosts, "hk")
        return up.groupBy(*keys.columns).agg(F.sort_array(F.collect_list(F.struct(F.length("hk").alias("n"), "hk", "rh")), False).alias("chain"))

    hosts = urls.select("h").distinct().select("h", key_of(F.col("h")).alias("key"))
    chains = holders(rule_hosts.select(F.col("hk").alias("key")), "key")
    above = sweep(hosts, chains, lambda lows: holders(lows, "low"))
    above = saved(above.select("h", F.explode(F.filter("chain", lambda r: F.startswith("key", r["hk"]))).alias("r")).select("h", "r.hk", "r.rh"), "above")

    # second sweep: of each of these, the rule with the longest path that the url's path begins with
    sizes = rules.select("hk", F.length("rp").alias("n")).distinct()

    def prefixes(keys: DataFrame, hk: str, path: str) -> DataFrame:
        """The chain of rules of a host, longest path first, that hold each path."""
        some = keys.join(sizes.withColumnRenamed("hk", "_hk"), F.col(hk) == F.col("_hk")).where(F.col("n") <= F.length(path)).withColumn("_rp", F.substring(F.col(path), F.lit(1), F.col("n")))
        met = some.join(rules.select(F.col("hk").alias("_k"), F.col("rp"), "action"), (F.col("_hk") == F.col("_k")) & (F.col("_rp") == F.col("rp")))
        return met.groupBy(*[F.col(c) for c in keys.columns]).agg(F.sort_array(F.collect_list(F.struct("n", F.concat("_hk", "rp").alias("key"), "rp", "action")), False).alias("chain"))

    # hosts below one rule host often have one path (all home pages): each such pair is a point once
    below = saved(urls.join(above, "h"), "below")
    points = below.select("hk", "rh", "p").distinct().select(F.concat("hk", "p").alias("key"), "rh", "p")
    own = rules.select(F.col("hk").alias("k"), F.col("rp").alias("r"))
    chains = prefixes(own, "k", "r").select(F.concat("k", "r").alias("key"), "chain")
    # a host's key has no slash, and a path begins with one
    cut = lambda lows: lows.select("*", F.regexp_extract("low", r"(?s)^([^/]*)", 1).alias("k"), F.regexp_extract("low", r"(?s)^[^/]*(.*)$", 1).alias("r"))
    found = sweep(points, chains, lambda lows: prefixes(cut(lows), "k", "r"))
    found = found.withColumn("best", F.try_element_at(F.filter("chain", lambda r: F.startswith("key", r["key"])), F.lit(1))).where("best IS NOT NULL").select("rh", "p", "best")
    best = below.select("h", "p", "rh").join(found, ["rh", "p"]).groupBy(F.col("h").alias("_h"), F.col("p").alias("_p")).agg(F.max_by(F.struct("rh", "best.rp", "best.action"), F.length("rh")).alias("_best"))
    out = judged.join(saved(best, "best"), ["_h", "_p"], "left")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, F.col("_h").alias("host"), F.col("_p").alias("path"), F.concat("_best.rh", "_best.rp").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH rules(rh, rp, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT host, path, arg_max(rh || rp, length(rh) * 1000 + length(rp)) AS rule, arg_max(action, length(rh) * 1000 + length(rp)) AS action
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
