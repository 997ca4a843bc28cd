"""URL rules by host and path prefix, found by a sort-merge range join.

**Keys.** A host's labels are reversed and each closed by a dot: ``a.example.org`` becomes ``org.example.a.``. A rule's host then covers
exactly the keys in ``[key, key with its last dot made '/')``, itself and all subdomains. Two such intervals are nested or apart.

**Sweep.** Distinct hosts and the intervals' edges are sorted by key in ranges of keys. An edge carries the stack of rules that are active from
there on, from the outermost host to the innermost; a host takes the stack of the last edge before it. An interval that crosses a range's
start is opened again there, so that ranges are swept apart. The path prefixes of the stack's rules are then compared, and the longest rule wins.

Only distinct hosts are sorted, so a host with a third of all pages costs one row; its pages get the stack by a join that Spark may split.
Range limits come from at most 20,000 hosts with the smallest hashes. They decide where the work is done, never the result. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barley.llm.shared import stash, tasks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT_HOSTS = 20_000

#: the rules of the registered query: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next of / ? #, in lower case (A to Z); empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge_urls(df: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of ``df``.

    ``rules`` has verdict, host, path. The rule with the most characters (host and path together) of those that fit decides; among equally long
    ones the longer host, then ``block`` before ``allow``, then the later text. Rules without host or path fit nothing; a repeated rule counts once. A
    url that no rule fits, a null url and one without :// get ``default`` and a null rule.
    """
    pages = df.select(F.col(id_column), F.col(url_column).cast("string").alias("url")).select(
        id_column, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    stacks = sweep(pages.select("host").where("host <> ''").distinct(), rules)
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        F.length(r["rule"]).alias("long"), F.length(r["host"]).alias("host_long"), (r["verdict"] == "block").alias("blocks"),
        r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return pages.join(stacks, "host", "left").withColumn("best", best).select(
        id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def sweep(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack) for the hosts inside any rule's interval; the stack holds the rules of all enclosing hosts, outermost first."""
    spark = hosts.sparkSession
    known = stash(hosts.select("host", host_key(F.col("host")).alias("key")), "hosts")
    limits = _limits(known, tasks(spark))
    edges = _edges(rules, limits)
    events = known.select(_range(F.col("key"), limits).alias("range"), "key", F.lit(1).alias("late"), "host", F.lit(None).cast(edges.schema["stack"].dataType).alias("stack"))
    swept = events.unionByName(edges.withColumns({"late": F.lit(0), "host": F.lit(None).cast("string")}))
    last = F.last("stack", ignorenulls=True).over(W.partitionBy("range").orderBy("key", "late").rowsBetween(W.unboundedPreceding, 0))
    return swept.withColumn("stack", last).where((F.col("late") == 1) & (F.size("stack") > 0)).select("host", "stack")


def _limits(known: DataFrame, n: int) -> list[str]:
    """At most ``n - 1`` keys that part the hosts about evenly, fewer when there are few hosts."""
    if n < 2:
        return []
    some = [r.key for r in known.select("key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(LIMIT_HOSTS).collect()]
    some.sort(key=str.encode)
    n = min(n, 1 + len(some) // 100)
    return sorted({some[len(some) * i // n] for i in range(1, n)}, key=str.encode)


def _range(key: Column, limits: list[str]) -> Column:
    """How many limits are at or before the key."""
    if not limits:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= key))


def _edges(rules: DataFrame, limits: list[str]) -> DataFrame:
    """(range, key, stack): where the stack changes, in the order of keys."""
    own = (rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna().where("host <> ''").distinct()
           .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("host", "path", F.concat("host", "path").alias("rule"), "verdict"))).alias("rules"))
           .withColumn("key", host_key(F.col("host"))))
    # the enclosing hosts of a rule's host: its key cut after each label
    labels = F.split(F.col("key"), r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    outer = own.select("key", F.explode(cuts).alias("outer")).join(own.select(F.col("key").alias("outer"), "rules"), "outer")
    stacks = outer.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.length("outer").alias("long"), "outer", "rules"))).alias("levels"))
    rules_of = F.flatten(F.transform("levels", lambda x: x["rules"]))
    outside = F.flatten(F.transform(F.slice(F.col("levels"), F.lit(1), F.size("levels") - 1), lambda x: x["rules"]))
    close = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    spans = stacks.select("key", close.alias("close"), rules_of.alias("inside"), outside.alias("outside"),
                          F.size("levels").alias("depth"), _range(F.col("key"), limits).alias("a"), _range(close, limits).alias("b"))
    opened = spans.select(F.col("a").alias("range"), "key", F.col("inside").alias("stack"), "depth")
    closed = spans.select(F.col("b").alias("range"), F.col("close").alias("key"), F.col("outside").alias("stack"), F.lit(0).alias("depth"))
    # an interval that reaches into later ranges is open from their start; the innermost such interval's stack holds
    later = spans.where("b > a").select(F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("range"), F.col("inside").alias("stack"), "depth")
    starts = later.groupBy("range").agg(F.max_by("stack", "depth").alias("stack")).select("range", F.lit("").alias("key"), "stack", F.lit(0).alias("depth"))
    return opened.unionByName(closed).unionByName(starts).drop("depth")


def op4_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge_urls(spark.read.parquet(f"{sf}/pages.parquet"), rules)


OP4_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row FROM pages),
f AS (SELECT p.row, r.host || r.path AS rule, r.verdict FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
b AS (SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (row)
"""
