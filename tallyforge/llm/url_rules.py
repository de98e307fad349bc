"""URL filtering as a sort-merge range join of URLs with prefix rules.

A host is written backwards, label by label ("a.example.org" -> "org.example.a."), so
that a host and all its subdomains share a prefix. A rule's canonical key is its reversed
host, a separator and its path; every URL that it fits under that host has the rule's key
as a prefix, so a rule is an interval of sorted keys, and two rules' intervals are nested
or disjoint. URLs and rules are sorted together. A sweep needs no more than the last rule
key at or before a URL: the rules that are active there are nested in one another, and
those still open at the URL are the ones whose key is a prefix of its key. So each rule
carries the stack that is open at its own start; a URL takes the stack of the last rule
before it and drops what has closed. A URL has one key for each level of its host down to
the deepest rule host.

Sorting is by range partitions; what is open where a partition begins is handed over by a
table of one row per partition. Everything is DataFrame expressions.

Edge cases: a null URL, or one without "://", has an empty host and path and fits no rule,
like an empty host. The longest rule (host and path together) wins. A repeated rule
counts once; of rules that differ only in the verdict, `block` wins. Empty tables give no
rows, and no rules give every URL the default. Repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import table
from tallyforge.plans.scratch import materialise
from tallyforge.plans.skew import ascii_lower, explode_copies

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
SEP = "\x01"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, host, path)")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without "://"."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def key_of(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."), F.lit(SEP), path)


def with_stacks(rules: DataFrame) -> DataFrame:
    """Rules as (key, stack): the stack holds the rules whose key is a prefix of the key, longest first."""
    one = rules.where("host is not null and path is not null and verdict is not null").select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    one = one.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = one.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict", key_of(reversed_labels(F.col("host")), F.col("path")).alias("key"))
    lengths = one.select(F.col("host").alias("lh"), F.length("path").alias("len")).distinct()
    parts = own.join(lengths, (F.col("h") == F.col("lh")) & (F.length("p") >= F.col("len"))).select("h", "key", F.expr("substring(p, 1, len)").alias("part"))
    outer = own.select(F.col("h").alias("oh"), F.col("p").alias("op"), F.col("key").alias("okey"), F.col("verdict").alias("over"))
    nested = parts.join(outer, (F.col("h") == F.col("oh")) & (F.col("part") == F.col("op")))
    entry = F.struct(F.length("okey").alias("n"), F.col("okey").alias("key"), F.concat("oh", "op").alias("rule"), F.col("over").alias("verdict"))
    return nested.groupBy("key").agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", partitions: int | None = None) -> DataFrame:
    """(id, host, path, copies, rule, verdict) for each distinct (id, host, path) of urls."""
    spark = urls.sparkSession
    host, path = url_parts(F.col(url_col))
    pages = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).groupBy("id", "host", "path").agg(F.count("*").alias("copies"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    labels = reversed_labels(F.col("host"))
    levels = F.when(F.col("host") == "", F.lit(1)).otherwise(F.least(F.size(labels), F.lit(deepest)))
    points = pages.withColumn("level", F.explode(F.sequence(F.lit(1), levels)))
    points = points.select("id", "host", "path", "copies", key_of(F.slice(labels, F.lit(1), F.col("level")), F.col("path")).alias("key"))
    starts = with_stacks(rules)
    none = F.lit(None)
    both = points.withColumn("stack", none.cast(starts.schema["stack"].dataType)).unionByName(
        starts.select(none.cast("bigint").alias("id"), none.cast("string").alias("host"), none.cast("string").alias("path"), F.lit(0).cast("long").alias("copies"), "key", "stack"),
        allowMissingColumns=False,
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(both.repartitionByRange(n, "key", F.col("stack").isNull(), "id").withColumn("part", F.spark_partition_id()), "url-keys")
    within = Window.partitionBy("part").orderBy("key", F.col("stack").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("stack", ignorenulls=True).over(within)
    swept = dealt.withColumn("open", last)
    ends = dealt.where("stack is not null").groupBy("part").agg(F.max_by("stack", "key").alias("at_end"))
    # what is open where a partition begins: the stack at the end of the last one before it that has a rule; one row a partition
    before = Window.orderBy("to").rowsBetween(Window.unboundedPreceding, -1)
    every = dealt.select(F.col("part").alias("to")).distinct().join(F.broadcast(ends), F.col("part") == F.col("to"), "left")
    handed = every.select("to", F.last("at_end", ignorenulls=True).over(before).alias("carried"))
    swept = swept.where("copies > 0").join(F.broadcast(handed), F.col("part") == F.col("to"), "left")
    held = F.filter(F.coalesce("open", "carried"), lambda r: F.startswith(F.col("key"), r["key"]))
    best = swept.select("id", "host", "path", "copies", F.element_at(F.when(F.size(held) > 0, held), 1).alias("best"))
    best = best.withColumn("best", F.when(F.col("host") != "", F.col("best")))
    longest = best.groupBy("id", "host", "path", "copies").agg(F.max(F.struct(F.col("best.n"), F.col("best.rule"), F.col("best.verdict"))).alias("w"))
    return longest.select(F.col("id").alias(id_col), "host", "path", "copies", F.col("w.rule").alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged: page_id, host, path, rule, verdict."""
    judged = judge(table(spark, sf_dir, "pages"), rule_table(spark))
    return explode_copies(judged, "copies", "copy").select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(r, '^([^/?#]*)', 1)) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), hits AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h USING (page_id)
"""
