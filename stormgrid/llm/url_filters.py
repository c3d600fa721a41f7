"""URL filters: a sorted sweep of reversed-host keys over nested rule intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm.common import ascii_lower, materialize, table

# The rules of the registered query, as host, path and verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"

_OUT = "page_id bigint, host string, path string, rule string, verdict string"


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by U+0001: a host's key begins all its subdomains' keys.

    U+0001 in a label becomes U+0002 and a, and U+0002 becomes U+0002 and b.
    """
    host = F.replace(F.replace(host, F.lit("\u0002"), F.lit("\u0002b")), F.lit("\u0001"), F.lit("\u0002a"))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\u0001"), F.lit("\u0001"))


def _sweep(frames: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Walk rules and pages in key order with a stack of the rules whose interval is open."""
    part, stack = None, []  # of (host key, {path: (rule, verdict)}, path lengths), outermost first
    for frame in frames:
        out = []
        for at, key, is_page, path, page_id, host, verdict in zip(
            *(frame[c].tolist() for c in ("part", "key", "is_page", "path", "page_id", "host", "verdict")),
            strict=True,
        ):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_page:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                stack[-1][1].setdefault(path, (host + path, verdict))
                stack[-1][2].add(len(path))
                continue
            best = None
            for _, rules, lengths in stack:
                fits = (rules.get(path[:n]) for n in lengths if n <= len(path))
                found = max((x for x in fits if x), key=lambda x: len(x[0]), default=None)
                if found and (best is None or len(found[0]) >= len(best[0])):
                    best = found
            out.append((page_id, host, path, best and best[0], best[1] if best else default))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Judge every url by the longest rule that fits; ``rules`` has host, path and verdict.

    A host with its labels reversed is a prefix of its subdomains' keys, so that each rule covers
    an interval of keys. Rules and pages are sorted together by range partitions of the key; each
    partition is swept once with a stack of open rules, and its rules of parents that began in an
    earlier partition are found by a join on the prefixes of its first key. Neither side is
    broadcast, and one large host splits over partitions by path.

    Longest counts host and path together; of equal ones the deeper host wins, and of repeated
    rules the verdict that comes first in the alphabet. Null urls and urls without ``://`` have an
    empty host and path and no rule; the verdict is then ``default``. Null rule parts count as
    empty. Repeated rows stay; other columns are not read; empty tables are fine.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    page_rows = pages.select(
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        F.lit(1).alias("is_page"),
        F.col("page_id").cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("verdict"),
    )
    rule_rows = rules.select(
        ascii_lower(F.coalesce(F.col("host"), F.lit(""))).alias("host"),
        F.coalesce(F.col("path"), F.lit("")).alias("path"),
        F.lit(0).alias("is_page"),
        F.lit(None).cast("long").alias("page_id"),
        F.col("verdict"),
    )
    order = ["key", "is_page", "path", "page_id", "verdict"]
    rows = page_rows.unionByName(rule_rows).withColumn("key", host_key(F.col("host")))
    # Written once: a second run of the plan may draw other range bounds.
    ranged = materialize(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "url-filters"
    )
    first = ranged.groupBy("part").agg(F.min("key").alias("key"))
    labels = F.split(F.col("key"), "\u0001")
    parents = first.select(
        "part",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels) - 1),
                lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "\u0001"), F.lit("\u0001")),
            )
        ).alias("key"),
    )
    open_rules = (
        ranged.where("is_page = 0")
        .withColumnRenamed("part", "began")
        .join(parents, "key")
        .where("began < part")
        .drop("began")
    )
    return (
        ranged.unionByName(open_rules)
        .repartition("part")
        .sortWithinPartitions("part", *order)
        .mapInPandas(lambda frames: _sweep(frames, default), _OUT)
    )


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = r"""
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(rhost, rpath, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits as (
  select p.*, rhost || rpath as rule, verdict,
    row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last) as k
  from parts p left join rules r
    on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where k = 1
"""
