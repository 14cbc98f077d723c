"""URL filter: host-suffix and path-prefix expressions matched against rules by hashed keys.

Every URL is expanded into the expressions ``suffix + prefix`` that a rule could be written as: each
suffix of its host at a label border, joined with each prefix of its path whose length some rule
uses. Expressions meet rules in an equi-join on a short piece of their digest; the full digest then
decides, and of several rules that fit the longest wins. Only distinct ``(host, path)`` pairs are
expanded, so a host or page that holds a third of all rows costs one expansion, and no stage groups
rows by host.

Results for odd input: a null URL or one without ``://`` has an empty host and path and gets the
default verdict; an empty path fits no rule, as every rule path starts with ``/``; repeated rows and
null ids are kept, one result row per input row; an empty table or an empty rule list gives no rows
or default verdicts; other columns of the input are not read. Rules that are equally long and both
fit are the same text, and of those ``block`` wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightline.llm.text import lower_ascii


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Hexadecimal digits of the digest that serve as join key.
SHORT_DIGITS = 8


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Host suffixes joined with the path prefixes of the given lengths (in code points)."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.array(
        *[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    )
    present = F.filter(prefixes, lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(present, lambda p: F.concat(s, p))))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule`` and ``verdict`` of every row."""
    spark = pages.sparkSession
    parted = pages.select(
        *[F.col(k) for k in keep],
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    lengths = sorted({len(r.path) for r in rules})
    table = spark.createDataFrame(
        [(r.host + r.path, r.verdict) for r in rules], "rule string, verdict string"
    ).withColumn("digest", F.sha2("rule", 256))
    table = table.groupBy("digest").agg(
        F.max("rule").alias("rule"), F.max("verdict").alias("verdict")
    )
    table = table.withColumn("short", F.substring("digest", 1, SHORT_DIGITS))
    expanded = (
        parted.select("host", "path")
        .filter(F.col("host") != "")
        .distinct()
        .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
        .withColumn("full", F.sha2("e", 256))
        .withColumn("short", F.substring("full", 1, SHORT_DIGITS))
    )
    fits = expanded.join(table, "short").filter(F.col("full") == F.col("digest"))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    )
    return parted.join(best, ["host", "path"], "left").select(
        *keep,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
