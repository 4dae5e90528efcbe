"""URL rules by expression digests, with DataFrame functions only.

Each URL is expanded into host suffixes and path prefixes. Expressions meet the rules on a
short prefix of their digest, then the full digest decides, and the longest rule wins.

A null URL, or one without ``://``, has empty host and path, and no rule fits it. Rules with
a null host or path are ignored. Of two rules with the same text, block wins. Repeated rows
and ids are judged alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _digests(df: DataFrame, expression: Column) -> DataFrame:
    df = df.withColumn("digest", F.sha2(expression, 256))
    return df.withColumn("short", F.substring("digest", 1, SHORT_HEX))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per page: id, host, path, rule (host and path of the winning rule), verdict.

    ``rules``: host, path, verdict ('allow' or 'block'). Only label counts and path lengths
    that rules have are expanded; those two lists of small integers are all that is collected.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null and host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.size(F.split("host", r"\."))
    sizes = rules.agg(F.collect_set(labels).alias("labels"), F.collect_set(F.length("path")).alias("paths")).first()
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    lengths = sorted(sizes["paths"])
    head = F.substring("path", 1, lengths[-1] if lengths else 0)
    urls = urls.withColumn("head", head)
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(sizes["labels"])]).cast("array<int>"), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("head")),
        lambda n: F.substr(F.col("head"), F.lit(1), n),
    )
    both = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    seen = urls.where("host <> ''").select("host", "head").distinct()
    expressions = _digests(seen.select("host", "head", F.explode(both).alias("e")), F.concat("e.h", "e.p")).drop("e")
    known = _digests(rules.select(F.concat("host", "path").alias("rule"), F.col("host").alias("rule_host"), "verdict"), F.col("rule"))
    known = known.select("short", F.col("digest").alias("rule_digest"), "rule", "rule_host", "verdict")
    fits = expressions.join(known, "short").where("digest = rule_digest")
    best = fits.groupBy("host", "head").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("m"), "rule", "verdict")).alias("best"))
    return urls.join(best, ["host", "head"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
