"""URL filter: explicit host and path rules, then a path-template tree with smoothed purity.

The urls that a rule decides are the labelled ones. Per host, path segments that vary become
wildcards: by their form (digits in them) or by statistics (almost as many different values
as urls below the same prefix). The templates of one parent are branches; branches whose share
of blocked urls does not differ significantly from their siblings' are merged with them. A
template is rejected when its purity, the blocked share smoothed towards the same template
on all hosts and that towards the overall share, is over one half.
Everything is grouped with partial aggregation and joined by host and prefix; no host is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: The rules of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A prefix with this many different segments, over half as many as it has urls, is a variable place.
MANY, SHARE = 10, 0.5
#: Squared z score under which a branch is like its siblings; weight of the prior in urls.
LIKE, WEIGHT = 1.96**2, 4.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones are asked first
        at, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    Null urls and those without :// have an empty host and path and are judged like any other
    by the template '/'. Repeated pages give repeated rows that count each; an empty table gives
    no rows; without any labelled url the purity is 0 and every url is allowed.
    """
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    # The form of a segment: * if it has a digit.
    forms = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))
    base = base.select("*", rule.alias("rule"), said.alias("said"), forms.alias("forms"))
    # Places: (host, prefix by form) with the segments seen there.
    kinds = base.groupBy("host", "forms").agg(F.count("*").alias("n"))
    prefix = F.concat(F.lit("/"), F.array_join(F.slice("forms", 1, F.col("at")), "/"))
    seen = kinds.select("host", "forms", "n", F.posexplode("forms").alias("at", "segment")).select("host", "forms", "n", "at", prefix.alias("prefix"), "segment")
    wild = (seen.groupBy("host", "prefix", "segment").agg(F.sum("n").alias("n"))
            .groupBy("host", "prefix").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
            .where((F.col("kinds") >= MANY) & (F.col("kinds") > SHARE * F.col("n"))).select("host", "prefix", F.lit(True).alias("wild")))
    # Each segment finds its own place by a join; only the segments of one path come together again.
    starred = seen.join(wild, ["host", "prefix"], "left").groupBy("host", "forms").agg(
        F.array_sort(F.collect_list(F.when(F.col("wild"), F.struct("at", F.lit("*").alias("part"))).otherwise(F.struct("at", F.col("segment").alias("part"))))).alias("parts"))
    parts = starred.select("host", "forms", F.transform("parts", lambda p: p["part"]).alias("parts")).unionByName(kinds.where(F.size("forms") == 0).select("host", "forms", F.col("forms").alias("parts")))
    shaped = parts.select(
        "host", "forms", F.concat(F.lit("/"), F.array_join("parts", "/")).alias("template"),
        F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))), "/")).alias("parent"),
    )
    labelled = base.groupBy("host", "forms").agg(F.count("said").alias("n"), F.count_if(F.col("said") == "block").alias("b"))
    branch = shaped.join(labelled, ["host", "forms"]).groupBy("host", "parent", "template").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    total = branch.agg(F.coalesce(F.try_divide(F.sum("b"), F.sum("n")), F.lit(0.0)).alias("rate"))
    everywhere = branch.groupBy("template").agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))
    siblings = branch.groupBy("host", "parent").agg(F.sum("n").alias("sn"), F.sum("b").alias("sb"))
    share = F.try_divide("sb", "sn")  # null without labels
    apart = F.pow(F.col("b") - F.col("n") * share, 2) >= LIKE * F.col("n") * share * (1 - share)
    own = (F.col("n") > 0) & apart
    prior = (F.col("tb") + WEIGHT * F.col("rate")) / (F.col("tn") + WEIGHT)
    purity = (F.when(own, F.col("b")).otherwise(F.col("sb")) + WEIGHT * prior) / (F.when(own, F.col("n")).otherwise(F.col("sn")) + WEIGHT)
    judged = branch.join(siblings, ["host", "parent"]).join(everywhere, "template").crossJoin(F.broadcast(total)).select(
        "host", "parent", "template", F.round(purity, 9).alias("purity"))
    # total is one row, so its cross join is a projection
    per_form = shaped.join(judged, ["host", "parent", "template"]).select("host", "forms", "template", "purity")
    return base.join(per_form, ["host", "forms"]).select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("purity") > 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "purity",
    )
