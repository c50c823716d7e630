"""Tables that are kept: upserts, insert-if-absent, dead letters, messages and texts for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(table: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """table and those rows of new whose key it does not have, one of each."""
    return table.unionByName(new.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti"))


def upsert(table: DataFrame, new: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The latest row of each key by `order`; rows of new win ties."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def replace_of(table: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """table with all rows of the owners in new replaced by new's."""
    return table.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new.distinct())


def remove_ids(letters: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Dead letters without those that were delivered."""
    return letters.join(gone.select(key).distinct(), key, "left_anti")


def release_node(ecosystem: Column, name: Column, version: Column) -> Column:
    """The same id for the same release, whenever it is made."""
    return F.concat_ws("-", F.lit("release"), ecosystem, name, version)


def tenant_finding(ecosystem: Column, name: Column, version: Column, tenant: Column) -> Column:
    return F.concat_ws("-", ecosystem, name, version, tenant)


def finding_severity(verdict: Column) -> Column:
    """What a tenant is told, null for verdicts that are not passed on."""
    return F.when(verdict == "MALICIOUS", "critical").when(verdict == "SUSPICIOUS", "high")


def file_name(tenant: Column) -> Column:
    """A tenant's id as a file name: letters, digits, dot, underscore and hyphen, none of the marks at its ends."""
    clean = F.regexp_replace(F.regexp_replace(tenant, "[^A-Za-z0-9._-]", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", "tenant").otherwise(F.left(clean, F.lit(128)))


def chat_message(release: Column, verdict: Column, severity: Column, confidence: Column, findings: Column) -> Column:
    """A message as JSON with the first five findings (an array of strings)."""
    colour = F.when(severity == "CRITICAL", "#ff0000").when(severity == "HIGH", "#ff8800").when(severity == "MEDIUM", "#ffcc00").otherwise("#36a64f")
    head = F.format_string("%s: %s (%s, %s%%)", release, verdict, severity, F.round(confidence * 100).cast("int").cast("string"))
    return F.to_json(F.struct(head.alias("text"), F.array(F.struct(colour.alias("color"), F.array_join(F.slice(findings, 1, 5), "\n").alias("text"))).alias("attachments")))


def diff_markdown(diffs: DataFrame, key: str) -> DataFrame:
    """key, text: a release's file diffs as one document, in the order of paths."""
    part = F.concat(F.lit("## "), "path", F.when(F.col("is_new"), " (new)").when(F.col("is_deleted"), " (deleted)").otherwise(""), F.when(F.col("is_binary"), "\n\nbinary file\n").otherwise(F.concat(F.lit("\n\n```diff\n"), "content", F.lit("\n```\n"))))
    return diffs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
