"""Watchlists, known-bad releases, bills of material, tenants and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import stripped_spec


def watched(feed: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Feed rows of watched packages (ecosystem, name). A semi-join; Spark broadcasts the list where it is small."""
    return feed.join(watchlist.select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_semi")


def merged_watchlist(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("ecosystem", "name")
    for more in lists[1:]:
        out = out.unionByName(more.select("ecosystem", "name"))
    return out.distinct()


def watchlist_counts(lists: DataFrame) -> DataFrame:
    """ecosystem, packages (different ones), listed (over all lists); lists: ecosystem, name, list."""
    per = lists.groupBy("ecosystem", "name").agg(F.countDistinct("list").alias("n"))
    return per.groupBy("ecosystem").agg(F.count("*").alias("packages"), F.sum("n").alias("listed"))


def known_bad_hits(components: DataFrame, known_bad: DataFrame, version: str = "version") -> DataFrame:
    """components with verdict and severity of the known-bad release of exactly that name, version and ecosystem; signs at the left of a version are cut."""
    kb = known_bad.select("name", F.col("version").alias("_v"), "ecosystem", F.col("verdict").alias("kb_verdict"), F.col("severity").alias("kb_severity"))
    return components.withColumn("_v", stripped_spec(F.col(version))).join(kb, ["name", "_v", "ecosystem"]).drop("_v")


def validate_sbom(components: DataFrame, known_bad: DataFrame, advisories: DataFrame, sbom: str = "sbom_id") -> DataFrame:
    """Per bill of material: components, local hits, advisory hits (only versioned components), issues."""
    kb = known_bad.groupBy("name", F.col("version").alias("_plain"), "ecosystem").agg(F.count("*").alias("_local"))
    adv = advisories.groupBy("name", "version", "ecosystem").agg(F.count("*").alias("_remote"))
    each = components.select(sbom, "name", "version", "ecosystem", stripped_spec(F.col("version")).alias("_plain"))
    found = each.join(kb, ["name", "_plain", "ecosystem"], "left").join(adv, ["name", "version", "ecosystem"], "left")
    remote = F.when(F.coalesce("version", F.lit("")) != "", F.col("_remote"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counted = found.groupBy(sbom).agg(F.count("*").alias("components"), n(F.col("_local")).alias("local_hits"), n(remote).alias("advisory_hits"))
    return counted.withColumn("issues", F.col("local_hits") + F.col("advisory_hits"))


def affected_tenants(releases: DataFrame, packages: DataFrame) -> DataFrame:
    """Distinct (release columns, tenant_id): tenants that use the package in that version; an empty or null version of theirs is any."""
    t = packages.select("tenant_id", "ecosystem", "name", F.coalesce("version", F.lit("")).alias("_used")).distinct()
    return releases.join(t, ["ecosystem", "name"]).where((F.col("_used") == "") | (F.col("_used") == F.col("version"))).drop("_used").distinct()


def blast_radius(releases: DataFrame, depends_on: DataFrame) -> DataFrame:
    """release_id, tenant_id, direct, indirect: how many services depend on the package."""
    hit = releases.join(depends_on, ["tenant_id", "ecosystem", "name"])
    return hit.groupBy("release_id", "tenant_id").agg(F.count_if(F.col("direct")).alias("direct"), F.count_if(~F.col("direct")).alias("indirect"))


def risk_delta(severity: Column, direct: Column) -> Column:
    out = F.when(direct, C.RISK_DELTAS["MEDIUM"][0]).otherwise(C.RISK_DELTAS["MEDIUM"][1])
    for name, (near, far) in C.RISK_DELTAS.items():
        out = F.when(severity == name, F.when(direct, near).otherwise(far)).otherwise(out)
    return out


def risk_scores(findings: DataFrame) -> DataFrame:
    """tenant_id, target, risk: the sum of what each finding adds to a service."""
    return findings.groupBy("tenant_id", "target").agg(F.sum(risk_delta(F.col("severity"), F.col("direct"))).alias("risk"))


def advisory_severity(score: Column, advisory_id: Column) -> Column:
    """From a bare number of the third scoring version (vectors are not numbers); malicious-package advisories are HIGH, others MEDIUM."""
    n = F.try_to_number(F.lit("0"), F.lit("9")) if score is None else F.split_part(score, F.lit("/"), F.lit(1)).try_cast("double")
    return F.when(n >= 9, "CRITICAL").when(n >= 7, "HIGH").when(n >= 4, "MEDIUM").when(advisory_id.startswith("MAL-"), "HIGH").otherwise("MEDIUM")


def finding_texts(ecosystem: Column, name: Column, version: Column, verdict: Column, severity: Column, confidence: Column, summary: Column, direct: Column, indirect: Column) -> tuple[Column, Column]:
    """(title, description) of a finding."""
    what = F.concat(ecosystem, F.lit("/"), name, F.lit("@"), version)
    title = F.concat(F.lit("["), verdict, F.lit("] "), what)
    lines = (F.concat(F.lit("Release: "), what), F.concat(F.lit("Verdict: "), verdict, F.lit(" ("), F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%)")), F.concat(F.lit("Severity: "), severity),
             F.concat(F.lit("Summary: "), F.coalesce(summary, F.lit(""))), F.concat(F.lit("Affected: "), direct.cast("string"), F.lit(" direct, "), indirect.cast("string"), F.lit(" indirect services")))
    return title, F.concat_ws("\n", *lines)


def tenant_findings(alerts: DataFrame, packages: DataFrame, depends_on: DataFrame) -> DataFrame:
    """The flow from verdicts to tenants: finding_id, release_id, tenant_id, title, description, severity, direct, indirect, risk; one finding per release and affected tenant.

    alerts: release_id, ecosystem, name, version, verdict, severity, confidence, summary; only malicious and suspicious ones count. packages: tenant_id,
    ecosystem, name, version (empty is any). depends_on: tenant_id, ecosystem, name, target, direct. risk is what the finding adds over all services. Tenants without a
    dependent service have a finding without risk. Joins on package and tenant only; nothing is gathered.
    """
    bad = alerts.where(F.col("verdict").isin("MALICIOUS", "SUSPICIOUS"))
    hit = affected_tenants(bad, packages)
    added = risk_delta(F.col("severity"), F.col("direct"))
    reach = hit.select("release_id", "tenant_id", "ecosystem", "name", "severity").join(depends_on, ["tenant_id", "ecosystem", "name"])
    reach = reach.groupBy("release_id", "tenant_id").agg(F.count_if(F.col("direct")).alias("direct"), F.count_if(~F.col("direct")).alias("indirect"), F.sum(added).alias("risk"))
    out = hit.join(reach, ["release_id", "tenant_id"], "left").withColumn("direct", F.coalesce("direct", F.lit(0))).withColumn("indirect", F.coalesce("indirect", F.lit(0)))
    c = F.col
    title, description = finding_texts(c("ecosystem"), c("name"), c("version"), c("verdict"), c("severity"), c("confidence"), c("summary"), c("direct"), c("indirect"))
    return out.select(F.concat_ws("-", F.lit("finding"), "ecosystem", "name", "version", c("tenant_id").cast("string")).alias("finding_id"), "release_id", "tenant_id", title.alias("title"), description.alias("description"), "severity", "direct", "indirect", F.coalesce("risk", F.lit(0)).cast("long").alias("risk"))
