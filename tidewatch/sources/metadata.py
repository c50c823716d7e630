"""Registry documents, landed as JSON, to the versions of packages and what transitions compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import semver_key
from ..operators.ranges import kept, with_previous_row

PYPI = "struct<info: struct<author: string, version: string>, releases: map<string, array<struct<upload_time_iso_8601: string, upload_time: string, filename: string>>>>"
NPM = "struct<`dist-tags`: map<string, string>, time: map<string, string>, versions: map<string, struct<maintainers: array<struct<name: string>>, dependencies: map<string, string>, scripts: map<string, string>>>>"
GO = "struct<Version: string, Time: string, Origin: struct<URL: string>>"
CRATES = "struct<versions: array<struct<num: string, created_at: string, yanked: boolean>>>"


def timestamp(text: Column) -> Column:
    """ISO times with or without Z, offset or fraction, all read as they are written; null for anything else."""
    plain = F.substring_index(F.substring_index(F.regexp_replace(text, "Z+$", ""), "+", 1), ".", 1)
    return F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")))


def pypi_versions(docs: DataFrame) -> DataFrame:
    """name, version, published (earliest upload), files, author of each release that has files. docs: name, body."""
    each = docs.select("name", F.from_json("body", PYPI).alias("d")).select("name", "d.info.author", F.explode("d.releases").alias("version", "uploads")).where(F.size("uploads") > 0)
    at = F.transform("uploads", lambda u: timestamp(F.coalesce(u["upload_time_iso_8601"], u["upload_time"])))
    return each.select("name", "version", F.array_min(at).alias("published"), F.transform("uploads", lambda u: u["filename"]).alias("files"), "author")


def pypi_metrics(docs: DataFrame) -> DataFrame:
    """name, ecosystem, first_published (of all files of all releases), weekly_downloads (not offered: null), total_versions."""
    d = docs.select("name", F.from_json("body", PYPI).alias("d"))
    times = F.filter(F.flatten(F.transform(F.map_values("d.releases"), lambda files: F.transform(files, lambda f: F.nullif(f["upload_time_iso_8601"], F.lit(""))))), lambda t: t.isNotNull())
    return d.select("name", F.lit("pypi").alias("ecosystem"), timestamp(F.array_min(times)).alias("first_published"), F.lit(None).cast("long").alias("weekly_downloads"), F.size("d.releases").cast("long").alias("total_versions"))


def npm_versions(docs: DataFrame) -> DataFrame:
    """name, version, published, maintainers (sorted), dependencies, scripts (names) of each version. docs: name, body."""
    d = docs.select("name", F.from_json("body", NPM).alias("d")).select("name", "d.time", F.explode("d.versions").alias("version", "v"))
    names = lambda m: F.coalesce(F.array_sort(F.map_keys(m)), F.array().cast("array<string>"))
    people = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("v.maintainers", F.array().cast("array<struct<name: string>>")), lambda m: m["name"]), lambda n: n.isNotNull())))
    return d.select("name", "version", timestamp(F.try_element_at("time", "version")).alias("published"), people.alias("maintainers"), names(F.col("v.dependencies")).alias("dependencies"), names(F.col("v.scripts")).alias("scripts"))


def npm_metrics(docs: DataFrame, downloads: DataFrame) -> DataFrame:
    """name, ecosystem, first_published (time.created), weekly_downloads, total_versions. downloads: name, weekly_downloads."""
    d = docs.select("name", F.from_json("body", NPM).alias("d"))
    return d.join(downloads, "name", "left").select(
        "name", F.lit("npm").alias("ecosystem"), timestamp(F.try_element_at("d.time", F.lit("created"))).alias("first_published"), "weekly_downloads", F.size("d.versions").cast("long").alias("total_versions"))


def npm_latest(docs: DataFrame) -> DataFrame:
    """name, version, previous_version of each document: the version that the tag `latest` names and its predecessor by precedence among all versions (null if it is the least).

    Documents without the tag, and those whose tag names a version that they don't have, give no row. Versions of one precedence are ordered by their text.
    """
    d = docs.select("name", F.from_json("body", NPM).alias("d")).select("name", F.map_keys("d.versions").alias("versions"), F.try_element_at(F.col("d")["dist-tags"], F.lit("latest")).alias("version"))
    key = lambda v: F.struct(semver_key(v).alias("key"), v.alias("version"))
    before = F.array_max(F.filter(F.transform("versions", key), lambda x: x < key(F.col("version"))))["version"]
    return d.where(F.array_contains("versions", F.col("version"))).select("name", "version", before.alias("previous_version"))


def go_versions(docs: DataFrame) -> DataFrame:
    """name, version, published, origin. docs: name, body (one version's info)."""
    return docs.select("name", F.from_json("body", GO).alias("d")).select("name", F.col("d.Version").alias("version"), timestamp(F.col("d.Time")).alias("published"), F.col("d.Origin.URL").alias("origin"))


def crate_versions(docs: DataFrame) -> DataFrame:
    """name, version, published, yanked, place (the registry's order, 0 the newest). docs: name, body."""
    return docs.select("name", F.posexplode(F.from_json("body", CRATES)["versions"]).alias("place", "v")).select("name", F.col("v.num").alias("version"), timestamp(F.col("v.created_at")).alias("published"), F.coalesce("v.yanked", F.lit(False)).alias("yanked"), "place")


def transitions(versions: DataFrame, *columns: str) -> DataFrame:
    """versions with prev_version, prev_published and prev_<column> of the version published before; the first of a package has none and is left out. Documents are read once: versions are written and read again."""
    seen = with_previous_row(kept(versions, "versions"), ("name",), ["published", "version"], {f"prev_{c}": c for c in ("version", "published", *columns)})
    return seen.where("prev_version is not null")
