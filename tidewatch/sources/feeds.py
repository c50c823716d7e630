"""Change feeds of package registries, landed as tables, to new releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import semver_key
from ..operators.ranges import with_previous_row


def new_from_log(log: DataFrame, watchlist: DataFrame, since: int, action: str = "new release") -> DataFrame:
    """PyPI's change log: name, version, serial of the first event of each new release after `since` of a watched package."""
    mine = log.where((F.col("serial") > since) & (F.col("action") == action)).join(watchlist.select("name").distinct(), "name", "left_semi")
    return mine.groupBy("name", "version").agg(F.min("serial").alias("serial"))


def next_cursor(log: DataFrame, since: int) -> DataFrame:
    """One row: the largest serial of all events, or `since`."""
    return log.agg(F.greatest(F.coalesce(F.max("serial"), F.lit(since)), F.lit(since)).alias("cursor"))


def latest_changes(feed: DataFrame, by: str = "name", value: str = "latest", order: str = "seq") -> DataFrame:
    """npm's feed: rows whose `latest` differs from the one seen before; the first sighting of a package is only recorded."""
    seen = with_previous_row(feed, (by,), [order], {"previous": value})
    return seen.where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def polled_latest(snapshot: DataFrame, known: DataFrame) -> DataFrame:
    """Go's proxy: modules whose largest version is not the known one: name, version, previous_version. Unknown modules are not reported."""
    top = snapshot.groupBy("name").agg(F.max_by("version", F.struct(semver_key(F.col("version")), "version")).alias("version"))
    return top.join(known.select("name", F.col("version").alias("previous_version")), "name").where("version <> previous_version")


def first_two(rows: DataFrame, order: list) -> DataFrame:
    """crates.io and Maven: name, version, previous_version by the registry's order, yanked versions left out."""
    ok = rows.where(~F.coalesce(F.col("yanked"), F.lit(False))) if "yanked" in rows.columns else rows
    n = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    ranked = ok.withColumn("_n", n).where("_n <= 2")
    return ranked.groupBy("name").agg(F.max(F.when(F.col("_n") == 1, F.col("version"))).alias("version"), F.max(F.when(F.col("_n") == 2, F.col("version"))).alias("previous_version"))


def top_packages(counts: DataFrame, n: int) -> DataFrame:
    """The n most used packages, ties by name."""
    return counts.orderBy(F.desc("uses"), "name").limit(n)


def admitted(releases: DataFrame, limit: int, order: str = "serial") -> DataFrame:
    """The first `limit` releases of each ecosystem (0: all); the cursor, which counts all events, is next_cursor's."""
    if not limit:
        return releases
    n = F.row_number().over(Window.partitionBy("ecosystem").orderBy(order, "name", "version"))
    return releases.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def release_url(ecosystem, name, version):
    return (F.when(ecosystem == "pypi", F.format_string("https://pypi.org/project/%s/%s/", name, version)).when(ecosystem == "go", F.format_string("https://pkg.go.dev/%s@%s", name, version))
            .when(ecosystem == "cargo", F.format_string("https://crates.io/crates/%s/%s", name, version)).otherwise(F.format_string("https://www.npmjs.com/package/%s/v/%s", name, version)))
