"""Reputation scores and signals of version transitions: expressions over joined rows, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import gap_days, severity_rank
from .ranges import with_previous_row

SIGNAL = "struct<signal_id: string, severity: string, boost: double>"


def signal(name: str, severity: str, boost: float) -> Column:
    return F.struct(F.lit(name).alias("signal_id"), F.lit(severity).alias("severity"), F.lit(boost).alias("boost"))


def signals(*when: tuple[Column, Column]) -> Column:
    """The signals whose condition holds, as an array."""
    return F.filter(F.array(*(F.when(c, s) for c, s in when)), lambda s: s.isNotNull())


def reputation_score(age_days: Column, weekly: Column, versions: Column, parent_weekly: Column) -> Column:
    """Points for young, rare and single-version packages, and for a parent that is far more used. Null metrics give none."""
    part = lambda *cases: reduce(lambda c, x: c.when(x[0], x[1]), cases[1:], F.when(*cases[0])).otherwise(0)
    ratio = F.try_divide(parent_weekly, weekly)
    asked = F.coalesce(parent_weekly, F.lit(0)) != 0
    return (part((age_days < 7, 40), (age_days < 30, 25), (age_days < 90, 10)) + part((weekly < 100, 30), (weekly < 1000, 15)) + part((versions == 1, 20))
            + part((asked & (weekly == 0), 40), (asked & (ratio > 10_000), 35), (asked & (ratio > 1_000), 20)))


def reputation_level(score: Column) -> tuple[Column, Column]:
    """(severity, confidence boost) of a score."""
    severity, boost = F.lit("NONE"), F.lit(0.0)
    for least, name, value in reversed(C.REPUTATION_LEVELS):
        severity, boost = F.when(score >= least, name).otherwise(severity), F.when(score >= least, value).otherwise(boost)
    return severity, boost


def judged_reputation(dependencies: DataFrame, metrics: DataFrame, as_of: Column | None = None) -> DataFrame:
    """dependencies (name, ecosystem, ...) with score, severity, boost and is_suspicious.

    metrics: name, ecosystem, age_days or first_published, weekly_downloads, total_versions, parent_downloads (optional); as_of: the time to count ages at.
    npm and PyPI packages without metrics are not in their registry: HIGH, 0.15. Other ecosystems are not judged.
    """
    m = metrics if "parent_downloads" in metrics.columns else metrics.withColumn("parent_downloads", F.lit(None).cast("long"))
    if "age_days" not in m.columns:
        m = m.withColumn("age_days", gap_days(F.col("first_published"), F.current_timestamp() if as_of is None else as_of))
    m = m.select("name", "ecosystem", reputation_score(F.col("age_days"), F.col("weekly_downloads"), F.col("total_versions"), F.col("parent_downloads")).alias("score"), F.lit(True).alias("_known"))
    joined = dependencies.join(m, ["name", "ecosystem"], "left")
    asked = F.col("ecosystem").isin("npm", "pypi")
    severity, boost = reputation_level(F.coalesce("score", F.lit(0)))
    level = lambda found, absent, other: F.when(asked & F.col("_known").isNull(), absent).when(asked, found).otherwise(other)
    out = joined.withColumn("severity", level(severity, F.lit("HIGH"), F.lit("NONE"))).withColumn("boost", level(boost, F.lit(0.15), F.lit(0.0)))
    return out.withColumn("is_suspicious", severity_rank(F.col("severity")) >= 3).drop("_known")


def is_security_package(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*C.SECURITY_PACKAGES) | low.rlike("|".join(C.SECURITY_WORDS))


def with_previous(versions: DataFrame, by: tuple[str, ...], order: list, *columns: str) -> DataFrame:
    """versions with prev_<column> of the version before, per package."""
    return with_previous_row(versions, by, order, {f"prev_{c}": c for c in columns})


def dormancy(name: Column, previous: Column, now: Column) -> Column:
    """Signals for a release after more than 180 or 365 days; security packages are expected to rest."""
    gap = gap_days(previous, now)
    ok = ~is_security_package(name) & gap.isNotNull()
    return signals((ok & (gap > 365), signal("LONG_DORMANCY", "HIGH", 0.15)), (ok & (gap > 180) & (gap <= 365), signal("MEDIUM_DORMANCY", "MEDIUM", 0.08)))


def maintainer_change(old: Column, new: Column) -> Column:
    """Arrays of maintainers, both of them known, that differ as sets."""
    differ = (F.size(F.array_except(old, new)) > 0) | (F.size(F.array_except(new, old)) > 0)
    return signals(((F.size(old) > 0) & (F.size(new) > 0) & differ, signal("MAINTAINER_CHANGE", "HIGH", 0.20)))


def author_change(old: Column, new: Column) -> Column:
    return signals(((F.coalesce(old, F.lit("")) != "") & (F.coalesce(new, F.lit("")) != "") & (old != new), signal("MAINTAINER_CHANGE", "HIGH", 0.20)))


def new_dependencies(old: Column, new: Column) -> Column:
    """Names in new, not in old and not among the expected ones."""
    return F.array_sort(F.array_except(F.array_except(new, old), F.array(*map(F.lit, C.EXPECTED_DEPENDENCIES))))


def npm_transition(old_deps: Column, new_deps: Column, old_scripts: Column, new_scripts: Column) -> Column:
    hooks = F.array_except(F.array_intersect(new_scripts, F.array(*map(F.lit, C.INSTALL_HOOKS))), old_scripts)
    return signals((F.size(new_dependencies(old_deps, new_deps)) > 0, signal("NEW_DEPENDENCY", "MEDIUM", 0.08)), (F.size(hooks) > 0, signal("NEW_INSTALL_HOOK", "CRITICAL", 0.30)))


def pypi_files(old: Column, new: Column) -> Column:
    has = lambda files: F.exists(files, lambda f: f.contains("setup.py"))
    return signals((has(new) & ~has(old), signal("NEW_SETUP_PY", "MEDIUM", 0.10)))


def origin_change(old: Column, new: Column) -> Column:
    return signals(((F.coalesce(old, F.lit("")) != "") & (F.coalesce(new, F.lit("")) != "") & (old != new), signal("VCS_ORIGIN_CHANGED", "CRITICAL", 0.40)))


def yanked_predecessor(yanked: Column) -> Column:
    return signals((F.coalesce(yanked, F.lit(False)), signal("YANKED_PREDECESSOR", "MEDIUM", 0.10)))


def diff_signals(added: Column, removed: Column, deleted: Column, binary: Column, new: Column) -> Column:
    """Signals from the statistics of a diff; deleted, binary and new are arrays of paths."""
    some = lambda parts: lambda p: reduce(lambda a, b: a | b, (p.contains(x) for x in parts))
    ends = lambda p: reduce(lambda a, b: a | b, (p.endswith(x) for x in C.BINARY_SIGNAL_SUFFIXES))
    return signals(
        ((removed > 0) & (added > 5 * removed) & (added > 50), signal("LARGE_ADDITION", "MEDIUM", 0.05)), ((removed == 0) & (added > 100), signal("PURE_ADDITION", "MEDIUM", 0.07)),
        (F.size(F.filter(deleted, some(C.TEST_PARTS))) >= 2, signal("TESTS_DELETED", "HIGH", 0.15)), (F.exists(binary, ends), signal("BINARY_ADDED", "HIGH", 0.20)),
        (F.exists(new, some(C.BUILD_FILES)) | F.exists(deleted, some(C.BUILD_FILES)), signal("BUILD_FILES_CHANGED", "MEDIUM", 0.08)))


def manifest_signals(n_deps: Column, added: Column, removed: Column) -> Column:
    total = added + removed
    return signals(
        ((n_deps > 0) & (total == 0), signal("MANIFEST_ONLY_NEW_DEP", "CRITICAL", 0.35)), ((n_deps > 0) & (total > 0) & (total <= 5), signal("ZERO_CODE_CHANGE_WITH_NEW_DEP", "HIGH", 0.25)),
        (n_deps >= 3, signal("MANY_NEW_DEPS_AT_ONCE", "MEDIUM", 0.10)))


def total_boost(found: Column) -> Column:
    return F.aggregate(found, F.lit(0.0), lambda a, s: a + s["boost"])


def any_high(found: Column) -> Column:
    return F.exists(found, lambda s: severity_rank(s["severity"]) >= 4)


def ids(found: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(found, lambda s: s["signal_id"])), ",")
