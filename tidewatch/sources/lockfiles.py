"""Lockfiles of six kinds to pinned packages: key, ecosystem, name, version. The first entry of a name wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lines import file_lines


def lock_kind(name: Column) -> Column:
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    return F.when(base.isin("package-lock.json", "npm-shrinkwrap.json"), "npm").when(base == "yarn.lock", "yarn").when(base == "pipfile.lock", "pipfile").when(base == "poetry.lock", "poetry").when(base == "go.sum", "go").when(base == "cargo.lock", "cargo")


def _first(rows: DataFrame, key: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key, "ecosystem", "name").orderBy("pos"))
    return rows.where("name <> ''").withColumn("_n", n).where("_n = 1").select(key, "ecosystem", "name", "version")


def _npm(rows: DataFrame, key: str) -> DataFrame:
    entry = "struct<name: string, version: string>"
    doc = rows.select(key, F.from_json("text", f"struct<packages: map<string, {entry}>, dependencies: map<string, {entry}>>").alias("d"))
    modern = doc.select(key, F.posexplode("d.packages").alias("pos", "path", "e")).where("path <> ''")
    new = modern.select(key, "pos", F.coalesce("e.name", F.substring_index("path", "node_modules/", -1)).alias("name"), F.coalesce("e.version", F.lit("")).alias("version"))
    old = doc.where("d.packages is null").select(key, F.posexplode("d.dependencies").alias("pos", "name", "e")).select(key, "pos", "name", F.coalesce("e.version", F.lit("")).alias("version"))
    return new.unionByName(old).withColumn("ecosystem", F.lit("npm"))


def _pipfile(rows: DataFrame, key: str) -> DataFrame:
    doc = rows.select(key, F.from_json("text", "struct<`default`: map<string, struct<version: string>>, develop: map<string, struct<version: string>>>").alias("d"))
    part = lambda name, base: doc.select(key, F.posexplode(f"d.{name}").alias("pos", "name", "e")).select(key, (F.col("pos") + base).alias("pos"), "name", F.ltrim(F.coalesce("e.version", F.lit("")), F.lit("=")).alias("version"))
    return part("default", 0).unionByName(part("develop", 1 << 30)).withColumn("ecosystem", F.lit("pypi"))


def _sections(rows: DataFrame, key: str, ecosystem: str) -> DataFrame:
    """[[package]] sections with name and version lines."""
    lines = file_lines(rows, "text", (key,))
    w = Window.partitionBy(key).orderBy("line_no")
    value = lambda k: F.max(F.when(F.col("line").rlike(rf"^{k}\s*="), F.regexp_extract("line", rf'^{k}\s*=\s*"([^"]*)"', 1)))
    head = F.col("line").startswith("[")
    staged = lines.select("*", F.sum(head.cast("int")).over(w).alias("section"), F.last(F.when(head, F.trim("line")), ignorenulls=True).over(w).alias("title"))
    return staged.where("title = '[[package]]'").groupBy(key, "section").agg(value("name").alias("name"), value("version").alias("version")).select(
        key, F.col("section").alias("pos"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("version", F.lit("")).alias("version"), F.lit(ecosystem).alias("ecosystem"))


def _yarn(rows: DataFrame, key: str) -> DataFrame:
    """An entry's header line names it, its version line ends it."""
    lines = file_lines(rows, "text", (key,)).where("line <> '' and not startswith(line, '#')")
    w = Window.partitionBy(key).orderBy("line_no")
    header = ~F.col("line").rlike(r"^\s") & F.col("line").endswith(":") & ~F.col("line").startswith("__metadata")
    name = F.regexp_extract("line", r'^"?(@?[^@"]+)@', 1)
    staged = lines.withColumn("name", F.last(F.when(header, name), ignorenulls=True).over(w)).where(F.col("line").rlike(r"^\s+version:?\s"))
    return staged.select(key, F.col("line_no").alias("pos"), F.coalesce("name", F.lit("")).alias("name"), F.regexp_extract("line", r'^\s+version:?\s+"?([^"\s]+)"?', 1).alias("version"), F.lit("npm").alias("ecosystem"))


def _go(rows: DataFrame, key: str) -> DataFrame:
    pattern = r"^(\S+)\s+v([^\s/]+)(?:/go\.mod)?\s+h1:"
    lines = file_lines(rows, "text", (key,)).where(F.col("line").rlike(pattern))
    return lines.select(key, F.col("line_no").alias("pos"), F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version"), F.lit("go").alias("ecosystem"))


def locked_packages(locks: DataFrame, key: str = "lock_id") -> DataFrame:
    """key, ecosystem, name, version. locks: key, file_name, text. Unknown file names and broken files have no packages."""
    f = locks.withColumn("kind", lock_kind(F.col("file_name")))
    of = lambda kind: f.where(F.col("kind") == kind)
    parts = [_npm(of("npm"), key), _yarn(of("yarn"), key), _pipfile(of("pipfile"), key), _sections(of("poetry"), key, "pypi"), _go(of("go"), key), _sections(of("cargo"), key, "cargo")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _first(out, key)


def plain_list(lines: DataFrame, ecosystem: str) -> DataFrame:
    """ecosystem, name from a text of one name a line, # starting comments. lines: value."""
    name = F.trim(F.regexp_replace("value", "#.*$", ""))
    return lines.select(F.lit(ecosystem).alias("ecosystem"), name.alias("name")).where("name <> ''").distinct()
