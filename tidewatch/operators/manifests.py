"""Dependencies that a manifest's diff adds: npm, PyPI, Go, Cargo manifests and Cargo locks.

All are windows over the lines of one file: the section a line is in is the last one that was opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.catalog import CRATE, CRATE_TABLE, CRATE_VERSION, GO, PACKAGE, PACKAGE_SECTION, PYPI
from .lines import file_lines


def manifest_kind(path: Column) -> Column:
    """npm, go, cargo, cargo-lock, pypi, or both (npm and pypi) for names that say nothing."""
    p = F.lower(path)
    return (F.when(p.contains("package.json"), "npm").when(p.contains("go.mod") | p.contains("go.sum"), "go").when(p.contains("cargo.toml"), "cargo")
            .when(p.contains("cargo.lock"), "cargo-lock").when(p.rlike(r"(?:\.toml|\.cfg|\.txt|requirements)$"), "pypi").otherwise("both"))


def new_dependencies(diffs: DataFrame, key: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """key, path, ecosystem, name, version_spec, is_dev, line_number (of the line in the diff), from diffs of manifests."""
    raw = file_lines(diffs, content, (key, path)).withColumn("kind", manifest_kind(F.col(path)))
    order = Window.partitionBy(key).orderBy("line_no")
    line = F.col("line")
    added = line.startswith("+") & ~line.startswith("+++")
    bare = F.regexp_replace(line, r"^[+ ]+", "")
    body = F.trim(F.substring(line, 2, 2147483647))
    opens = bare.startswith("[")
    last = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(order)
    state = raw.select(
        "*", added.alias("added"), bare.alias("bare"), body.alias("body"),
        last(line.rlike(PACKAGE_SECTION), F.regexp_extract(line, PACKAGE_SECTION, 1)).alias("npm_section"),
        last(opens, F.lower(bare)).alias("section"),
        # a lock's entry lives while lines are added or removed; others end it
        last(~added & ~line.startswith("-") | (body == "[[package]]") | body.rlike(r'^name\s*=\s*"') | body.rlike(r'^version\s*=\s*"'), F.when(added & body.rlike(r'^name\s*=\s*"'), F.struct(F.regexp_extract(body, r'^name\s*=\s*"([^"]+)"', 1).alias("name"), F.col("line_no").alias("at"))).otherwise(F.struct(F.lit("").alias("name"), F.lit(0).alias("at")))).alias("entry"),
    ).withColumn("pending", F.lag("entry").over(order))
    body, section = F.col("body"), F.coalesce("section", F.lit(""))
    kind = F.col("kind")
    out = lambda when, eco, name, version, dev, at="line_no": state.where(F.col("added") & when).select(key, path, F.lit(eco).alias("ecosystem"), name.alias("name"), version.alias("version_spec"), dev.alias("is_dev"), F.col(at).cast("long").alias("line_number"))
    whole = F.substring(line, 2, 2147483647)
    npm = out(kind.isin("npm", "both") & ~line.rlike(PACKAGE_SECTION) & whole.rlike(PACKAGE) & ~F.regexp_extract(whole, PACKAGE, 1).startswith("//"), "npm", F.regexp_extract(whole, PACKAGE, 1), F.regexp_extract(whole, PACKAGE, 2), F.coalesce("npm_section", F.lit("dependencies")) != "dependencies")
    keyed = body.rlike(r"^[A-Za-z0-9_\-]+\s*=") & F.replace(F.lower(F.trim(F.substring_index(body, "=", 1))), F.lit("-"), F.lit("_")).isin(*C.PYPI_KEYS)
    unquoted = F.regexp_replace(F.regexp_replace(body, r'^"+|"+$', ""), r"^'+|'+$", "")
    name = F.regexp_extract(unquoted, PYPI, 1)
    pypi = out(kind.isin("pypi", "both") & (body != "") & ~body.startswith("#") & ~F.col("bare").startswith("[") & ~keyed & (F.length(name) > 1) & ~name.startswith("-"), "pypi", name,
               F.regexp_replace(F.trim(F.regexp_extract(unquoted, PYPI, 2)), r"""^["',]+|["',]+$""", ""), section.contains("dev") | section.contains("test"))
    asked = F.trim(F.regexp_replace(body, r"^require ", ""))
    go = out((kind == "go") & ~body.startswith("//") & ~(F.col("bare").contains("require") & F.col("bare").contains("(")) & asked.rlike(GO), "go", F.regexp_extract(asked, GO, 1), F.regexp_extract(asked, GO, 2), body.contains("// indirect"))
    in_section = section.contains("dependencies") & ~F.col("bare").startswith("[") & ~body.startswith("#")
    crate = F.coalesce(F.nullif(F.regexp_extract(body, CRATE, 1), F.lit("")), F.regexp_extract(body, CRATE_TABLE, 1))
    cargo = out((kind == "cargo") & in_section & (F.length(crate) > 1) & ~F.lower(crate).isin(*C.CARGO_KEYS), "cargo", crate,
                F.coalesce(F.nullif(F.regexp_extract(body, CRATE, 2), F.lit("")), F.regexp_extract(body, CRATE_VERSION, 1)), section.contains("dev") | section.contains("build"))
    lock = state.where(F.col("added") & (kind == "cargo-lock") & body.rlike(r'^version\s*=\s*"') & (F.col("pending.name") != "")).select(
        key, path, F.lit("cargo").alias("ecosystem"), F.col("pending.name").alias("name"), F.regexp_extract(body, CRATE_VERSION, 1).alias("version_spec"), F.lit(False).alias("is_dev"), F.col("pending.at").cast("long").alias("line_number"))
    return npm.unionByName(pypi).unionByName(go).unionByName(cargo).unionByName(lock)


def to_watch(dependencies: DataFrame) -> DataFrame:
    """The dependencies worth watching: no development ones, none of the well-known names, none of one character."""
    return dependencies.where(~F.col("is_dev") & ~F.lower("name").isin(*C.KNOWN_SAFE) & (F.length("name") >= 2)).select("name", "ecosystem").distinct()
