"""Suspicious imports among added lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C


def module_severity(module: Column, names: Column) -> Column:
    """CRITICAL modules, then dangerous imported names, then HIGH and MEDIUM modules; a module counts by itself or by its first part."""
    root = F.substring_index(module, ".", 1)
    among = lambda group: module.isin(*group) | root.isin(*group)
    return (F.when(among(C.CRITICAL_MODULES), "CRITICAL").when(F.arrays_overlap(names, F.array(*map(F.lit, C.HIGH_FROM_NAMES))), "HIGH")
            .when(among(C.HIGH_MODULES), "HIGH").when(among(C.MEDIUM_MODULES), "MEDIUM"))


def import_signals(added: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key..., module, names (sorted, joined by commas), severity, line_number: each suspicious module once per diff, at its first line.

    added: key..., seq, line_number, line. `import a, b as c` judges each module; `from m import x, y` judges m with the names.
    """
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    plain, origin = C.IMPORT_LINE, C.FROM_LINE
    listed = F.col("line").contains(",") & ~line.startswith("from") & line.rlike(r"^import\s")
    no_names = F.array().cast("array<string>")
    names = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract(line, origin, 2), r"^[\s()]+|[\s()]+$", ""), ","), lambda n: F.trim(n)), lambda n: (n != "") & (n != "*"))
    item = lambda m, ns: F.struct(m.alias("module"), ns.alias("names"))
    modules = F.transform(F.split(F.regexp_replace(line, r"^import", ""), ","), lambda m: item(F.trim(F.substring_index(F.trim(m), " as ", 1)), no_names))
    found = (F.when(listed, modules).when(line.rlike(plain), F.array(item(F.regexp_extract(line, r"^import\s+([\w.]+)", 1), no_names)))
             .when(line.rlike(origin), F.array(item(F.regexp_extract(line, origin, 1), names))))
    each = added.select(*key, "seq", "line_number", listed.alias("listed"), F.posexplode(found).alias("at", "_i")).select(*key, "seq", "line_number", "listed", "at", "_i.module", "_i.names").where("module <> ''")
    judged = each.withColumn("severity", module_severity(F.col("module"), F.col("names"))).where("not listed or severity is not null")
    first = F.row_number().over(Window.partitionBy(*key, "module").orderBy("seq", "at"))
    return judged.withColumn("_n", first).where("_n = 1 and severity is not null").select(*key, "module", F.array_join(F.array_sort("names"), ",").alias("names"), "severity", "line_number")
