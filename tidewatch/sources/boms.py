"""Bills of material: CycloneDX and SPDX, as JSON and XML, to components (ecosystem, name, version)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, purl, purl_parts

_REF = "array<struct<referenceType: string, referenceLocator: string>>"
CYCLONE = "struct<bomFormat: string, components: array<struct<type: string, name: string, version: string, `group`: string, purl: string, `bom-ref`: string>>>"
SPDX = f"struct<SPDXID: string, packages: array<struct<SPDXID: string, name: string, versionInfo: string, externalRefs: {_REF}>>>"
CYCLONE_XML = "struct<components: struct<component: array<struct<_type: string, `_bom-ref`: string, name: string, version: string, `group`: string, purl: string>>>>"
SPDX_XML = f"struct<packages: struct<package: array<struct<SPDXID: string, name: string, versionInfo: string, externalRef: {_REF}>>>, package: array<struct<SPDXID: string, name: string, versionInfo: string, externalRef: {_REF}>>>"


def bom_format(name: Column, text: Column) -> Column:
    """cyclonedx-xml, spdx-xml, cyclonedx-json, spdx-json, or null. What an XML text is, its root element tells: links further down may name the other format."""
    xml = F.lower(name).endswith(".xml") | F.ltrim(text).startswith("<")
    root = F.lower(F.regexp_extract(text, r"<(?:\s*)([A-Za-z][^>]*)", 1))
    spdx = text.contains("SPDXID") | text.contains("spdx") & text.contains('"packages"')
    return F.when(xml, F.when(root.contains("spdx"), "spdx-xml").otherwise("cyclonedx-xml")).when(text.contains('"bomFormat"') | text.contains('"components"'), "cyclonedx-json").when(spdx, "spdx-json")


def guessed(name: Column, group: Column, ref: Column) -> dict[str, Column]:
    """ecosystem and name of a library without a package url: by group, scope, a dotted first path segment, or a reference that is a package url."""
    by_ref = purl(ref)
    grouped = F.coalesce(group, F.lit("")) != ""
    eco = F.when(grouped, "maven").when(name.rlike("^@[^/]+/"), "npm").when(name.contains("/") & F.substring_index(name, "/", 1).contains("."), "go").otherwise(F.coalesce(by_ref["ecosystem"], F.lit("unknown")))
    return {"ecosystem": eco, "name": F.when(grouped, F.concat_ws(":", group, name)).otherwise(name)}


def _component(keep: Column, ecosystem: Column, name: Column, version: Column) -> Column:
    return F.when(keep, F.struct(ecosystem.alias("ecosystem"), name.alias("name"), version.alias("version")))


def _cyclone(list_: Column, ref: str) -> Column:
    def one(c: Column, p: Column) -> Column:
        g, has = guessed(c["name"], c["group"], c[ref]), p["name"].isNotNull()
        kind = c["type"] if ref == "bom-ref" else c["_type"]
        return _component(has | (kind == "library") & (F.coalesce(c["name"], F.lit("")) != ""), F.coalesce(p["ecosystem"], g["ecosystem"]), F.when(has, p["name"]).otherwise(g["name"]), F.coalesce(F.when(has, p["version"]), c["version"], F.lit("")))

    return F.transform(list_, lambda c: let(purl_parts(c["purl"]), lambda p: one(c, p)))


def _spdx(list_: Column, refs: str) -> Column:
    def first(p: Column) -> Column:
        return F.get(F.filter(F.transform(F.filter(p[refs], lambda r: F.lower(r["referenceType"]).contains("purl")), lambda r: purl_parts(r["referenceLocator"])), lambda x: x["name"].isNotNull()), F.lit(0))

    def one(p: Column, first: Column) -> Column:
        named = F.coalesce(p["name"], F.lit(""))
        keep = first.isNotNull() | ~named.isin("", "NOASSERTION") & ~F.coalesce(p["SPDXID"], F.lit("")).isin("SPDXRef-DOCUMENT", "SPDXRef-ROOT")
        return _component(keep, F.coalesce(first["ecosystem"], F.lit("unknown")), F.coalesce(first["name"], named), F.coalesce(first["version"], F.nullif(p["versionInfo"], F.lit("NOASSERTION")), F.lit("")))

    return F.transform(list_, lambda p: let(first(p), lambda f: one(p, f)))


def bom_components(boms: DataFrame, key: str = "sbom_id", format: Column | None = None) -> DataFrame:
    """key, ecosystem, name, version of each component. boms: key, file_name, text; format: a stated format, guessed where null. Texts that cannot be parsed have no components.

    The bills are gone through once: each is read by the parser of its format within the row.
    """
    guess, text = bom_format(F.col("file_name"), F.col("text")), F.col("text")
    xml = lambda schema: F.from_xml(text, schema, {"ignoreNamespace": "true"})
    sx = let(xml(SPDX_XML), lambda d: F.coalesce(d["packages"]["package"], d["package"]))
    found = {"cyclonedx-json": _cyclone(F.from_json(text, CYCLONE)["components"], "bom-ref"), "spdx-json": _spdx(F.from_json(text, SPDX)["packages"], "externalRefs"),
             "cyclonedx-xml": _cyclone(xml(CYCLONE_XML)["components"]["component"], "_bom-ref"), "spdx-xml": _spdx(sx, "externalRef")}
    by = lambda kind: F.coalesce(*(F.when(kind == k, v) for k, v in found.items()))
    each = boms.select(key, F.explode(let(guess if format is None else F.coalesce(format, guess), by)).alias("c"))
    return each.where("c IS NOT NULL").select(key, "c.*")
