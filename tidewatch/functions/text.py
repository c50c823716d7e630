"""Column functions on text: lines, globs, tokens, decoding, package urls, versions, ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog as C

#: What ends a line for the scanners.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def lines_of(text: Column) -> Column:
    """The lines of a text: no empty one after a final line end, none at all for null and empty texts."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def severity_rank(severity: Column) -> Column:
    return _ranked(severity, C.SEVERITY_RANK)


def verdict_rank(verdict: Column) -> Column:
    return _ranked(verdict, C.VERDICT_RANK)


def _ranked(name: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for key, rank in ranks.items():
        out = F.when(name == key, rank).otherwise(out)
    return out


def severity_of(rank: Column) -> Column:
    return _named(rank, C.SEVERITY_RANK, "NONE")


def verdict_of(rank: Column) -> Column:
    return _named(rank, C.VERDICT_RANK, "UNKNOWN")


def _named(rank: Column, ranks: dict[str, int], other: str) -> Column:
    out = F.lit(other)
    for key, value in ranks.items():
        out = F.when(rank == value, key).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """A glob over a base name as a regular expression; made when the plan is built."""
    special = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(special.get(c, "\\" + c if not c.isalnum() and c != "_" else c) for c in glob) + "$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def skipped(path: Column) -> Column:
    """Documentation, examples, tests and metadata. A directory pattern is compared as it is, with its * too."""
    folders = [p[:-1] for p in C.SKIP_PATTERNS if p.endswith("/")]
    names = [glob_regex(p) for p in C.SKIP_PATTERNS if not p.endswith("/")]
    above = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(above, F.array(*map(F.lit, folders))) | base_name(path).rlike("|".join(f"(?:{n})" for n in names))


def priority(path: Column) -> Column:
    """Place in the list of files to look at first; files that are not in it come after."""
    out = F.lit(len(C.PRIORITY_FILES))
    for i, name in reversed(list(enumerate(C.PRIORITY_FILES))):
        out = F.when(base_name(path) == name, i).otherwise(out)
    return out


def binary_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*C.BINARY_SUFFIXES)


def looks_binary(path: Column, content: Column) -> Column:
    """By suffix, or a zero byte among the first 8192; null content counts as binary."""
    return binary_suffix(path) | F.coalesce(F.contains(F.substring(content, 1, 8192), F.lit(b"\0")), F.lit(True))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / C.CHARS_PER_TOKEN)).cast("long")


def rot13(text: Column) -> Column:
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, low + up, low[13:] + low[:13] + up[13:] + up[:13])


def from_hex(text: Column) -> Column:
    """The text in hexadecimal digits; null for odd lengths and other characters, U+FFFD for bytes that are not UTF-8."""
    return F.when((F.length(text) % 2 == 0) & text.rlike("^[0-9a-fA-F]*$"), F.make_valid_utf8(F.unhex(text).cast("string")))


def from_base64(text: Column) -> Column:
    """The text in base64, padded where padding is missing; null if that is not possible."""
    padded = F.concat(text, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)).cast("int")))
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def purl_parts(url: Column) -> Column:
    """ecosystem, name and version of a package url as a struct; null if it is none. Qualifiers and subpaths are left out."""
    pattern = r"^pkg:([A-Za-z0-9.+-]+)/(?:(.+)/)?([^/@?#]+)(?:@([^?#]*))?"

    def made(p: Column) -> Column:
        eco = F.lit(None).cast("string")
        for k, v in C.PURL_ECOSYSTEMS.items():
            eco = F.when(p["kind"] == k, v).otherwise(eco)
        full = F.when((p["space"] != "") & (p["kind"].isin([k for k, v in C.PURL_ECOSYSTEMS.items() if v == "maven"])), F.concat_ws(":", p["space"], p["name"])).when(p["space"] != "", F.concat_ws("/", p["space"], p["name"])).otherwise(p["name"])
        return F.when((p["name"] != "") & p["kind"].isin(list(C.PURL_ECOSYSTEMS)), F.struct(eco.alias("ecosystem"), full.alias("name"), p["version"].alias("version")))

    part = lambda d, i: F.regexp_extract(d, pattern, i)
    parts = let(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), lambda d: F.struct(F.lower(part(d, 1)).alias("kind"), part(d, 2).alias("space"), part(d, 3).alias("name"), part(d, 4).alias("version")))
    return F.when(url.isNotNull(), let(parts, made))


def purl(url: Column) -> dict[str, Column]:
    """The fields of purl_parts."""
    return {k: purl_parts(url)[k] for k in ("ecosystem", "name", "version")}


def semver_key(version: Column) -> Column:
    """A sortable key: the three numbers, whether it is a release (later than its pre-releases), and the pre-release's parts."""
    pattern = r"^v?(\d{1,18})(?:\.(\d{1,18}))?(?:\.(\d{1,18}))?(?:-([0-9A-Za-z.-]+))?"
    number = lambda i: F.coalesce(F.expr("try_cast(NULL as bigint)") if i < 0 else F.nullif(F.regexp_extract(version, pattern, i), F.lit("")).try_cast("long"), F.lit(0))
    pre = F.regexp_extract(version, pattern, 4)
    parts = F.transform(F.filter(F.split(pre, r"\."), lambda p: p != ""), lambda p: F.struct(
        F.when(p.rlike("^[0-9]{1,18}$"), 0).otherwise(1).alias("kind"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("number"), F.when(p.rlike("^[0-9]{1,18}$"), "").otherwise(p).alias("word")))
    return F.struct(version.rlike(pattern).alias("valid"), number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("release"), parts.alias("pre"))


def stripped_spec(spec: Column) -> Column:
    """A version requirement without the signs at its left."""
    return F.regexp_replace(F.coalesce(spec, F.lit("")), r"^[\^~>=<]+", "")


def gap_days(earlier: Column, later: Column) -> Column:
    """Whole days from earlier to later, rounded down; timestamps."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)).cast("long")


def pep440_key(version: Column) -> Column:
    """A sortable key of a PyPI version: epoch, release without zeros at its end, pre, post and dev release, local part; invalid ones first.

    A development release comes before a pre-release, that before the release, and a post-release after it.
    """
    low = F.lower(F.trim(version))
    pattern = r"^v?(?:(\d{1,18})!)?(\d{1,18}(?:\.\d{1,18})*)(?:[._-]?(alpha|a|beta|b|preview|pre|c|rc)[._-]?(\d{0,18}))?((?:-(\d{1,18}))|(?:[._-]?(?:post|rev|r)[._-]?(\d{0,18})))?([._-]?dev[._-]?(\d{0,18}))?(?:\+([a-z0-9]+(?:[._-][a-z0-9]+)*))?$"
    part = lambda i: F.regexp_extract(low, pattern, i)
    number = lambda i, other: F.coalesce(F.nullif(part(i), F.lit("")).try_cast("long"), F.lit(other))
    release = F.transform(F.split(F.regexp_replace(part(2), r"(?:\.0+)+$", ""), r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    kind, dev, post = part(3), part(8) != "", part(5) != ""
    stage = F.when(kind.isin("a", "alpha"), 1).when(kind.isin("b", "beta"), 2).when(kind != "", 3).when(dev & ~post, 0).otherwise(4)
    after = F.when(post, F.coalesce(F.nullif(part(6), F.lit("")).try_cast("long"), F.nullif(part(7), F.lit("")).try_cast("long"), F.lit(0))).otherwise(-1)
    local = F.transform(F.filter(F.split(part(10), r"[._-]"), lambda x: x != ""), lambda x: F.struct(x.rlike("^[0-9]+$").cast("int").alias("kind"), F.coalesce(x.try_cast("long"), F.lit(0)).alias("number"), x.alias("word")))
    return F.struct(low.rlike(pattern).alias("valid"), number(1, 0).alias("epoch"), release.alias("release"), stage.alias("stage"), number(4, 0).alias("pre"), after.alias("post"), F.when(dev, number(9, 0)).otherwise(F.lit((1 << 63) - 1)).alias("dev"), local.alias("local"))


def snippets(text: Column, pattern: str) -> Column:
    """Distinct surroundings of the matches of a pattern: up to 10 characters before and 20 after, at most 60 in all."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{0,10}}(?:{pattern}).{{0,20}})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.left(F.trim(x), F.lit(60))))
