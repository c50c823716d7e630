"""The whole triage of releases: every scanner over the files of their diffs, put together to one decision each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import verdicts
from .decode import decoded_payloads
from .imports import import_signals
from .lines import added_files, likely_benign
from .manifests import new_dependencies, to_watch
from .ranges import kept
from .rules import chain_matches, merge_matches, text_matches
from .signals import judged_reputation
from .syntax import file_findings
from .tenants import known_bad_hits

#: Parts of the names of manifests whose new dependencies are looked up.
MANIFESTS = ("package.json", "pyproject.toml", "setup.cfg", "requirements")
_MARK = "\x1f"


def parsed_diffs(diffs: DataFrame) -> DataFrame:
    """diffs with added, numbers and lines (see added_files) as a written table, so that all scanners and the decision go by one parse; content stays for manifests only.

    diffs: release_id (string), path, content, is_binary and any others. Binary files have no lines.
    """
    name, is_manifest = F.lower("path"), F.lit(False)
    for part in MANIFESTS:
        is_manifest = is_manifest | name.contains(part)
    text = F.when(~F.col("is_binary"), F.col("content"))
    shown = diffs.withColumn("_text", text).withColumn("content", F.when(is_manifest, F.col("_text")))
    return kept(added_files(shown, "_text", tuple(diffs.columns)), "parsed-diffs")


def scanner_matches(diffs: DataFrame, known_bad: DataFrame, metrics: DataFrame, as_of: Column | None = None) -> DataFrame:
    """release_id, path, phase (rule, import, known_bad, reputation, payload, syntax), rule_id, category, severity, line_number, evidence: what all scanners find.

    diffs: release_id (string), path, content, is_binary, or these as parsed_diffs. known_bad: name, version, ecosystem, verdict, severity. metrics: see judged_reputation.
    Only CRITICAL payloads and syntax findings and CRITICAL and HIGH imports become matches. Every new dependency is looked up.
    """
    files = diffs if "added" in diffs.columns else parsed_diffs(diffs)
    files = files.where(~F.col("is_binary")).withColumn("file_id", F.concat_ws(_MARK, "release_id", "path"))
    added = files.where(F.size("lines") > 0)
    lines = added.select("file_id", F.inline("added"))
    columns = ["file_id", "phase", "rule_id", "category", "severity", "line_number", "evidence"]

    def rows(found: DataFrame, phase: str) -> DataFrame:
        return found.withColumn("phase", F.lit(phase)).withColumn("line_number", F.col("line_number").cast("long")).select(*columns)

    rules = rows(merge_matches(text_matches(added, ("file_id",)), chain_matches(added, ("file_id",))), "rule")
    imported = import_signals(lines, ("file_id",)).where(F.col("severity").isin("CRITICAL", "HIGH"))
    imported = rows(imported.select("file_id", F.concat(F.lit("IMPORT_"), F.upper(F.translate("module", ".", "_"))).alias("rule_id"), F.lit("EXECUTION").alias("category"), "severity", "line_number", F.concat(F.lit("import "), "module").alias("evidence")), "import")
    name = F.lower("path")
    asked = new_dependencies(files.where("content <> ''")).select("file_id", "ecosystem", "name", "version_spec", "is_dev", "line_number")
    confusion = F.lit("DEPENDENCY_CONFUSION").alias("category")
    bad = known_bad_hits(asked, known_bad, "version_spec")
    bad = rows(bad.select("file_id", F.lit("KNOWN_BAD_DEP_INJECTED").alias("rule_id"), confusion, F.lit("CRITICAL").alias("severity"), "line_number", F.concat_ws(": ", "name", "version_spec").alias("evidence")), "known_bad")
    judged = judged_reputation(asked.join(to_watch(asked), ["name", "ecosystem"], "left_semi"), metrics, as_of).where(F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM"))
    judged = rows(judged.select("file_id", F.when(F.col("severity") == "MEDIUM", "UNKNOWN_DEP_ADDED").otherwise("SUSPICIOUS_NEW_DEP_REPUTATION").alias("rule_id"), confusion, "severity", F.lit(None).alias("line_number"), "name").withColumnRenamed("name", "evidence"), "reputation")
    payload = decoded_payloads(lines, ("file_id",)).where("severity = 'CRITICAL'")
    payload = rows(payload.select("file_id", F.lit("DECODED_PAYLOAD_CRITICAL").alias("rule_id"), F.lit("OBFUSCATION").alias("category"), "severity", "line_number", F.col("encoded").alias("evidence")), "payload")
    python = added.where(name.endswith(".py") | name.endswith(".pyw") | ~F.substring_index(name, "/", -1).contains("."))
    syntax = rows(file_findings(python, "file_id").where("severity = 'CRITICAL'").withColumnRenamed("finding_id", "rule_id"), "syntax")
    out = rules
    for more in (imported, bad, judged, payload, syntax):
        out = out.unionByName(more)
    file = F.split("file_id", _MARK)
    return out.select(file[0].alias("release_id"), file[1].alias("path"), *columns[1:])


def triage_releases(releases: DataFrame, diffs: DataFrame, matches: DataFrame) -> DataFrame:
    """release_id, analyze, reason, n_matches: the first phase that decides for each release.

    releases: release_id, said (what the analyzer's own triage said, null where it failed). diffs: release_id, path, content, is_binary, is_new, chunk_index, or these as parsed_diffs. matches:
    rows of scanner_matches. Releases without a diff need no analysis; files that are binary or new count from the second chunk on. All is
    grouped by release with partial aggregation and joined once.
    """
    critical = lambda phase: F.bool_or((F.col("phase") == phase) & (F.col("severity") == "CRITICAL")).alias(phase)
    flags = matches.groupBy("release_id").agg(*(critical(p) for p in ("rule", "import", "known_bad", "reputation", "payload", "syntax")), F.bool_or(F.col("severity") == "HIGH").alias("any_high"), F.count("*").alias("n_matches"))
    of = diffs.groupBy("release_id").agg(F.bool_or((F.col("chunk_index") > 0) & (F.col("is_binary") | F.col("is_new"))).alias("odd"), F.lit(True).alias("any_chunk"))
    plain = diffs.where(~F.col("is_binary"))
    plain = plain if "added" in diffs.columns else added_files(plain, "content", ("release_id",))
    plain = likely_benign(plain.select("release_id", F.inline("added")), ("release_id",)).select("release_id", "likely_benign")
    row = releases.join(of, "release_id", "left").join(flags, "release_id", "left").join(plain, "release_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = F.coalesce("n_matches", F.lit(0))
    analyze, reason = verdicts.triage(no("any_chunk"), no("rule"), no("import"), no("known_bad"), no("reputation"), no("payload"), no("syntax"), F.coalesce("likely_benign", F.lit(True)), n > 0, no("any_high"), F.col("said"), no("odd"))
    return row.select("release_id", analyze.alias("analyze"), reason.alias("reason"), n.alias("n_matches"))
