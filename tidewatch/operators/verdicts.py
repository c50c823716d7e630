"""Triage and verdicts: what analyzers said per chunk, rule matches and version signals as one verdict per release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import severity_of, severity_rank, verdict_of, verdict_rank

PHASES = ("no chunks", "critical rule", "critical import", "known bad dependency", "critical reputation", "critical payload", "critical syntax")


def triage(any_chunk: Column, rule: Column, imports: Column, known_bad: Column, reputation: Column, payload: Column, syntax: Column, benign: Column, any_match: Column, any_high: Column, said: Column, odd_files: Column) -> tuple[Column, Column]:
    """(analyze, reason): the first phase that decides. rule ... syntax are booleans "has a CRITICAL one"; said is the analyzer's triage, null on error."""
    t, f = F.lit(True), F.lit(False)
    flags = list(zip((rule, imports, known_bad, reputation, payload, syntax), PHASES[1:]))
    analyze, reason = F.when(~any_chunk, f), F.when(~any_chunk, PHASES[0])
    for flag, name in flags:
        analyze, reason = analyze.when(flag, t), reason.when(flag, name)
    for when, value, name in ((benign & ~any_match, f, "likely benign"), (any_high, t, "high severity match"), (said.isNull(), t, "triage failed"), (said, t, "analyzer"), (odd_files, t, "binary or new files"), (t, f, "nothing found")):
        analyze, reason = analyze.when(when, value), reason.when(when, name)
    return analyze, reason


def merge_chunks(chunks: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Analyzer outputs as one verdict: key..., verdict, severity, confidence, summary, n_chunks, tokens.

    chunks: key..., chunk_index, verdict, severity, confidence, n_findings, summary, tokens_used. The strictest verdict and the highest severity;
    confidence weighted by findings (plain if there are none, 0.5 where missing); the summary of the most severe chunk, the first of equal ones.
    """
    c = F.coalesce("confidence", F.lit(0.5))
    n = F.sum("n_findings")
    return chunks.groupBy(*key).agg(
        verdict_of(F.max(verdict_rank(F.col("verdict")))).alias("verdict"), severity_of(F.max(severity_rank(F.col("severity")))).alias("severity"),
        F.when(n == 0, F.avg(c)).otherwise(F.try_divide(F.sum(c * F.col("n_findings")), n)).alias("confidence"),
        F.max_by("summary", F.struct(severity_rank(F.col("severity")), -F.col("chunk_index"))).alias("summary"), F.count("*").alias("n_chunks"), F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens"))


def distinct_findings(findings: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Findings of known categories, the first of each (file, category, lines, or evidence where there is no line)."""
    same = [*key, "file", "category", "line_start", "line_end", F.when(F.col("line_start").isNull() & F.col("line_end").isNull(), F.col("evidence"))]
    first = F.row_number().over(Window.partitionBy(*same).orderBy("chunk_index", "position"))
    known = findings.where(F.col("category").isin(*C.CATEGORIES) & F.col("severity").isin(*C.SEVERITY_RANK))
    return known.withColumn("_n", first).where("_n = 1").drop("_n")


def with_rules(findings: DataFrame, matches: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """findings and the rule matches that they do not cover: key..., file, category, line_start, severity, origin."""
    a = findings.select(*key, "file", "category", "line_start", "severity", F.lit("analyzer").alias("origin"))
    m = matches.select(*key, "file", "category", F.col("line_number").alias("line_start"), "severity", F.lit("rule").alias("origin"))
    f = a.alias("f")
    on = [F.col(f"f.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*key, "file", "category", "line_start")]
    return a.unionByName(m.alias("m").join(f, on, "left_anti"))


def escalate(verdict: Column, severity: Column, confidence: Column, rule_rank: Column, boost: Column, high_signal: Column) -> tuple[Column, Column, Column]:
    """(verdict, severity, confidence) after rules and signals.

    rule_rank: the highest rank among rule matches, 0 if there are none. Matches only lift BENIGN. The boost counts before a
    confident BENIGN (over 0.90) is protected from high signals.
    """
    after = F.when((verdict == "BENIGN") & (rule_rank >= 4), "MALICIOUS").when((verdict == "BENIGN") & (rule_rank > 0), "SUSPICIOUS").otherwise(verdict)
    worst = severity_of(F.greatest(severity_rank(severity), rule_rank))
    sure = F.least(F.lit(1.0), confidence + F.coalesce(boost, F.lit(0.0)))
    final = F.when((rule_rank == 5) & high_signal, "MALICIOUS").when((after == "BENIGN") & high_signal & ~(sure > 0.90), "SUSPICIOUS").otherwise(after)
    return final, worst, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 3)


def is_alert(verdict: Column, severity: Column, least: Column) -> Column:
    return (verdict != "BENIGN") & (severity_rank(severity) >= severity_rank(least))


def last_per_key(rows: DataFrame, key: tuple[str, ...], order: list, keep: int) -> DataFrame:
    """The last `keep` rows per key: the retention of queues and seen-lists."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")
