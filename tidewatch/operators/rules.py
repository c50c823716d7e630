"""The rule scanners: single lines, whole texts, chains over neighbouring lines, and their merge. All are native expressions."""

from __future__ import annotations

from functools import lru_cache
from re import _parser as parser  # the standard library's own reading of expressions

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import severity_of, severity_rank

#: Not characters, so they are in no text: what is put around matches.
BEGIN, FINISH = "\ufdd0", "\ufdd1"


def expression(rule: tuple) -> str:
    """A rule's expression for Spark: flags, exclusions as look-aheads, and repeated groups in forms that do not recurse."""
    name, pattern = rule[0], C.FLAT_FORMS.get(rule[0], rule[5])
    if name in C.UNLESS:
        before, after = C.UNLESS[name][0], C.UNLESS[name][1].removeprefix("^")
        at = pattern.index(before) if before else len(pattern)
        pattern = f"{pattern[:at]}(?!{after}){pattern[at:]}"
    return f"(?{'is' if rule[4] else 'i'}){pattern}"


@lru_cache(maxsize=None)
def literals(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of texts in lower case; each match of an expression that ignores case holds one at least of every set."""
    return tuple(sorted(set(_needed(parser.parse(pattern))), key=lambda x: (-min(map(len, x)), len(x), sorted(x))))


def _needed(items) -> list[frozenset[str]]:
    found, run = [], ""
    for op, value in items:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if len(run) > 1:
            found.append(frozenset([run]))
        run = ""
        if name == "SUBPATTERN":
            found += _needed(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0]:
            found += _needed(value[2])
        elif name == "ATOMIC_GROUP":
            found += _needed(value)
        elif name == "BRANCH":
            each = [max(_needed(branch), key=lambda x: (min(map(len, x)), -len(x)), default=None) for branch in value[1]]
            if all(each):
                found.append(frozenset().union(*each))
    return [*found, frozenset([run])] if len(run) > 1 else found


def may(low: Column, pattern: str) -> Column:
    """Whether a text, given in lower case, has what the expression needs: a search for fixed texts, which is many times cheaper."""
    return _all([_any([low.contains(x) for x in sorted(some)]) for some in literals(pattern)] or [F.lit(True)])


def hit(line: Column, rule: tuple) -> Column:
    """Whether a rule matches a text."""
    return line.rlike(expression(rule))


def _last_part(rule: tuple) -> str | None:
    """Of a rule A.*?B over line ends: B."""
    a, _, b = C.FLAT_FORMS.get(rule[0], rule[5]).partition(".*?")
    return b if rule[4] and b and ".*" not in a + b else None


def _marked(text: Column, rule: tuple) -> Column:
    """The text with marks around a rule's matches, null if it has none.

    A rule A.*?B over line ends is searched for up to the last B only, so that no A looks through all of the rest in vain: the time is
    that of the text's length, not of its square.
    """
    marks, last = (lambda t: F.regexp_replace(t, expression(rule), f"{BEGIN}$0{FINISH}")), _last_part(rule)
    if not last:
        return F.when(hit(text, rule), marks(text))
    head = F.regexp_extract(text, f"(?is)^.*(?:{last})", 0)
    return F.get(F.transform(F.array(head), lambda h: F.when((h != "") & hit(h, rule), F.concat(marks(h), F.substring(text, F.length(h) + 1, F.length(text))))), F.lit(0))


def _about(rule: tuple) -> list[Column]:
    return [F.lit(rule[0]).alias("rule_id"), F.lit(rule[1]).alias("category"), F.lit(rule[2]).alias("severity"), F.lit(f"CWE-{rule[3]}").alias("cwe")]


def scan_lines(lines: DataFrame, keep: tuple[str, ...], rules=C.RULES) -> DataFrame:
    """keep..., rule_id, category, severity, cwe, evidence (50 characters of the match): one row per line and rule, each line by itself. A projection and an explode, no shuffle."""
    line, low = F.col("line"), F.col("_low")
    lines = lines.withColumn("_low", F.lower("line"))
    made = [F.when(may(low, expression(r)) & hit(line, r), F.struct(*_about(r), F.left(F.regexp_extract(line, expression(r), 0), F.lit(50)).alias("evidence"))) for r in rules]
    found = lines.select(*keep, F.explode(F.array(*made)).alias("_hit")).where("_hit is not null")
    return found.select(*keep, "_hit.*")


def joined(lines: DataFrame, key: tuple[str, ...], order: str = "seq", number: str = "line_number") -> DataFrame:
    """key..., numbers, lines: the lines of each file as arrays in order."""
    found = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(number).cast("long").alias("number"), "line"))).alias("all"))
    return found.select(*key, F.transform("all", lambda x: x["number"]).alias("numbers"), F.transform("all", lambda x: x["line"]).alias("lines"))


def text_matches(files: DataFrame, key: tuple[str, ...], rules=C.RULES) -> DataFrame:
    """key..., rule_id, category, severity, cwe, line_number, evidence: every rule over the lines of a file as one text. No shuffle.

    files: key..., numbers, lines. A match may span lines; it is reported at the line where it starts, once a line, with its
    first 50 characters. In a text that a rule fits, marks are put around its matches, so that the lines tell where they are.
    """
    texts = files.select(*key, "numbers", F.array_join("lines", "\n").alias("_text")).withColumn("_low", F.lower("_text"))
    made = [F.when(may(F.col("_low"), expression(r)), F.struct(*_about(r), _marked(F.col("_text"), r).alias("marked"))) for r in rules]
    hits = texts.select(*key, "numbers", F.explode(F.filter(F.array(*made), lambda h: h["marked"].isNotNull())).alias("hit"))
    rows = hits.select(*key, "numbers", "hit.*").withColumn("rows", F.split("marked", "\n"))
    shown = lambda i: F.regexp_extract(F.array_join(F.slice("rows", i + 1, F.lit(51)), "\n"), f"{BEGIN}([^{FINISH}]{{0,50}})", 1)
    found = F.filter(F.transform("rows", lambda x, i: F.when(x.contains(BEGIN), F.struct(i.alias("at"), shown(i).alias("evidence")))), lambda x: x.isNotNull())
    each = rows.select(*key, "numbers", "rule_id", "category", "severity", "cwe", F.explode(found).alias("m"))
    return each.select(*key, "rule_id", "category", "severity", "cwe", F.get("numbers", F.col("m.at")).alias("line_number"), "m.evidence")


def chain_matches(files: DataFrame, key: tuple[str, ...], chains=C.CHAINS) -> DataFrame:
    """key..., rule_id, category, severity, cwe, line_number, evidence: the lines from which all expressions of a chain occur in its window of lines, taken as one text. No shuffle.

    files: key..., numbers, lines. Windows are looked at only in files that have all of a chain's expressions somewhere. evidence is the start of the window's first line.
    """
    files = files.withColumn("_text", F.array_join("lines", "\n")).withColumn("_low", F.lower("_text"))
    made = []
    for c in chains:
        window = lambda i, c=c: F.array_join(F.slice("lines", i + 1, F.lit(c[4])), "\n")
        both = lambda t, c=c: _all([t.rlike(f"(?i){p}") for p in c[5]])
        at = F.filter(F.transform("lines", lambda x, i: F.when(both(window(i)), F.struct(i.alias("at"), F.left(x, F.lit(50)).alias("evidence")))), lambda x: x.isNotNull())
        made.append(F.when(_all([may(F.col("_low"), f"(?i){p}") for p in c[5]]) & both(F.col("_text")), F.struct(*_about(c), at.alias("found"))))
    hits = files.select(*key, "numbers", F.explode(F.array_compact(F.array(*made))).alias("hit")).select(*key, "numbers", "hit.*")
    each = hits.select(*key, "numbers", "rule_id", "category", "severity", "cwe", F.explode("found").alias("m"))
    return each.select(*key, "rule_id", "category", "severity", "cwe", F.get("numbers", F.col("m.at")).alias("line_number"), "m.evidence")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def scan_chains(lines: DataFrame, key: tuple[str, ...], order: str, keep: tuple[str, ...], chains=C.CHAINS) -> DataFrame:
    """keep..., rule_id, ...: chain_matches of lines; keep is the key and, where wanted, the order column."""
    found = chain_matches(joined(lines, key, order, order), key, chains)
    return found.select(*(F.col("line_number").alias(c) if c == order else F.col(c) for c in keep), "rule_id", "category", "severity", "cwe", "evidence")


def scan_texts(added: DataFrame, key: str, rules=C.RULES) -> DataFrame:
    """text_matches of the added lines of files; added: key, seq, line_number, line."""
    return text_matches(joined(added, (key,)), (key,), rules)


def merge_matches(single: DataFrame, chains: DataFrame, key: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Both kinds of matches as one list per file: key..., position, rule_id, category, severity, cwe, line_number, evidence, is_chain.

    Single hits of LOW or MEDIUM go where a CRITICAL chain has their category. Of matches of one rule and line the most
    severe stays (chains first). position orders by severity, then line (none first), then kind and rule.
    """
    both = single.withColumn("is_chain", F.lit(False)).unionByName(chains.withColumn("is_chain", F.lit(True)))
    by = Window.partitionBy(*key, "category")
    rank = severity_rank(F.col("severity"))
    both = both.withColumn("covered", F.max(F.col("is_chain") & (F.col("severity") == "CRITICAL")).over(by))
    both = both.where(F.col("is_chain") | ~F.col("covered") | ~F.col("severity").isin("LOW", "MEDIUM")).withColumn("rank", rank)
    first = F.row_number().over(Window.partitionBy(*key, "rule_id", "line_number").orderBy(F.desc("rank"), F.desc("is_chain"), "evidence"))
    one = both.withColumn("_n", first).where("_n = 1")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("rank"), F.coalesce("line_number", F.lit(0)), F.desc("is_chain"), "rule_id"))
    return one.withColumn("position", place).select(*key, "position", "rule_id", "category", "severity", "cwe", "line_number", "evidence", "is_chain")


def summary(matches: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key..., n_matches, worst, any_high, any_critical."""
    rank = severity_rank(F.col("severity"))
    return matches.groupBy(*key).agg(F.count("*").alias("n_matches"), severity_of(F.max(rank)).alias("worst"), F.bool_or(rank >= 4).alias("any_high"), F.bool_or(rank == 5).alias("any_critical"))
