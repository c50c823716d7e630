"""Findings in the syntax trees of added Python lines.

A tree needs Python's own parser; Spark deals out the files, and each file is parsed by a small helper.
What cannot be parsed as one module is parsed line by line. Input that breaks the parser gives no
findings and never fails the task.
"""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C

#: finding -> (severity, category, CWE)
KINDS = {
    "DIRECT_EXEC_EVAL": ("CRITICAL", "EXECUTION", 506), "GETATTR_DANGEROUS": ("CRITICAL", "OBFUSCATION", 506), "DYNAMIC_IMPORT_SUSPICIOUS": ("HIGH", "EXECUTION", 913),
    "ALIASED_EXEC": ("CRITICAL", "OBFUSCATION", 506), "ATEXIT_REGISTER": ("HIGH", "EXECUTION", 693), "THREADING_TIMER": ("MEDIUM", "EXECUTION", 693),
    "CI_SANDBOX_CHECK": ("HIGH", "EXECUTION", 693), "TIME_BOMB_CHECK": ("HIGH", "EXECUTION", 693), "CREDENTIAL_FILE_CHECK": ("HIGH", "EXFILTRATION", 200), "FSTRING_ENV_EMBED": ("MEDIUM", "EXFILTRATION", 200),
}
#: A cheap sign that a line's file may have a finding; others never reach Python: one of the names as a whole word, a statement that begins with if or elif,
#: an f-string's start. Names outside ASCII may be other forms of one of these.
SIGN = r"\b(?:exec|execfile|eval|compile|getattr|__import__|atexit|Timer)\b|^[\x00-\x20]*(?:el)?if\b|\b(?:[fF][rR]?|[rR][fF])['\"]|[^\x00-\x7F]"


def _string(call: ast.Call, i: int):
    arg = call.args[i] if len(call.args) > i else None
    return arg.value if isinstance(arg, ast.Constant) and isinstance(arg.value, str) else None


def _name(node) -> str | None:
    return node.id if isinstance(node, ast.Name) else None


def _of_call(node: ast.Call, aliases: dict[str, str]):
    name, f = _name(node.func), node.func
    if name in C.DANGEROUS_CALLS:
        yield "DIRECT_EXEC_EVAL", f"{name}(...)"
    if name == "getattr" and _string(node, 1) in C.DANGEROUS_CALLS + C.DANGEROUS_ATTRIBUTES:
        yield "GETATTR_DANGEROUS", f"getattr(obj, '{_string(node, 1)}')"
    if name == "__import__" and _string(node, 0) in C.SUSPICIOUS_MODULES:
        yield "DYNAMIC_IMPORT_SUSPICIOUS", f"__import__('{_string(node, 0)}')"
    if name in aliases:
        yield "ALIASED_EXEC", f"{name}(...) [alias for {aliases[name]}]"
    owner = (_name(f.value), f.attr) if isinstance(f, ast.Attribute) else None
    if owner == ("atexit", "register"):
        yield "ATEXIT_REGISTER", "atexit.register(...)"
    if owner == ("threading", "Timer"):
        yield "THREADING_TIMER", "threading.Timer(...)"


def _of_test(node: ast.If):
    source = ast.unparse(node.test)
    if any(x in source for x in C.CI_NAMES):
        yield "CI_SANDBOX_CHECK", source[:60]
    if "date" in source and ("today" in source or "now" in source):
        yield "TIME_BOMB_CHECK", source[:60]
    if any(x in source for x in C.CREDENTIAL_PLACES):
        yield "CREDENTIAL_FILE_CHECK", source[:60]


def _alias(node: ast.Assign) -> str | None:
    v = node.value
    if _name(v) in C.DANGEROUS_CALLS:
        return v.id
    return _string(v, 1) if isinstance(v, ast.Call) and _name(v.func) == "getattr" and _string(v, 1) in C.DANGEROUS_CALLS else None


def findings(tree: ast.AST) -> dict[tuple[str, int], str]:
    """(finding, line) -> evidence, parents before children, in the order of the source."""
    out, aliases, stack = {}, {}, [tree]
    while stack:
        node = stack.pop()
        made = ()
        if isinstance(node, ast.Call):
            made = _of_call(node, aliases)
        elif isinstance(node, ast.If):
            made = _of_test(node)
        elif isinstance(node, ast.Assign) and (original := _alias(node)):
            aliases |= {t.id: original for t in node.targets if isinstance(t, ast.Name)}
        elif isinstance(node, ast.JoinedStr) and any(x in (source := ast.unparse(node)) for x in C.SECRET_NAMES):
            made = [("FSTRING_ENV_EMBED", source[:60])]
        for kind, evidence in made:
            out.setdefault((kind, node.lineno), evidence)
        stack += reversed(list(ast.iter_child_nodes(node)))
    return out


def parse_lines(numbers: list[int], lines: list[str]) -> dict[tuple[str, int], str]:
    """Findings of added lines at their numbers: as one module, in which an empty line stands for each gap, or else line by line."""
    at = dict(sorted(zip(numbers, lines)))
    rows, place = [], {}
    for number, line in at.items():
        if rows and number - 1 not in at:
            rows.append("")
        rows.append(line)
        place[len(rows)] = number
    try:
        return {(kind, place.get(row, place.get(row + 1, row))): e for (kind, row), e in findings(ast.parse("\n".join(rows))).items()}
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    out = {}
    for number, line in at.items():
        try:
            out |= {(kind, number): e for (kind, _), e in findings(ast.parse(textwrap.dedent(line).strip())).items()}
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
    return out


def syntax_findings(added: DataFrame, key: str) -> DataFrame:
    """key, finding_id, severity, category, cwe, line_number, evidence; added: key, seq, line_number, line of Python files."""
    return _found(added.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("lines"), F.max(F.col("line").rlike(SIGN)).alias("sign")), key)


def file_findings(files: DataFrame, key: str) -> DataFrame:
    """syntax_findings of files whose added lines are arrays (key, added: see added_files): lines move as one array for each file."""
    lines = F.transform("added", lambda x: F.struct(x["line_number"].alias("line_number"), x["line"].alias("line")))
    sign = F.exists("added", lambda x: x["line"].rlike(SIGN))
    return _found(files.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(lines))).alias("lines"), F.max(sign).alias("sign")), key)


def _found(gathered: DataFrame, key: str) -> DataFrame:
    schema = f"{key} string, finding_id string, severity string, category string, cwe string, line_number long, evidence string"

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, numbers, lines in zip(part[key], part["numbers"], part["texts"]):
                for (kind, line), evidence in parse_lines([int(n) for n in numbers], list(lines)).items():
                    severity, category, cwe = KINDS[kind]
                    rows.append((k, kind, severity, category, f"CWE-{cwe}", line, evidence))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"line_number": "Int64"})

    shaped = gathered.where("sign").select(F.col(key).cast("string").alias(key), F.transform("lines", lambda x: x["line_number"]).alias("numbers"), F.transform("lines", lambda x: x["line"]).alias("texts"))
    return shaped.mapInPandas(found, schema)
