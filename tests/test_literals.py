"""The literal filter of the rules and the linear search of rules over line ends: same rows as the plain expressions."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import catalog as C
from tidewatch.operators import rules as R

SPANNING = [r for r in C.RULES if R._last_part(r)]


def python_form(rule):
    return re.compile(R.expression(rule))


def plain(texts, rules):
    """(file, rule, line, evidence) by Python's own search, once a line."""
    out = set()
    for name, text in texts.items():
        for r in rules:
            seen = set()
            for m in python_form(r).finditer(text):
                line = text[: m.start()].count("\n") + 1
                if m.group() and line not in seen:
                    seen.add(line)
                    out.add((name, r[0], line, m.group()[:50]))
    return out


def found(spark, texts, rules):
    files = spark.createDataFrame([(k, [i + 1 for i in range(t.count("\n") + 1)], t.split("\n")) for k, t in texts.items()], "f string, numbers array<long>, lines array<string>")
    return {(r.f, r.rule_id, r.line_number, r.evidence) for r in R.text_matches(files, ("f",), rules).collect()}


def test_every_rule_has_literals_of_its_own_matches():
    """What a rule matches always passes its filter: texts put together from the pieces of all rules' literals."""
    rng = np.random.default_rng(2)
    pieces = sorted({x for r in C.RULES for some in R.literals(R.expression(r)) for x in some}) + ["(", ")", "'", '"', " ", "\n", ".", "1.2.3.4", "=", "os", ":"]
    hits = 0
    for _ in range(3000):
        text = "".join(rng.choice(pieces, 12)).swapcase() if rng.random() < 0.5 else "".join(rng.choice(pieces, 12))
        for r in C.RULES:
            if r[0] not in C.UNLESS and python_form(r).search(text):
                hits += 1
                assert all(any(x in text.lower() for x in some) for some in R.literals(R.expression(r))), (r[0], text)
    assert hits > 500 and sum(bool(R.literals(R.expression(r))) for r in C.RULES) >= 43


def test_rules_over_line_ends_against_plain_search(spark):
    rng = np.random.default_rng(4)
    words = ["entry_points", "EXEC", "subprocess", "socket", "connect((\"1.2.3.4\"", "discord", "leveldb", "Cookies", "chrome", "edge", "x" * 60, "Local State"]
    texts = {f"t{k}": "".join(str(rng.choice(words)) + ("\n" if rng.random() < 0.4 else " ") for _ in range(int(rng.integers(1, 25)))) for k in range(60)} | {"none": "", "tail": "exec\nentry_points\nentry_points"}
    got = found(spark, texts, SPANNING)
    assert got == plain(texts, SPANNING) and len({r for _, r, _, _ in got}) == len(SPANNING) == 4


@pytest.mark.parametrize("line", ['"entry_points": ["a=b:c"],', "Cookies", "discord x", "socket.x"])
def test_long_files_take_linear_time(spark, line):
    """Ten megabytes of a rule's first word without the second."""
    n = 10_000_000 // (len(line) + 1)
    begun = time.time()
    files = spark.range(1).select(F.lit("f").alias("f"), F.sequence(F.lit(1), F.lit(n)).cast("array<long>").alias("numbers"), F.array_repeat(F.lit(line), n).alias("lines"))
    assert R.text_matches(files, ("f",), SPANNING).count() == 0
    assert time.time() - begun < 60
