"""Differences of long files: valid edits, the same as difflib's where nothing repeats, cuts that cross nothing, bounded parts."""

import difflib
import time

import numpy as np
import pytest

from tidewatch.operators import large_diffs as ld
from tidewatch.operators import lines


def applied(a, b, edits):
    out, i = [], 0
    for i1, i2, j1, j2 in edits:
        out += a[i:i1] + b[j1:j2]
        i = i2
    return out + a[i:]


@pytest.mark.parametrize("whole", [0, 10, 4000])
def test_changes_are_valid(monkeypatch, whole):
    monkeypatch.setattr(ld, "WHOLE", whole)
    rng = np.random.default_rng(whole)
    for _ in range(150):
        a = [str(x) for x in rng.integers(0, 40, rng.integers(0, 60))]
        b = [x for x in a if rng.random() > 0.2] + [str(x) for x in rng.integers(0, 60, rng.integers(0, 9))]
        if rng.random() < 0.3:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        edits = ld.changes(a, b)
        assert applied(a, b, edits) == b
        if whole > 1000:
            assert [e for e in edits if e[0] < e[1] or e[2] < e[3]] == edits


def test_unified_rows_are_difflibs():
    a, b = [f"l{i}\n" for i in range(50)], [f"l{i}\n" for i in range(50) if i not in (0, 7, 8, 30)] + ["end\n"]
    assert [r.rstrip("\n") for r in ld.unified("p", a, b, ld.changes(a, b))] == [r.rstrip("\n") for r in difflib.unified_diff(a, b, "a/p", "b/p", lineterm="")]
    assert ld.unified("p", a, a, []) == []


def edited(rng, n):
    old = [f"line {i}" if i % 5 else "same" for i in range(n)]
    new = [x for i, x in enumerate(old) if i % 97] + ["more"]
    new[n // 2 : n // 2] = [f"new {i}" for i in range(40)]
    return "\n".join(old) + "\n", "\n".join(new)


def _shown(rows, lines, sign):
    """The lines of a version that the hunks' headers say they show."""
    out = []
    for r in rows:
        if r.startswith("@@"):
            at, _, n = r.split(" ")[1 + (sign == "+")][1:].partition(",")
            n = int(n or 1)
            out += lines[int(at) - (n > 0) : int(at) - (n > 0) + n]
    return out


def test_long_pairs_in_parts(spark, monkeypatch):
    """Long files give the counts that difflib gives for them, and rows that lead from one version to the other; short ones are compared as before."""
    monkeypatch.setattr(lines, "LONG", 2000)
    monkeypatch.setattr(ld, "BLOCK", 50)
    rng = np.random.default_rng(1)
    pairs = {f"f{k}": edited(rng, n) for k, n in enumerate((400, 900, 20))} | {"gone": (edited(rng, 500)[0], None), "new": (None, edited(rng, 500)[0]), "equal": ("x\n" * 3000, "x\n" * 3000), "swap": ("".join(f"{i}\n" for i in range(700)), "".join(f"{i}\n" for i in [*range(350, 700), *range(350)]))}
    schema = "release_id string, path string, content string, is_binary boolean"
    frame = lambda k: spark.createDataFrame([("r", p, v[k], False) for p, v in pairs.items() if v[k] is not None], schema)
    got = {r.path: r for r in lines.unified_diffs(frame(0), frame(1)).collect()}
    assert got.keys() == pairs.keys() - {"equal"}
    for p, r in got.items():
        a, b = ([] if x is None else x.splitlines(keepends=True) for x in pairs[p])
        rows = [x.rstrip("\n") for x in difflib.unified_diff(a, b, f"a/{p}", f"b/{p}", lineterm="")]
        if p != "swap":
            assert (r.lines_added, r.lines_removed) == tuple(sum(x.startswith(c) for x in rows[2:]) for c in "+-"), p
        if len("".join(a + b)) <= lines.LONG:
            assert r.content.split("\n") == rows
        told = r.content.split("\n")[2:]
        kept = [x for x in told if not x.startswith("@@")]
        assert [x[1:] for x in kept if x[0] in "- "] == [x for x in (y.rstrip("\n") for y in _shown(told, a, "-"))] and [x[1:] for x in kept if x[0] in "+ "] == [y.rstrip("\n") for y in _shown(told, b, "+")]
    assert got["swap"].lines_added == got["swap"].lines_removed == 350 and got["new"].is_new and got["gone"].is_deleted


def test_cuts_cross_nothing(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 1)
    old = [str(i) for i in range(60)]
    new = old[:20] + old[35:40] + old[20:35] + old[40:]  # a moved block
    cuts = ld.cuts_of(spark.createDataFrame([("k", old, new)], "k string, old array<string>, new array<string>"), ["k"]).first().cuts
    assert [(c.i, c.j) for c in cuts] == [(i, i) for i in [*range(20), *range(40, 60)]]


def test_a_million_lines(spark):
    """Two versions of a file of a million lines, with changes all over: each part has at most a few thousand lines."""
    begun = time.time()
    old = "\n".join(f"line {i}" for i in range(1_000_000))
    new = old.replace("777\n", "778x\n")
    schema = "release_id string, path string, content string, is_binary boolean"
    got = lines.unified_diffs(spark.createDataFrame([("r", "f", old, False)], schema), spark.createDataFrame([("r", "f", new, False)], schema)).select("lines_added", "lines_removed").first()
    assert tuple(got) == (1000, 1000) and time.time() - begun < 150
