"""Filter audit against plain sequential filtering, on odd rows."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tidewatch.llm import filter_audit as fa

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """doc_id, source, text rows filtered one order and one filter after another."""
    docs = [(i, s or "", t or "") for i, s, t in rows]
    seen = {}
    for i, _, t in docs:
        if i is not None:
            seen[t] = min(i, seen.get(t, i))
    fails = []
    for i, _, t in docs:
        w = WORDS.findall(t)
        fails.append((len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), any(c in t for c in "#$%&*|"), i is not None and t in seen and seen[t] < i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = {}, Counter()
    for part in {s for _, s, _ in docs}:
        mine = [k for k, d in enumerate(docs) if d[1] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                c = "ABCDE".index(f)
                gone = [k for k in left if fails[k][c]]
                out[part, "".join(order), step] = [
                    len(left) - len(gone), len(gone), sum(fails[k][c] for k in mine) - sum(fails[k][c] for k in left), sum(fails[k][c] and sum(fails[k]) == 1 for k in mine),
                    sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone)]
                shapley[part, f] += len(gone)
                left = [k for k in left if not fails[k][c]]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_against_plain_filtering(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(rng.choice(["a", "bee", "C", "DD", "e#", "\u00e9", "f\u00a0g"], rng.integers(0, 90))) + " ".join(map(str, range(rng.integers(0, 80))))
    texts = [text() for _ in range(25)] + ["", None, "\x0b\x0c", "w " * 60_000]
    rows = [(None if k % 17 == 5 else k // 2 * 3 % 40, [None, "", "s", "t"][k % 4], texts[rng.integers(len(texts))], "x") for k in range(120)] + [(7, "s", "one", "y")] * 2 + [(100, "t", texts[-1], "z")]
    labels = [(int(i), [None, 0, 1][k % 3], [1, 0, None, 2][k % 4], "t") for k, i in enumerate(rng.integers(0, 40, 50))] + [(None, 1, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mask string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    assert got(fa.audit_filters(docs, said)) == plain([r[:3] for r in rows], [r[:3] for r in labels])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit_filters(docs, labels).count() == 0
    one = got(fa.audit_filters(spark.createDataFrame([(1, None, None)], docs.schema), labels))
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and one["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_minimum_of_mask_and_places():
    fails, gone = fa.removal_steps()
    for k, order in enumerate(permutations(range(5))):
        for mask in range(32):
            steps = [s for s, f in enumerate(order, 1) if mask >> f & 1]
            assert gone[mask, k] == (min(steps) if steps else np.inf)


@pytest.mark.parametrize("parts", [1, 3 * fa.AT_ONCE + 1])
def test_many_parts(spark, parts):
    docs = spark.range(parts).selectExpr("id AS doc_id", "concat('s', id) AS source", "'X' AS text")
    rows = fa.audit_filters(docs, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int"))
    assert rows.count() == 600 * parts
    assert [tuple(r) for r in rows.where("filter_order = 'EDCBA' AND step = 3 AND part = 's0'").select("kept", "removed", "good_lost", "shapley").collect()] == [(0, 1, 1, 60)]
