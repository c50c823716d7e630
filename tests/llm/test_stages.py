"""Every stage of the pipeline against a plain version of itself, on clean and on odd tables; the classifier's training against plain FTRL."""

import math
import os
import re
import sys

import numpy as np
import pytest

from test_mixing import plain_mix
from test_near import brute as near_brute
from test_texts import check_packing
from tidewatch.llm import mixing, quality
from tidewatch.llm.common import written

sys.path.insert(0, os.getcwd())
import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
STAGES = dict(cp.STAGES)


def rows(df):
    return sorted(map(str, df.collect()))


def good(docs, labels):
    """The rows that score one half or more, each by a plain sum."""
    w, b = quality.fit(docs, labels)
    of = quality.Features()
    return [r for r in docs.collect() if sum(float(w[p]) * float(v) for p, v in zip(*of(r.text))) + b >= 0]


def first_of_text(found):
    seen, out = {}, []
    for r in sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        key = re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
        if key not in seen:
            seen[key] = r
            out.append(r)
    return out


def first_of_group(found):
    groups = near_brute([(r.doc_id, r.text) for r in found])
    return [r for r, (doc_id, n, component) in zip(found, groups) if not n or component == doc_id]


def drawn(found):
    return [r for r, x in zip(found, plain_mix([(r.doc_id, r.text, r.lang, r.source) for r in found], mixing.Targets())) if x[4]]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, plain in (("quality", lambda d: good(d, labels)), ("exact", lambda d: first_of_text(d.collect())), ("near", lambda d: first_of_group(d.collect())), ("mixture", lambda d: drawn(d.collect()))):
        got = written(STAGES[name](spark, docs, SF), name)
        assert got.columns == docs.columns and rows(got) == sorted(map(str, plain(docs))), name
        assert 0 < got.count() <= docs.count()
        docs = got
    check_packing(docs, STAGES["packed"](spark, docs, SF).collect())


LONG = " ".join(f"long{i}" for i in range(200_000))
ODD = [
    (1, None, "en", "src0", None), (2, "", None, None, 5), (3, "   \n\t ", "de", "src1", 0), (4, "one", "xx", "?", 3), (4, "one", "xx", "?", 3), (5, "one", "en", "src2", 3),
    (None, "a row without an id and some words", "en", "src3", 3), (None, None, None, None, None), (6, "same text in five words or more", "en", "src0", 1), (7, "same  text in five words or\nmore", "en", "src0", 1),
    (8, LONG, "en", "src4", 1), (9, LONG + " end", "en", "src4", 1), (10, "x" * 300_000, "fr", "src5", 1), (11, "é \U0001f600 ​  words", "es", "src6", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_row", "_number", "_gone", "_cell", "_mixed", "_body", "_sha", "_rank", "keep_id", "label", "component_id", "length", "piece", "kept")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "d")
    wide = [(*r, *(f"{c}-{i}" for c in CLASHING)) for i, r in enumerate(ODD)]
    spark.createDataFrame(wide, SCHEMA + "".join(f", `{c}` string" for c in CLASHING)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows_through_each_stage(spark, odd, name):
    got = written(STAGES[name](spark, odd, SF), f"odd-{name}")
    if name == "packed":
        check_packing(odd, got.collect())
        return
    assert got.columns == odd.columns and got.exceptAll(odd).count() == 0
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    if name == "exact":  # null is empty; of equal rows one
        assert ids == sorted([1, 3, 4, 6, 8, 9, 10, 11, None], key=str)
    if name == "near":  # no words, no links: 1, 2, 3 and the empty row without an id stay
        assert ids == sorted([1, 2, 3, None, 4, None, 6, 8, 10, 11], key=str)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_empty_table_through_each_stage(spark, odd, name):
    got = STAGES[name](spark, written(odd.limit(0), "none"), SF)
    assert got.count() == 0 and (name == "packed" or got.columns == odd.columns)


def plain_ftrl(found, bits, epochs):
    """Follow the regularised leader, one number at a time."""
    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= quality.L1 else -(s - math.copysign(quality.L1, s)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for place, value, y in found:
            x = [*zip(place.tolist(), value.tolist()), (1 << bits, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x)))))
            for i, v in x:
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return [weight(i) for i in range(1 << bits)], weight(1 << bits)


def test_training_is_ftrl():
    rng, bits = np.random.default_rng(3), 6
    found = []
    for _ in range(300):
        place = np.unique(rng.integers(0, 1 << bits, 8))
        found.append((place, rng.random(len(place)), int(place[0] % 3 == 0)))
    w, b = quality.train(found, bits, 3)
    want, bias = plain_ftrl(found, bits, 3)
    assert np.allclose(w, want, atol=1e-6) and math.isclose(b, bias, abs_tol=1e-6) and np.abs(w).max() > 0.1


def test_scores_are_plain_sums(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    w, b = quality.fit(docs, labels)
    of, texts = quality.Features(), {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score_quality(docs, w, b).collect():
        logit = sum(float(w[p]) * float(v) for p, v in zip(*of(texts[r.doc_id]))) + b
        assert math.isclose(r.score, 1 / (1 + math.exp(-logit)), rel_tol=1e-4, abs_tol=1e-6) and r.predicted == (r.score >= 0.5)
