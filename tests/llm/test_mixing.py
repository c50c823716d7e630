"""Raking and drawing against the targets."""

import dataclasses
import hashlib
import math
import re

from pyspark.sql import functions as F

from tidewatch.llm import mixing as mx

SMALL = mx.Targets({"a": 0.5, "b": 0.3, "*": 0.2}, {"en": 0.6, "*": 0.4}, {"prose": 0.9, "legal": 0.1}, 0.5)


def test_rake_meets_all_marginals():
    tokens = {(s, g, t): 10.0 + 97 * i % 53 for i, (s, g, t) in enumerate((s, g, t) for s in "ab*" for g in ("en", "*") for t in ("prose", "legal"))}
    factors = mx.rake(tokens, SMALL)
    total = sum(tokens.values())
    for i, shares in enumerate((SMALL.source, SMALL.lang, SMALL.topic)):
        for name, share in shares.items():
            assert math.isclose(sum(n * factors[c] for c, n in tokens.items() if c[i] == name), share * total, rel_tol=1e-6)
    keep = mx.probabilities(tokens, SMALL)
    assert all(0 <= p <= 1 for p in keep.values())
    assert math.isclose(sum(tokens[c] * p for c, p in keep.items()), 0.5 * total, rel_tol=1e-9)


def test_absent_and_empty():
    assert mx.rake({}, SMALL) == {}
    factors = mx.rake({("a", "en", "prose"): 5.0}, SMALL)
    assert math.isclose(factors["a", "en", "prose"], 1.0)
    assert mx.probabilities({("a", "en", "prose"): 5.0}, dataclasses.replace(SMALL, budget=1.0)) == {("a", "en", "prose"): 1.0} and mx.probabilities({}, SMALL) == {}


def test_draw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4)
    report = mx.mix_report(docs).collect()
    assert len(report) == docs.count()
    total, kept = sum(r.n_tokens for r in report), sum(r.n_tokens for r in report if r.drawn)
    assert abs(kept / total - mx.Targets().budget) < 0.05
    expected = {}
    for r in report:
        expected[r.lang_cell] = expected.get(r.lang_cell, 0) + r.n_tokens * r.probability
    for r in report:
        assert r.n_tokens >= 1 and 0 <= r.probability <= 1
    kept_ids = {r.doc_id for r in mx.mix(docs).select("doc_id").collect()}
    assert kept_ids == {r.doc_id for r in report if r.drawn}


def test_odd_rows(spark):
    rows = [(1, None, None, None, 5), (2, "", "xx", "nowhere", 1), (None, "Licence text " * 3, "en", "src0", None), (3, "a | b | c", "de", "src1", 1), (3, "a | b | c", "de", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight long")
    got = mx.mix_report(docs).collect()
    assert len(got) == 5 and {r.topic for r in got} == {"prose", "legal", "table"}
    assert mx.mix(docs).columns == docs.columns
    assert mx.mix_report(docs.limit(0)).count() == 0


def test_full_cells_do_not_bend_the_marginals():
    """One cell is too small for its part; the other cells of its source make up for it, so all shares are still reached."""
    tokens = {(s, g, "prose"): n for s, g, n in (("a", "en", 10.0), ("a", "*", 800.0), ("b", "en", 500.0), ("b", "*", 500.0), ("*", "en", 400.0), ("*", "*", 300.0))}
    targets = dataclasses.replace(SMALL, lang={"en": 0.4, "*": 0.6}, topic={"prose": 1.0}, budget=0.4)
    keep = mx.probabilities(tokens, targets)
    assert keep["a", "en", "prose"] == 1.0 and all(0 < p < 1 for c, p in keep.items() if c != ("a", "en", "prose"))
    for side, value, target, _, reached in mx.shares(tokens, keep, targets):
        assert math.isclose(target, reached, rel_tol=1e-6), (side, value)


def test_too_little_of_a_source_is_reported(spark):
    rows = [(i, "one two three", "en", "a" if i < 5 else "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r.side, r.value): r for r in mx.reached(docs, SMALL).collect()}
    assert math.isclose(got["source", "a"].target, 0.5) and math.isclose(got["source", "a"].available, 0.005) and math.isclose(got["source", "a"].reached, 0.01)
    assert math.isclose(got["source", "b"].reached, 0.99) and got["source", "*"].available == 0


def plain_mix(rows, targets):
    """(cell, tokens, factor, probability, drawn) of each row, without Spark or arrays."""
    sides = (targets.source, targets.lang, targets.topic)
    cells = []
    for _, text, lang, source in rows:
        text = text or ""
        topic = next(n for n, p in mx.TOPICS if re.search(p, text))
        cells.append((tuple(x if x in s and x != "*" else "*" for x, s in zip((source, lang, topic), sides)), len(re.findall(r"[^\x20\x09-\x0D]+", text)) + 1))
    have = {}
    for c, n in cells:
        have[c] = have.get(c, 0) + n
    total = sum(have.values())

    def raked(w, wanted):
        for _ in range(3000):
            for i, want in enumerate(wanted):
                now = {}
                for c, x in w.items():
                    now[c[i]] = now.get(c[i], 0) + x
                w = {c: x * want[c[i]] / now[c[i]] for c, x in w.items()}
        return w

    def wanted(amount, full, names):
        out = []
        for i, s in enumerate(sides):
            present = {c[i] for c in have}
            norm = sum(s.get(x, 0) for x in present)
            left = {x: max(0, s.get(x, 0) / norm * amount - sum(have[c] for c in full if c[i] == x)) for x in {c[i] for c in names}}
            scale = (amount - sum(have[c] for c in full)) / sum(left.values())
            out.append({x: v * scale for x, v in left.items()})
        return out

    factor = {c: x / have[c] for c, x in raked(dict(have), wanted(total, [], have)).items()}
    full = set()
    while True:
        rest = {c: n for c, n in have.items() if c not in full}
        w = raked(rest, wanted(targets.budget * total, full, rest))
        more = {c for c, x in w.items() if x >= have[c] * (1 - 1e-12)}
        if not more:
            break
        full |= more
    keep = {c: 1.0 if c in full else w[c] / have[c] for c in have}
    chance = lambda i: int(hashlib.sha256(f"mix:{i}".encode()).hexdigest()[:12], 16) / 2**48
    return [(c, n, factor[c], keep[c], chance(r[0]) < keep[c]) for r, (c, n) in zip(rows, cells)]


def test_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    want = {r[0]: x for r, x in zip(rows, plain_mix(rows, mx.Targets()))}
    got = mx.mix_report(docs).collect()
    assert len(got) == len(rows) and any(r.probability == 1 for r in got)
    for r in got:
        cell, n, factor, keep, drawn = want[r.doc_id]
        assert ((r.source_cell, r.lang_cell, r.topic), r.n_tokens, r.drawn) == (cell, n, drawn)
        assert math.isclose(r.weight, factor, rel_tol=1e-6) and math.isclose(r.probability, keep, rel_tol=1e-6)


def test_own_topics_clashing_columns_and_long_texts(spark):
    rows = [(i, "word " * (400_000 if i == 7 else i), "en", "a", "legal" if i % 3 else None, i, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, _cell int, _mixed string")
    made = mx.mix(docs, SMALL, F.col("topic"))
    assert made.columns == docs.columns and all(r["_cell"] == r.doc_id and r["_mixed"] == "x" for r in made.collect())
    assert {r.topic for r in mx.mix_report(docs.drop("topic"), SMALL, F.lit("legal")).collect()} == {"legal"}
    assert mx.mix(docs.limit(0), SMALL).count() == 0
