"""Suffix sorting and the removal of repeats against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import suffix_dedup as sd
from tidewatch.llm.suffix_sort import deep_shallow_sort


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=4).map(lambda b: b"same prefix of more than 64 bytes " * 3 * (len(b) % 2) + b), max_size=30))
def test_sort(strings):
    order, lcp = deep_shallow_sort(strings)
    assert sorted(order.tolist()) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)
    for i in range(1, len(order)):
        a, b = strings[order[i - 1]], strings[order[i]]
        assert lcp[i] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute(rows, span):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + span] for b in bodies for i in range(len(b) - span + 1))
    out = []
    for (d, _), b in zip(rows, bodies):
        gone = [False] * len(b)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("span,k", [(200, 48), (24, 8), (9, 3)])
def test_removal(spark, tmp_path, span, k):
    rng = random.Random(span)
    words = [f"w{i}é"[: rng.randrange(2, 5)] for i in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (10, 30, 60, 70, 100)]
    rows = [(1, None), (2, ""), (3, "x" * (span - 1)), (4, "x" * span), (5, "ab" * 300), (None, text(50)), (6, "y" * span), (6, "z" + "y" * span)]
    for i in range(40):
        rows.append((10 + i, text(rng.randrange(60)) + " " + rng.choice(passages)[rng.randrange(9) :] + " " + text(rng.randrange(80)) + rng.choice(passages)))
    rows += [(100 + i, rows[12][1]) for i in range(5)] + [(200 + i, rows[13][1][:-i - 1] + "!") for i in range(5)]
    path = str(tmp_path / "d")
    spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, place int, body string").repartition(4).write.parquet(path)
    got = sd.cut_repeats(spark.read.parquet(path), span, k).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=key) == sorted(brute(rows, span), key=key)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_parts_of_long_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "PART", 1000)
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(1, base), (2, base[1500:4100]), (3, base[::-1])]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = sd.cut_repeats(spark.read.parquet(path)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute(rows, 200))


def test_empty(spark):
    assert sd.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
