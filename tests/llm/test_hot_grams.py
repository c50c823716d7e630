"""Repeats of one k-gram that very many texts hold: never one group of a task, and removed as before."""

import random

import pytest

from test_suffix import brute
from tidewatch.llm import suffix_dedup as sd


@pytest.mark.parametrize("span,k,line", [(200, 48, 60), (200, 48, 230), (24, 8, 12)])
def test_hot_gram(spark, tmp_path, monkeypatch, span, k, line):
    monkeypatch.setattr(sd, "HOT", 2)
    monkeypatch.setattr(sd, "RATE", 1)
    rng = random.Random(line)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, tail = text(line), text(span)
    rows = [(i, text(rng.randrange(2 * span)) + common + (tail[: rng.randrange(span)] if i % 2 else "") + text(rng.randrange(2 * span))) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(4)] + [(200, common * 5), (201, None)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.cut_repeats(docs, span, k).collect())
    assert got == sorted(brute(rows, span))


def test_single_windows_of_a_crowded_run(spark, tmp_path, monkeypatch):
    """A passage just shorter than a window in every text: contexts differ at their edges only, and no group holds them all."""
    for name, value in (("HOT", 2), ("RATE", 1), ("BATCH", 5)):
        monkeypatch.setattr(sd, name, value)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab") for _ in range(n))
    common = "".join(rng.choice("abcdefgh ") for _ in range(195))
    rows = [(i, text(90) + common + text(90)) for i in range(60)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.cut_repeats(spark.read.parquet(path)).collect())
    assert got == sorted(brute(rows, 200)) and sum(r[2] for r in got) > 0
