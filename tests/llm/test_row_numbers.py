"""Rows keep their numbers where later scans of the input are split otherwise."""

import random

import pytest

from test_suffix import brute
from tidewatch.llm import common, exact_dedup, near_dedup, suffix_dedup

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def docs(spark, tmp_path, monkeypatch):
    """A table of many files of unlike row counts; each written table changes how the next scans are split."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(90)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 40, 3)] + [(200 + i, rows[i][1] + " end") for i in range(1, 40, 3)]
    rng.shuffle(rows)
    for a, b in ((0, 5), (5, 30), (30, 34), (34, 80), (80, len(rows))):
        spark.createDataFrame(rows[a:b], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    real, sizes = common.written, ["1g", "1k", "4k"]

    def written(df, *rest, **options):
        out = real(df, *rest, **options)
        sizes.append(sizes.pop(0))
        spark.conf.set(SPLIT, sizes[0])
        return out

    for module in (common, exact_dedup, near_dedup, suffix_dedup):
        monkeypatch.setattr(module, "written", written)
    for conf, value in ((SPLIT, "1g"), ("spark.sql.files.openCostInBytes", "0"), ("spark.sql.files.minPartitionNum", "1")):
        spark.conf.set(conf, value)
    yield spark.read.parquet(str(tmp_path / "d")), rows
    for conf in (SPLIT, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(conf)


def test_exact(docs):
    assert sorted(r.doc_id for r in exact_dedup.keep_first(docs[0]).collect()) == sorted(d for d, _ in docs[1] if not 100 <= d < 200)


def test_near(docs):
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs[0]).collect()) == list(range(90))


def test_suffix(docs):
    got = suffix_dedup.cut_repeats(docs[0]).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute(docs[1], 200))
