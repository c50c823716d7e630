"""Registered queries, their SQL, the URL filter's odd cases, the classifier and the pipeline."""

import os
import sys

import duckdb
import numpy as np
import pytest

from tidewatch.llm import queries as q
from tidewatch.llm import quality, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({q.ORACLES[name]})").fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG", "http://example.org/es/x?y", "http://notexample.org/es/1", "https://x.com/fr/1#z", "ftp://u.com/de/", "http://com/fr/9", "a://b.net?x/y", "http://m.example.org/en/17", "http://x.org/z://q"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(0, None, None)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    said = {i: (r.host, r.path, r.rule) for i, r in got.items()}
    assert said[0] == said[1] == said[2] == ("", "", None)
    assert said[3] == ("a.example.org", "", None)
    assert said[4] == ("example.org", "/es/x", "example.org/es/") and got[4].verdict == "block"
    assert said[5] == ("notexample.org", "/es/1", "org/") and said[6] == ("x.com", "/fr/1", "com/fr/") and said[7][2] == "com/de/"
    assert said[8] == ("com", "/fr/9", "com/fr/") and said[9] == ("b.net", "", None) and said[10][2] == "example.org/en/1"
    assert said[11] == ("x.org", "/z://q", "org/")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_reject_by_purity(spark):
    rows = [(i, f"http://h{i % 3}.com/{'de' if i % 2 else 'fr'}/{i}") for i in range(60)] + [(100 + i, f"http://other.net/{'de' if i % 2 else 'fr'}/{i}") for i in range(6)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 100").collect()
    assert all(r.verdict == ("block" if "/de/" in r.path else "allow") and r.template in ("/de/*", "/fr/*") for r in got)


def test_varying_segments_become_wildcards(spark):
    words = ["".join(chr(97 + (i * 7 + j * 11) % 26) for j in range(5)) for i in range(30)]
    rows = [(i, f"http://h.net/tags/{w}/page") for i, w in enumerate(words)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.template for r in got} == {"/tags/*/page"}


def test_classifier_on_held_out(spark):
    got = q.op9_quality_classifier(spark, "/root/testdata/sf0.1").join(q.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 1000 and np.mean([r.predicted == r.quality for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_classifier_without_labels_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x" * 100_000, 3), (3, "a b " * 50_000, 4), (3, "a b", 5)], "doc_id long, text string, score int")
    w, b = quality.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    got = quality.score_quality(docs, w, b).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality.keep_good(docs, w, b).columns == docs.columns
    assert quality.score_quality(docs.limit(0), w, b).count() == 0


def test_training_learns():
    of = quality.Features(12)
    rows = [(*of(t), y) for t, y in [("good words here", 1), ("BAD!! WORDS!!", 0)] * 20]
    w, b = quality.train(rows, 12)
    logit = lambda t: float(w[of(t)[0]] @ of(t)[1]) + b
    assert logit("good words here") > 0 > logit("BAD!! WORDS!!")


def test_pipeline(spark):
    sys.path.insert(0, os.getcwd())
    import corpus_pipeline as cp
    from tidewatch.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        if name != "packed":
            assert docs.columns == columns and docs.join(before, columns, "left_anti").count() == 0 and 0 < docs.count() <= before.count()
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()
