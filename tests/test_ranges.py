"""Hot keys: rows before, running sums and chunks by ranges give what a window or a fold over the whole key gives."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import chunks, ranges, signals
from tidewatch.sources import feeds

ORDER = [("k", "long"), ("seq", "long"), ("v", "string")]


@pytest.fixture
def hot(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k) if k < 9 else None, i, None if i % 7 == 0 else f"v{int(rng.integers(3))}") for i, k in enumerate(np.r_[np.zeros(400, int), rng.integers(0, 10, 200)][rng.permutation(600)])]
    return spark.createDataFrame(rows, "k long, seq long, v string").repartition(5)


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_previous_row_of_a_hot_key(hot):
    w = Window.partitionBy("k").orderBy("seq")
    want = hot.withColumns({"before": F.lag("v").over(w), "at": F.lag("seq").over(w)})
    for few in (5, 50, 10_000):
        assert rows_of(ranges.with_previous_row(hot, ("k",), ["seq"], {"before": "v", "at": "seq"}, few), "k", "seq", "v", "before", "at") == rows_of(want, "k", "seq", "v", "before", "at")


def test_running_sums_and_last_values(hot):
    rows = ranges.in_order(hot.where("k IS NOT NULL"), "k", "seq")
    w = Window.partitionBy("k").orderBy("seq")
    got = ranges.last_before(ranges.running_sum(rows, ("k",), "seq", "upto"), ("k",), "v", "past")
    want = hot.where("k IS NOT NULL").withColumns({"upto": F.sum("seq").over(w), "past": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    assert rows_of(got, "k", "seq", "upto", "past") == rows_of(want, "k", "seq", "upto", "past")


def test_no_window_holds_a_large_key(hot):
    """Windows over rows are partitioned by range as well; only the borders' window, a row for each range, is not."""
    rows = ranges.last_before(ranges.in_order(hot, "k", "seq"), ("k",), "v", "past")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line and "Window [" in line]
    assert windows and all("_range#" in w.split("windowspecdefinition(", 1)[1].split(" ASC", 1)[0] for w in windows)


def test_versions_use_it(hot):
    feed = hot.select(F.coalesce(F.col("k").cast("string"), F.lit("none")).alias("name"), F.coalesce("v", F.lit("")).alias("latest"), "seq")
    got = feeds.latest_changes(feed)
    w = Window.partitionBy("name").orderBy("seq")
    want = feed.withColumn("previous", F.lag("latest").over(w)).where("previous <> latest")
    assert rows_of(got, "name", "seq", "latest", "previous") == rows_of(want, "name", "seq", "latest", "previous")
    assert "prev_v" in signals.with_previous(hot, ("k",), ["seq"], "v").columns


def plain_chunks(sizes, limit):
    out, total, at = [], 0, 0
    for n in sizes:
        if total > 0 and total + n > limit:
            at, total = at + 1, 0
        total += n
        out.append(at)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_of_large_releases(spark, seed):
    """Jump pointers, the fold and a plain loop agree, with empty files, files over the limit, equal sizes and a release that holds most files."""
    rng = np.random.default_rng(seed)
    rows = [(int(r), f"p{int(i):04d}.py", int(rng.choice([0, 0, 1, 3, 10, 40, 99, 100, 101, 250]))) for r, n in ((0, 300), (1, 1), (2, 40), (3, 12)) for i in range(n)] + [(4, f"z{i}.py", 0) for i in range(5)]
    df = spark.createDataFrame(rows, "release long, path string, tokens long").repartition(6)
    want = []
    for r in {x[0] for x in rows}:
        mine = sorted((p, t) for k, p, t in rows if k == r)
        want += [(r, p, t, c) for (p, t), c in zip(mine, plain_chunks([t for _, t in mine], 100), strict=True)]
    for few in (0, 20, 10_000):
        got = chunks.chunk_files(df, "release", 100, few=few)
        assert got.columns == ["release", "path", "tokens", "chunk_index"]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_files(spark):
    assert chunks.chunk_files(spark.createDataFrame([], "release long, path string, tokens long"), "release", 100, few=0).count() == 0
