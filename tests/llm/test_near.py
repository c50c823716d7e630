"""Near-duplicate groups against a comparison of all pairs."""

import random

import numpy as np
import pytest

from tidewatch.llm import near_dedup as nd
from tidewatch.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = (text or "").translate(FOLD).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if all_ and 100 * both >= 75 * all_:
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def check(spark, rows, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, size string, label int").repartition(3).write.mode("overwrite").parquet(path)
    docs = spark.read.parquet(path)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nd.near_groups(docs).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return docs


def test_groups(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 6, 30, 80, 200, 3000)]
    rows = [(90, ""), (91, None), (92, "  \n"), (93, "a b"), (94, "A  b"), (95, "a b c"), (None, "a b"), (7, "solo text of five words"), (7, "solo text of five words")]
    for k, words in enumerate(base):
        for j in range(8):  # copies with more and more changes, so that links form chains
            changed = list(words)
            for _ in range(j * len(words) // 60):
                changed[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * k + j, " ".join(changed).upper() if j % 2 else "\t".join(changed)))
    docs = check(spark, rows, tmp_path)
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {(c, d if c is None else 0) for d, n, c in brute(rows) if n} | {("empty", i) for i, (_, n, _) in enumerate(brute(rows)) if not n}
    assert kept.count() == len(groups)


def test_empty(spark, tmp_path):
    docs = check(spark, [], tmp_path)
    assert nd.keep_one(docs).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:1500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    of = nd.MinMax(2000)
    assert abs((of.signature(a) == of.signature(b)).mean() - true) < 0.03


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("n", [1, 4, 5, 9])
def test_set_sizes(n):
    assert len(nd.Shingles()(" ".join(map(str, range(n))))) == max(1, n - 4)
