"""Prefix trie against one built by hand, the centroid rollup on deep and wide trees, and odd rows."""

import hashlib
import zlib

import numpy as np
import pytest

from tidewatch.llm import prefix_trie as pt


def plain(rows):
    """The nodes of (conv_id, turn, role, text) rows by plain sets and recursion-free sums."""
    told = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in told.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = turns.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    nodes = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out, children = {}, {}
    for p in nodes:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    sums = {p: [0, 0] for p in nodes}
    for p, members in nodes.items():
        leaf, saved = p not in children, (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            sums[p[:d]][0] += leaf
            sums[p[:d]][1] += saved
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(p))))
        out[min(members), len(p)] = (min(nodes[p[:-1]]) if p else None, len(members), children.get(p, 0), *sums[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def random_rows(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(1, longest))):
            rows.append((c - 7, t, ["user", None][int(rng.integers(2))], ["a", "b\u00e9", None, ""][int(rng.integers(4))], 1))
    return rows


@pytest.mark.parametrize(("limit", "block"), [(pt.LIMIT, pt.BLOCK), (3, 4), (1, 2)])
def test_against_a_plain_trie(spark, monkeypatch, limit, block):
    rng = np.random.default_rng(limit)
    monkeypatch.setattr(pt, "BLOCK", block)
    monkeypatch.setattr(pt, "IDS", 2)
    rows = random_rows(rng, 60 if limit > 3 else 24, 14) + [(3, None, "x", "first", 0), (3, None, "x", "first", 0), (3, 1, None, None, 0), (None, 1, "user", "nobody", 0), (10**15, 5, "user", "far", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(pt.prefix_trie(df, limit)) == plain([r[:4] for r in rows])


def test_empty_and_turnless(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # A conversation that takes all its turns from one that isn't there has none.
    c = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "gone", 0)]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain([r[:4] for r in rows]) == {(c, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_one_conversation_holds_most_turns(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 64)
    rows = [(5, t, "user", f"t{t}", 0) for t in range(700)] + [(c, t, "user", f"t{t}", 0) for c in (6, 7, 8) for t in range(20)]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), 100)) == plain([r[:4] for r in rows])


@pytest.mark.parametrize("kind", ["chain", "star", "random", "many"])
def test_subtree_sums(kind):
    rng = np.random.default_rng(1)
    n = 600
    parent = {"chain": np.arange(-1, n - 1), "star": np.r_[-1, np.zeros(n - 1, int)], "random": np.array([-1, *(int(rng.integers(max(0, i - 9), i)) for i in range(1, n))]), "many": np.array([-1 if i % 7 == 0 else i - 1 - int(rng.integers(i % 7)) for i in range(n)])}[kind]
    depth, comp = np.zeros(n, int), np.zeros(n, int)
    for i in range(n):
        depth[i], comp[i] = (0, comp[:i].max() + 1 if i else 0) if parent[i] < 0 else (depth[parent[i]] + 1, comp[parent[i]])
    values = rng.integers(0, 100, (2, n))
    want, weight = values.copy(), rng.integers(1, 5, n)
    for i in np.argsort(-depth, kind="stable"):
        if parent[i] >= 0:
            want[:, parent[i]] += want[:, i]
            weight[parent[i]] += weight[i]
    mixed = rng.permutation(n)
    back = np.argsort(mixed)
    turned = np.where(parent[mixed] < 0, -1, back[parent[mixed]])
    assert (pt.subtree_sums(turned, depth[mixed], comp[mixed], weight[mixed], values[:, mixed]) == want[:, mixed]).all()
