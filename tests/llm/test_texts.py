"""Operators 2, 3 and 6 against plain Python on small tables with nulls, ties, empty and long texts."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup as ed
from tidewatch.llm import packing, winnowing

LONG = " ".join(f"word{i * i % 977}" for i in range(9000))
TEXTS = ["a b", "a  b", "a\t\nb", "", None, LONG, LONG, LONG + "x", "x" * 4096, "x" * 4097, "é" * 5000, "é" * 5000 + "\u0085", "one", " ", "  ", "<|endoftext|> hi", "A b"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i * 3 % 17, t, "en", None, 1) for i, t in enumerate(TEXTS)] + [(5, "twice", "en", "s", 2), (5, "twice", None, "s", 2), (None, "a b", None, None, None), (None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    # extra columns with clashing names
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("name", F.lit(1)).withColumn("length", F.lit("x")).withColumn("kept", F.lit(0)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_exact_dedup(docs, block):
    if block == 1:
        docs = docs.where("length(text) < 50 or text is null")
        docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    got = ed.exact_dedup(docs, block=block).drop("_row").collect()
    rows = plain(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert len(got) == len(rows)
    expected = []
    for i, t in rows:
        same = [j for j, u in rows if norm(u) == norm(t)]
        expected.append((i, min((j for j in same if j is not None), default=None), len(same), hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(expected, key=key)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted({x[3] for x in expected})
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_keep_first(docs):
    out = ed.keep_first(docs)
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in plain(docs)})


def test_empty_tables(docs):
    none = docs.limit(0)
    assert ed.exact_dedup(none).count() == 0 and packing.pack(none).count() == 0 and winnowing.compare_edits(none).count() == 0


def brute_winnow(data, k, w, of):
    if not data:
        return []
    grams = [of.rolling.windows(of.rolling.sums(__import__("numpy").frombuffer(data[i : i + k], "uint8")), min(k, len(data)))[0] >> __import__("numpy").uint64(32) for i in range(max(1, len(data) - k + 1))]
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        window = [(int(g), -(i + j)) for j, g in enumerate(grams[i : i + w])]
        least = min(window)
        if not out or out[-1] != (least[0], -least[1]):
            out.append((least[0], -least[1]))
    return out


@pytest.mark.parametrize("data", [b"", b"a", b"abc" * 40, b"x" * 200, LONG.encode()[:3000]])
def test_winnowing(data):
    of = winnowing.Winnower(7, 10)
    h, p = of(data)
    assert list(zip(h.tolist(), p.tolist())) == brute_winnow(data, 7, 10, of)


def test_match_guarantee():
    of = winnowing.Winnower()
    shared = LONG[500 : 500 + winnowing.GUARANTEE]
    a, b = of(("q" * 333 + shared + "tail" * 99).encode())[0], of(("other text " * 50 + shared).encode())[0]
    assert set(a.tolist()) & set(b.tolist())


def test_compare_edits(docs):
    docs = docs.where("doc_id is null or doc_id <> 5").where("doc_id is not null or text is not null")
    got = {r.doc_id: r for r in winnowing.compare_edits(docs).collect()}
    rows = sorted(plain(docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.next_id) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), j)
        of = winnowing.Winnower()
        assert r.fingerprint == winnowing.digest(*of(t.encode())) and r.edited_fingerprint == winnowing.digest(*of(edited.encode()))
        assert r.near_next == winnowing.likeness(of(t.encode())[0], of(u.encode())[0]) and 0 <= r.near_edited <= 1


@pytest.mark.parametrize("n", [1, 3, 50])
def test_ranges_with_ties_and_repeated_rows(spark, tmp_path, n, monkeypatch):
    """Every row meets its successor, also where one id has most rows and where rows are equal."""
    monkeypatch.setattr(winnowing, "partitions", lambda _: n)
    rows = [(7, f"text {i}") for i in range(200)] + [(7, "same")] * 5 + [(i, f"other {i}") for i in range(60)] + [(None, "none"), (None, None), (2**62 + 1, "large"), (2**62, "large too"), (-5, ""), (-5, "")]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _key int, _range string").repartition(7).write.parquet(path)
    docs = spark.read.parquet(path)
    hashed = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    got = winnowing.compare_edits(docs).collect()
    want = []
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest(), j))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.next_id)) for r in got)
    assert winnowing.in_ranges(docs).where("not _guest").groupBy("_range").count().agg({"count": "max"}).first()[0] <= max(266 / n * 3, 20)


def test_pack_small(docs):
    check_packing(docs, packing.pack(docs).collect())


def check_packing(docs, got):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in plain(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [(0, first)] + [(a, a + 1024) for a in range(first, len(ids), 1024)]
        expected += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(cuts)]
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(expected, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins), sum(r.length for r in got) / 1024


def test_packing_is_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bins, least = check_packing(docs, packing.pack(docs).collect())
    assert bins <= 1.02 * least + 2, (bins, least)


def test_plans_place_everything():
    counts = {900: 5, 512: 7, 300: 11, 128: 4, 97: 3}
    groups = packing.grouped(counts, 4)
    assert sum(g[1] for g in groups) == 30 and all(g[1] <= 8 for g in groups)
    configs = packing.configurations(groups, 1024)
    assert [sum(t * c.get(g, 0) for t, c in configs) for g in range(len(groups))] == [g[1] for g in groups]
    assert all(sum(k * groups[g][2] for g, k in c.items()) <= 1024 for _, c in configs)
    assert packing.small_plan({}, {}, 1024) == []
