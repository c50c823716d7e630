"""Near-duplicate detection by min-max hashing.

A document's distinct five-word shingles are hashed once per permutation, and both the least
and the greatest value are kept, so PERMUTATIONS hash evaluations give 2 * PERMUTATIONS
signature values, cut into BANDS bands of ROWS values. Documents that agree in a band are
candidates; a pair at the threshold 0.75 is missed with probability (1 - 0.75**5)**40 = 2e-5.

Documents with equal sets are one node. Links are confirmed on the full sets, in three passes:
1. each member of a bucket with the bucket's leader, the node that shares most buckets;
2. in buckets that still span several components, the members outside the usual one with their own leader;
3. what is left, across components, where sizes allow a link. Before that, members go that have too
   few shingles in common with all other candidates to be similar to any.
The first two have as many pairs as members; the pairs of a large group of near copies are not formed.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, numbered, partitions, written
from .components import components

WORDS, PERMUTATIONS, ROWS, BANDS = 5, 100, 5, 40
#: A link: 100 * intersection >= 75 * union.
PERCENT = 75
#: In the last pass: permutations of the finer signature, least share of agreeing values, members of a block.
FINE, LIKELY, BLOCK = 500, 0.69, 2000
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """text -> sorted distinct 64-bit hashes of its shingles; equal texts up to A-Z and white space give equal arrays."""

    def __init__(self, words: int = WORDS):
        self.words, self.factors, self.known = words, odd(words, 5), {}

    def _hash(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[word] = xxhash.xxh64_intdigest(word)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
        n, k = len(tokens), self.words
        w = np.fromiter(map(self._hash, tokens), np.uint64, n)
        if n < k:
            h = (w * self.factors[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n) if n else w
        else:
            h = w[: n - k + 1] * self.factors[0]
            for i in range(1, k):
                h = h + w[i : n - k + 1 + i] * self.factors[i]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(h ^ (h >> np.uint64(32)))


class MinMax:
    """Set of hashes -> one 64-bit value per band."""

    def __init__(self, permutations: int = PERMUTATIONS, rows: int = ROWS, bands: int = BANDS):
        assert rows * bands <= 2 * permutations
        self.turn, self.rows, self.bands = odd(permutations, 17)[:, None], rows, bands
        self.join, self.salt = odd(rows, 19), odd(bands, 23)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """least and greatest value of each permutation, alternating."""
        least, most = None, None
        for at in range(0, len(s), 4096):
            x = s[None, at : at + 4096] * self.turn
            x ^= x >> np.uint64(33)
            lo, hi = x.min(axis=1), x.max(axis=1)
            least, most = (lo, hi) if least is None else (np.minimum(least, lo), np.maximum(most, hi))
        return np.column_stack([least, most]).ravel()

    def __call__(self, s: np.ndarray) -> np.ndarray:
        parts = self.signature(s)[: self.rows * self.bands].reshape(self.bands, self.rows)
        h = (parts * self.join).sum(axis=1, dtype=np.uint64) * self.salt + self.salt
        return (h ^ (h >> np.uint64(31))).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(rows_in: DataFrame, words: int = WORDS, permutations: int = PERMUTATIONS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(_row, doc_id, n_shingles, set_id, bands) of each (_row, doc_id, text); set_id, a 128-bit digest of the set, and bands are null without words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minmax = Shingles(words), MinMax(permutations, rows, bands)
        for batch in batches:
            sizes, ids, found = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                sizes.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(minmax(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["_row", "doc_id", "n_shingles", "set_id", "bands"])

    ready = rows_in.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ready.mapInArrow(made, "_row long, doc_id long, n_shingles long, set_id binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are links. Each text is read from the table of candidates' texts, by joins on its number."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, kept = Shingles(words), OrderedDict()

        def of(node, text):
            if node not in kept:
                kept[node] = shingles(text.as_py())
                if len(kept) > 64:
                    kept.popitem(last=False)
            kept.move_to_end(node)
            return kept[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [similar(of(a[i], batch.column(2)[i]), of(b[i], batch.column(3)[i]), percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b").mapInArrow(linked, "a long, b long")


def _stars(scored: DataFrame) -> DataFrame:
    """(a, b), a < b: each member of a bucket with the bucket's leader."""
    leaders = scored.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("top"))
    pairs = scored.join(leaders.select("bucket", (-F.col("top.minus")).alias("leader")), "bucket").where("node <> leader")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _mixed(scored: DataFrame, label: DataFrame) -> DataFrame:
    """The members of buckets that span several components, with their label and the most usual one of the bucket."""
    labelled = scored.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kinds = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n_label"), F.min("size").alias("least"))
    usual = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max_by("label", F.struct("n_label", "label")).alias("usual"), F.min("least").alias("least"))
    return written(labelled.join(usual.where("kinds > 1"), "bucket").select("bucket", "node", "size", "score", "label", "usual", "least"), "mixed")


def _able(mixed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """mixed without the members that can have no link, and without buckets that are not mixed then.

    A member outside its bucket's usual component can only share those shingles that some other text among the
    candidates has. Where these are too few for a link with a text of any size that occurs, it goes. Exact: no link is lost.
    """
    per_node = mixed.groupBy("node").agg(F.max(F.col("label") != F.col("usual")).alias("outside"), F.min("least").alias("least"), F.min("size").alias("size"))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            nodes, sides, hashes, size = [], [], [], 0
            for node, side, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingles(text.as_py())
                nodes.append(np.full(len(s), node)), sides.append(np.full(len(s), side)), hashes.append(s.view(np.int64))
                size += len(s)
                if size > 500_000:
                    yield packed(nodes, sides, hashes)
                    nodes, sides, hashes, size = [], [], [], 0
            if nodes:
                yield packed(nodes, sides, hashes)

    def packed(nodes, sides, hashes):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sides)), pa.array(np.concatenate(hashes))], ["node", "outside", "shingle"])

    found = texts.join(per_node, "node").select("node", "outside", "text").mapInArrow(exploded, "node long, outside boolean, shingle long")
    common = found.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("outside").alias("asked")).where("asked and lo < hi").select("shingle")
    shared = found.where("outside").join(common, "shingle").groupBy("node").agg(F.count("*").alias("shared"))
    partner = F.greatest(F.ceil(F.col("size") * percent / 100), F.col("least"))
    weak = 100 * F.col("shared") < percent * (F.col("size") + partner - F.col("shared"))
    judged = per_node.join(shared, "node", "left").withColumn("shared", F.when(F.col("outside"), F.coalesce("shared", F.lit(0))).otherwise(F.col("size")))
    left = mixed.drop("least").join(judged.where(~weak).select("node", "shared"), "node")
    still = left.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return left.join(still, "bucket", "left_semi").select("bucket", "node", "size", "shared", "label")


def _finer(mixed: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, low): a byte of each value of a signature by FINE permutations, for the nodes of mixed."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minmax = Shingles(words), MinMax(FINE)
        for batch in batches:
            low = [(minmax.signature(shingles(t.as_py())) & np.uint64(255)).astype(np.uint8).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], ["node", "low"])

    return texts.join(mixed.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(made, "node long, low binary")


def _across(mixed: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, once each: members of one bucket in different components that may be linked.

    Sizes and shared shingles must allow a link, and at least LIKELY of the finer signature's values must agree; at a similarity
    of 0.75 less than that has a probability of 1e-5. A large bucket is cut into blocks of about BLOCK members, and
    each two of its blocks are compared in a group of their own, so no group is larger than two blocks. Only
    pairs that pass are rows.
    """
    counts = mixed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.hash("node"), F.col("blocks"))
    placed = mixed.join(counts, "bucket").withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = placed.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "size", "shared", "label").join(sketched, "node")

    def compared(group):
        node, size, shared, label, own = (np.array([r[k] for r in group], np.int64) for k in (4, 5, 6, 7, 3))
        if label.min() == label.max():
            return
        bucket, p, q = group[0][0], group[0][1], group[0][2]
        bands, low = np.stack([np.asarray(r[8], np.int64) for r in group]), np.stack([np.frombuffer(r[9], np.uint8) for r in group])
        for i in range(len(group)):
            ok = (label != label[i]) & (node > node[i]) & ((own != own[i]) if p != q else True)
            most = np.minimum(shared, shared[i])
            at = np.flatnonzero(ok & (100 * most >= percent * (size + size[i] - most)))
            if len(at):
                at = at[(low[at] == low[i]).sum(axis=1) >= LIKELY * low.shape[1]]
            if len(at):  # a pair is a row of the first bucket that it shares
                first = bands[i][(bands[at] == bands[i]).argmax(axis=1)]
                yield from ((int(node[i]), int(node[j])) for j in at[first == bucket])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pairs = [], []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:8]]
            bands = np.asarray(batch.column(8).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else ()
            for row in zip(*columns, bands, batch.column(9).to_pylist()):
                if group and row[:3] != group[0][:3]:
                    pairs += compared(group)
                    group = []
                    if len(pairs) > 10_000:
                        yield packed()
                        pairs = []
                group.append(row)
        pairs += compared(group) if group else ()
        if pairs:
            yield packed()

    ready = dealt.select("bucket", "p", "q", "own", "node", "size", "shared", "label", "bands", "low")
    return ready.repartition(partitions(mixed.sparkSession), "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(found, "a long, b long")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: _row, doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id that links reach. Null and wordless texts have an empty set and
    link with nothing. Rows that repeat an id or a text are linked like others; of rows with one id
    and component all are kept (see keep_one for one row of each group). A null id is greater than
    any other. An empty table gives an empty result. docs must be a scan or a written table.
    """
    return _groups(numbered(docs.select("doc_id", "text")), words, percent, permutations, rows, bands)


def _groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """near_groups of (_row, doc_id, text), a written table."""
    made = written(sketches(docs, words, permutations, rows, bands), "sketches")
    nodes = made.where("set_id is not null").groupBy("set_id").agg(
        F.min("_row").alias("node"), F.min("doc_id").alias("least"), F.min("n_shingles").alias("size"), F.min(F.struct("_row", "bands")).alias("first"))
    nodes = written(nodes.select("set_id", "node", "least", "size", F.col("first.bands").alias("bands")), "nodes")
    each = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(each.join(buckets, "bucket"), "members")
    texts = written(docs.select(F.col("_row").alias("node"), "text").join(members.select("node").distinct(), "node", "left_semi"), "texts")

    # a bucket's leader is the member that shares most buckets with others: the origin of a group of copies, if it is there
    scores = members.groupBy("node").agg(F.sum("n").alias("score"))
    scored = written(members.join(scores, "node"), "scored-members")
    tested = written(_stars(scored), "star-pairs")
    links = written(confirmed(tested, texts, words, percent), "star-links")
    label = components(links)

    mixed = _mixed(scored, label)
    second = written(_stars(mixed.where("label <> usual")).join(tested, ["a", "b"], "left_anti"), "second-pairs")
    tested, more = tested.unionByName(second), written(confirmed(second, texts, words, percent), "second-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        label = components(links)
        mixed = _mixed(scored, label)
    mixed = written(_able(mixed, texts, words, percent), "able-members")
    pairs = _across(mixed, _finer(mixed, texts, words).join(nodes.select("node", "bands"), "node"), percent).join(tested, ["a", "b"], "left_anti")
    more = written(confirmed(written(pairs, "cross-pairs"), texts, words, percent), "cross-links")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    whole = nodes.join(label, "node", "left").select("set_id", "least", F.coalesce("label", "node").alias("label"))
    groups = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    of = whole.join(groups, "label").select("set_id", "component_id", "label")
    out = made.drop("bands").join(of, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("_row", "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "label")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near-duplicates, that with the least doc_id; all columns stay. Documents without words stay; an empty table stays empty."""
    number, gone_name = fresh(docs, "number"), fresh(docs, "gone")
    docs = numbered(docs, number)
    found = written(_groups(docs.select(F.col(number).alias("_row"), "doc_id", "text"), **options), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = found.where("label is not null").groupBy("label").agg(F.min(order).alias("first"))
    gone = found.join(first, "label").where("_row <> first._row").select(F.col("_row").alias(gone_name))
    return docs.join(gone, F.col(number) == F.col(gone_name), "left_anti").drop(number)
