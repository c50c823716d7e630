"""Removal of byte strings of SPAN bytes that occur more than once, by sorting suffixes.

Every window of SPAN bytes has an anchor: its k-gram of least hash (the rightmost of equal ones).
Equal windows have equal anchors at equal places, so only the suffixes at anchors are sorted, one
in about 75 bytes. The windows that share an anchor are a run of starts; their bytes are its context.

1. Anchors are grouped by k-gram, as hashes and places only. K-grams that occur once are done. Contexts are told apart by
   the hashes of the k-gram and of all bytes together (128 bits); of equal ones two stand for all.
2. The bytes of those are cut from the texts and dealt out by k-gram. Each
   task sorts the suffixes from the anchors and the reversed prefixes before them (deep-shallow
   sorting, see suffix_sort). A window that starts o bytes before the anchor occurs again exactly
   if another context agrees with it in o bytes to the left and SPAN - o to the right: classes of
   neighbours in the two sorted orders.
3. K-grams of more than about HOT anchors are never one group. Windows with nearly the same o share most of their bytes: WIDTH
   neighbouring starts have SPAN - WIDTH + 1 bytes in common, and only contexts that agree in those can share one of these windows. So
   a context of such a k-gram is cut into runs of WIDTH starts, dealt out by a hash of the common bytes; what is alone there
   is done, the rest is sorted as in 2. Where even that leaves more than BATCH contexts to one key, single windows are counted by two hashes.
4. The repeated windows of a context are those of all anchors that have it; they are joined with the texts, which are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bucketed, partitions, written
from .rolling import Rolling, sliding_min
from .suffix_sort import deep_shallow_sort

SPAN, K, WIDTH = 200, 48, 38
#: A text is searched in parts of so many bytes (with SPAN - 1 more); contexts are sorted about so many at once.
PART, BATCH = 1 << 22, 40_000
#: Anchors of a k-gram from which it is no group of one task; found in one anchor of RATE, which only decides where rows go.
HOT, RATE = 40_000, 64
_PLACE = np.uint64((1 << 23) - 1)


def anchors_of(data: np.ndarray, span: int, k: int, grams: Rolling, whole: Rolling):
    """(place, first window start, last window start, hash of the k-gram, hash of the context) of each anchor of one part."""
    sums = grams.sums(data)
    h = grams.windows(sums, k)
    key = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    least = sliding_min(key, span - k + 1)
    lo = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    hi = np.append(lo[1:], len(least)) - 1
    place = (_PLACE - (least[lo] & _PLACE)).astype(np.int64)
    context = whole.span(whole.sums(data), lo, hi + span) ^ ((place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return place, lo, hi, h[place], context


def find_anchors(rows: DataFrame, span: int = SPAN, k: int = K, rate: int = 1) -> DataFrame:
    """(_row, place, reach, gram, context), one in `rate`: window starts place - back ... place - back + runs choose the anchor at place; reach is back * 2**16 + runs. rows: _row, body (compressed)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, whole, unpack = Rolling(31), Rolling(37), zstandard.ZstdDecompressor()
        for batch in batches:
            parts, size = [], 0
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(unpack.decompress(body.as_py()), np.uint8)
                for at in range(0, len(data) - span + 1, PART):
                    place, lo, hi, gram, context = anchors_of(data[at : at + PART + span - 1], span, k, grams, whole)
                    made = (np.full(len(place), row), place + at, ((place - lo) << 16) + (hi - lo), gram.view(np.int64), context.view(np.int64))
                    if rate > 1:
                        chosen = ((made[1] + row).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(rate) == 0
                        made = tuple(c[chosen] for c in made)
                    parts.append(made)
                    size += len(made[0])
                if size > 50_000:
                    yield packed(parts)
                    parts, size = [], 0
            if parts:
                yield packed(parts)

    def packed(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)], ["_row", "place", "reach", "gram", "context"])

    return rows.select("_row", "body").mapInArrow(found, "_row long, place long, reach long, gram long, context long")


def repeated_windows(left: list[bytes], right: list[bytes], runs: np.ndarray, span: int) -> Iterator[tuple[int, int, int]]:
    """(context, first, last): windows o = last ... first bytes before the anchor that another context has too. left: reversed prefixes."""
    back = np.array([len(s) for s in left], np.int64)
    n = len(left)
    right_order, right_lcp = deep_shallow_sort(right)
    left_order, left_lcp = deep_shallow_sort(left)
    again = np.zeros((int(back.max(initial=0)) + 1, n), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(len(again)):
        active = np.flatnonzero((back >= o) & (o >= back - runs))
        if len(active) < 2:
            continue
        right_class[right_order] = np.cumsum(right_lcp < span - o)
        left_class[left_order] = np.cumsum(left_lcp < o)
        key = right_class[active] * np.int64(n + 1) + left_class[active]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again[o, active[order[np.append(same, False) | np.append(False, same)]]] = True
    edge = np.zeros((1, n), bool)
    change = np.diff(np.concatenate([edge, again, edge]).astype(np.int8), axis=0)
    first, who = np.nonzero((change == 1).T)[::-1]
    last, _ = np.nonzero((change == -1).T)[::-1]
    yield from zip(who.tolist(), (last - 1).tolist(), first.tolist())


#: A context to sort: its part (what it is dealt out by), its hashes, whether it is the first of the two that stand for it, reach and bytes.
CONTEXTS = "part long, gram long, context long, first boolean, reach long, bytes binary"
#: Repeated windows of a context: those that start far ... near bytes before the anchor.
MARKS = "gram long, context long, far long, near long"


def sorted_windows(contexts: DataFrame, span: int) -> DataFrame:
    """MARKS of CONTEXTS: contexts of one part are compared with one another."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            backs = [h[4] >> 16 for h in held]
            left = [h[5][:b][::-1] for h, b in zip(held, backs)]
            right = [h[5][b:] for h, b in zip(held, backs)]
            marked = [(held[i][1], held[i][2], far, near) for i, far, near in repeated_windows(left, right, np.array([h[4] & 0xFFFF for h in held]), span) if held[i][3]]
            columns = list(zip(*marked)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "context", "far", "near"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    n = partitions(contexts.sparkSession)
    return contexts.repartition(n, "part").sortWithinPartitions("part").mapInArrow(found, MARKS)


def dealt_anchors(anchors: DataFrame, sample: DataFrame) -> DataFrame:
    """anchors of k-grams that occur again, with hot, and lead and first: the two anchors that stand for their context, and one of them.

    sample: one anchor in RATE; it only decides where rows go.
    """
    least = max(2, HOT // RATE)
    grams = sample.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("gram", F.lit(True).alias("is_hot"))
    at = F.struct("_row", "place")
    common = sample.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(at).alias("one"), F.max(at).alias("two")).where(F.col("n") >= least).drop("n")
    found = anchors.join(written(grams, "hot-grams"), "gram", "left").join(written(common, "hot-contexts"), ["gram", "context"], "left")
    hot, proven = F.coalesce("is_hot", F.lit(False)), F.col("one").isNotNull()
    part = F.when(proven, F.xxhash64("_row", "place")).when(hot, F.xxhash64("gram", "context")).otherwise(F.col("gram"))
    parts = found.withColumn("hot", hot).withColumn("part", part).repartition(partitions(anchors.sparkSession), "part")
    same, gram = Window.partitionBy("part", "gram", "context"), Window.partitionBy("part", "gram")
    counted = parts.withColumn("nth", F.row_number().over(same.orderBy("_row", "place"))).withColumn("n", F.count("*").over(gram))
    is_at = lambda c: (F.col(f"{c}._row") == F.col("_row")) & (F.col(f"{c}.place") == F.col("place"))
    lead = F.when(proven, is_at("one") | is_at("two")).otherwise(F.col("nth") <= 2)
    first = F.when(proven, is_at("one")).otherwise(F.col("nth") == 1)
    return counted.where(F.col("hot") | proven | (F.col("n") > 1)).select("_row", "place", "reach", "gram", "context", "hot", lead.alias("lead"), first.alias("first"))


def hot_windows(leads: DataFrame, cut, span: int) -> DataFrame:
    """MARKS of leads of k-grams that are too frequent to be one group; cut: see cut_repeats. Nothing but hashes moves until a key is known to come again."""
    width = max(1, min(WIDTH, span // 5))
    mask = 0xFFFFFFFFFFFFFFFF

    def runs_of(reach: int) -> np.ndarray:
        back = reach >> 16
        return np.arange((back - (reach & 0xFFFF)) // width, back // width + 1)

    def keys_of(hashes: Rolling, lead: dict, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(runs, keys): the hash of the bytes that all windows of a run share, from its latest start to the end of its earliest."""
        runs, back = runs_of(lead["reach"]), lead["reach"] >> 16
        lo = back - runs * width
        salt = np.uint64(lead["gram"] & mask) ^ (runs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return runs, (hashes.span(hashes.sums(np.frombuffer(body, np.uint8)), lo, lo + span - width + 1) ^ salt).view(np.int64)

    def keys():
        hashes = Rolling(43)

        def of(row: int, lead: dict, body: bytes):
            runs, k = keys_of(hashes, lead, body)
            return [(int(x), row, lead["place"], int(r)) for r, x in zip(runs, k)]

        return of

    def narrow():
        def of(row: int, lead: dict, body: bytes):
            back, least = lead["reach"] >> 16, (lead["reach"] >> 16) - (lead["reach"] & 0xFFFF)
            for w in lead["runs"]:
                far, near = min(back, w["run"] * width + width - 1), max(least, w["run"] * width)
                yield w["part"], lead["gram"], lead["context"], lead["first"], (far << 16) + far - near, body[back - far : back - near + span], w["wide"]

        return of

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(47), Rolling(53)
        for batch in batches:
            rows = []
            for gram, context, is_first, reach, body in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(body, np.uint8)
                a, b = (h.windows(h.sums(data), span).view(np.int64) for h in (one, two))
                rows.append((np.full(len(a), gram), np.full(len(a), context), np.full(len(a), is_first), (reach >> 16) - np.arange(len(a)), a, b))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["gram", "context", "first", "back", "a", "b"])

    made = written(cut(leads, keys, "part long, _row long, place long, run long"), "hot-keys")
    again = made.groupBy("part").agg(F.count("*").alias("n")).where("n > 1")
    wanted = made.join(again, "part").groupBy("_row", "place").agg(F.collect_list(F.struct("part", "run", (F.col("n") > BATCH).alias("wide"))).alias("runs"))
    cuts = written(cut(leads.join(wanted, ["_row", "place"]), narrow, CONTEXTS + ", wide boolean"), "hot-runs")
    marks = sorted_windows(cuts.where("not wide").drop("wide"), span)
    wide = cuts.where("wide")
    if wide.isEmpty():
        return marks
    single = wide.select("gram", "context", "first", "reach", "bytes").mapInArrow(windows, "gram long, context long, first boolean, back long, a long, b long")
    twice = single.groupBy("gram", "back", "a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return marks.unionByName(single.where("first").join(twice, ["gram", "back", "a", "b"]).select("gram", "context", F.col("back").alias("far"), F.col("back").alias("near")))


def cut_repeats(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs), and kept (the bytes left).

    Texts are UTF-8 bytes, null ones empty. A byte goes if it is in a string of `span` bytes that also starts
    somewhere else, in the same text too, overlapping or not. Texts under `span` bytes stay whole. Rows that
    repeat a text are documents of their own. docs must be a scan or a written table.
    """

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = [pack.compress((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], ["_row", "doc_id", "body"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = bucketed(rows.mapInArrow(compressed, "_row long, doc_id long, body binary"), "_row", "texts")
    repeats = written(dealt_anchors(find_anchors(texts, span, k), find_anchors(texts, span, k, RATE)), "repeated-anchors")

    def cut(some: DataFrame, make, schema: str) -> DataFrame:
        """The rows that make()(row number, lead, bytes of its context) gives for each of some leads; texts do not move."""
        extra = [c for c in some.columns if c == "runs"]
        wanted = some.groupBy("_row").agg(F.collect_list(F.struct("gram", "context", "first", "place", "reach", *extra)).alias("at"))
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

        def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, unpack = make(), zstandard.ZstdDecompressor()
            packed = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
            for batch in batches:
                rows = []
                for row, body, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    body = unpack.decompress(body.as_py())
                    for a in at.as_py():
                        lo = a["place"] - (a["reach"] >> 16)
                        rows += of(row, a, body[lo : lo + (a["reach"] & 0xFFFF) + span])
                    if len(rows) > 20_000:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

        return texts.join(wanted, "_row").select("_row", "body", "at").mapInArrow(contexts, schema)

    def plain():
        return lambda row, lead, body: [(lead["gram"], lead["gram"], lead["context"], lead["first"], lead["reach"], body)]

    marks = sorted_windows(cut(repeats.where("lead and not hot"), plain, CONTEXTS), span)
    hot = repeats.where("lead and hot")
    if not hot.isEmpty():
        marks = marks.unionByName(hot_windows(hot, cut, span))
    marked = repeats.select("_row", "place", "gram", "context").join(written(marks, "marks"), ["gram", "context"]).select("_row", (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + span).alias("end"))
    spans = marked.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("marks"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unpack = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"], zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, body, marks in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                body, found = unpack.decompress(body.as_py()), []
                for m in sorted((m["start"], m["end"]) for m in marks.as_py() or []):
                    if found and m[0] <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], m[1])
                    else:
                        found.append(list(m))
                ends = [0, *(x for f in found for x in f), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(ends[::2], ends[1::2]))
                rows.append((doc_id, len(body), len(body) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), found, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return texts.join(spans, "_row", "left").select("_row", "doc_id", "body", "marks").mapInArrow(
        removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary")
