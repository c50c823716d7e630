"""Document fingerprints by winnowing.

The UTF-8 bytes of a text have a rolling hash for each k-gram; of every w neighbouring
hashes the least is kept, the rightmost of equal ones, together with its position. Any
two texts that share GUARANTEE = w + k - 1 bytes share a fingerprint. A text of fewer
than k bytes has the hash of the whole text, an empty or null one has no fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .rolling import Rolling, sliding_min

K, W = 24, 77
GUARANTEE = W + K - 1
#: Rows of each range that are sampled for its bounds.
SAMPLED = 40


class Winnower:
    """bytes -> (hashes, positions), uint32 arrays in order of position."""

    def __init__(self, k: int = K, w: int = W, seed: int = 11):
        self.k, self.w, self.rolling = k, w, Rolling(seed)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not data:
            return np.empty(0, np.uint32), np.empty(0, np.uint32)
        sums = self.rolling.sums(np.frombuffer(data, np.uint8))
        h = self.rolling.windows(sums, min(self.k, len(data))) >> np.uint64(32)
        place = np.arange(len(h), dtype=np.uint64)
        least = sliding_min((h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - place), min(self.w, len(h)))
        kept = least[np.append(True, least[1:] != least[:-1])]
        return (kept >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """16 hexadecimal digits for each fingerprint: its hash and its position."""
    return np.column_stack([hashes, positions]).astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, hashes, positions (arrays) for each row of docs. No shuffle."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Winnower(k, w)
        for batch in batches:
            pairs = [of((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[i].tolist() for p in pairs], pa.list_(pa.int64())) for i in (0, 1))], ["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, "doc_id long, hashes array<long>, positions array<long>")


def _order_key(ids: pd.Series, hashes: pd.Series) -> np.ndarray:
    """16 bytes that sort by descending id, then by hash."""
    flip = np.uint64(1 << 63)
    down = ~(ids.to_numpy(np.int64).view(np.uint64) ^ flip)
    return np.column_stack([down, hashes.to_numpy(np.int64).view(np.uint64) ^ flip]).astype(">u8").view("S16").ravel()


def in_ranges(docs: DataFrame, n: int | None = None) -> DataFrame:
    """(_range, _guest, _key, _hash, doc_id, text): rows dealt out by descending id, so that a row's successor is in its partition.

    Rows are cut into n ranges, as many as the session shuffles to, by id and then by a hash of the text, so that an id
    that very many rows have is cut too. The row that starts a range is also a guest at the end of
    the range before it, and the very first row at the end of the last. Null ids come last. The driver holds some rows of each range, without texts.
    """
    spark = docs.sparkSession
    n = n or partitions(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_key"), F.xxhash64(text).alias("_hash"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keys = keyed.select("_key", "_hash")
    rate = max(1, docs.count() // (SAMPLED * n))
    sample = keys.where(F.pmod(F.xxhash64("_hash", "_key"), F.lit(rate)) == 0).distinct().toPandas()
    ordered = np.sort(_order_key(sample["_key"], sample["_hash"]))
    bounds = spark.sparkContext.broadcast(np.unique(ordered[[len(ordered) * i // n for i in range(1, n)]]) if len(ordered) and n > 1 else ordered[:0])

    @F.pandas_udf("int")
    def range_of(key: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, _order_key(key, hashed), "right"))

    starts = keys.withColumn("_range", range_of("_key", "_hash")).groupBy("_range").agg(F.min(F.struct(F.bitwise_not("_key").alias("down"), "_hash", "_key")).alias("s")).select("_range", "s._key", "s._hash").toPandas().sort_values("_range")
    order = _order_key(starts["_key"], starts["_hash"])
    hosts = spark.sparkContext.broadcast((np.sort(order), np.roll(starts["_range"].to_numpy(), 1)[np.argsort(order)]))

    @F.pandas_udf("int")
    def host_of(key: pd.Series, hashed: pd.Series) -> pd.Series:  # the range before the one that the row starts, or none
        at, (begin, before) = _order_key(key, hashed), hosts.value
        found = np.minimum(np.searchsorted(begin, at), max(0, len(begin) - 1))
        return pd.Series(np.where(begin[found] == at, before[found], -1) if len(begin) else np.full(len(at), -1))

    placed = keyed.withColumn("_own", range_of("_key", "_hash")).withColumn("_host", host_of("_key", "_hash"))
    own, guest = F.struct(F.col("_own").alias("_range"), F.lit(False).alias("_guest")), F.struct(F.col("_host").alias("_range"), F.lit(True).alias("_guest"))
    dealt = placed.select(F.inline(F.when(F.col("_host") >= 0, F.array(own, guest)).otherwise(F.array(own))), "_key", "_hash", "doc_id", "text")
    return dealt.repartition(max(1, len(starts)), "_range").sortWithinPartitions("_range", "_guest", F.desc("_key"), "_hash", "text")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_id long"


def compare_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """For each row: its fingerprint, that of its edited text, and its likeness to that and to the next row's.

    The next row is the one after it by descending doc_id (the first row after the last); the edited text
    has its second half replaced by the start of the next row's text. Rows with one id follow in the order of
    a hash of their texts; a single row is its own successor. Text is shuffled once.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last, rows = Winnower(k, w), None, []  # last: the row that waits for its successor

        def pair(row, follower):
            text, (h, p) = row[2], row[3]
            half = len(text) // 2
            edited = (text[: len(text) - half] + follower[2][:half]).encode()
            eh, ep = of(edited)
            return (row[1], len(text), hashlib.sha256(edited).hexdigest(), digest(h, p), digest(eh, ep), likeness(h, eh), likeness(h, follower[3][0]), follower[1])

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], names)

        names = [x.split()[0] for x in COMPARED.split(", ")]
        for batch in batches:
            for at, guest, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py()
                if guest and last is None:
                    continue  # a further guest with the same id
                row = (at, doc_id, text, of(text.encode()))
                if last is not None:
                    rows.append(pair(last, row))
                last = None if guest else row
                if len(rows) >= 500:
                    yield packed()
                    rows = []
        if rows:
            yield packed()

    return in_ranges(docs).select("_range", "_guest", "doc_id", "text").mapInArrow(compared, COMPARED)
