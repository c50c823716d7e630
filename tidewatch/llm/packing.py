"""Packing documents into sequences of 1024 tokens by the linear grouping scheme.

Only counts by length (at most 1024 numbers) reach the driver, which plans by them:
1. Large pieces, ranked from the longest, are cut into GROUPS groups of equal cardinality and
   rounded up to the largest length of their group; configurations of these few sizes are
   chosen one after another, each the fullest that starts with the largest size left, and used
   as often as the groups allow.
2. The actual pieces take the places of their group by their rank, a join-free computation.
3. The space that is left, again counted by size, is given to the small pieces by best fit.
Ranks are made in salted groups, so a length that most pieces have is not gathered anywhere.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import partitions, written

SIZE, END, SMALL, GROUPS = 1024, 2, 96, 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """text -> ids as the tokenizers library gives them.

    Texts are encoded with the same vocabulary's rank file, which takes a quarter of the time; those that
    hold a special token's string are left to the tokenizers library.
    """

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [x.content for x in self.slow.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(x in text for x in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4")


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Every document's ids and END, cut into pieces of `size` counted from its end; the first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path or vocabulary("byte_bpe_50k.json"), ranks or vocabulary("byte_bpe_50k.tiktoken"))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                ends = range(len(ids) - (len(ids) - 1) // size * size, len(ids) + 1, size)
                for i, end in enumerate(ends):
                    start = max(0, end - size)
                    rows.append((doc_id, i, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def ranked(df: DataFrame, by: str, order: list[str], salts: int) -> DataFrame:
    """df with _rank: 0, 1, 2, ... among the rows of each `by`, made in groups of (by, salt)."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
    base = counts.select(by, "_salt", (F.sum("_n").over(Window.partitionBy(by).orderBy("_salt")) - F.col("_n")).alias("_base"))
    own = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order))
    return salted.withColumn("_own", own).join(base, [by, "_salt"]).withColumn("_rank", F.col("_base") + F.col("_own") - 1).drop("_salt", "_own", "_base")


def grouped(counts: dict[int, int], groups: int) -> list[list[int]]:
    """[first rank, number, rounded size] of each group of large pieces, ranked from the longest."""
    total = sum(counts.values())
    each, out, rank = max(1, -(-total // groups)), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not out or out[-1][1] == each:
                out.append([rank, 0, length])
            took = min(left, each - out[-1][1])
            out[-1][1] += took
            rank, left = rank + took, left - took
    return out


def configurations(groups: list[list[int]], size: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {group: places}) until no piece is left: the fullest that starts with the largest size left."""
    left, sizes, out = [g[1] for g in groups], [g[2] for g in groups], []
    first = 0
    while first < len(groups):
        if not left[first]:
            first += 1
            continue
        config, room, barred = {first: 1}, size - sizes[first], set()
        while room:
            # best[c]: the largest sum up to c of the sizes that are left; last[c]: a group that it ends with
            best, last = np.zeros(room + 1, np.int64), np.full(room + 1, -1)
            for g in range(len(groups) - 1, first - 1, -1):
                s = sizes[g]
                if s > room:
                    break
                if g in barred or left[g] - config.get(g, 0) < 1:
                    continue
                for c in range(s, room + 1, s):  # a size may be used again and again
                    top = min(c + s, room + 1)
                    better = best[c - s : top - s] + s > best[c:top]
                    best[c:top] = np.where(better, best[c - s : top - s] + s, best[c:top])
                    last[c:top] = np.where(better, g, last[c:top])
            if not best[room]:
                break
            c, want = int(best[room]), {}
            while c:
                g = int(last[c])
                want[g], c = want.get(g, 0) + 1, c - sizes[g]
            short = {g for g, k in want.items() if left[g] < k + config.get(g, 0)}
            for g, k in want.items():
                k = min(k, left[g] - config.get(g, 0))
                config[g] = config.get(g, 0) + k
                room -= k * sizes[g]
            if not short:
                break
            barred |= short
        times = min(left[g] // k for g, k in config.items())
        for g, k in config.items():
            left[g] -= times * k
        out.append((times, config))
    return out


def large_plan(groups, configs) -> tuple[list[tuple[int, int, int]], int]:
    """(first rank, first sequence, places in each sequence) of each run of ranks, and the number of sequences."""
    used, runs, sequence = [0] * len(groups), [], 0
    for times, config in configs:
        for g, k in config.items():
            runs.append((groups[g][0] + used[g], sequence, k))
            used[g] += times * k
        sequence += times
    return sorted(runs), sequence


def small_plan(small: dict[int, int], room: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, room, first sequence among those with that room, places in each); room -1: new sequences.

    Best fit: from the longest, each length goes where the least room is left. Equal cases are moved together.
    """
    lots = {r: [(r, 0, n)] for r, n in room.items() if r > 0}  # by the room left now: (room before, first, number)
    plan, new = [], 0
    for length in sorted(small, reverse=True):
        rank, left = 0, small[length]
        while left:
            fit = min((r for r in lots if r >= length), default=None)
            if fit is None:
                each = size // length
                bins = -(-left // each)
                plan.append((length, rank, -1, new, each))
                whole = left // each
                if whole and size - each * length:
                    lots.setdefault(size - each * length, []).append((-1, new, whole))
                if bins > whole:
                    lots.setdefault(size - (left - whole * each) * length, []).append((-1, new + whole, 1))
                new, left = new + bins, 0
                continue
            origin, at, number = lots[fit].pop()
            each = max(1, fit // length) if number * (fit // length) <= left else 1
            took = min(number, left // each)
            plan.append((length, rank, origin, at, each))
            if took < number:
                lots[fit].append((origin, at + took, number - took))
            if not lots[fit]:
                del lots[fit]
            if fit - each * length:
                lots.setdefault(fit - each * length, []).append((origin, at, took))
            rank, left = rank + took * each, left - took * each
    return plan


def pack(docs: DataFrame, size: int = SIZE, small: int = SMALL, groups: int = GROUPS, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one END token. Rows that repeat a doc_id are packed as separate documents.
    An empty table gives no rows. Pieces of a full sequence's length are alone in theirs.
    """
    spark = docs.sparkSession
    salts = max(64, partitions(spark))
    cut = written(pieces(docs, size, path, ranks), "pieces")
    items = written(ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], salts), "ranked-pieces")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    large = {x: n for x, n in counts.items() if small < x < size}
    few = grouped(large, groups)
    runs, sequences = large_plan(few, configurations(few, size))
    first = np.array([r[0] for r in runs] or [0], np.int64)
    base = np.array([r[1] for r in runs] or [0], np.int64)
    places = np.array([r[2] for r in runs] or [1], np.int64)
    above, ahead = 0, np.zeros(size + 1, np.int64)
    for x in sorted(large, reverse=True):
        ahead[x], above = above, above + large[x]

    @F.pandas_udf("long")
    def large_sequence(length: pd.Series, rank: pd.Series) -> pd.Series:
        r = ahead[length.to_numpy()] + rank.to_numpy()
        at = np.searchsorted(first, r, "right") - 1
        return pd.Series(base[at] + (r - first[at]) // places[at])

    length = F.col("length")
    big = items.where((length > small) & (length < size)).withColumn("sequence_id", large_sequence("length", "_rank"))
    used = big.groupBy("sequence_id").agg((F.lit(size) - F.sum("length")).alias("room"))
    bins = written(ranked(used, "room", ["sequence_id"], salts).select("room", F.col("_rank").alias("bin"), "sequence_id"), "rooms")
    room = {r["room"]: r["n"] for r in bins.groupBy("room").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    plan = small_plan({x: n for x, n in counts.items() if x <= min(small, size - 1)}, room, size)
    table = {x: sorted(p[1:] for p in plan if p[0] == x) for x in {p[0] for p in plan}}
    starts = {x: [p[0] for p in t] for x, t in table.items()}

    @F.pandas_udf("room long, bin long")
    def small_place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        found = []
        for x, r in zip(length, rank):
            lo, origin, at, each = table[x][bisect_right(starts[x], r) - 1]
            found.append((origin, at + (r - lo) // each))
        return pd.DataFrame(found, columns=["room", "bin"])

    placed = items.where((length <= small) & (length < size)).withColumn("_at", small_place("length", "_rank")).select("*", "_at.room", "_at.bin").drop("_at")
    filled = placed.where("room >= 0").join(bins, ["room", "bin"]).drop("room", "bin")
    fresh = placed.where("room < 0").withColumn("sequence_id", F.col("bin") + sequences).drop("room", "bin")
    added = max((at + -(-(counts[x]) // each) for x, lo, origin, at, each in plan if origin < 0), default=0)
    full = items.where(length == size).withColumn("sequence_id", F.col("_rank") + (sequences + added))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "_rank")  # at most `size` rows
    shared = big.unionByName(filled).unionByName(fresh).withColumn("offset", F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - length)
    return shared.unionByName(full.withColumn("offset", F.lit(0).cast("long"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
