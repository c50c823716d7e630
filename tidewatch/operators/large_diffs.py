"""Differences of long files in parts of bounded size.

Lines that occur once in both versions are anchors. An anchor that no other crosses, in the order of the old file and of the new one, cuts the pair
in two that can be compared apart; such cuts are found for all files at once by ranks and running maxima over ranges of anchors. One cut is
taken in each `BLOCK` lines, and each part is compared in a task of its own. What has no such cut is cut in the task by the longest rising sequence of
its own anchors. The result is a difference like any other, but not always the one that a comparison of the whole files would choose.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import in_order, kept, running

#: Lines between two cuts; lines of both sides up to which difflib compares a part as a whole.
BLOCK, WHOLE = 2000, 4000


def changes(a: list[str], b: list[str], ai: int = 0, bi: int = 0) -> list[tuple[int, int, int, int]]:
    """(i1, i2, j1, j2) of the stretches of a that are replaced by stretches of b, in order; ai and bi are added to the places."""
    lo, hi = 0, 0
    most = min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b, ai, bi = a[lo : len(a) - hi], b[lo : len(b) - hi], ai + lo, bi + lo
    if not a or not b:
        return [(ai, ai + len(a), bi, bi + len(b))] if a or b else []
    if len(a) + len(b) <= WHOLE:
        return [(ai + i1, ai + i2, bi + j1, bi + j2) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes() if tag != "equal"]
    cuts = _rising(a, b)
    if not cuts:  # nothing but repeated lines: popular ones are no anchors of difflib's either
        return [(ai, ai + len(a), bi, bi + len(b))]
    out, i, j = [], 0, 0
    for x, y in [*cuts, (len(a), len(b))]:
        out += changes(a[i:x], b[j:y], ai + i, bi + j)
        i, j = x + 1, y + 1
    return out


def _rising(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The longest sequence of lines unique in both that rises in both."""
    once_a, once_b = ({x for x, n in Counter(s).items() if n == 1} for s in (a, b))
    at = {x: j for j, x in enumerate(b) if x in once_b}
    pairs = [(i, at[x]) for i, x in enumerate(a) if x in once_a and x in at]
    ends, tops, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        back.append(tops[n - 1] if n else -1)
        if n == len(ends):
            ends.append(j), tops.append(k)
        else:
            ends[n], tops[n] = j, k
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def unified(path: str, a: list[str], b: list[str], edits: list[tuple[int, int, int, int]]) -> list[str]:
    """The rows of a unified diff with three lines of context."""
    codes, i, j = [], 0, 0
    for i1, i2, j1, j2 in edits:
        if i < i1:
            codes.append(("equal", i, i1, j, j1))
        codes.append(("replace" if i1 < i2 and j1 < j2 else "delete" if i1 < i2 else "insert", i1, i2, j1, j2))
        i, j = i2, j2
    if i < len(a):
        codes.append(("equal", i, len(a), j, len(b)))
    matcher = difflib.SequenceMatcher(None, "", "")
    matcher.opcodes = codes
    place = lambda lo, hi: f"{lo + 1}" if hi - lo == 1 else f"{lo + (hi > lo)},{hi - lo}"
    out = [f"--- a/{path}", f"+++ b/{path}"] if edits else []
    for group in matcher.get_grouped_opcodes(3) if edits else ():
        out.append(f"@@ -{place(group[0][1], group[-1][2])} +{place(group[0][3], group[-1][4])} @@")
        for tag, i1, i2, j1, j2 in group:
            if tag == "equal":
                out += [f" {x}" for x in a[i1:i2]]
            else:
                out += [f"-{x}" for x in a[i1:i2]] + [f"+{x}" for x in b[j1:j2]]
    return out


def cuts_of(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, cuts: an array of (i, j), places from 0 of lines that are equal and cross no other. pairs: key..., old, new (arrays of lines)."""
    side = lambda c, s: pairs.select(*key, F.posexplode(c).alias("at", "line"), F.lit(s).alias("side"))
    both = side("old", 0).unionByName(side("new", 1))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("at"))).cast("long")
    many = lambda s: F.count_if(F.col("side") == s)
    digest = F.unhex(F.sha2("line", 256)).alias("line")
    once = both.select(*key, "at", "side", digest).groupBy(*key, "line").agg(of(0).alias("i"), of(1).alias("j"), many(0).alias("n0"), many(1).alias("n1")).where("n0 = 1 AND n1 = 1")
    anchors = kept(once.select(*key, "i", "j", F.lit(1).alias("one")), "anchors")
    by_old = running(running(in_order(anchors, *key, "i"), tuple(key), "one", "rank", F.sum), tuple(key), "j", "top", F.max)
    by_new = running(in_order(anchors, *key, "j"), tuple(key), "one", "place", F.sum)
    # Nothing before it lies behind it: it is the greatest so far, and as many are smaller as come before.
    clean = by_old.where("top = j").select(*key, "i", "j", "rank").join(by_new.select(*key, "i", "place"), [*key, "i"]).where("rank = place")
    thin = clean.groupBy(*key, F.floor(F.col("i") / BLOCK).alias("block")).agg(F.min(F.struct("i", "j")).alias("cut"))
    return thin.groupBy(*key).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))  # one for each BLOCK lines of a file that is a row itself


def large_edits(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, edits: the changes of each pair; every part is compared by itself."""
    none = F.array().cast("array<struct<i: bigint, j: bigint>>")
    cut = pairs.join(cuts_of(pairs, key), key, "left").withColumn("cuts", F.coalesce("cuts", none))
    first = F.array(F.struct(F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
    last = F.array(F.struct(F.size("old").cast("long").alias("i"), F.size("new").cast("long").alias("j")))
    spans = F.arrays_zip(F.concat(first, "cuts").alias("lo"), F.concat("cuts", last).alias("hi"))
    each = cut.select(*key, "old", "new", F.explode(spans).alias("s"))
    piece = lambda c, k: F.slice(c, (F.col(f"s.lo.{k}") + 2).cast("int"), (F.col(f"s.hi.{k}") - F.col(f"s.lo.{k}") - 1).cast("int"))
    parts = each.select(*key, (F.col("s.lo.i") + 1).alias("ai"), (F.col("s.lo.j") + 1).alias("bi"), piece("old", "i").alias("a"), piece("new", "j").alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    n = len(key)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("i1", "i2", "j1", "j2")]))
        for batch in batches:
            found = [[dict(zip(("i1", "i2", "j1", "j2"), e)) for e in changes(a.as_py(), b.as_py(), ai.as_py(), bi.as_py())] for ai, bi, a, b in zip(*batch.columns[n:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, kind)], [*key, "edits"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", edits array<struct<i1: bigint, i2: bigint, j1: bigint, j2: bigint>>"
    dealt = parts.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "ai", "bi")
    return dealt.mapInArrow(compared, schema).groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("edits"))).alias("edits"))

