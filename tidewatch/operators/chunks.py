"""Chunks of files under a token limit, in order of priority and path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import priority, skipped, token_estimate
from .ranges import in_order, kept, last_before, running_sum, split_by_size

#: Files of a release that one row may list.
MANY = 10_000


def chunk_files(files: DataFrame, key: str, limit: int = C.CHUNK_TOKENS, skip: bool = True, few: int = MANY) -> DataFrame:
    """key, path, tokens, chunk_index (from 0): a file starts a new chunk when the current one is not empty and would exceed the limit.

    files: key, path, content or tokens. Files of one release are ordered by priority, then path. The running total starts anew with each
    chunk, which a window cannot do. Releases of up to `few` files are folded, each one's list of sizes in a row; larger ones go by jump pointers.
    """
    sized = files if "tokens" in files.columns else files.withColumn("tokens", token_estimate(F.col("content")))
    if skip:
        sized = sized.where(~skipped(F.col("path")))
    sized = sized.select(key, priority(F.col("path")).alias("place"), "path", F.col("tokens").cast("long").alias("tokens"))
    small, large = split_by_size(sized.na.fill(0, ["tokens"]), (key,), few)
    folded = _folded(small, key, limit)
    return folded if large is None else folded.unionByName(_jumped(large, key, limit))


def _folded(sized: DataFrame, key: str, limit: int) -> DataFrame:
    listed = sized.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "path", "tokens"))).alias("files"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(a, f):  # only the places where chunks start are kept
        fresh = (a["total"] > 0) & (a["total"] + f["tokens"] > limit)
        return F.struct((F.when(fresh, F.lit(0)).otherwise(a["total"]) + f["tokens"]).alias("total"), (a["at"] + 1).alias("at"), F.when(fresh, F.array_append(a["starts"], a["at"])).otherwise(a["starts"]).alias("starts"))

    folded = listed.select(key, "files", F.aggregate("files", start, step, lambda a: a["starts"]).alias("starts"))
    each = folded.select(key, "starts", F.posexplode("files").alias("at", "f"))
    return each.select(key, "f.path", "f.tokens", F.size(F.filter("starts", lambda s: s <= F.col("at"))).alias("chunk_index"))


def _jumped(sized: DataFrame, key: str, limit: int) -> DataFrame:
    """The same for releases of any size: each file points to the first file of the next chunk, were it the first of one; from the release's first file on, those that are pointed to start chunks.

    The next chunk begins at the first file whose prefix sum is over this one's plus the limit, found by sorting sums and searched values together.
    Which files are reached is marked by doubled pointers, the farthest first, so that chunks take as many joins as their number has binary digits.
    """
    rows = in_order(sized, key, "place", "path", "tokens")
    sums = kept(running_sum(rows, (key,), "tokens", "upto").select(key, "path", "tokens", "_at", "_range", "upto"), "sums")
    # In falling order the file met last before a searched value is the first one over it.
    none = F.lit(None).cast("long")
    seek = lambda kind, value: sums.select(key, value.alias("value"), F.lit(kind).alias("kind"), "_at").select(key, "value", "kind", F.col("_at").alias("mine"), none.alias("target"))
    targets = sums.select(key, F.col("upto").alias("value"), F.lit(2).alias("kind"), none.alias("mine"), F.struct("_at", "upto").alias("t")).select(key, "value", "kind", "mine", F.col("t")["_at"].alias("target"))
    base = F.col("upto") - F.col("tokens")
    # Of equal sums the first file counts, and a sum that equals the searched value does not: falling, searched values come before it.
    found = in_order(targets.unionByName(seek(0, base + limit)).unionByName(seek(1, base)), key, F.desc("value"), F.asc("kind"), F.desc("target"))
    found = last_before(found, (key,), "target", "next").where("kind < 2")
    # A chunk that is empty so far takes any file: the next one starts after the first file with tokens.
    both = found.groupBy(key, "mine").agg(F.max(F.when(F.col("kind") == 0, F.col("next"))).alias("over"), F.max(F.when(F.col("kind") == 1, F.col("next"))).alias("filled"))
    after = last_before(in_order(sums.select(key, "_at", F.col("_at").alias("follower")).withColumnRenamed("_at", "file"), key, F.desc("file")), (key,), "follower", "then").select(key, F.col("file").alias("filled"), "then")
    jumps = both.join(after, [key, "filled"], "left").select(key, F.col("mine").alias("file"), F.when(F.col("over") > F.col("filled"), F.col("over")).when(F.col("over").isNotNull(), F.col("then")).alias("next"))
    levels = [kept(jumps.where("next IS NOT NULL"), "jumps-0")]
    while True:
        far = levels[-1].alias("a").join(levels[-1].select(key, F.col("file").alias("next"), F.col("next").alias("far")), [key, "next"]).select(key, "file", F.col("far").alias("next"))
        far = kept(far, f"jumps-{len(levels)}")
        if far.isEmpty():
            break
        levels.append(far)
    marks = kept(sums.groupBy(key).agg(F.min("_at").alias("file")), "marks")
    for level in reversed(levels):
        marks = kept(marks.unionByName(level.join(marks, [key, "file"], "left_semi").select(key, F.col("next").alias("file"))), "marks")
    marked = sums.join(marks.select(key, F.col("file").alias("_at"), F.lit(1).alias("start")), [key, "_at"], "left").na.fill(0, ["start"])
    return running_sum(marked, (key,), "start", "n").select(key, "path", "tokens", (F.col("n") - 1).cast("int").alias("chunk_index"))


def rendered(files: DataFrame, key: str = "release_id") -> DataFrame:
    """key, chunk_index, text: the text of each chunk. files: key, chunk_index, path, content, is_binary, priority order in `place`.

    A binary file is named only; the others follow their path. Empty lines stand between files. A chunk is as large as its token limit lets it be.
    """
    part = F.when(F.col("is_binary"), F.concat(F.lit("[Binary file: "), "path", F.lit("]"))).otherwise(F.concat(F.lit("--- "), "path", F.lit("\n"), F.coalesce("content", F.lit(""))))
    return files.groupBy(key, "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("text"))
