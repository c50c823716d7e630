"""Exact deduplication by deterministic block naming.

A text is cut into blocks of BLOCK bytes. Equal blocks get one integer name: the least
block number at which that content occurs, found by grouping the sorted block contents.
Then adjacent pairs of names are named the same way, again and again, until each document
has a single name. Names come from comparing contents, never from hashes, so two
documents have the same (number of blocks, name) exactly if their texts are equal.

Cost: block contents are shuffled twice (to name them, and to take the names back);
every later level moves integers of the documents that have more than one block.
Copies are pre-aggregated before the first shuffle, and a hot block on the other side
of the join is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, fresh, numbered, written

BLOCK = 4096


def normalised(text: Column) -> Column:
    """null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", " ")


def _named(segments: DataFrame, content: list[str]) -> DataFrame:
    """segments with `name`: the least `loc` among those with equal content."""
    names = segments.groupBy(*content).agg(F.min("loc").alias("name"))
    return segments.join(names, content).drop(*content)


def document_names(docs: DataFrame, text: Column, block: int = BLOCK, row: Column | None = None) -> DataFrame:
    """(_row, doc_id, text_sha256, n_blocks, name), one row per row of docs.

    row: the number of each row, made here by default. docs must be a scan or a written table, so that its rows keep their numbers when a task runs again.
    """
    body = F.col("_body")
    count = F.greatest(F.lit(1), F.ceil(F.length(body) / F.lit(block))).cast("int")
    cut = docs.select((F.monotonically_increasing_id() if row is None else row).alias("_row"), "doc_id", text.cast("binary").alias("_body")).select(
        "_row", "doc_id", F.sha2(body, 256).alias("_sha"), count.alias("n_blocks"),
        F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(body, i * block + 1, F.lit(block)))).alias("pos", "block"),
    ).select(
        "_row", F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("pos") == 0, F.col("_sha")).alias("text_sha256"),
        "n_blocks", "pos", "block", F.monotonically_increasing_id().alias("loc"),
    )
    level = written(_named(cut, ["block"]), "block-names")
    first = level.where("pos = 0").select("_row", "doc_id", "text_sha256", "n_blocks", "name")
    done = [first.where("n_blocks = 1")]
    heads = first.where("n_blocks > 1").drop("name")
    level = level.where("n_blocks > 1").select("_row", "pos", "loc", "name", F.col("n_blocks").alias("left"))
    longest = level.agg(F.max("left")).first()[0] or 1
    while longest > 1:
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("_row", (F.col("pos") / 2).cast("int").alias("half")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.min("loc").alias("loc"), F.max("left").alias("left"),
        ).select("_row", F.col("half").alias("pos"), "loc", F.ceil(F.col("left") / 2).cast("int").alias("left"), "a", "b")
        level = written(_named(pairs, ["a", "b"]), "pair-names")
        done.append(heads.join(level.where("left = 1").select("_row", "name"), "_row"))
        level = level.where("left > 1")
        longest = (longest + 1) // 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, text: Column | None = None, block: int = BLOCK, row: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    text: the column to compare, by default `text` with white space normalised. Null texts equal
    empty ones. Of equal texts the row with the least doc_id stays (null ids come last; of rows
    that repeat an id, one stays). An empty table gives an empty result; other columns are not read.
    """
    named = written(document_names(docs, normalised(F.col("text")) if text is None else text, block, row), "document-names")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("_row"))
    groups = named.groupBy("n_blocks", "name").agg(F.min(order).alias("keep"), F.count("*").alias("group_size"))
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep._row") == F.col("_row")).alias("kept"), "text_sha256", "_row",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat an earlier text; all columns stay. Null texts are empty ones; of rows that repeat an id and a text one stays; an empty table stays empty."""
    number, found = fresh(docs, "number"), fresh(docs, "gone")
    docs = numbered(docs, number)
    gone = exact_dedup(docs, row=F.col(number)).where(~F.col("kept")).select(F.col("_row").alias(found))
    return docs.join(gone, F.col(number) == F.col(found), "left_anti").drop(number)
