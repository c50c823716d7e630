"""Filter interaction audit: what each filter removes in every order in which five filters can be applied.

A document is known by the set of filters that it fails, its mask. With M[mask, filter] = 0 where the filter fails and infinity where
it passes, and P[filter, order] the filter's place in an order (the inverse permutation), the min-plus product of M and P is the step at
which a document is removed, for all masks and orders at once. Counts by mask, all documents or those with a label, are then added up
at those steps: removed, kept, redundant (failing, but gone before), and each filter's removals over all orders.

On Spark: masks are expressions on the whole text; equal texts meet as digests; documents are counted by part and mask before anything
moves, so a part of any size ends as 32 counts, and one row per part enters the small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, written

FILTERS = "ABCDE"
#: The conditions of the registered audit.
LEAST_WORDS, DISTINCT_SHARE, UPPER_SHARE, MARKS = 50, 65, 5, "[#$%&*|]"
#: Parts that enter the matrices together: their rows are made in memory.
AT_ONCE = 64
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column, words: Column) -> list[Column]:
    """The failure conditions of A to D; E asks for other documents."""
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_SHARE * F.length(text),
        text.rlike(MARKS),
    ]


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit i: fails the i-th filter) of each document."""
    base = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("words", F.filter(F.split("text", BLANK + "+"), lambda w: w != ""))
    own = sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("text"), F.col("words"))))
    known = written(base.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    # Texts are equal if their SHA-256 are. Only those that occur again are joined to their smallest id.
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return known.join(first, "digest", "left").select("doc_id", "part", F.when(later, F.col("own") + 16).otherwise(F.col("own")).alias("mask"))


def removal_steps() -> tuple[np.ndarray, np.ndarray]:
    """fails[mask, filter], and the step from 1 at which a mask is removed in each order, by the min-plus product; infinity if never."""
    n = len(FILTERS)
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1 == 1
    orders = np.array(list(permutations(range(n))))
    places = np.argsort(orders, axis=1).T + 1.0  # filter x order: the inverse permutations
    cost = np.where(fails, 0.0, np.inf)
    return fails, (cost[:, :, None] + places[None, :, :]).min(axis=1)


def audit_rows(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of the report for parts x masks counts, each of shape parts x orders x steps."""
    fails, gone = removal_steps()
    orders = np.array(list(permutations(range(len(FILTERS)))))
    steps = np.arange(1, len(FILTERS) + 1)
    at = gone[:, :, None] == steps  # masks x orders x steps
    before = gone[:, :, None] < steps
    of = lambda weights, where: np.tensordot(weights, where.astype(np.int64), 1)
    removed = of(counts, at)
    each = np.stack([removed[:, orders == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return {
        "kept": of(counts, ~(at | before)), "removed": removed, "redundant": of(counts, before & fails[:, orders]), "unique_fails": counts[:, 1 << orders],
        "good_lost": of(good, at), "toxic_lost": of(toxic, at), "shapley": each[:, orders],
    }


def _reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["".join(o) for o in permutations(FILTERS)]
    for batch in batches:
        for i in range(0, len(batch), AT_ONCE):
            some = batch.iloc[i : i + AT_ONCE]
            sums = np.zeros((3, len(some), 1 << len(FILTERS)), np.int64)
            for k, cells in enumerate(some["cells"]):
                for c in cells:
                    sums[:, k, c["mask"]] = c["n"], c["good"], c["toxic"]
            rows = audit_rows(*sums)
            shape = rows["kept"].shape
            yield pd.DataFrame(
                {"part": np.repeat(some["part"].to_numpy(), shape[1] * shape[2]), "filter_order": np.tile(np.repeat(names, shape[2]), shape[0]), "step": np.tile(np.arange(1, shape[2] + 1, dtype=np.int32), shape[0] * shape[1])}
                | {k: v.ravel() for k, v in rows.items()}
            )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step.

    A null text is empty, a null source the part ''. An empty text fails A only, and E if a smaller id is empty too. Rows that repeat
    count each; equal ids are not smaller than each other, and a null id neither has a smaller one nor is one. A document has a label if any
    row of labels with its id says 1. An empty table gives no rows.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")))
    known = masks(docs).join(said, "doc_id", "left")
    cells = known.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return parts.mapInPandas(_reports, SCHEMA)
