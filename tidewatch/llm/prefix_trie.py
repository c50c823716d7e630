"""Conversation prefix trie: shared beginnings of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. Turns are SHA-256 digests of role and text; the name of a prefix is the exclusive or of
128-bit hashes of its (place, digest) pairs, so it is a running sum that can be made in blocks. Names are checked: all members of a node
must have the same last digest and the same parent name, else the job fails. A node is (its smallest member, its depth).

Subtree sums go by centroids. A node's weight is the number of turns that its members have from it on, which one aggregation gives; the
deepest node with over half of its component's weight is the centroid. Its part of the component is added up, once, and that total is
added to the centroid and to the nodes on the path from it to the component's top; then the centroid is taken out and its children's
subtrees and the rest are components of their own. Each turn halves the weights, so a chain of any length takes few turns.
Components of over `LIMIT` nodes are split by joins over all of them at once; what is smaller is finished in a task, many at a time, by the same method.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Nodes of a component that one task may finish; depths of a block of a running sum; ids of a piece of a digest's text (a power of two).
LIMIT, BLOCK, IDS = 4096, 4096, 256
#: Conversations from which others take their first turns, and how many they may take.
EVERY, MOST = 5, 8


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df as a written table sorted by keys over all partitions, whose numbers `_at` rise in that order."""
    spark = df.sparkSession
    return written(df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and bytes of each turn. No conversation is in one task: a turn's place is its rank in the sorted part plus what the parts before hold."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = written(conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("_row")), "turns")
    rows = in_order(turns, "conv_id", "turn", "digest", "_row").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy("conv_id", "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv_id", "_part", (1 - F.col("_from") + F.coalesce(before, F.lit(0))).alias("_shift"))
    return written(rows.join(runs, ["conv_id", "_part"]).select("conv_id", (F.col("_at") + F.col("_shift")).alias("place"), "digest", "bytes"), "places")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv, len) and their turns (conv, depth, digest, bytes, len): the first h turns of another, then their own after the first h."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST + 1))
    convs = counts.select("conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    own = turns.join(convs, "conv_id").where("place > h").select(F.col("conv_id").alias("conv"), (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "digest", "bytes", "len")
    first = turns.where(F.col("place") <= MOST).withColumnRenamed("conv_id", "base")
    shared = convs.join(first, "base").where("place <= h").select(F.col("conv_id").alias("conv"), F.col("place").alias("depth"), "digest", "bytes", "len")
    return convs.select(F.col("conv_id").alias("conv"), "len"), own.unionByName(shared)


def named(rows: DataFrame) -> DataFrame:
    """rows with the names a, b of their prefix and pa, pb of the one before, by running exclusive ors within blocks of depths."""
    rows = rows.withColumns({"ta": F.xxhash64(F.lit(1), "depth", "digest"), "tb": F.xxhash64(F.lit(2), "depth", "digest"), "block": F.floor(F.col("depth") / BLOCK)})
    rows = written(rows, "terms")
    blocks = rows.groupBy("conv", "block").agg(F.expr("bit_xor(ta)").alias("xa"), F.expr("bit_xor(tb)").alias("xb"))
    past = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *(F.coalesce(F.expr(f"bit_xor(x{c})").over(past), F.lit(0)).alias(f"x{c}") for c in "ab"))
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.join(blocks, ["conv", "block"]).select("*", *(F.expr(f"bit_xor(t{c})").over(upto).bitwiseXOR(F.col(f"x{c}")).alias(c) for c in "ab"))
    return written(run.select("conv", "depth", "len", "digest", "bytes", "a", "b", *(F.col(c).bitwiseXOR(F.col(f"t{c}")).alias(f"p{c}") for c in "ab")), "prefixes")


def nodes_of(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The trie: m (smallest member), depth, pm (the parent's), n_convs, n_children, weight, bytes, names a and b."""
    same = reduce(Column.__and__, (F.min(c) == F.max(c) for c in ("digest", "pa", "pb")))
    found = rows.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("m"), F.count("*").alias("n_convs"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"), F.max("bytes").alias("bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("two prefixes have one name"))).alias("same"))
    top = convs.agg(F.min("conv").alias("m"), F.count("*").alias("n_convs"), F.sum(F.col("len") + 1).alias("weight")).where("m IS NOT NULL")
    top = top.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "m", "n_convs", "weight", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), F.lit(True).alias("same"))
    found = written(found.select(top.columns).unionByName(top).where("same"), "names")
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("m").alias("pm"))
    found = written(found.join(parents, ["depth", "pa", "pb"], "left").select("m", "depth", "pm", "n_convs", "weight", "bytes", "a", "b"), "parents")
    children = found.where("depth > 0").groupBy(F.col("pm").alias("m"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    return written(found.join(children, ["m", "depth"], "left").na.fill(0, ["n_children"]), "nodes")


def digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256 of the nodes at which conversations end.

    Ids are sorted over all partitions and joined in pieces of `IDS`. SHA-256 has to read a node's pieces one after another: they stream, sorted, through the node's task, which holds none of them.
    """
    zero = F.lit(0).cast("long")
    ends = rows.where("len = depth").select("depth", "a", "b", "conv").unionByName(convs.where("len = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv"))
    ends = in_order(ends, "depth", "a", "b", "conv").withColumn("piece", F.shiftright("_at", IDS.bit_length() - 1))
    pieces = ends.groupBy("depth", "a", "b", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    spark = rows.sparkSession
    dealt = pieces.repartition(partitions(spark), "depth", "a", "b").sortWithinPartitions("depth", "a", "b", "piece").select("depth", "a", "b", "ids")
    return dealt.mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, sha = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key == of:
                sha.update(b",")
            else:
                if of:
                    done.append((*of, sha.hexdigest()))
                of, sha = key, hashlib.sha256()
            sha.update(ids.encode())
        yield _digest_rows(done)
    if of:
        yield _digest_rows([(*of, sha.hexdigest())])


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.string(),), strict=True)], names=["depth", "a", "b", "ends_sha256"])


def roll_up(nodes: DataFrame, rows: DataFrame, convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """m, depth, n_leaves and saved_tokens of each node's subtree."""
    own = nodes.select("m", "depth", "pm", "weight", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    top = nodes.where("depth = 0").select(F.col("m").alias("cm")).first()
    active = own.select("*", F.lit(top.cm if top else 0).cast("long").alias("cm"), F.lit(0).cast("long").alias("cd"))
    known, left, parts = None, [], []
    while True:
        sizes = written(active.groupBy("cm", "cd").agg(F.count("*").alias("n"), F.max("weight").alias("total")), "sizes")
        if sizes.where(F.col("n") > limit).isEmpty():
            left.append(active)
            break
        if known is None:
            known = _ways(nodes, rows, convs)
        sized = active.join(sizes, ["cm", "cd"])
        left.append(sized.where(F.col("n") <= limit).select(active.columns))
        active, sums = _split(sized.where(F.col("n") > limit), known)
        parts.append(sums)
    small = reduce(DataFrame.unionByName, left)
    n = partitions(nodes.sparkSession)
    parts.append(small.repartition(n, "cm", "cd").sortWithinPartitions("cm", "cd", "depth").select("cm", "cd", "m", "depth", "pm", "weight", "leaves", "saved").mapInArrow(_finished, "m long, depth long, leaves long, saved long"))
    return reduce(DataFrame.unionByName, parts).groupBy("m", "depth").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _ways(nodes: DataFrame, rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth, block, and m and pm of the node that the conversation passes there."""
    at = rows.select("conv", "depth", "a", "b").join(nodes.select("depth", "a", "b", "m", "pm"), ["depth", "a", "b"])
    top = convs.crossJoin(F.broadcast(nodes.where("depth = 0").select("depth", "m", "pm")))  # the one root
    both = at.select("conv", "depth", "m", "pm").unionByName(top.select("conv", "depth", "m", "pm"))
    return written(both.withColumn("block", F.floor(F.col("depth") / BLOCK)), "ways")


def _split(active: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes the centroid out of each component: the nodes left with their components, and what is added to the centroids and the nodes above them."""
    heavy = active.where(2 * F.col("weight") > F.col("total")).groupBy("cm", "cd").agg(F.max(F.struct("depth", "m", "weight")).alias("z"))
    centroids = written(heavy.select("cm", "cd", F.col("z.depth").alias("zd"), F.col("z.m").alias("zm"), F.col("z.weight").alias("zw")), "centroids")
    # The path to the top is the centroid's own conversation, from the top's depth on.
    spans = centroids.where("zd > cd").withColumn("block", F.explode(F.sequence(F.floor(F.col("cd") / BLOCK), F.floor((F.col("zd") - 1) / BLOCK))))
    path = spans.join(ways.select(F.col("conv").alias("zm"), "block", "depth", "m"), ["zm", "block"]).where("depth >= cd AND depth < zd")
    path = written(path.select("cm", "cd", "m", "depth", "zw"), "path")
    # A node is below the centroid if its own conversation passes it; the node after it is the new top.
    after = ways.select(F.col("conv").alias("m"), (F.col("depth") - 1).alias("zd"), F.col("m").alias("new"), F.col("pm").alias("via"))
    placed = active.join(centroids, ["cm", "cd"]).join(after, ["m", "zd"], "left")
    below = F.coalesce((F.col("depth") > F.col("zd")) & (F.col("via") == F.col("zm")), F.lit(False))
    placed = placed.select("cm", "cd", "m", "depth", "pm", "weight", "leaves", "saved", "zd", "new", below.alias("below"), ((F.col("m") == F.col("zm")) & (F.col("depth") == F.col("zd"))).alias("centre"))
    placed = written(placed, "placed")
    totals = placed.where("below OR centre").groupBy("cm", "cd").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    gets = path.select("cm", "cd", "m", "depth").unionByName(centroids.select("cm", "cd", F.col("zm").alias("m"), F.col("zd").alias("depth")))
    sums = written(gets.join(totals, ["cm", "cd"]).select("m", "depth", "leaves", "saved"), "sums")
    lighter = placed.where("NOT centre").join(path.select("m", "depth", "zw"), ["m", "depth"], "left")
    rest = lighter.select(
        "m", "depth", "pm", (F.col("weight") - F.coalesce("zw", F.lit(0))).alias("weight"), "leaves", "saved",
        F.when(F.col("below"), F.col("new")).otherwise(F.col("cm")).alias("cm"), F.when(F.col("below"), F.col("zd") + 1).otherwise(F.col("cd")).alias("cd"),
    )
    return written(rest, "active"), sums


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of whole components, which come sorted; the last one of a batch waits for the next."""
    rest = None
    for batch in batches:
        rows = np.array([c.to_numpy(zero_copy_only=False) if c.null_count == 0 else c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns], np.int64)
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        if not rows.shape[1]:
            continue
        ends = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
        cut = ends[-1] + 1 if len(ends) else 0
        rest = rows[:, cut:]
        if cut:
            yield _sums(rows[:, :cut])
    if rest is not None and rest.shape[1]:
        yield _sums(rest)


def _sums(rows: np.ndarray) -> pa.RecordBatch:
    cm, cd, m, depth, pm, weight, leaves, saved = rows
    comp = np.cumsum(np.r_[0, ((cm[1:] != cm[:-1]) | (cd[1:] != cd[:-1])).astype(np.int64)])
    ids, rank = np.unique(m, return_inverse=True)
    rel, span = depth - cd, int((depth - cd).max()) + 1
    key = (comp * span + rel) * len(ids) + rank
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(ids, pm), len(ids) - 1)
    up = (comp * span + rel - 1) * len(ids) + at
    place = np.minimum(np.searchsorted(key[order], up), len(key) - 1)
    parent = np.where((rel > 0) & (ids[at] == pm) & (key[order][place] == up), order[place], -1)
    got = subtree_sums(parent, rel, comp, weight, np.stack([leaves, saved]))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (m, depth, *got)], names=["m", "depth", "leaves", "saved"])


def subtree_sums(parent: np.ndarray, depth: np.ndarray, comp: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over the subtrees of a forest, by centroids of all components at once. parent: -1 at tops; weight: of whole subtrees."""
    n = len(parent)
    order = np.argsort(depth, kind="stable")
    size, start, base = [1] * n, [0] * n, 0
    above = parent.tolist()
    for i in order[::-1].tolist():
        if above[i] >= 0:
            size[above[i]] += size[i]
    free = [0] * n  # the first place of the next child
    for i in order.tolist():
        p = above[i]
        if p < 0:
            start[i], base = base, base + size[i]
        else:
            start[i] = free[p]
            free[p] += size[i]
        free[i] = start[i] + 1
    first, size = np.array(start), np.array(size)
    tops = np.flatnonzero(parent < 0)
    at = np.empty(comp.max() + 1, np.int64)
    at[comp[tops]] = tops
    label, weight, alive, out = at[comp], weight.copy(), np.ones(n, bool), np.zeros_like(values)
    while alive.any():
        heavy = order[(alive & (2 * weight > weight[label]))[order]]
        centre = np.full(n, -1)
        centre[label[heavy]] = heavy  # the deepest comes last
        live = np.flatnonzero(alive)
        z = centre[label[live]]
        inside = (first[live] >= first[z]) & (first[live] < first[z] + size[z])
        zs = np.unique(z)
        total = np.zeros_like(values)
        for k, v in enumerate(values):
            np.add.at(total[k], z[inside], v[live[inside]])
        out[:, zs] += total[:, zs]
        on, cur = zs, parent[zs]
        while True:  # up all paths at once
            go = (cur >= 0) & (label[cur] == label[on]) & alive[cur]
            on, cur = on[go], cur[go]
            if not len(on):
                break
            out[:, cur] += total[:, on]
            weight[cur] -= weight[on]
            cur = parent[cur]
        below = live[inside & (live != z)]
        heads = live[(parent[live] >= 0) & (parent[live] == z)]
        heads = heads[np.argsort(label[heads] * (n + 1) + first[heads])]
        if len(below):
            found = np.searchsorted(label[heads] * (n + 1) + first[heads], label[below] * (n + 1) + first[below], side="right") - 1
            label[below] = heads[found]
        alive[zs] = False
    return out


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), ties by the SHA-256 of role and text, so repeated rows are turns of their own. A null role or text is
    empty. Rows without a conv_id belong to no conversation and are left out. A conversation that gets no turns is a member of the root only.
    An empty table has no root and gives no rows.
    """
    convs, rows = rebuilt(turns_of(conversations))
    rows = named(rows)
    nodes = nodes_of(convs, rows)
    sums = roll_up(nodes, rows, convs, limit)
    ends = digests(rows, convs)
    none = F.lit(hashlib.sha256().hexdigest())
    return nodes.join(sums, ["m", "depth"]).join(ends, ["depth", "a", "b"], "left").select(
        F.col("m").alias("conv_id"), "depth", F.col("pm").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
