"""Lines of files and diffs."""

from __future__ import annotations

import difflib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of
from .large_diffs import large_edits, unified
from .ranges import kept

#: Characters of both versions of a file up to which they are compared as a whole.
LONG = 400_000


def file_lines(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """One row per line: the columns `keep`, line_no from 1, line."""
    return files.select(*keep, F.posexplode(lines_of(F.col(content))).alias("_at", "line")).select(*keep, (F.col("_at") + 1).alias("line_no"), "line")


def rows_of(content: Column) -> Column:
    """The lines of a text with their places: an array of (seq, raw)."""
    return F.transform(lines_of(content), lambda x, i: F.struct((i + 1).alias("seq"), x.alias("raw")))


def hunks_of(rows: Column) -> Column:
    """(start, first, end) of the part before the first hunk and of each hunk: the place of its header, the number of its first line, the place after its last."""
    heads = F.filter(rows, lambda r: r["raw"].rlike(r"^@@.*?\+\d"))
    starts = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(1).cast("long").alias("first"))), F.transform(heads, lambda h: F.struct(h["seq"].alias("start"), F.regexp_extract(h["raw"], r"\+(\d+)", 1).cast("long").alias("first"))))
    ends = F.concat(F.transform(heads, lambda h: h["seq"]), F.array(F.size(rows) + 1))
    return F.zip_with(starts, ends, lambda a, end: F.struct(a["start"].alias("start"), a["first"].alias("first"), end.alias("end")))


def added_of(rows: Column, hunks: Column) -> Column:
    """The added lines of one unified diff with their numbers in the new file: an array of (seq, line_number, line), made within the row.

    rows and hunks must be columns of a table. A hunk header's first number after + sets the line counter; a header without one changes
    nothing. Before the first hunk, lines that start with +++ are headers; inside hunks they are added lines whose text starts with ++.
    """

    def of(h):
        body = F.filter(F.slice(rows, h["start"] + 1, h["end"] - h["start"] - 1), lambda r: ~r["raw"].startswith("-") & ~r["raw"].startswith("@@"))
        numbered = F.transform(body, lambda r, i: F.struct(r["seq"].alias("seq"), (h["first"] + i).alias("line_number"), r["raw"].alias("raw")))
        added = F.filter(numbered, lambda r: r["raw"].startswith("+") & ((h["start"] > 0) | ~r["raw"].startswith("+++")))
        return F.transform(added, lambda r: F.struct(r["seq"].alias("seq"), r["line_number"].alias("line_number"), F.substring(r["raw"], 2, 2147483647).alias("line")))

    # the part before the first hunk starts at place 0, its first line is row 1
    return F.flatten(F.transform(hunks, lambda h: of(h)))


def added_lines(diffs: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """keep..., seq, line_number, line: the rows of added_of. No shuffle."""
    return added_files(diffs, content, keep).select(*keep, F.inline("added"))


def added_files(diffs: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """keep..., added, numbers, lines: the added lines of each diff as arrays, ready for the scanners of whole texts."""
    found = diffs.select(*keep, rows_of(F.col(content)).alias("_rows")).select(*keep, "_rows", hunks_of(F.col("_rows")).alias("_hunks"))
    found = found.select(*keep, added_of(F.col("_rows"), F.col("_hunks")).alias("added"))
    return found.select(*keep, "added", F.transform("added", lambda x: x["line_number"]).alias("numbers"), F.transform("added", lambda x: x["line"]).alias("lines"))


def line_diff(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Multiset difference of the lines of old and new versions: key..., line, added, removed (how often).

    old and new: key..., line. Order within a file does not matter here. Equal lines are counted before the join.
    """
    a = old.groupBy(*key, "line").agg(F.count("*").alias("n_old"))
    b = new.groupBy(*key, "line").agg(F.count("*").alias("n_new"))
    both = a.join(b, [*key, "line"], "full_outer")
    n_old, n_new = F.coalesce("n_old", F.lit(0)), F.coalesce("n_new", F.lit(0))
    return both.select(*key, "line", F.greatest(n_new - n_old, F.lit(0)).alias("added"), F.greatest(n_old - n_new, F.lit(0)).alias("removed")).where("added > 0 or removed > 0")


def unified_diffs(old_files: DataFrame, new_files: DataFrame, release: str = "release_id") -> DataFrame:
    """The files that differ between two versions: release, path, content (unified diff), lines_added, lines_removed, is_binary, is_new, is_deleted.

    old_files, new_files: release, path, content, is_binary. Files are matched by a full outer join on their paths; equal ones are
    left out there, so only changed texts reach Python's difflib, one file after another in tasks that Spark deals out. New and deleted files are compared with
    nothing; binary ones have no text and no lines. Header lines and marks are those of the usual form, three lines of context. Pairs of more than
    `LONG` characters are cut at lines that both have and compared in parts (large_diffs).
    """
    o = old_files.select(release, "path", F.col("content").alias("old"), F.col("is_binary").alias("old_binary"), F.lit(True).alias("had"))
    n = new_files.select(release, "path", F.col("content").alias("new"), F.col("is_binary").alias("new_binary"), F.lit(True).alias("has"))
    pair = o.join(n, [release, "path"], "full_outer").withColumn("is_binary", F.coalesce("new_binary", "old_binary", F.lit(False)))
    pair = pair.withColumn("is_new", F.col("had").isNull()).withColumn("is_deleted", F.col("has").isNull())
    pair = pair.where(F.col("is_new") | F.col("is_deleted") | F.col("is_binary") | ~F.col("old").eqNullSafe(F.col("new")))
    keep = [release, "path", "is_binary", "is_new", "is_deleted"]
    text = lambda c: F.when(F.col("is_binary"), "").otherwise(F.coalesce(c, F.lit("")))
    kinds = {f.name: f.dataType.simpleString() for f in pair.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", content string, lines_added long, lines_removed long"

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, added, removed = [], [], []
            for path, old, new, edits in zip(batch.column(1).to_pylist(), *batch.columns[5:8]):
                a, b = (io.StringIO(x.as_py(), newline=None).readlines() for x in (old, new))
                if edits.is_valid:
                    edits = [(e["i1"], e["i2"], e["j1"], e["j2"]) for e in edits.as_py()]
                    rows = [r.rstrip("\n") for r in unified(path, a, b, edits)]
                else:
                    rows = [r.rstrip("\n") for r in difflib.unified_diff(a, b, f"a/{path}", f"b/{path}", lineterm="")]
                texts.append("\n".join(rows))
                added.append(sum(r.startswith("+") for r in rows[2:])), removed.append(sum(r.startswith("-") for r in rows[2:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(texts, pa.string()), pa.array(added, pa.int64()), pa.array(removed, pa.int64())], [*keep, "content", "lines_added", "lines_removed"])

    pair = pair.select(*keep, text("old").alias("old"), text("new").alias("new"))
    none = F.lit(None).cast("array<struct<i1: bigint, i2: bigint, j1: bigint, j2: bigint>>").alias("edits")
    long = F.length("old") + F.length("new") > LONG
    if pair.where(long).isEmpty():
        return pair.select("*", none).mapInArrow(compared, schema)
    split = lambda c: F.regexp_extract_all(F.regexp_replace(c, "\r\n?", "\n"), F.lit("[^\n]*\n|[^\n]+"), F.lit(0)).alias(c)
    both = kept(pair.where(long).select(release, "path", split("old"), split("new")), "long-pairs")
    edits = pair.where(long).join(large_edits(both, [release, "path"]), [release, "path"]).select(*pair.columns, "edits")
    return pair.where(~long).select("*", none).unionByName(edits).mapInArrow(compared, schema)


def diff_stats(old_files: DataFrame, new_files: DataFrame, release: str = "release_id") -> DataFrame:
    """stats_of the unified diffs of two versions."""
    return stats_of(unified_diffs(old_files, new_files, release), release)


def stats_of(diffs: DataFrame, release: str = "release_id") -> DataFrame:
    """Per release: files_changed, lines_added, lines_removed, new_files, deleted_files, binary_files (sorted arrays); diffs: rows of unified_diffs."""
    names = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("path"))))
    return diffs.groupBy(release).agg(
        F.count("*").alias("files_changed"), F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"),
        names(F.col("is_new")).alias("new_files"), names(F.col("is_deleted")).alias("deleted_files"), names(F.col("is_binary")).alias("binary_files"))


def likely_benign(lines: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key..., n_lines, likely_benign: more than nine of ten added lines are blank, comments, docstrings or version numbers."""
    text = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    plain = (text == "") | text.startswith("#") | text.startswith('"""') | text.startswith("'''") | text.rlike(r"(?i)^version\s*=") | text.startswith("__version__")
    return lines.groupBy(*key).agg(F.count("*").alias("n_lines"), F.coalesce(F.avg(plain.cast("double")) > 0.9, F.lit(True)).alias("likely_benign"))
