"""Files and archives as tables: path and content."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import looks_binary

#: What one archive may unpack to.
MAX_BYTES, MAX_FILES = 500 * 1024 * 1024, 10_000


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), content (binary), length of every file under root; any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") if ":" in root.split("/", 1)[0] else root.rstrip("/").lstrip("/")
    # Spark gives scheme:/root/...: all up to the first place where the root stands goes, later ones are folders of that name
    after = F.locate(base + "/", F.col("path")) + len(base) + 1
    return files.select(F.substring("path", after, F.length("path")).alias("path"), "content", "length")


def read_diffs(spark: SparkSession, root: str) -> DataFrame:
    """file_id, path, content: ready-made diffs, one for each file under root; their path is that of the diff's own +++ line, where there is one."""
    rows = read_tree(spark, root).select(F.col("path").alias("file_id"), as_text(F.col("content")).alias("content"))
    named = F.regexp_extract("content", r"(?m)^\+\+\+ (?:b/)?([^\t\r\n]+)", 1)
    return rows.select("file_id", F.coalesce(F.nullif(named, F.lit("")), F.col("file_id")).alias("path"), "content")


def as_text(content: Column) -> Column:
    """UTF-8 with U+FFFD for what is not; null as empty."""
    return F.coalesce(F.make_valid_utf8(content.cast("string")), F.lit(""))


def text_files(files: DataFrame) -> DataFrame:
    """files with is_binary and text (empty for binary files)."""
    binary = looks_binary(F.col("path"), F.col("content"))
    return files.withColumn("is_binary", binary).withColumn("text", F.when(binary, "").otherwise(as_text(F.col("content"))))


def _safe(name: str) -> str | None:
    """The path of a member, without a leading package folder; None for absolute and climbing ones."""
    parts = PurePosixPath(name.replace("\\", "/")).parts
    if not parts or parts[0].startswith("/") or ".." in parts or ":" in parts[0]:
        return None
    return "/".join(parts)


def members(name: str, content: bytes, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of the regular members of a zip, wheel, jar, tar.gz, tgz or crate, up to the limits."""
    total = count = 0
    if name.lower().endswith((".zip", ".whl", ".jar")):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                path = None if info.is_dir() or (info.external_attr >> 16) & 0o170000 == 0o120000 else _safe(info.filename)
                total, count = total + info.file_size, count + 1
                if total > max_bytes or count > max_files:
                    return
                if path:
                    yield path, z.read(info)
    elif name.lower().endswith((".tar.gz", ".tgz", ".crate")):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
            for info in t:
                path = _safe(info.name.removeprefix("./").removeprefix("package/")) if info.isfile() else None
                if path is None:
                    continue
                total, count = total + info.size, count + 1
                if total > max_bytes or count > max_files:
                    return
                yield path, t.extractfile(info).read()


def unpack(archives: DataFrame) -> DataFrame:
    """name, path, content of every member; error is set, and path null, for archives that cannot be read. archives: name, content."""

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["name"], part["content"]):
                rows = []
                try:
                    for path, data in members(name, content):
                        rows.append((name, path, data, None))
                        if len(rows) >= 100:
                            yield pd.DataFrame(rows, columns=["name", "path", "content", "error"])
                            rows = []
                except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, RuntimeError) as e:
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"[:200]))
                yield pd.DataFrame(rows, columns=["name", "path", "content", "error"])

    return archives.select("name", "content").mapInPandas(opened, "name string, path string, content binary, error string")
