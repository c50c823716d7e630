"""Kept state that survives broken writes, and dimensions that change under a running stream.

A snapshot is a folder of Parquet files and, written last, a manifest with its number of rows and a checksum of them. What is read is the last
snapshot that agrees with its manifest; others are set aside by name, and where none is whole the state is empty. A stream joins each batch
with the snapshot that was whole when the batch first ran: the choice is logged by batch, so a batch that runs again joins the same one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, n_rows long, checksum long"


def _seal(df: DataFrame) -> tuple[int, int]:
    """The number of rows, and an exclusive or of their hashes with the number of times that each occurs."""
    each = df.groupBy(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("n"))
    row = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("h", "n")), F.lit(0))).first()
    return row[0], row[1]


def _read(spark: SparkSession, path: str, schema: str) -> list:
    try:
        return spark.read.schema(schema).json(path).collect()
    except AnalysisException:  # not there
        return []


def save(df: DataFrame, root: str, version: int) -> None:
    """Writes df as the snapshot `version`; a version is written once."""
    path = f"{root}/data/version={version}"
    df.write.mode("overwrite").parquet(path)
    n, checksum = _seal(df.sparkSession.read.schema(df.schema).parquet(path))
    df.sparkSession.createDataFrame([(version, n, checksum)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/version={version}")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that have a manifest, the newest first."""
    return sorted({r["version"] for r in _read(spark, f"{root}/manifests", MANIFEST) if r["version"] is not None}, reverse=True)


def snapshot(spark: SparkSession, root: str, version: int, schema) -> DataFrame | None:
    """A snapshot, or None if it is not what its manifest says."""
    said = _read(spark, f"{root}/manifests/version={version}", "n_rows long, checksum long")
    df = spark.read.schema(schema).parquet(f"{root}/data/version={version}")
    try:
        whole = len(said) == 1 and _seal(df) == (said[0]["n_rows"], said[0]["checksum"])
    except Exception as broken:  # files that can't be read are what this looks for
        if not any(x in str(broken) for x in ("Parquet", "parquet", "FAILED_READ_FILE", "PATH_NOT_FOUND", "not exist")):
            raise
        whole = False
    return df if whole else None


def latest(spark: SparkSession, root: str, schema) -> tuple[DataFrame, int | None]:
    """The last whole snapshot and its version; an empty table and None if there is none. Broken ones are named in root/quarantine."""
    for version in versions(spark, root):
        df = snapshot(spark, root, version, schema)
        if df is not None:
            return df, version
        spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").json(f"{root}/quarantine/version={version}")
    return spark.createDataFrame([], schema), None


def quarantined(spark: SparkSession, root: str) -> list[int]:
    return sorted({r["version"] for r in _read(spark, f"{root}/quarantine", "version long")})


def of_batch(spark: SparkSession, root: str, chosen: str, batch: int, schema) -> tuple[DataFrame, int | None]:
    """The snapshot of a stream's batch: the last whole one when the batch first ran, logged in the folder `chosen` before it is used."""
    logged = _read(spark, f"{chosen}/batch={batch}", "version long")
    if logged:
        version = logged[0]["version"]
        df = None if version is None else snapshot(spark, root, version, schema)
        if version is not None and df is None:
            raise ValueError(f"batch {batch} was joined with snapshot {version}, which is no longer whole")
        return (df if df is not None else spark.createDataFrame([], schema)), version
    df, version = latest(spark, root, schema)
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{chosen}/batch={batch}")
    return df, version
