"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts, as a character class.
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests, one machine)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tidewatch.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors on other machines could not read what is written")
        found = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("tidewatch.scratch.dir", found)
    return found


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read it and need none of its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, placed: bool = False) -> DataFrame:
    """df as a table in the shared folder, dealt out by key: joins on key move only the other side, as often as they come. placed: df is dealt out by key already."""
    spark, n, table = df.sparkSession, partitions(df.sparkSession), f"{name}_{uuid.uuid4().hex}"
    (df if placed else df.repartition(n, key)).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{table}").option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files are external, and out knows them
    return out


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a number of each row in the column `name`, as a written table: a second scan of docs may be split otherwise and number anew."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in have:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, n: int, each: int = 1) -> list[int]:
    """each * n int keys, of which Spark's hash partitioning puts the i-th into partition i // each of n: groups of like size are dealt out evenly."""
    key = F.col("id").cast("int")
    found = spark.range(40 * each * n).select(key.alias("k"), F.pmod(F.hash(key), F.lit(n)).alias("p")).groupBy("p").agg(F.slice(F.array_sort(F.collect_list("k")), 1, each).alias("k")).collect()
    keys, spare = {r["p"]: r["k"] for r in found}, iter(range(40 * each * n, 41 * each * n))
    return [k for i in range(n) for k in [*keys.get(i, []), *(next(spare) for _ in range(each - len(keys.get(i, []))))]]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as decimal text, modulo n; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")
