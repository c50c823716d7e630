"""Continuous operation: release feeds deduplicated, latest versions kept as state, alerts delivered at least once."""

from __future__ import annotations

import hashlib
import hmac
import tempfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import verdict_rank
from ..operators.verdicts import is_alert


def new_releases(feed: DataFrame, watchlist: DataFrame | None = None, late: str = "1 hour") -> DataFrame:
    """The first event of each (ecosystem, name, version) within `late` of event time; state is dropped behind the watermark."""
    mine = feed if watchlist is None else feed.join(watchlist.select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_semi")
    return mine.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ecosystem", "name", "version"])


def version_changes(feed: DataFrame) -> DataFrame:
    """name, previous, latest, seq: each change of a package's latest version. The version seen last is the package's state; the first sighting is only recorded."""

    def changed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        out = []
        # a batch has what the source's read limit lets through; of that only numbers and versions are held
        for seq, latest in sorted(((int(s), x) for part in parts for s, x in zip(part["seq"], part["latest"])), key=lambda r: r[0]):
            if seen is not None and latest != seen:
                out.append((key[0], seen, latest, seq))
            seen = latest
        state.update((seen,))
        yield pd.DataFrame(out, columns=["name", "previous", "latest", "seq"])

    return feed.groupBy("name").applyInPandasWithState(changed, "name string, previous string, latest string, seq long", "latest string", "append", GroupStateTimeout.NoTimeout)


def activity(feed: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and kind; late events are dropped behind the watermark."""
    return feed.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))


def sessions(feed: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return feed.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "name").agg(F.count("*").alias("n"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only on one machine may a temporary one stand for it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors on other machines could not read what is written")
    return found or tempfile.mkdtemp(prefix="tidewatch-")


def drained(query: StreamingQuery, seconds: float = 0.2) -> StreamingQuery:
    """Waits until a batch finds nothing to read, and stops. Where state expires, batches without rows go on for ever, so processAllAvailable would not return."""
    while query.isActive and not (query.lastProgress and query.lastProgress.numInputRows == 0):
        time.sleep(seconds)
    if query.exception():
        raise query.exception()
    query.stop()
    return query


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, as micro-batches, into Parquet; offsets and state are kept in `checkpoint`."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def payload(alerts: DataFrame) -> DataFrame:
    """alerts with `body`, the message as JSON."""
    return alerts.withColumn("body", F.to_json(F.struct(*alerts.columns)))


@F.pandas_udf(StringType())
def signature(body: pd.Series, secret: pd.Series) -> pd.Series:
    """HMAC-SHA256 of a message's bytes, in hexadecimal."""
    return pd.Series([None if b is None else hmac.new(k.encode(), b.encode(), hashlib.sha256).hexdigest() for b, k in zip(body, secret)])


def deliver(alerts: DataFrame, send: Callable[[Iterator[dict]], Iterator[tuple[str, str | None]]], least: str, checkpoint: str, failed: str) -> StreamingQuery:
    """Sends each alert from the executors. send: takes the rows of a partition, yields (alert_id, error or None).

    Failures go to the dead-letter table `failed`, partitioned by batch. A batch may be sent again after a crash, so receivers key on alert_id;
    its failures replace those of the first time.
    """

    def batch(df: DataFrame, number: int) -> None:
        due = payload(df.where(is_alert(F.col("verdict"), F.col("severity"), F.lit(least))))

        def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame(list(send(iter(part.to_dict("records")))), columns=["alert_id", "error"])

        done = due.select("alert_id", "verdict", "severity", "body").mapInPandas(sent, "alert_id string, error string")
        # one folder for each batch, written over when the batch is sent again
        done.where("error is not null").write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return alerts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health(last_run: DataFrame, as_of, stale_seconds: int = 600) -> DataFrame:
    """last_run with healthy: status ok and not older than `stale_seconds` at as_of."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp"))
    return last_run.withColumn("healthy", (F.col("status") == "ok") & (age <= stale_seconds))


def metrics(verdicts: DataFrame) -> DataFrame:
    """Per ecosystem and in all (null): releases, malicious and suspicious ones, average milliseconds and tokens."""
    return verdicts.rollup("ecosystem").agg(
        F.count("*").alias("releases"), F.count_if(verdict_rank(F.col("verdict")) == 4).alias("malicious"), F.count_if(verdict_rank(F.col("verdict")) == 3).alias("suspicious"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.avg("tokens"), F.lit(0.0)).alias("avg_tokens"))
