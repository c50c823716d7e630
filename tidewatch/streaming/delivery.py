"""Alerts to several receivers with a ledger, and the status of a stream from Spark's own reports.

The ledger is a table of events: an alert is pending for a receiver before it is sent, then sent or failed. What a batch sends is what it has
and no event of the ledger says was sent, so a batch that runs again, or an alert that comes again, sends only what is open. Each receiver's results are
written before the next one's begin. An alert counts as alerted once any receiver has it; what failed for a receiver is that receiver's dead letter.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from uuid import uuid4

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.release_log import file_system
from .monitor import payload, shared_folder

EVENTS = "alert_id string, backend string, state string, error string, body string, at timestamp, batch long"
#: A sender takes the rows of a partition and yields (alert_id, error or None).
Sender = Callable[[Iterator[dict]], Iterator[tuple[str, str | None]]]


def events(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(EVENTS).parquet(ledger)
    except AnalysisException:  # nothing was ever written
        return spark.createDataFrame([], EVENTS)


def _note(df: DataFrame, ledger: str) -> None:
    df.select(*(c.split()[0] for c in EVENTS.split(", "))).write.mode("append").parquet(ledger)


def state_of(log: DataFrame) -> DataFrame:
    """alert_id, backend, state, error, body, tries: sent if it ever was; removed if taken out after that; else failed if it ever did, else pending."""
    last = F.max_by("state", F.struct("at", F.when(F.col("state") == "pending", 0).otherwise(1)))
    return log.groupBy("alert_id", "backend").agg(
        F.when(F.bool_or(F.col("state") == "sent"), "sent").when(last == "removed", "removed").when(F.bool_or(F.col("state") == "failed"), "failed").otherwise("pending").alias("state"),
        F.max_by("error", F.when(F.col("state") == "failed", F.col("at"))).alias("error"), F.max_by("body", "at").alias("body"), F.count_if(F.col("state").isin("sent", "failed")).alias("tries"))


def route(alerts: DataFrame, backends: dict[str, Sender], ledger: str, batch: int = 0) -> None:
    """Sends each alert (alert_id, ...) to each receiver that has not got it yet. Failures of one receiver keep no other from it."""
    spark = alerts.sparkSession
    asked = payload(alerts).select("alert_id", "body").where("alert_id IS NOT NULL").dropDuplicates(["alert_id"]).withColumn("backend", F.explode(F.array(*map(F.lit, backends))))
    got = events(spark, ledger).where("state = 'sent'").select("alert_id", "backend").distinct()
    note = lambda df, state, error: df.select("*", F.lit(state).alias("state"), error.alias("error"), F.current_timestamp().alias("at"), F.lit(batch).cast("long").alias("batch"))
    mark = f"{shared_folder(spark)}/open-{uuid4().hex}"
    asked.join(got, ["alert_id", "backend"], "left_anti").write.parquet(mark)  # what this run sends, settled before anything is
    open_ = spark.read.schema(asked.schema).parquet(mark)
    _note(note(open_, "pending", F.lit(None).cast("string")), ledger)
    for name, send in backends.items():

        def sent(parts: Iterator[pd.DataFrame], send: Sender = send) -> Iterator[pd.DataFrame]:
            for part in parts:
                said = dict(send(iter(part.to_dict("records"))))
                yield part.assign(error=[said.get(i, "no answer") for i in part["alert_id"]])[["alert_id", "backend", "body", "error"]]

        done = open_.where(F.col("backend") == name).mapInPandas(sent, "alert_id string, backend string, body string, error string")
        done = done.select("*", F.when(F.col("error").isNull(), "sent").otherwise("failed").alias("state"), F.current_timestamp().alias("at"), F.lit(batch).cast("long").alias("batch"))
        _note(done, ledger)


def alerted(log: DataFrame) -> DataFrame:
    """alert_id of those that any receiver has."""
    return log.where("state = 'sent'").select("alert_id").distinct()


def dead_letters(log: DataFrame) -> DataFrame:
    """What is failed and neither sent nor taken out since: alert_id, backend, error, body, tries."""
    return state_of(log).where("state = 'failed'").drop("state")


def take_out(letters: DataFrame, ledger: str) -> None:
    """Removes dead letters (alert_id, backend): all of dead_letters() clears them, a part removes some."""
    gone = letters.select("alert_id", "backend", F.lit("removed").alias("state"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("body"), F.current_timestamp().alias("at"), F.lit(-1).cast("long").alias("batch"))
    _note(gone, ledger)


class StatusListener(StreamingQueryListener):
    """Keeps one row about a stream (status, updated_at, batch, rows, error) as the JSON file `path`, for monitor.health. The file is replaced as a whole."""

    def __init__(self, path: str, name: str | None = None):
        self.path, self.name, self.batch, self.rows = path, name, -1, 0

    def _write(self, status: str, error: str | None = None) -> None:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        row = json.dumps({"status": status, "updated_at": now, "batch": self.batch, "rows": self.rows, "error": error})
        fs, file = file_system(self.path)
        fs.create_dir(file.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{file}.new") as f:
            f.write(row.encode())
        fs.move(f"{file}.new", file)

    def onQueryStarted(self, event) -> None:
        if self.name is None or event.name == self.name:
            self.id = event.id
            self._write("ok")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is None or p.name == self.name:
            self.batch, self.rows = p.batchId, self.rows + p.numInputRows
            self._write("ok")

    def onQueryIdle(self, event) -> None:
        if getattr(self, "id", None) == event.id:
            self._write("ok")

    def onQueryTerminated(self, event) -> None:
        if getattr(self, "id", None) == event.id:
            self._write("failed" if event.exception else "stopped", event.exception)


def status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("status string, updated_at timestamp, batch long, rows long, error string").json(path)
