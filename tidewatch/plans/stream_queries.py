"""Queries on the change log as a stream with serial offsets and a read limit."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.release_log import land, release_stream
from ..streaming.monitor import shared_folder
from ..streaming.state import keep_state_on_disk, version_state
from . import bindings as B
from .queries import query

#: An event's ecosystem: one of three by its user.
ECOSYSTEMS = ("pypi", "npm", "cargo")
SQL_ECO_LOG = "log AS (SELECT event_id AS serial, ['pypi', 'npm', 'cargo'][user_id % 3 + 1] AS ecosystem, user_id::VARCHAR AS name, CASE event_type WHEN 'signup' THEN 'new release' ELSE event_type END AS action, coalesce(json_extract_string(props, '$.k'), '') AS version FROM events)"
#: Batches of the queries: a share of the releases of an ecosystem, so that their number does not grow with the table.
BATCHES = 6


def event_log(spark, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    eco = F.element_at(F.array(*map(F.lit, ECOSYSTEMS)), (F.col("user_id") % len(ECOSYSTEMS) + 1).cast("int"))
    return e.select(eco.alias("ecosystem"), F.col("user_id").cast("string").alias("name"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("version"),
                    F.when(F.col("event_type") == "signup", "new release").otherwise(F.col("event_type")).alias("action"), F.col("event_id").alias("serial"), F.col("ts").cast("timestamp").alias("ts"))


def _landed(spark, sf_dir: str) -> tuple[str, int]:
    """A folder with the landed log, and the read limit that makes BATCHES of the largest ecosystem."""
    root, log = f"{shared_folder(spark)}/feed-{uuid4().hex}", event_log(spark, sf_dir)
    land(log, f"{root}/log", 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = log.where("action = 'new release'").groupBy("ecosystem").count().agg(F.max("count")).first()[0] or 1
    return root, -(-most // BATCHES)


@query(f"""WITH {SQL_ECO_LOG}, m AS (SELECT ((max(n) + {BATCHES - 1}) // {BATCHES})::BIGINT AS part FROM (SELECT count(*) AS n FROM log WHERE action = 'new release' GROUP BY ecosystem)),
    c AS (SELECT *, sum((action = 'new release')::INT) OVER (PARTITION BY ecosystem ORDER BY serial)::BIGINT AS upto FROM log)
    SELECT CASE WHEN action = 'new release' THEN (upto - 1) // part ELSE upto // part END AS batch, ecosystem, count(*) AS n_events, count(*) FILTER (action = 'new release') AS n_releases, min(serial) AS first_serial, max(serial) AS last_serial
    FROM c, m GROUP BY ALL""")
def q_stream_admission(spark, sf_dir):
    """The log drained in batches by two runs of one query: what each batch admits of each ecosystem, and that no event is passed over or read twice."""
    root, limit = _landed(spark, sf_dir)

    def keep(df: DataFrame, number: int) -> None:
        df.groupBy("ecosystem").agg(F.count("*").alias("n_events"), F.count_if(F.col("action") == "new release").alias("n_releases"), F.min("serial").alias("first_serial"), F.max("serial").alias("last_serial")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        if number == 1 and not stopped:  # the first run ends in the middle of its second batch
            stopped.append(number)
            raise RuntimeError("stopped on purpose")

    stopped: list[int] = []
    for _ in range(2):
        q = release_stream(spark, f"{root}/log", f"{root}/cursor/at.json", limit).writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").start()
        try:
            q.processAllAvailable()
        except Exception:
            if "stopped on purpose" not in str(q.exception()):
                raise
        q.stop()
    return spark.read.schema("ecosystem string, n_events long, n_releases long, first_serial long, last_serial long, batch long").parquet(f"{root}/out")


@query(f"""WITH {SQL_ECO_LOG}, c AS (SELECT * FROM (SELECT *, lag(version) OVER (PARTITION BY ecosystem, name ORDER BY serial) AS previous FROM log) WHERE previous <> version)
    SELECT ecosystem, name, previous, version AS latest, serial AS seq, row_number() OVER (PARTITION BY ecosystem, name, version ORDER BY serial) > 1 AS reported_before FROM c""")
def q_stream_versions(spark, sf_dir):
    """Changes of latest versions, with those reported before, from state that batches of limited size go through."""
    root, limit = _landed(spark, sf_dir)
    keep_state_on_disk(spark)
    feed = release_stream(spark, f"{root}/log", f"{root}/cursor/at.json", limit).select("ecosystem", "name", F.col("version").alias("latest"), F.col("serial").alias("seq"))
    made = version_state(feed)
    q = made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(made.schema).parquet(f"{root}/out")


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS late, o_orderkey % 11 = 0 AS never, o_orderkey % 13 = 0 AS gone FROM orders WHERE o_orderpriority = '1-URGENT'),
    s AS (SELECT o_orderkey, 'chat' AS backend, 'sent' AS state, CASE WHEN late THEN 2 ELSE 1 END AS tries FROM a UNION ALL
          SELECT o_orderkey, 'mail', CASE WHEN never AND gone THEN 'removed' WHEN never THEN 'failed' ELSE 'sent' END, CASE WHEN never THEN 2 ELSE 1 END FROM a)
    SELECT backend, state, count(*) AS n, sum(tries)::BIGINT AS tries, count(*) FILTER (state = 'sent' OR backend = 'mail') AS n_alerted FROM s GROUP BY ALL""")
def q_alert_ledger(spark, sf_dir):
    """Urgent orders as alerts to two receivers, one of which fails at first and one for good for some; sent twice, then part of the dead letters is taken out."""
    from ..streaming import delivery as D

    root = f"{shared_folder(spark)}/ledger-{uuid4().hex}"
    alerts = B.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("alert_id"), F.lit("MALICIOUS").alias("verdict"))
    for batch in range(2):

        def chat(rows, batch=batch):
            return ((r["alert_id"], "busy" if batch == 0 and int(r["alert_id"]) % 7 == 0 else None) for r in rows)

        def mail(rows):
            return ((r["alert_id"], "no such address" if int(r["alert_id"]) % 11 == 0 else None) for r in rows)

        D.route(alerts, {"chat": chat, "mail": mail}, root, batch)
    D.take_out(D.dead_letters(D.events(spark, root)).where("cast(alert_id AS long) % 13 = 0"), root)
    log = D.events(spark, root)
    known = D.state_of(log).join(D.alerted(log).withColumn("alerted", F.lit(True)), "alert_id", "left")
    return known.groupBy("backend", "state").agg(F.count("*").alias("n"), F.sum("tries").alias("tries"), F.count_if("alerted").alias("n_alerted"))


@query(f"""WITH {SQL_ECO_LOG}, m AS (SELECT ((max(n) + {BATCHES - 1}) // {BATCHES})::BIGINT AS part FROM (SELECT count(*) AS n FROM log WHERE action = 'new release' GROUP BY ecosystem)),
    c AS (SELECT *, sum((action = 'new release')::INT) OVER (PARTITION BY ecosystem ORDER BY serial)::BIGINT AS upto FROM log),
    b AS (SELECT *, CASE WHEN action = 'new release' THEN (upto - 1) // part ELSE upto // part END AS batch FROM c, m)
    SELECT batch, (CASE WHEN batch < 2 THEN 1 ELSE 2 END)::BIGINT AS version, count(*) AS n FROM b WHERE action = 'new release' AND name::BIGINT % 2 = CASE WHEN batch < 2 THEN 0 ELSE 1 END GROUP BY ALL""")
def q_stream_watchlist(spark, sf_dir):
    """Watched releases by batch, with a watch-list that is replaced while the stream runs: each batch keeps the list it began with."""
    from ..operators import snapshots

    root, limit = _landed(spark, sf_dir)
    names = event_log(spark, sf_dir).select("name").distinct()
    part = lambda k: names.where(F.col("name").cast("long") % 2 == k)
    snapshots.save(part(0), f"{root}/watch", 1)

    def keep(df: DataFrame, number: int) -> None:
        if number == 2 and not replaced:
            snapshots.save(part(1), f"{root}/watch", 2)
            replaced.append(number)
        watch, version = snapshots.of_batch(spark, f"{root}/watch", f"{root}/chosen", number, "name string")
        mine = df.where("action = 'new release'").join(watch, "name", "left_semi")
        mine.agg(F.count("*").alias("n")).select(F.lit(version).cast("long").alias("version"), "n").where("n > 0").write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    replaced: list[int] = []
    q = release_stream(spark, f"{root}/log", f"{root}/cursor/at.json", limit).writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema("version long, n long, batch long").parquet(f"{root}/out")
