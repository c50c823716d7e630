"""The change log as a stream: offsets, the read limit, restarts, state with expiry, delivery with a ledger, snapshots, status."""

import glob
import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import snapshots
from tidewatch.sources.release_log import LogReader, land, release_stream
from tidewatch.streaming import delivery as D
from tidewatch.streaming.monitor import drained, health
from tidewatch.streaming.state import keep_state_on_disk, version_state

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "ecosystem string, name string, version string, action string, serial long, ts timestamp"


def landed(spark, path, rows, files=3):
    """rows: (ecosystem, name, version, action, serial)."""
    land(spark.createDataFrame([(*r, None) for r in rows], SCHEMA), path, files)


def some_rows(n=120):
    return [(("pypi", "npm")[i % 3 == 0], f"p{i % 7}", f"1.{i % 5}", "new release" if i % 4 else "other", i) for i in range(n)]


def offsets(path, tmp_path, **options):
    """All offsets that a reader gives, and the serials that it reads for each."""
    reader, at, out = LogReader({"path": path, "cursor": str(tmp_path / "cursor.json"), **{k: str(v) for k, v in options.items()}}), {}, []
    while True:
        end = reader.latestOffset()
        if end == at:
            return out
        rows = [r for p in reader.partitions(at, end) for b in reader.read(p) for r in b.to_pylist()]
        out.append((end, sorted((r["ecosystem"], r["serial"]) for r in rows)))
        at = end


@pytest.mark.parametrize("limit", [0, 1, 7, 1000])
def test_every_event_is_read_once_and_none_is_passed_over(spark, tmp_path, limit):
    rows = some_rows()
    landed(spark, str(tmp_path / "log"), rows)
    seen = []
    for end, got in offsets(str(tmp_path / "log"), tmp_path, limit=limit):
        seen += got
        for eco in ("pypi", "npm"):
            mine = {s for e, s in got if e == eco}
            assert not limit or sum(r[3] == "new release" for r in rows if r[0] == eco and r[4] in mine) <= limit
            # all events up to the cursor have been read
            assert {r[4] for r in rows if r[0] == eco and r[4] <= end.get(eco, -1)} == {s for e, s in seen if e == eco}
    assert sorted(seen) == sorted((r[0], r[4]) for r in rows)


def test_a_quiet_ecosystem_does_not_hold_the_search_up(spark, tmp_path):
    """One that has no more events lets its cursor go on, and the search reads `ahead` row groups at most."""
    rows = [("cargo", "a", "1", "new release", 0)] + [("pypi", "b", str(i), "new release", i) for i in range(1, 100)]
    landed(spark, str(tmp_path / "log"), rows, 8)
    got = offsets(str(tmp_path / "log"), tmp_path, limit=10, ahead=2)
    assert sum(len(r) for _, r in got) == 100 and got[-1][0]["cargo"] > 50


def test_shares_are_full_however_many_row_groups_the_log_has(spark, tmp_path):
    """What a batch admits does not depend on how finely the log was written, nor on an ecosystem with few events or one that comes late."""
    rows = [("pypi", "b", str(i), "new release" if i % 3 else "other", i) for i in range(0, 300, 2)] + [("cargo", "a", "1", "new release", i) for i in range(1, 300, 30)] + [("npm", "c", "1", "new release", i) for i in range(201, 300, 4)]
    want = []
    for files in (1, 150):
        path = tmp_path / str(files)
        path.mkdir()
        landed(spark, str(path / "log"), rows, files)
        got = offsets(str(path / "log"), path, limit=50)
        assert sorted(s for _, read in got for s in read) == sorted((r[0], r[4]) for r in rows)
        want.append([[sum(r[0] == e and r[3] == "new release" and (e, r[4]) in set(read) for r in rows) for e in ("pypi", "cargo", "npm")] for _, read in got])
    assert len(list((tmp_path / "150" / "log").glob("*.parquet"))) > 100
    assert [[n[0] for n in x] for x in want] == [[50, 50]] * 2 and all(max(n) <= 50 for x in want for n in x) and all(sum(n[2] for n in x) == 25 for x in want)


def test_a_new_reader_goes_on_where_the_last_planned_batch_ended(spark, tmp_path):
    landed(spark, str(tmp_path / "log"), some_rows())
    options = {"path": str(tmp_path / "log"), "cursor": str(tmp_path / "c.json"), "limit": "5"}
    first = LogReader(options)
    end = first.latestOffset()
    first.partitions({}, end)
    assert LogReader(options).latestOffset() == first.latestOffset() != end and json.load(open(tmp_path / "c.json")) == end


def test_an_empty_log(spark, tmp_path):
    landed(spark, str(tmp_path / "log"), [])
    assert offsets(str(tmp_path / "log"), tmp_path, limit=3) == []


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tidewatch.sources.release_log import release_stream
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def keep(df, n):
    df.write.mode("overwrite").parquet(f"{path}/out/batch={{n}}")
    if n == {at}:
        os._exit(9)  # after the batch's rows, before Spark knows
q = release_stream(spark, "{path}/log", "{path}/cursor.json", 9).writeStream.foreachBatch(keep).option("checkpointLocation", "{path}/state").start()
q.processAllAvailable()
"""


def test_a_killed_driver_loses_and_repeats_nothing(spark, tmp_path):
    rows = some_rows()
    landed(spark, str(tmp_path / "log"), rows)
    for at in (1, -1):
        done = subprocess.run([sys.executable, "-c", KILLED.format(root=ROOT, path=tmp_path, at=at)], cwd=ROOT, capture_output=True, text=True, timeout=200)
        assert done.returncode == (9 if at == 1 else 0), done.stderr[-2000:]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.serial for r in got.collect()) == [r[4] for r in rows] and got.select("batch").distinct().count() > 4


def stateful(spark, tmp_path, rows, run, live_ms=None, limit=50, **options):
    landed(spark, str(tmp_path / f"log{run}"), rows)
    keep_state_on_disk(spark)
    feed = release_stream(spark, str(tmp_path / f"log{run}"), str(tmp_path / f"cursor{run}.json"), limit).select("ecosystem", "name", F.col("version").alias("latest"), F.col("serial").alias("seq"))
    q = version_state(feed, live_ms, **options).writeStream.format("parquet").option("path", str(tmp_path / f"out{run}")).option("checkpointLocation", str(tmp_path / f"state{run}")).start()
    return q


def test_state_drops_what_it_has_gone_past(spark, tmp_path):
    """Repeated numbers and null names are dropped, a version that comes back is known, null versions are empty."""
    rows = [("npm", "a", v, "new release", s) for s, v in enumerate(["1", "2", "2", "1", None, "2"])] + [("npm", "a", "9", "new release", 3), ("npm", None, "1", "x", 7), ("pypi", "a", "5", "x", 8)]
    q = stateful(spark, tmp_path, rows, 0)
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out0")).collect())
    assert got == [("", "2", 5, True), ("1", "", 4, False), ("1", "2", 1, False), ("2", "1", 3, False)]


def test_state_of_many_reported_versions(spark, tmp_path):
    """What was reported is known in the list and behind it, over batches. A batch's work does not ask the state for each version of a package."""
    rows = [("npm", f"p{s % 2}", str(s * s % 23), "new release", s) for s in range(150)]
    q = stateful(spark, tmp_path, rows, 2, limit=20, few=3)
    q.processAllAvailable()
    q.stop()
    want, seen, reported = [], {}, set()
    for _, name, version, _, s in rows:
        if name in seen and seen[name] != version:
            want.append((name, seen[name], version, s, (name, version) in reported))
            reported.add((name, version))
        seen[name] = version
    assert sorted(tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out2")).collect()) == sorted(want) and any(w[4] for w in want)


def test_state_expires(spark, tmp_path):
    """A package that was silent for longer than its state lives is seen for the first time again."""
    rows = [("npm", "a", str(i), "new release", i) for i in range(4)]
    q = stateful(spark, tmp_path, rows, 1, live_ms=2000)
    time.sleep(1)
    while not (q.lastProgress and q.lastProgress.batchId >= 1):
        time.sleep(0.3)
    time.sleep(4)
    files = glob.glob(str(tmp_path / "log1" / "*.parquet"))
    spark.createDataFrame([("npm", "a", "9", "new release", 10, None), ("npm", "a", "8", "new release", 11, None)], SCHEMA).coalesce(1).sortWithinPartitions("serial").write.mode("append").parquet(str(tmp_path / "log1"))
    assert len(glob.glob(str(tmp_path / "log1" / "*.parquet"))) > len(files)
    before = q.lastProgress.batchId
    while q.isActive and not any(p.batchId > before and p.numInputRows for p in q.recentProgress):
        time.sleep(0.3)
    drained(q)
    got = sorted((r.previous, r.latest) for r in spark.read.parquet(str(tmp_path / "out1")).collect())
    assert got == [("0", "1"), ("1", "2"), ("2", "3"), ("9", "8")]  # not ("3", "9")


def ledger_counts(spark, root):
    return {(r.backend, r.state): r["count"] for r in D.state_of(D.events(spark, root)).groupBy("backend", "state").count().collect()}


def test_what_was_sent_is_not_sent_again(spark, tmp_path):
    """A receiver's crash between sending and noting leaves its alerts pending; the next run sends those and no other receiver's again."""
    root, sent = str(tmp_path / "ledger"), str(tmp_path / "sent")
    os.makedirs(sent)
    alerts = spark.createDataFrame([(str(i), "MALICIOUS") for i in range(6)] + [("3", "MALICIOUS"), (None, "x")], "alert_id string, verdict string").repartition(2)

    def chat(rows):
        for r in rows:
            with open(f"{sent}/chat-{r['alert_id']}", "a") as f:
                f.write("x")
            yield r["alert_id"], None

    def mail(rows):
        for r in rows:
            if not os.path.exists(f"{sent}/up"):
                raise RuntimeError("down")
            yield r["alert_id"], "full" if r["alert_id"] == "5" else None

    with pytest.raises(Exception, match="down"):
        D.route(alerts, {"chat": chat, "mail": mail}, root, 0)
    assert ledger_counts(spark, root) == {("chat", "sent"): 6, ("mail", "pending"): 6}
    open(f"{sent}/up", "w").close()
    D.route(alerts, {"chat": chat, "mail": mail}, root, 0)
    assert ledger_counts(spark, root) == {("chat", "sent"): 6, ("mail", "sent"): 5, ("mail", "failed"): 1}
    assert all(len(open(f).read()) == 1 for f in glob.glob(f"{sent}/chat-*")) and D.alerted(D.events(spark, root)).count() == 6
    letters = D.dead_letters(D.events(spark, root))
    assert [(r.alert_id, r.error, r.tries, json.loads(r.body)["verdict"]) for r in letters.collect()] == [("5", "full", 1, "MALICIOUS")]
    D.take_out(letters, root)
    assert D.dead_letters(D.events(spark, root)).count() == 0
    assert D.events(spark, str(tmp_path / "none")).count() == 0


def test_broken_snapshots_are_set_aside(spark, tmp_path):
    root, schema = str(tmp_path / "kept"), "name string, n long"
    df, version = snapshots.latest(spark, root, schema)
    assert version is None and df.count() == 0
    make = lambda k: spark.createDataFrame([(f"p{i}", k) for i in range(20)] + [("p0", k)], schema).repartition(2)
    for k in range(1, 5):
        snapshots.save(make(k), root, k)
    assert snapshots.latest(spark, root, schema)[1] == 4
    whole = glob.glob(f"{root}/data/version=4/*.parquet")[0]
    with open(whole, "r+b") as f:
        f.truncate(os.path.getsize(whole) // 2)  # truncated
    os.remove(glob.glob(f"{root}/data/version=3/*.parquet")[0])  # half written
    for f in glob.glob(f"{root}/manifests/version=2/*.json"):
        os.remove(f)  # never finished
    df, version = snapshots.latest(spark, root, schema)
    assert version == 1 and df.count() == 21 and set(snapshots.quarantined(spark, root)) >= {3, 4}


def test_a_batch_keeps_its_snapshot(spark, tmp_path):
    root, chosen, schema = str(tmp_path / "w"), str(tmp_path / "chosen"), "name string"
    assert snapshots.of_batch(spark, root, chosen, 0, schema)[1] is None
    snapshots.save(spark.createDataFrame([("a",)], schema), root, 1)
    assert snapshots.of_batch(spark, root, chosen, 1, schema)[1] == 1
    snapshots.save(spark.createDataFrame([("b",)], schema), root, 2)
    assert [snapshots.of_batch(spark, root, chosen, k, schema)[1] for k in (0, 1, 2, 1)] == [None, 1, 2, 1]
    assert snapshots.of_batch(spark, root, chosen, 1, schema)[0].first().name == "a"


def test_status_of_streams(spark, tmp_path):
    landed(spark, str(tmp_path / "log"), some_rows(20))
    healthy = lambda path, at: [r.healthy for r in health(D.status(spark, path), at).collect()]
    for name, fails in (("good", False), ("bad", True)):
        path = str(tmp_path / f"{name}-status.json")
        listener = D.StatusListener(path, name)
        spark.streams.addListener(listener)

        def keep(df, n, fails=fails):
            if fails:
                raise RuntimeError("no luck")
            df.count()

        q = release_stream(spark, str(tmp_path / "log"), str(tmp_path / f"{name}.json"), 5).writeStream.queryName(name).foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/{name}-state").start()
        try:
            q.processAllAvailable()
            for _ in range(100):
                if os.path.exists(path) and D.status(spark, path).where("batch >= 0").count():
                    break
                time.sleep(0.2)
            row = D.status(spark, path).first()
            assert row.status == "ok" and row.rows > 0 and healthy(path, row.updated_at) == [True]
            late = spark.range(1).select((F.lit(row.updated_at) + F.expr("INTERVAL 11 MINUTES")).alias("t")).first().t
            assert healthy(path, late) == [False]
        except Exception as error:
            if not fails or isinstance(error, AssertionError):
                raise
        q.stop()
        for _ in range(100):
            if os.path.exists(path) and D.status(spark, path).first().status != "ok":
                break
            time.sleep(0.2)
        row = D.status(spark, path).first()
        assert row.status == ("failed" if fails else "stopped") and (not fails or "no luck" in row.error) and healthy(path, row.updated_at) == [False]
        spark.streams.removeListener(listener)
