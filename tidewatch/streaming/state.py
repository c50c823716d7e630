"""State of packages under a stream that never ends: value and map state whose entries expire.

What a package's latest version is, and which of its versions were reported, is kept for each (ecosystem, name) in RocksDB with a time to live:
a package that is silent for that long costs nothing, and its next event is a first sighting again. Events that the state has gone past, because
they are late or come twice, are dropped. A batch holds what the source's read limit admits, so the rows of one name in one batch are bounded
by that limit, however often the name occurs in the log; they are ordered by their numbers and walked once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "ecosystem string, name string, previous string, latest string, seq long, reported_before boolean"


#: Reported versions of a package that are kept as one list, read and added to at once; later ones are looked up one by one.
FEW = 1000


class LatestVersions(StatefulProcessor):
    """latest: (version, seq) last seen, and whether there are more than FEW reported ones. few: the first FEW reported versions; many: the others, by version."""

    def __init__(self, live_ms: int | None, few: int = FEW):
        self.live_ms, self.most = live_ms, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "version string, seq long, more boolean", self.live_ms)
        self.few = handle.getListState("few", "version string", self.live_ms)
        self.many = handle.getMapState("many", "version string", "seq long", self.live_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, last, more = self.latest.get() or (None, None, False)
        before, changes = last, []
        for seq, version in sorted((r["seq"], r["latest"]) for r in rows):
            if last is not None and seq <= last:  # late, or seen
                continue
            if last is not None and version != seen:
                changes.append((seen, version, seq))
            seen, last = version, seq
        if changes:
            asked, known, n, new = {c[1] for c in changes}, set(), 0, {}
            for (version,) in self.few.get():  # of what was reported, only what is asked for is held
                n += 1
                if version in asked:
                    known.add(version)
            if more:
                known |= {v for v in asked - known if self.many.containsKey((v,))}
            for previous, version, seq in changes:
                yield Row(ecosystem=key[0], name=key[1], previous=previous, latest=version, seq=seq, reported_before=version in known)
                if version not in known:
                    known.add(version)
                    new[version] = seq
            listed = list(new)[: max(0, self.most - n)]
            if listed:
                self.few.appendList([(v,) for v in listed])
            for version in list(new)[len(listed) :]:
                self.many.updateValue((version,), (new[version],))
            more = more or len(new) > len(listed)
        if last != before:
            self.latest.update((seen, last, more))

    def close(self) -> None:
        pass


def version_state(feed: DataFrame, live_ms: int | None = None, few: int = FEW) -> DataFrame:
    """CHANGES of a stream of ecosystem, name, latest, seq. live_ms: how long a silent package's state lives; None: for ever. Null versions are ''; rows without a number are left out."""
    keyed = feed.where("seq IS NOT NULL AND name IS NOT NULL").na.fill("", ["latest", "ecosystem"])
    mode = "ProcessingTime" if live_ms else "None"
    return keyed.groupBy("ecosystem", "name").transformWithState(LatestVersions(live_ms, few), CHANGES, "Append", mode)


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of any size, of many columns, with expiry: the provider that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
