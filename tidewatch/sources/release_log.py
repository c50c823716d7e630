"""A landed change log as a stream whose offsets are serials: `spark.readStream.format("release_log")`.

The log is a folder of Parquet files with ecosystem, name, version, action, serial and ts, written in the order of serials (`land`). An
offset holds one serial for each ecosystem: all its events up to there have been read, none after. Each batch admits at most `limit` events
with the action `counted` of each ecosystem, at the source: the new offset is the serial of the last admitted one, or the last serial that was
looked at where there are fewer, so that a cursor never passes an event that was not read. Partitions are row groups, that is ranges of serials;
row groups whose statistics lie outside of the batch are not opened.

Spark asks this kind of source for the next offset without saying where it stands, so the offset of the batch that was planned last is kept in
`cursor`. It is written when a batch is planned, which is after Spark has logged it: after a crash Spark plans the logged batch anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "ecosystem string, name string, version string, action string, serial long, ts timestamp"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def land(log: DataFrame, path: str, files: int) -> None:
    """Writes a log in the order of serials, as so many files; ties stay in one."""
    log.select(*COLUMNS).repartitionByRange(files, "serial").sortWithinPartitions("serial").write.mode("overwrite").parquet(path)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Ranges(InputPartition):
    """A row group of a file, and the serials (after, up to) of each ecosystem that are of the batch."""

    file: str
    group: int
    spans: dict[str, tuple[int, int]]


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.cursor = options["path"], options["cursor"]
        self.limit, self.counted, self.since = int(options.get("limit", 0)), options.get("counted", "new release"), int(options.get("since", -1))
        self.ahead = int(options.get("ahead", 0))
        self.at: dict[str, int] | None = None
        self.groups: dict[str, list[tuple[int, int, str, int]]] = {}
        self.known: dict[tuple[str, int], dict[str, tuple[int, int]]] = {}

    def initialOffset(self) -> dict:
        return {}

    def _ranges(self) -> list[tuple[int, int, str, int]]:
        """(least serial, greatest, file, row group), in order. Files do not change, so each is opened once for its statistics."""
        fs, root = file_system(self.path)
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if info.type == pafs.FileType.File and info.base_name.endswith(".parquet") and not info.base_name.startswith(("_", ".")) and info.path not in self.groups:
                with fs.open_input_file(info.path) as f:
                    meta = pq.ParquetFile(f).metadata
                column = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "serial") if meta.num_row_groups else 0
                stats = [(g, meta.row_group(g).column(column).statistics) for g in range(meta.num_row_groups)]
                self.groups[info.path] = [(s.min, s.max, info.path, g) for g, s in stats if s is not None and s.has_min_max]
        return sorted(x for groups in self.groups.values() for x in groups)

    def _here(self) -> dict[str, int]:
        if self.at is None:
            fs, file = file_system(self.cursor)
            if fs.get_file_info(file).type == pafs.FileType.File:
                with fs.open_input_stream(file) as f:
                    self.at = json.loads(f.read())
            else:
                self.at = {}
        return self.at

    def _rows(self, file: str, group: int) -> pa.Table:
        with file_system(self.path)[0].open_input_file(file) as f:
            return pq.ParquetFile(f).read_row_group(group, columns=["ecosystem", "action", "serial"]).sort_by("serial")

    def _summary(self, file: str, group: int) -> dict[str, tuple[int, int]]:
        """Of each ecosystem in a row group: how many events the limit counts, and the last serial. Row groups do not change, so each is read once for this."""
        if (file, group) not in self.known:
            rows = self._rows(file, group)
            hit = pc.fill_null(pc.equal(rows["action"], self.counted), False).cast(pa.int64())
            found = pa.table({"ecosystem": rows["ecosystem"], "hit": hit, "serial": rows["serial"]}).group_by("ecosystem").aggregate([("hit", "sum"), ("serial", "max")])
            self.known[file, group] = {r["ecosystem"]: (r["hit_sum"], r["serial_max"]) for r in found.to_pylist() if r["ecosystem"] is not None and r["serial_max"] is not None}
        return self.known[file, group]

    def latestOffset(self) -> dict:
        """Goes through the row groups in order until every ecosystem has its share, or has no more events; the cursor of the latter goes on to where the search ended.

        A row group is looked at only if an ecosystem without its share has not gone past it, so one without events costs a look at each new row group. Rows are
        read only where a share may end. One that is met for the first time starts after `since`; behind a row group that was passed over it has to wait for a
        later search, which will look at all of them.
        """
        start = self._here()
        found, left, behind = {}, {}, min(start.values(), default=self.since)
        waiting, end, looked, passed = set(start), behind, 0, False  # waiting: ecosystems that may still get something
        for least, most, file, group in self._ranges():
            if start and most <= behind:
                continue
            short = [e for e in waiting if left.get(e) != 0]
            if waiting and not short or self.ahead and looked == self.ahead:
                break
            if waiting and all(start.get(e, self.since) >= most for e in short):
                passed = True
                continue
            end, looked, rows = max(end, most), looked + 1, None
            for eco, (n, last) in self._summary(file, group).items():
                at = start.get(eco, self.since)
                if passed and eco not in waiting:
                    continue
                waiting.add(eco)
                if last <= at or left.get(eco) == 0:
                    continue
                room = left.get(eco, self.limit) if self.limit else n + 1
                if least > at and n < room:
                    found[eco], left[eco] = last, room - n
                    continue
                rows = self._rows(file, group) if rows is None else rows
                mine = rows.filter(pc.and_(pc.equal(rows["ecosystem"], eco), pc.greater(rows["serial"], at)))
                counted = mine.filter(pc.fill_null(pc.equal(mine["action"], self.counted), False))["serial"]
                full = counted.length() >= room
                found[eco] = counted[room - 1].as_py() if full else mine["serial"][-1].as_py()
                left[eco] = 0 if full else room - counted.length()
        return {**start, **found, **{e: end for e in waiting if left.get(e) != 0 and end > start.get(e, self.since)}}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = dict(end)
        fs, file = file_system(self.cursor)
        fs.create_dir(file.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(file) as f:
            f.write(json.dumps(end).encode())
        spans = {e: (start.get(e, self.since), s) for e, s in end.items() if s > start.get(e, self.since)}
        return [Ranges(file, g, mine) for lo, hi, file, g in self._ranges() if (mine := {e: (a, b) for e, (a, b) in spans.items() if hi > a and lo <= b})]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs = file_system(self.path)[0]
        with fs.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(row_groups=[partition.group], columns=COLUMNS):
                table = pa.Table.from_batches([batch])
                keep = None
                for eco, (a, b) in partition.spans.items():
                    mine = pc.and_(pc.equal(table["ecosystem"], eco), pc.and_(pc.greater(table["serial"], a), pc.less_equal(table["serial"], b)))
                    keep = mine if keep is None else pc.or_(keep, mine)
                rows = table.filter(keep).select(COLUMNS)
                rows = rows.set_column(5, "ts", rows["ts"].cast(pa.timestamp("us", "UTC")))
                yield from rows.to_batches()


class ReleaseLog(DataSource):
    """Options: path, cursor (a file of this query's own), limit (0: none), counted (the action that the limit counts), since (a serial to start after), ahead (row groups that one search may look at, though shares are not full then; 0: no bound)."""

    @classmethod
    def name(cls) -> str:
        return "release_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def release_stream(spark: SparkSession, path: str, cursor: str, limit: int = 0, **options) -> DataFrame:
    spark.dataSource.register(ReleaseLog)
    return spark.readStream.format("release_log").option("path", path).option("cursor", cursor).option("limit", str(limit)).options(**options).load()
