"""The queue's consumer: captured job events, Parquet files in a folder, as a stream of batches of bounded size.

    spark.dataSource.register(JobEvents)
    spark.readStream.format("job_events").option("path", ...).option("progress", ...).load()

A file's name says when it came: later files sort after earlier ones, and a file does not change once it is there. An
offset is a file's name and the rows of it that were read.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "event_id long, place_id long, host string, kind string, state string, ts timestamp"
_ARROW = pa.schema([("event_id", pa.int64()), ("place_id", pa.int64()), ("host", pa.string()), ("kind", pa.string()), ("state", pa.string()), ("ts", pa.timestamp("us", "UTC"))])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Slice(InputPartition):
    """Rows `first` to `end` of a file."""

    path: str
    first: int
    end: int


class JobEventReader(DataSourceStreamReader):
    """Options: path; progress, a folder in a shared place; maxRowsPerBatch; maxRowsPerTask.

    Spark asks for the latest offset without saying where it is. So the end of every planned batch is written to
    `progress` before the batch runs: what is found there after a restart is where Spark goes on, and the next batch is
    bounded as well. A stream has a progress folder of its own; without one, a batch reads all that is there.
    """

    def __init__(self, options: dict):
        self.path, self.progress = options["path"].rstrip("/"), options.get("progress")
        self.most, self.by_task = int(options.get("maxrowsperbatch", 100_000)), int(options.get("maxrowspertask", 25_000))
        self.at: dict | None = None
        self.counts: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def _files(self, since: str) -> list[str]:
        """Names from `since` on, in order."""
        store, path = located(self.path)
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
        return names[bisect_left(names, since) :]

    def _rows(self, name: str) -> int:
        """A file's rows, from its footer."""
        if name not in self.counts:
            store, path = located(f"{self.path}/{name}")
            with store.open_input_file(path) as f:
                self.counts[name] = pq.ParquetFile(f).metadata.num_rows
        return self.counts[name]

    def latestOffset(self) -> dict:
        at, left = dict(self.at or self._written()), self.most
        for name in self._files(at["file"]):
            first = at["row"] if name == at["file"] else 0
            step = min(left, self._rows(name) - first)
            at, left = {"file": name, "row": first + step}, left - step
            if not left:
                break
        return at

    def _plans(self) -> list[str]:
        store, path = located(self.progress)
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".json"))

    def _written(self) -> dict:
        if not self.progress:
            self.most = 1 << 62
            return self.initialOffset()
        store, _ = located(self.progress)
        for plan in reversed(self._plans()):
            with store.open_input_stream(plan) as f:
                said = f.read()
            # A driver may have been lost while it wrote; Spark then asks for the same batch again before any other.
            if said.endswith(b"}"):
                return json.loads(said)
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.at = end
        if self.progress:
            store, path = located(self.progress)
            plans = self._plans()
            store.create_dir(path, recursive=True)
            number = int(plans[-1].rsplit("/", 1)[-1].removesuffix(".json")) + 1 if plans else 0
            with store.open_output_stream(f"{path}/{number:012d}.json") as f:
                f.write(json.dumps(end).encode())
            for old in plans[:-2]:
                store.delete_file(old)
        slices = []
        for name in self._files(start["file"]):
            if name > end["file"]:
                break
            first, last = (start["row"] if name == start["file"] else 0), (end["row"] if name == end["file"] else self._rows(name))
            slices += [Slice(f"{self.path}/{name}", at, min(at + self.by_task, last)) for at in range(first, last, self.by_task)]
        return slices

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        store, path = located(partition.path)
        with store.open_input_file(path) as f:
            file, at = pq.ParquetFile(f), 0
            for group in range(file.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                low, high = max(partition.first - at, 0), min(partition.end - at, rows)
                if low < high:
                    yield from file.read_row_group(group, columns=_ARROW.names).slice(low, high - low).cast(_ARROW).to_batches(10_000)
                at += rows

    def commit(self, end: dict) -> None:
        self.counts = {name: n for name, n in self.counts.items() if name >= end["file"]}


class JobEvents(DataSource):
    """Streams the rows of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "job_events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> JobEventReader:
        return JobEventReader({k.lower(): v for k, v in self.options.items()})
