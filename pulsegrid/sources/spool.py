"""Spool folders as a stream: one file for each host and trigger, files kept until their epoch is committed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from pulsegrid.sources.scratch import file_system

#: Points after which a trigger takes no further files.
MAX_POINTS = 5000
#: Tasks up to which every file of a trigger has its own; files and bytes that a task reads at most beyond that (one file always).
FILE_TASKS, TASK_FILES, TASK_BYTES = 64, 2000, 16_000_000
#: Files that are deleted at a time.
DELETES = 16


def park(files: DataFrame, path: str) -> None:
    """Writes files (host, file_name, payload) to the folders of their hosts, each under another name first, as a sender does."""
    uri = uri_of(files.sparkSession, path)

    def put(rows: Iterator) -> None:
        system, top = fs.FileSystem.from_uri(uri)
        for r in rows:
            system.create_dir(f"{top}/{r.host}", recursive=True)
            with system.open_output_stream(f"{top}/{r.host}/{r.file_name}.tmp") as f:
                f.write(r.payload.encode())
            system.move(f"{top}/{r.host}/{r.file_name}.tmp", f"{top}/{r.host}/{r.file_name}")

    file_system(files.sparkSession, path)[0].mkdirs(file_system(files.sparkSession, path)[1])
    files.foreachPartition(put)


def uri_of(spark: SparkSession, path: str) -> str:
    """A path as Arrow reads it: with its scheme, and three slashes before a local one."""
    system, place = file_system(spark, path)
    whole = system.makeQualified(place).toUri()
    return f"file://{whole.getPath()}" if whole.getScheme() == "file" else whole.toString()


class SpoolFile(InputPartition):
    """A file, and more that the same task reads after it, as (host, name)."""

    def __init__(self, host: str, name: str, more: tuple[tuple[str, str], ...] = ()) -> None:
        self.host, self.name, self.more = host, name, more


class SpoolReader(DataSourceStreamReader):
    """An offset is the last file taken of each host: a trigger takes each host's next file, the oldest names first, until
    they hold max_points points; the files it was planned with, and no others, are read again if it is tried again.

    Names sort by time, so a host's next file is the least name over its offset. When Spark reports an offset as
    processed, files up to it are deleted, so that a new run finds what is left. A file has no more points than bytes:
    where the sizes of a trigger's files add up to less than max_points, none of them is read to make an offset;
    otherwise they are, one by one, as far as max_points reaches. Tasks read many files each where there are many.
    """

    def __init__(self, path: str, max_points: int) -> None:
        self.path, self.max_points, self.offset = path, max_points, {}
        # sizes of the files that the last offset has taken
        self.sizes: dict[tuple[str, str], int] = {}

    def files(self) -> tuple[fs.FileSystem, dict[str, list[tuple[str, int]]]]:
        """Names and sizes by host."""
        system, top = fs.FileSystem.from_uri(self.path)
        found: dict[str, list[tuple[str, int]]] = {}
        for f in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File and f.base_name.endswith(".json"):
                found.setdefault(f.path.rsplit("/", 2)[-2], []).append((f.base_name, f.size))
        return system, found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        following = {h: min((f for f in names if f[0] > self.offset.get(h, "")), default=None) for h, names in self.files()[1].items()}
        order = sorted((f[0], h, f[1]) for h, f in following.items() if f)
        few = sum(max(1, size) for _, _, size in order) < self.max_points
        system, top = fs.FileSystem.from_uri(self.path)
        points, taken, sizes = 0, dict(self.offset), {}
        for name, host, size in order:
            if points >= self.max_points:
                break
            taken[host], sizes[host, name] = name, size
            points += 0 if few else points_in(text(system, f"{top}/{host}/{name}"))
        self.offset, self.sizes = taken, sizes
        return taken

    def partitions(self, start: dict, end: dict) -> list[SpoolFile]:
        self.offset = {h: max(n, self.offset.get(h, "")) for h, n in end.items()}
        todo = [(h, n) for h, n in sorted(end.items()) if n > start.get(h, "")]
        if len(todo) <= FILE_TASKS:
            return [SpoolFile(*f) for f in todo]
        sizes = self.sizes if self.sizes.keys() >= set(todo) else {(h, n): size for h, found in self.files()[1].items() for n, size in found}
        most = min(TASK_FILES, -(-len(todo) // FILE_TASKS))
        tasks, held = [], 0
        for f in todo:
            size = sizes.get(f, 0)
            if not tasks or len(tasks[-1]) >= most or held + size > TASK_BYTES:
                tasks.append([])
                held = 0
            tasks[-1].append(f)
            held += size
        return [SpoolFile(*first, tuple(more)) for first, *more in tasks]

    def read(self, partition: SpoolFile) -> Iterator[tuple]:
        system, top = fs.FileSystem.from_uri(self.path)
        for host, name in ((partition.host, partition.name), *partition.more):
            yield host, name, text(system, f"{top}/{host}/{name}")

    def commit(self, end: dict) -> None:
        system, found = self.files()
        top = fs.FileSystem.from_uri(self.path)[1]
        gone = [f"{top}/{host}/{name}" for host, last in end.items() for name, _ in found.get(host, []) if name <= last]
        with ThreadPoolExecutor(DELETES) as pool:
            for _ in pool.map(system.delete_file, gone):
                pass


def text(system: fs.FileSystem, path: str) -> str:
    with system.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


def points_in(payload: str) -> int:
    """The points of a payload; one that cannot be read counts as one."""
    try:
        return max(1, len(json.loads(payload)["points"]))
    except (ValueError, TypeError, KeyError):
        return 1


class SpoolSource(DataSource):
    """spark.readStream.format("spool").option("path", ...).option("maxPoints", ...): host, file_name and payload."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return "host string, file_name string, payload string"

    def streamReader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(self.options["path"], int(self.options.get("maxpoints", self.options.get("maxPoints", MAX_POINTS))))


def spool_stream(spark: SparkSession, path: str, max_points: int = MAX_POINTS) -> DataFrame:
    """host, file_name and payload of the spool folders under path (one for each host), as a stream.

    path lies where the driver and all executors see it. Files of other names than *.json are left alone.
    """
    spark.dataSource.register(SpoolSource)
    return spark.readStream.format("spool").option("path", uri_of(spark, path)).option("maxPoints", max_points).load()
