"""A streaming source of appended lines: its offset is a byte position in each file, so a line that a worker appends to a
file comes once, however often the stream is started again. A line without its end waits until it is whole.

A file that has become shorter was written anew and is read from its start. Blank lines are passed over. Bytes that are
no UTF-8 become replacement marks. Files are listed by the driver and read in ranges of RANGE_BYTES by the tasks, through
Arrow's file systems, so a folder may lie in any store that both reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 32 << 20
BLOCK = 1 << 16


def opened(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole_lines(store, path: str, size: int) -> int:
    """The position after the last line end before `size`."""
    with store.open_input_file(path) as file:
        end = size
        while end > 0:
            begin = max(0, end - BLOCK)
            at = file.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


@dataclass
class Range(InputPartition):
    """Lines of a file that start in begin..end; stop is where its whole lines end."""

    path: str
    begin: int
    end: int
    stop: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, folder = opened(self.folder)
        files = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {x.path: whole_lines(store, x.path, x.size) for x in sorted(files, key=lambda x: x.path) if x.type == fs.FileType.File and fnmatch(x.base_name, self.pattern)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            begin = 0 if begin > stop else begin
            out += [Range(path, a, min(a + RANGE_BYTES, stop), stop) for a in range(begin, stop, RANGE_BYTES)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = opened(self.folder)
        with store.open_input_file(partition.path) as file:
            at = partition.begin
            if at and file.read_at(1, at - 1) != b"\n":  # the range before has this line
                at = self._line_end(file, at, partition.stop)
            while at < partition.end:
                after = self._line_end(file, at, partition.stop)
                line = file.read_at(after - at, at).decode("utf-8", "replace").rstrip("\r\n")
                if line.strip():
                    yield partition.path, at, line
                at = after

    def _line_end(self, file, at: int, stop: int) -> int:
        while at < stop:
            block = file.read_at(min(BLOCK, stop - at), at)
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
        return stop

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def appended_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """file, at (byte position), line: each line of the folder's files once, as it is appended."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).option("pattern", pattern).load(folder)
