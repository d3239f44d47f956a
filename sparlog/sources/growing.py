"""Log files that grow, as a stream: a Python data source that reads what was appended since the last batch (ST1)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_TAIL = 1 << 16


@dataclass
class Piece(InputPartition):
    """Bytes ``begin`` to ``end`` of a file: lines that start in it, up to ``limit``."""

    path: str
    begin: int
    end: int
    limit: int

    def __init__(self, path: str, begin: int, end: int, limit: int):
        super().__init__((path, begin, end, limit))
        self.path, self.begin, self.end, self.limit = path, begin, end, limit


def _system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))


class GrowingLogs(DataSource):
    """``spark.readStream.format("growing_logs").option("path", root)``: file_path, at (the line's first byte), line.

    Offsets hold, for every file, how many bytes of whole lines have been read.
    A line without its line feed waits for the rest; a file that became shorter
    was written anew and is read from its start; new files are picked up.
    Options: ``pattern`` (``*.jsonl``), ``skip`` (``/subagents/``; paths that
    hold it are left out) and ``pieceBytes`` (8 MB, of one task).
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return "file_path string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(dict(self.options))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.skip, self.piece = options.get("skip", "/subagents/"), int(options.get("piecebytes", options.get("pieceBytes", 8 << 20)))
        self.whole: dict[str, tuple[int, int]] = {}  # size and bytes of whole lines of each file, as last seen

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = _system(self.root)
        ends = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch(info.base_name, self.pattern) and not (self.skip and self.skip in info.path):
                size, end = self.whole.get(info.path, (-1, 0))
                if size != info.size:
                    end = _whole_lines(system, info.path, info.size)
                    self.whole[info.path] = (info.size, end)
                ends[info.path] = end
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, limit in new.items():
            begin = old.get(path, 0)
            begin = 0 if limit < begin else begin
            out += [Piece(path, at, min(at + self.piece, limit), limit) for at in range(begin, limit, self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        system, _ = _system(self.root)
        with system.open_input_file(partition.path) as f:
            at = partition.begin
            if at:
                f.seek(at - 1)
                at += len(_rest_of_line(f, partition.limit - at + 1)) - 1  # a line that began before belongs to the piece before
            f.seek(at)
            while at < partition.end:
                line = _rest_of_line(f, partition.limit - at)
                if not line:
                    break
                yield (partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at += len(line)
                f.seek(at)


def _rest_of_line(f, most: int) -> bytes:
    """Bytes up to the next line feed, with it, of ``most`` bytes."""
    out = b""
    while len(out) < most:
        block = f.read(min(_TAIL, most - len(out)))
        if not block:
            break
        k = block.find(b"\n")
        if k >= 0:
            return out + block[: k + 1]
        out += block
    return out


def _whole_lines(system, path: str, size: int) -> int:
    """The end of the last line feed, searched from the end."""
    with system.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - _TAIL)
            f.seek(begin)
            k = f.read(end - begin).rfind(b"\n")
            if k >= 0:
                return begin + k + 1
            end = begin
    return 0
