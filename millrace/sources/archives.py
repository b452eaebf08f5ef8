"""ZIP archives as a data source: batch and stream, several tasks to an archive.

spark.read.format("archives").load(path) after register(spark). The driver only lists archives;
each task reads the directory at an archive's end and inflates those members that begin in its
range of the file's bytes, so a large archive is shared out without anyone reading all of it.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..shipping import ship

SCHEMA = "repo_id string, path string, size_bytes long, content string, error string"
#: What reading a damaged member raises.
DAMAGED = (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, EOFError)


def unsafe_member(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or (len(name) > 1 and name[1] == ":")


def members(file, repo: str, length: int, most: int, first: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA of the members of an archive that begin at the bytes first to end; the archive's own error comes with its first byte.

    An archive that is too large, has no readable directory, an absolute or parent path or no
    member gives one row with its error and no member. A member that is damaged, or inflates
    to more than `most` bytes, has an error and no content; the others come as they are.
    Directories and resource forks are skipped.
    """
    fail = [] if first else [(repo, None, length)]
    if length > most:
        yield from ((*f, None, "too large") for f in fail)
        return
    try:
        z = zipfile.ZipFile(file)
    except DAMAGED as e:
        yield from ((*f, None, type(e).__name__) for f in fail)
        return
    with z:
        infos = z.infolist()
        if any(unsafe_member(i.filename) for i in infos):
            yield from ((*f, None, "unsafe path") for f in fail)
            return
        kept = [i for i in infos if not i.filename.endswith("/") and not i.filename.startswith(("__MACOSX", "._"))]
        if not kept:
            yield from ((*f, None, "empty") for f in fail)
        for i in kept:
            if i.header_offset < first or (end is not None and i.header_offset >= end):
                continue
            if i.file_size > most:  # what it says it inflates to; a member that says less fails when read
                yield (repo, i.filename, i.file_size, None, "member too large")
                continue
            try:
                yield (repo, i.filename, i.file_size, z.read(i).decode("utf-8", "ignore"), None)
            except DAMAGED as e:
                yield (repo, i.filename, i.file_size, None, type(e).__name__)


@dataclass
class Range(InputPartition):
    """The bytes of an archive in which a task's members begin; end None: to its end."""

    uri: str
    length: int
    first: int
    end: int | None


def _listed(path: str) -> list[tuple[int, str, int]]:
    """Modification time, address and length of the archives of a folder, of a pattern in its last part, or of one file; in that order."""
    from pyarrow import fs

    folder, _, name = path.rstrip("/").rpartition("/")
    pattern = name if set(name) & set("*?[") else None
    store, place = fs.FileSystem.from_uri(folder if pattern else path) if "://" in path else (fs.LocalFileSystem(), folder if pattern else path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = [f for f in store.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern or "*.zip")]
    else:
        raise FileNotFoundError(path)
    return sorted((f.mtime_ns or 0, scheme + f.path, f.size) for f in found)


def _ranges(archives: list[tuple[int, str, int]], most: int, each: int) -> list[Range]:
    out = []
    for _, uri, length in archives:
        n = 1 if length > most else max(1, -(-length // each))
        cuts = [length * k // n for k in range(n)]
        out += [Range(uri, length, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
    return out


class _File(io.RawIOBase):
    """A file of a store as zipfile expects one: a seek before its beginning is an OSError."""

    def __init__(self, file) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            self.file.seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class _Settings:
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.most = int(options.get("max_mb", 100)) << 20
        self.each = int(options.get("range_bytes", 8 << 20))

    def read(self, part: Range) -> Iterator[tuple]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(part.uri) if "://" in part.uri else (fs.LocalFileSystem(), part.uri)
        repo = part.uri.rpartition("/")[2].removesuffix(".zip")
        with store.open_input_file(place) as file:
            yield from members(io.BufferedReader(_File(file), 1 << 20), repo, part.length, self.most, part.first, part.end)


class _Batch(DataSourceReader):
    def __init__(self, options) -> None:
        self.settings = _Settings(options)

    def partitions(self) -> list[Range]:
        s = self.settings
        return _ranges(_listed(s.path), s.most, s.each)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.settings.read(partition)


class _Stream(DataSourceStreamReader):
    """Archives as they come, by modification time and name; one that appears with an earlier time than one already read is passed over."""

    def __init__(self, options) -> None:
        self.settings = _Settings(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "uri": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = _listed(self.settings.path)
        return {"time": found[-1][0], "uri": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        s = self.settings
        new = [f for f in _listed(s.path) if (start["time"], start["uri"]) < f[:2] <= (end["time"], end["uri"])]
        return _ranges(new, s.most, s.each)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.settings.read(partition)


class Archives(DataSource):
    """Options: path, max_mb (100: larger archives and members are errors), range_bytes (8 MB of an archive to a task)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Archives)


def read_archives_in_ranges(spark: SparkSession, path: str, max_mb: int = 100, range_bytes: int = 8 << 20) -> DataFrame:
    """The members of the archives at path (a folder, a pattern in its last part, a file; local or of a store that Arrow's file systems reach)."""
    register(spark)
    return spark.read.format("archives").option("max_mb", max_mb).option("range_bytes", range_bytes).load(path)
