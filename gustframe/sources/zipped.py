"""Zip files as a data source of Spark: a partition for each member, read line by line."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines, and bytes of text, that a batch between Python and Spark holds at most (a single longer line makes a batch of its own).
BATCH_LINES, BATCH_BYTES = 50_000, 8 << 20
SCHEMA = "path string, member string, line_no long, line string"


class Member(InputPartition):
    """One member of one file."""

    def __init__(self, path: str, member: str) -> None:
        self.path, self.member = path, member


def _opened(path: str):
    """(file system, path in it) by the path's scheme: local files, hdfs, s3 and gs as far as Arrow was built with them."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), path)


class _Seekable(io.RawIOBase):
    """An Arrow file that answers a seek before its start as Python's files do, which zipfile relies on."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e

    def tell(self) -> int:
        return self.file.tell()


def _unzipped(raw: pa.NativeFile) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(_Seekable(raw), 1 << 18))


class ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.encoding = options.get("encoding", "latin-1")
        self.members = re.compile(options["members"]) if options.get("members") else None

    def partitions(self) -> list[Member]:
        """Reads the directories of the zip files only, which stand at their ends."""
        from pyarrow import fs

        system, base = _opened(self.path)
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.extension.lower() == "zip"), key=lambda f: f.path):
            with system.open_input_file(f.path) as raw, _unzipped(raw) as z:
                out += [Member(f.path, i.filename) for i in z.infolist() if not i.is_dir() and (self.members is None or self.members.search(i.filename))]
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        def batch(first: int, lines: list[str]) -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * n, pa.string()), pa.array([partition.member] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], names=["path", "member", "line_no", "line"]
            )

        if partition is None:  # what Spark asks for where there are no partitions
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as raw, _unzipped(raw) as z, z.open(partition.member) as f:
            lines, held, first = [], 0, 0
            for line in io.TextIOWrapper(f, self.encoding):
                lines.append(line.rstrip("\r\n"))
                held += len(line)
                if len(lines) >= BATCH_LINES or held >= BATCH_BYTES:
                    yield batch(first, lines)
                    lines, held, first = [], 0, first + len(lines)
            if lines:
                yield batch(first, lines)


class ZipLines(DataSource):
    """spark.read.format("ziplines"): options path, encoding, members (a regular expression that a member's name has to meet)."""

    @classmethod
    def name(cls) -> str:
        return "ziplines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def zip_lines(spark: SparkSession, path: str, encoding: str = "latin-1", members: str | None = None) -> DataFrame:
    """(path, member, line_no, line) of the members of a zip file, or of all below a folder.

    A task reads one member through a seekable file, so neither a file nor a member is held whole; a lost task reads its member again.
    Members with the same name in one file are told apart by nothing: the last one is read for each. Empty members and files without
    members have no rows; a damaged file fails the read.
    """
    spark.dataSource.register(ZipLines)
    reader = spark.read.format("ziplines").option("encoding", encoding)
    return (reader.option("members", members) if members else reader).load(path)
