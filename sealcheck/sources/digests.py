"""File digests without a file in a row: every file is read in ranges with a running SHA-256.

    digests.file_digests(spark, "file:///work/samples")    # path, length, sha256

The files are listed on the driver (names and sizes only) and dealt to tasks by size. One file is one task's work, as the digest is
sequential, but never more than ``RANGE_BYTES`` of it are held. Stores that the workers' Python cannot open go through
``captures.with_sha256`` over the binary file source, which holds whole files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 8 << 20
#: Files share a task up to this size and number.
TASK_BYTES, TASK_FILES = 256 << 20, 1_000
SCHEMA = "path string, length bigint, sha256 string"


def _opened(uri: str):
    """(file system, path in it)"""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def running_digest(stream, size: int = RANGE_BYTES) -> tuple[int, str]:
    """(length, SHA-256) of a binary stream."""
    digest, length = hashlib.sha256(), 0
    while part := stream.read(size):
        digest.update(part)
        length += len(part)
    return length, digest.hexdigest()


@dataclass
class Files(InputPartition):
    paths: list[str]


class FileDigestReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Files]:
        from pyarrow import fs
        system, path = _opened(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        dealt, held = [Files([])], 0
        for info in sorted((i for i in found if i.type == fs.FileType.File), key=lambda i: i.path):
            if dealt[-1].paths and (held + info.size > TASK_BYTES or len(dealt[-1].paths) >= TASK_FILES):
                dealt.append(Files([]))
                held = 0
            dealt[-1].paths.append(info.path)
            held += info.size
        return dealt

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _opened(self.root)
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                yield (path, *running_digest(stream))


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileDigestReader:
        return FileDigestReader(self.options["path"])


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of every file below ``root``, or of the file ``root``."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").load(root)
