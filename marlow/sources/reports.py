"""A splittable source of concatenated reports: ``spark.read.format("reports")``.

A file holds reports one after the other, each under a ruled header.  Files are cut into byte ranges, one a task; a task owns the
reports whose header's title begins within its range, looks back for the start of the rule above the first of them and reads
on behind its range to the end of the last.  So any cut gives the same reports, and one huge file is read by many tasks, each
holding a report at a time.

Paths may be of any store that ``pyarrow.fs`` knows (local, HDFS, S3, GCS).  Options: ``path`` (a file or a folder of files) and ``split`` (bytes
of a range, 32 MB).  Columns: subject_id (of the header, as text), path, start (byte), block (without white space at its end, then one line break).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The title of a report between its rules.
TITLE = b"\nEVIDENCE ALIGNMENT REPORT: Patient "
HEADER = re.compile(rb"\nEVIDENCE ALIGNMENT REPORT: Patient (\d+)\n=")
#: Longest title line with its number and what follows that must be seen at once, and bytes read at a time.
REACH, STEP = 128, 1 << 20


def opened(path: str):
    """(file system, path within it); a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9]+:", path) else f"file://{path}")


def titles(f, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(byte of the line break before the title, number) of all titles that begin from ``begin`` to ``end`` and stand under a rule."""
    at = begin
    while at < end:
        f.seek(max(0, at - 1))
        back = at - max(0, at - 1)
        data = f.read(STEP + REACH + back)
        for m in HEADER.finditer(data):
            place = at - back + m.start()
            if at <= place < min(end, at + STEP) and m.start() and data[m.start() - 1 : m.start()] == b"=":
                yield place, m[1]
        at += STEP


def rule_start(f, place: int) -> int:
    """Where the run of ``=`` that ends at ``place`` begins."""
    while place:
        low = max(0, place - 4096)
        f.seek(low)
        data = f.read(place - low)
        bare = data.rstrip(b"=")
        place = low + len(bare)
        if bare:
            return place
    return 0


def blocks(f, begin: int, end: int, size: int) -> Iterator[tuple[str, int, str]]:
    """(number, start, block) of the reports that a range owns."""
    before: tuple[int, str] | None = None

    def block(start: int, stop: int) -> str:
        f.seek(start)
        return f.read(stop - start).decode("utf-8", "replace").rstrip() + "\n"

    for place, number in titles(f, begin, end, size):
        start = rule_start(f, place)
        if before:
            yield before[1], before[0], block(before[0], start)
        before = (start, number.decode())
    if before:
        follow = next(titles(f, max(end, begin), size, size), None)
        yield before[1], before[0], block(before[0], rule_start(f, follow[0]) if follow else size)


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, size: int):
        self.path, self.begin, self.end, self.size = path, begin, end, size


class ReportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", 32 << 20))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = opened(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [x for x in files if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        return [Range(x.path, lo, min(x.size, lo + self.split), x.size) for x in sorted(files, key=lambda x: x.path) for lo in range(0, x.size, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as f:
            for number, start, text in blocks(f, partition.begin, partition.end, partition.size):
                yield number, partition.path, start, text


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "subject_id string, path string, start long, block string"

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options)


def read_reports(spark: SparkSession, path: str, split: int = 32 << 20) -> DataFrame:
    """The reports of all files under ``path``."""
    spark.dataSource.register(ReportSource)
    return spark.read.format("reports").option("split", split).load(path)
