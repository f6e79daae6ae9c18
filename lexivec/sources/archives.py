"""Zip archives of texts as a data source: batch reads, streams of archives as they come, and a sink.

``spark.read.format("text_archive").load(folder)`` gives (archive, name, content), one row for each member of the folder's ``*.zip`` files. An archive is cut into
partitions by its size alone (``partBytes``), each taking every n-th member, so planning lists files and opens none. Streams take
archives in the order of their names, so later ones must be named later (by date, say); an offset is the last name taken, and ``archivesPerBatch`` bounds a batch.
As a sink, each task writes archives of about ``archiveBytes``, under names that readers pass over until the job commits.

Defined cases: members that are no UTF-8 have U+FFFD for what can't be decoded; folders inside of archives and empty archives give no rows; null contents are written as empty texts;
a null, empty or repeated name within a task is replaced by the place of its row, so that no row is lost; paths are any that ``pyarrow.fs`` opens on every executor.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lexivec.workers import ship

SCHEMA = "archive string, name string, content string"
#: Rows and bytes of a batch that a reader gives.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Archives up to this size are read whole: the directory of a zip file is looked for beyond the beginning of a tiny one.
SMALL = 1 << 20


@dataclass
class Part(InputPartition):
    """Every n-th member of an archive."""

    path: str
    place: int
    n: int


@dataclass
class Written(WriterCommitMessage):
    names: list


def _open(options: dict) -> tuple[fs.FileSystem, str]:
    path = options["path"]
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _archives(options: dict) -> list[fs.FileInfo]:
    store, folder = _open(options)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.base_name.endswith(".zip") and f.base_name[0] not in "._"), key=lambda f: f.base_name)


def _parts(options: dict, archives: list[fs.FileInfo]) -> list[Part]:
    size = int(options.get("partbytes", 64 << 20))
    return [Part(f.path, i, n) for f in archives for n in [max(1, -(-f.size // size))] for i in range(n)]


def _read(options: dict, part: Part) -> Iterator[pa.RecordBatch]:
    store, _ = _open(options)
    archive, held, size = part.path.rsplit("/", 1)[-1], [], 0
    with store.open_input_file(part.path) as raw, zipfile.ZipFile(io.BytesIO(raw.read()) if raw.size() <= SMALL else raw) as members:
        for member in [m for m in members.infolist() if not m.is_dir()][part.place :: part.n]:
            content = members.read(member).decode("utf-8", "replace")
            held.append((archive, member.filename, content))
            size += len(content)
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["archive", "name", "content"])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Part]:
        return _parts(self.options, _archives(self.options))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition) if partition else iter(())


class ArchiveStream(DataSourceStreamReader):
    """Archives in the order of their names; an offset is the last name taken."""

    def __init__(self, options: dict):
        self.options, self.last = dict(options), None

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = [f.base_name for f in _archives(self.options) if f.base_name > (self.last or "")]
        most = int(self.options.get("archivesperbatch", 1000))
        return {"after": names[:most][-1] if names else self.last or ""}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.last = max(self.last or "", end["after"])
        return _parts(self.options, [f for f in _archives(self.options) if start["after"] < f.base_name <= end["after"]])

    def commit(self, end: dict) -> None:
        self.last = max(self.last or "", end["after"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)


class ArchiveWriter(DataSourceWriter):
    """Each task's archives are written under hidden names; the commit of the job gives them their own."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.job = dict(options), uuid.uuid4().hex
        self.old = [f.path for f in _archives(self.options)] if overwrite else []

    def write(self, iterator) -> Written:
        store, folder = _open(self.options)
        store.create_dir(folder)
        most, made, task, used = int(self.options.get("archivebytes", 64 << 20)), [], uuid.uuid4().hex, set()
        raw = out = None
        for place, row in enumerate(iterator):
            if out is None:
                made.append(f"{self.options.get('prefix', 'part')}-{task}-{len(made):05d}.zip")
                raw = store.open_output_stream(f"{folder}/.{made[-1]}")
                out = zipfile.ZipFile(_Counted(raw), "w", zipfile.ZIP_DEFLATED)
            name = row["name"] if row["name"] and row["name"] not in used else f"row-{task}-{place}"
            used.add(name)
            out.writestr(name, (row["content"] or "").encode())
            if out.fp.tell() >= most:
                out.close(), raw.close()
                out, used = None, set()
        if out is not None:
            out.close(), raw.close()
        return Written(made)

    def commit(self, messages: list) -> None:
        store, folder = _open(self.options)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{folder}/.{name}", f"{folder}/{name}")
        for path in self.old:
            store.delete_file(path)

    def abort(self, messages: list) -> None:
        store, folder = _open(self.options)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{folder}/.{name}")


class _Counted(io.RawIOBase):
    """A stream that can't seek, which knows how far it is."""

    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self.raw.write(bytes(b))
        self.at += len(b)
        return len(b)

    def tell(self) -> int:
        return self.at


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the archives in a folder; the source is the archive's name, a slash and the member's."""
    register(spark)
    rows = spark.read.format("text_archive").load(path)
    source = F.concat_ws("/", "archive", "name")
    return rows.select(F.sha2(F.concat_ws("|", source, "content"), 256).alias("doc_id"), "content", F.create_map(F.lit("filename"), F.col("name"), F.lit("archive"), F.col("archive")).alias("metadata"), source.alias("source"))
