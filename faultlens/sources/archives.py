"""Source trees packed in tar or zip archives, as a data source with splits.

An archive is read in ranges of bytes: a range takes the members whose header begins in
it, by the directory at the end (zip) or hopping from header to header (tar). So that
no range of a tar file hops over those before it, one pass over its headers first finds
where ranges begin; these are rows that Spark deals out. Compressed tar files can't be entered in the middle and are
one range each. Members that no analysis wants, by ending or by a pruned directory, are
passed over without being read, and where the schema has no ``content`` nothing but
headers is, once an archive. The driver sees the archives' names and sizes alone.

Files are reached through Arrow's file systems, so a folder may be a mounted one or any
address these know. Writing packs each partition into one archive, under a name that
is given when the job commits; what a lost task has written is never read.

Results in special cases: a member's first directory is its repository, and a member
without one has none (null); links and directories are no files; of a path that
repeats each member is a row; an empty archive has no rows; a null content is written as
an empty member, and rows without a path are left out.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from faultlens.catalogs import domain
from faultlens.functions import text
from faultlens.shipping import ship_package
from faultlens.sources.files import decoded, select_files

FORMAT = "source_archives"
SCHEMA = "repo_url string, path string, size_bytes bigint, content binary"
#: Where a range begins and ends, and the headers for all members that a tar file gives before it.
RANGES = "archive string, low bigint, high bigint, headers string"
ENDINGS = (".tar", ".tar.gz", ".tgz", ".zip")
#: Bytes of archive a task reads, and of members in a batch.
SPLIT, BATCH = 64 << 20, 16 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Seekable(io.RawIOBase):
    """An Arrow file as the archive modules expect one."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def readinto(self, buffer):
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)

    def seek(self, offset, whence=io.SEEK_SET):
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the file's begin")
        return self.file.seek(min(at, self.file.size()))

    def tell(self):
        return self.file.tell()


@dataclass
class _Range(InputPartition):
    path: str
    low: int
    high: int | None


@dataclass
class _Written(WriterCommitMessage):
    names: list


def wanted(path: str) -> bool:
    """Whether a file of a tree is analysed: its ending is known, no directory of it is pruned."""
    parts = path.split("/")
    dot = parts[-1].rfind(".")
    return parts[-1][dot:] in domain.EXTENSION_LANGUAGE and not set(parts[:-1]) & set(domain.SKIP_DIRS) if dot >= 0 else False


def _tar_members(file, low: int, high: int | None, packed: bool, headers: str | None):
    """(name, size, function that reads it) of members whose header begins in the range;
    with ``headers``, a member's header begins at ``low``."""
    if packed:
        archive = tarfile.open(fileobj=file, mode="r|gz")
        for member in archive:
            if member.isfile():
                yield member.name, member.size, lambda m=member: archive.extractfile(m).read()
        return
    if headers is not None:
        file.seek(low)
    archive = tarfile.open(fileobj=file, mode="r:", pax_headers=json.loads(headers or "{}"))
    while (member := archive.next()) is not None:
        archive.members.clear()  # else every header passed by is kept
        if high is not None and member.offset >= high:
            return
        if member.offset >= low and member.isfile():
            yield member.name, member.size, lambda m=member: archive.extractfile(m).read()


def _tar_ranges(file, split: int):
    """(low, high, headers) of ranges of about ``split`` bytes, each from a member's header on."""
    archive = tarfile.open(fileobj=file, mode="r:")
    low, headers = 0, "{}"
    while (member := archive.next()) is not None:
        archive.members.clear()
        if member.offset // split > low // split:
            yield low, member.offset, headers
            low, headers = member.offset, json.dumps(archive.pax_headers)
    yield low, None, headers


def _zip_members(file, low: int, high: int | None):
    archive = zipfile.ZipFile(file)
    for member in sorted(archive.infolist(), key=lambda m: m.header_offset):
        if low <= member.header_offset and (high is None or member.header_offset < high) and not member.is_dir():
            yield member.filename, member.file_size, lambda m=member: archive.read(m)


def _record_batch(columns, rows):
    kinds = {"repo_url": pa.string(), "path": pa.string(), "size_bytes": pa.int64(), "content": pa.binary(),
             "archive": pa.string(), "low": pa.int64(), "high": pa.int64(), "headers": pa.string()}
    return pa.record_batch([pa.array(c, kinds[n]) for n, c in zip(columns, zip(*rows))], columns)


def _opened(system, archive: str):
    raw = system.open_input_file(archive)
    return raw, io.BufferedReader(_Seekable(raw), 4096)


def _files(system, columns, everything: bool, archive: str, low: int, high: int | None, headers: str | None = None):
    """Batches of the files of a range."""
    raw, file = _opened(system, archive)
    with raw, file:
        if archive.endswith(".zip"):
            members = _zip_members(file, low, high)
        else:
            members = _tar_members(file, low, high, not archive.endswith(".tar"), headers)
        held, total = [], 0
        for name, size, body in members:
            repository, _, path = name.removeprefix("./").partition("/")
            repository, path = (repository, path) if path else (None, repository)
            if not everything and not wanted(path):
                continue
            given = {"repo_url": repository, "path": path, "size_bytes": size}
            if "content" in columns:
                given["content"] = body()
                total += size
            held.append(tuple(given[c] for c in columns))
            if total >= BATCH or len(held) >= 10_000:
                yield _record_batch(columns, held)
                held, total = [], 0
        if held:
            yield _record_batch(columns, held)


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = schema.fieldNames()
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT))
        self.everything = options.get("everything", "false").lower() == "true"

    def partitions(self):
        from pyarrow import fs

        system, path = _system(self.path)
        ranges = []
        for found in system.get_file_info(fs.FileSelector(path, recursive=True)):
            hidden = found.base_name.startswith(("_", "."))
            if hidden or not found.is_file or not found.base_name.endswith(ENDINGS):
                continue
            whole = found.base_name.endswith((".gz", ".tgz")) or found.size <= self.split
            if "low" in self.columns:
                whole = whole or found.base_name.endswith(".tar")
            elif "content" not in self.columns:
                whole = True  # its headers are read once, not once a range
            cuts = [0] if whole else list(range(0, found.size, self.split))
            ranges += [_Range(found.path, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
        return ranges or [_Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = _system(self.path)
        if "low" in self.columns:
            yield from self._ranges(system, partition)
        else:
            yield from _files(system, self.columns, self.everything, partition.path, partition.low, partition.high)

    def _ranges(self, system, partition):
        if not partition.path.endswith(".tar"):
            yield _record_batch(self.columns, [(partition.path, partition.low, partition.high, None)])
            return
        raw, file = _opened(system, partition.path)
        with raw, file:
            for low, high, headers in _tar_ranges(file, self.split):
                yield _record_batch(self.columns, [(partition.path, low, high, headers)])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.kind = options["path"], options.get("kind", "tar")
        if self.kind not in ("tar", "tar.gz", "zip"):
            raise ValueError(f"no such kind of archive: {self.kind}")
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        # Hidden, and new in each attempt.
        name = f"{self.job}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.{self.kind}"
        some = False
        with system.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            archive = (zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if self.kind == "zip"
                       else tarfile.open(fileobj=out, mode="w|gz" if self.kind == "tar.gz" else "w|"))
            with archive:
                for batch in iterator:
                    columns = (batch.column(batch.schema.get_field_index(c)).to_pylist()
                               for c in ("repo_url", "path", "content"))
                    for repository, path, content in zip(*columns):
                        if path is None:
                            continue
                        full, body, some = f"{repository}/{path}" if repository else path, content or b"", True
                        if self.kind == "zip":
                            archive.writestr(zipfile.ZipInfo(full), body, zipfile.ZIP_DEFLATED)
                        else:
                            member = tarfile.TarInfo(full)
                            member.size = len(body)
                            archive.addfile(member, io.BytesIO(body))
        return _Written([name] if some else [])

    def commit(self, messages):
        system, folder = _system(self.path)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages):
        """Nothing was named, so nothing is read."""


class SourceArchives(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.dataSource.register(SourceArchives)
    return spark


def list_archives(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """Analysed files of all archives, without their content: only headers are read."""
    listing = _registered(spark).read.format(FORMAT).schema("repo_url string, path string, size_bytes bigint")
    return select_files(listing.option("splitBytes", split).load(folder))


def read_archives(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """The ``files`` table of all archives of a folder."""
    ranges = _registered(spark).read.format(FORMAT).schema(RANGES).option("splitBytes", split).load(folder)
    columns = ["repo_url", "path", "size_bytes", "content"]

    def files(batches):
        system, _ = _system(folder)
        for batch in batches:
            for part in batch.to_pylist():
                yield from _files(system, columns, False, part["archive"], part["low"], part["high"], part["headers"])

    # Dealt out evenly: a number that is given is not made smaller for rows as short as these.
    found = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(files, SCHEMA)
    body, ok = decoded(F.col("content"))
    return select_files(found).select(
        "repo_url", "path", "ext", "language",
        text.unify_newlines(body).alias("content"), ok.alias("decode_ok"), "size_bytes")


def write_archives(files: DataFrame, folder: str, kind: str = "tar") -> None:
    """Pack ``files(repo_url, path, content)``: an archive (``tar``, ``tar.gz`` or ``zip``) a partition."""
    _registered(files.sparkSession)
    files.select("repo_url", "path", F.col("content").cast("binary").alias("content")).write.format(
        FORMAT).option("kind", kind).mode("append").save(folder)
