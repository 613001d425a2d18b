"""ZIP archives as a data source of Spark, planned by ranges of the central directory.

``spark.dataSource.register(ZipEntries)``, then ``spark.read.format("zip_entries").load(path)``.  The plan lists the archives
below the path.  An archive of more than ``split_bytes`` has its directory read at planning: if that breaks a limit, the archive
is one row with an error and none of its content is read; else its entries are cut into ranges of about ``split_bytes``, each
a partition, so that many tasks read one archive.  Smaller archives share partitions and have their directory read in the task.
Files are opened by pyarrow's file systems (local, HDFS, S3 and others, by the path's scheme), by seeking, never as a whole.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftmill.config import DEFAULT, EngineConfig

ENTRY = "archive string, entry_ord int, path string, size long, attributes long, raw binary, error string"
ARROW = pa.schema([("archive", pa.string()), ("entry_ord", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("attributes", pa.int64()), ("raw", pa.binary()), ("error", pa.string())])
#: Bytes of entries that are held before they go on.
BATCH_BYTES = 16 << 20
#: What a broken archive may raise on the way.
BROKEN = (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, zipfile.zlib.error)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


class _Raw(io.RawIOBase):
    """A file of pyarrow as Python's own files are: a place before the beginning is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.file.size()}[whence]
        if at < 0:
            raise OSError("a place before the beginning")
        self.file.seek(at)
        return at

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, out) -> int:
        data = self.file.read(len(out))
        out[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def seekable(files: pafs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(_Raw(files.open_input_file(path)), 1 << 16)


def directory_error(infos: list[zipfile.ZipInfo], config: EngineConfig) -> str | None:
    """What the central directory alone tells against an archive.  No entry yields more bytes than it declares: reading stops there and the checksum fails."""
    if len(infos) > config.max_members:
        return "TOO_MANY_MEMBERS"
    return "TOO_LARGE_UNPACKED" if sum(i.file_size for i in infos) > config.max_unpacked_bytes else None


def batches(name: str, archive: zipfile.ZipFile, infos: list[tuple[int, zipfile.ZipInfo]]) -> Iterator[pa.RecordBatch]:
    """The entries with their bytes, in batches of bounded size; folders have none."""
    rows, held = [], 0
    for k, i in infos:
        data = None if i.is_dir() else archive.read(i)
        rows.append((name, k, i.filename.replace("\\", "/"), len(data or b""), i.external_attr, data, None))
        held += len(data or b"")
        if held > BATCH_BYTES:
            yield batch_of(rows)
            rows, held = [], 0
    yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(ARROW)], schema=ARROW)


def rejected(name: str, error: str) -> pa.RecordBatch:
    return batch_of([(name, -1, None, None, None, None, error)])


@dataclass
class Part(InputPartition):
    """Archives, or the range of entries of one archive, that a task reads.  (path, error known at planning, first and last + 1 entry or None)"""

    archives: list[tuple[str, str | None, int | None, int | None]]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 32 << 20))
        names = ("max_archive_bytes", "max_members", "max_unpacked_bytes")
        self.config = EngineConfig(**{n: int(options.get(n, getattr(DEFAULT, n))) for n in names})

    def partitions(self) -> list[Part]:
        files, base = opened(self.path)
        info = files.get_file_info(base)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(base, recursive=True))
        parts, small, held = [], [], 0
        for f in sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.path):
            error = "NOT_A_ZIP_NAME" if not f.path.lower().endswith(".zip") else "ARCHIVE_TOO_LARGE" if f.size > self.config.max_archive_bytes else None
            if error is None and f.size > self.split:
                parts += [Part([x]) for x in self._ranges(files, f.path)]
                continue
            small.append((f.path, error, None, None))
            held += 0 if error else f.size
            if held >= self.split or len(small) >= 1000:
                parts.append(Part(small))
                small, held = [], 0
        return [*parts, *([Part(small)] if small or not parts else [])]

    def _ranges(self, files: pafs.FileSystem, path: str) -> list[tuple[str, str | None, int | None, int | None]]:
        try:
            with seekable(files, path) as f, zipfile.ZipFile(f) as z:
                infos = z.infolist()
        except BROKEN:
            return [(path, "NOT_A_ZIP" if self._foreign(files, path) else "BAD_ZIP", None, None)]
        if error := directory_error(infos, self.config):
            return [(path, error, None, None)]
        out, first, held = [], 0, 0
        for k, i in enumerate(infos):
            held += i.compress_size
            if held >= self.split:
                out.append((path, None, first, k + 1))
                first, held = k + 1, 0
        return out + ([(path, None, first, len(infos))] if first < len(infos) or not out else [])

    @staticmethod
    def _foreign(files: pafs.FileSystem, path: str) -> bool:
        with files.open_input_file(path) as f:
            return f.read(2) != b"PK"

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        for path, error, first, last in part.archives:
            if error:
                yield rejected(path, error)
                continue
            try:
                if self._foreign(files, path):
                    yield rejected(path, "NOT_A_ZIP")
                    continue
                with seekable(files, path) as f, zipfile.ZipFile(f) as z:
                    infos = z.infolist()
                    error = directory_error(infos, self.config)
                    if error:
                        yield rejected(path, error)
                    else:
                        yield from batches(path, z, list(enumerate(infos))[first:last])
            except BROKEN:
                yield rejected(path, "BAD_ZIP")


class ZipEntries(DataSource):
    """One row per entry (ENTRY), in the order of the directory; a rejected archive has one row with its error and entry_ord -1.

    Options: path (a file or a folder, searched through), split_bytes, and the limits max_archive_bytes, max_members and max_unpacked_bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def read_zip_entries(spark, path: str, config: EngineConfig = DEFAULT, split_bytes: int = 32 << 20) -> DataFrame:
    """The entries of the archives below a path, by the data source."""
    spark.dataSource.register(ZipEntries)
    limits = {n: str(getattr(config, n)) for n in ("max_archive_bytes", "max_members", "max_unpacked_bytes")}
    return spark.read.format("zip_entries").options(split_bytes=str(split_bytes), **limits).load(path)


def write_archives(entries: DataFrame, folder: str) -> int:
    """Write entries (archive, path, raw) as ZIP files below a folder that all executors share; the number of archives.

    A group of one archive's entries is one task, so archives should be small.  A file appears under its name when it is
    whole, so a task that is tried again replaces it."""

    def write(table: pa.Table) -> pa.Table:
        name = table.column("archive")[0].as_py()
        files, base = opened(f"{folder}/{name}")
        files.create_dir(base.rpartition("/")[0], recursive=True)
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for path, raw in sorted(zip(table.column("path").to_pylist(), table.column("raw").to_pylist(), strict=True)):
                z.writestr(zipfile.ZipInfo(path), raw, zipfile.ZIP_DEFLATED)
        part = f"{base}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(held.getbuffer())
        files.move(part, base)
        return pa.table({"archive": [name]})

    return entries.select("archive", "path", F.coalesce("raw", F.lit(b"")).alias("raw")).groupBy("archive").applyInArrow(write, "archive string").count()
