"""Members of archives (tar, compressed or not, zip, and 7z in a zip where its library is
there) as rows, by a Spark data source.

Planning reads the directories of zip archives, and tasks take members from there, small
ones together. A tar archive has no directory: one task streams through it. A member goes
by in pieces, so that neither it nor its archive is ever held, whatever its size; 7z
archives alone are, as they can't be streamed.
"""

from __future__ import annotations

import codecs
import fnmatch
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pieces of a member handed over at once, and bytes read at once.
PIECES, READ = 5000, 1 << 20
#: Bytes, unpacked, of members of a zip archive that one task takes.
TASK = 64 << 20
ROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("ord", pa.int64()), ("value", pa.string())])


@contextmanager
def _file(uri: str) -> Iterator[io.IOBase]:
    """A file of a folder that all executors share, or of a file system that Arrow knows."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        with open(unquote(parts.path) if parts.scheme else uri, "rb") as held:
            yield held
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as held:
        yield held


def _zip_opened(packed: zipfile.ZipFile, names: list[str]) -> Iterator[tuple[str, io.IOBase]]:
    for name in names:
        if name.endswith(".7z"):
            yield from _opened_7z(packed.read(name))
        else:
            with packed.open(name) as member:
                yield name, member


def _tar_opened(held: io.IOBase) -> Iterator[tuple[str, io.IOBase]]:
    with tarfile.open(fileobj=held, mode="r|*") as packed:
        for member in packed:
            if member.isfile():
                yield member.name, packed.extractfile(member)


def _opened_7z(content: bytes) -> Iterator[tuple[str, io.IOBase]]:
    try:
        import py7zr
    except ModuleNotFoundError as missing:
        raise NotImplementedError("a 7z archive needs the library py7zr") from missing
    with py7zr.SevenZipFile(io.BytesIO(content)) as packed:
        yield from packed.readall().items()


def _pieces(source: io.IOBase, separator: str) -> Iterator[str]:
    decoder, held, tail = codecs.getincrementaldecoder("utf-8")(), [], ""
    while block := source.read(READ):
        *whole, rest = (tail + decoder.decode(block)).split(separator)
        if whole:
            yield "".join([*held, whole[0]])
            yield from whole[1:]
            held = []
        # A separator may begin in the last characters; a long piece is joined once.
        at = max(0, len(rest) - len(separator) + 1)
        held.append(rest[:at])
        tail = rest[at:]
    if rest := "".join([*held, tail, decoder.decode(b"", final=True)]):
        yield rest


def _rows(archive: str, member: str, source: io.IOBase, separator: str) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        n = len(held)
        columns = ([archive] * n, [member] * n, range(first, first + n), held)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW, strict=True)], schema=ROW)

    held, first = [], 0
    for piece in _pieces(source, separator):
        held.append(piece)
        if len(held) == PIECES:
            yield batch()
            held, first = [], first + PIECES
    if held:
        yield batch()


class _Members(InputPartition):
    def __init__(self, archive: str, names: list[str] | None):
        """names: members of a zip archive; None: all of a tar archive."""
        super().__init__(archive)
        self.archive, self.names = archive, names


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.archives, self.pattern = json.loads(options["archives"]), options.get("names", "*")
        self.separator = options.get("separator", "\n")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for archive in self.archives:
            with _file(archive) as held:
                if zipfile.is_zipfile(held):
                    out += self._tasks(archive, held)
                else:
                    out.append(_Members(archive, None))
        return out or [_Members("", [])]

    def _tasks(self, archive: str, held: io.IOBase) -> Iterator[_Members]:
        names, size = [], 0
        with zipfile.ZipFile(held) as packed:
            for member in packed.infolist():
                if member.is_dir() or not (fnmatch.fnmatch(member.filename, self.pattern) or member.filename.endswith(".7z")):
                    continue
                if names and size + member.file_size > TASK:
                    yield _Members(archive, names)
                    names, size = [], 0
                names, size = [*names, member.filename], size + member.file_size
        if names:
            yield _Members(archive, names)

    def read(self, partition: _Members) -> Iterator[pa.RecordBatch]:
        if partition.names == []:
            return
        with _file(partition.archive) as held:
            if partition.names is None:
                yield from self._found(partition.archive, _tar_opened(held))
            else:
                with zipfile.ZipFile(held) as packed:
                    yield from self._found(partition.archive, _zip_opened(packed, partition.names))

    def _found(self, archive: str, opened: Iterator[tuple[str, io.IOBase]]) -> Iterator[pa.RecordBatch]:
        for name, source in opened:
            if fnmatch.fnmatch(name, self.pattern):
                yield from _rows(archive, name, source, self.separator)


class ArchiveSource(DataSource):
    """spark.read.format("archive_members") with the options archives (addresses, a list in
    JSON), names (a pattern of shells) and separator."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, ord long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _listed(spark: SparkSession, paths: list[str]) -> list[str]:
    """Addresses of the files that the paths, which may be patterns, name; raises
    FileNotFoundError for one that names none."""
    out = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
        if not found:
            raise FileNotFoundError(path)
        out += [f.getPath().toUri().toString() for f in found if f.isFile()]
    return out


def members(spark: SparkSession, path: str | list[str], names: str = "*", separator: str = "\n") -> DataFrame:
    """archive, member, ord, value: the pieces, between separators, of the text files whose
    names match a pattern of shells, in order. A piece of white space only is kept."""
    spark.dataSource.register(ArchiveSource)
    archives = _listed(spark, [path] if isinstance(path, str) else list(path))
    options = {"archives": json.dumps(archives), "names": names, "separator": separator}
    return spark.read.format("archive_members").options(**options).load()
