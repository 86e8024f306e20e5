"""A folder of files as a Spark data source, for batches and streams.

``spark.read.format("weftline_files")`` and ``spark.readStream.format(...)`` give
pieces of files: (file_path, file_name, file_type, file_size, piece, start, text,
problem). Line-based text is cut into byte ranges of about ``pieceBytes``, so a large
file is many pieces over many tasks; a line belongs to the range in which it begins,
so a line longer than a range is one piece and ranges it covers are none.
Other types are one piece by their parser. Small pieces share a task up to
``partBytes``, so a million small files are not a million tasks.

A stream keeps a log of what it has seen in the folder ``log``, which driver and
executors share: numbered lists of files, each moved to its place whole. An offset is the
number of lists, so it stays small, and after a restart the same offsets mean the
same files whatever has arrived or gone since. A file is read once; one whose size or
time of change differs from the one seen is read as a new file.

Options: path (or the argument of load), glob (of file names, "*"), recursive
("true"), pieceBytes (8 MB), partBytes (128 MB); streams: log, maxFiles for a batch
(1,000). Paths may be local ones or addresses pyarrow's file systems know. Names are
listed on the driver, contents are read by tasks.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from weftline.sources import files

NAME = "weftline_files"
SCHEMA = "file_path string, file_name string, file_type string, file_size long, piece int, start long, text string, problem string"
#: Types whose text may be cut at line ends.
BY_LINES = ("txt", "md", "markdown", "jsonl", "log")
PIECE_BYTES, PART_BYTES, MAX_FILES = 8 << 20, 128 << 20, 1000


def opened(address: str):
    """(file system, path) of an address or a local path."""
    from pyarrow import fs

    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


class Pieces(InputPartition):
    """What one task reads: (path, size, piece, begin, end) each; end is None for a
    file that is read whole."""

    def __init__(self, pieces: list[tuple]):
        self.pieces = pieces


def file_type(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    stem, dot, kind = name.rpartition(".")
    return kind.lower() if dot and stem else ""


def pieces_of(path: str, size: int, piece_bytes: int) -> Iterator[tuple]:
    if file_type(path) not in BY_LINES or size <= piece_bytes:
        yield path, size, 0, 0, None
        return
    for k, at in enumerate(range(0, size, piece_bytes)):
        yield path, size, k, at, min(at + piece_bytes, size)


def dealt(found: list[tuple], piece_bytes: int, part_bytes: int) -> list[Pieces]:
    """Pieces in order, put together until a part is full."""
    parts, run, held = [], [], 0
    for path, size in found:
        for piece in pieces_of(path, size, piece_bytes):
            n = (size if piece[4] is None else piece[4]) - piece[3]
            if run and held + n > part_bytes:
                parts.append(Pieces(run))
                run, held = [], 0
            run.append(piece)
            held += n
    return parts + [Pieces(run)] if run else parts


def lines_in(f, begin: int, end: int) -> tuple[int, bytes]:
    """(where it begins, the lines that begin from ``begin`` to before ``end``). The line
    that reaches in from before is its own range's, and the last one may end later."""
    if begin:
        f.seek(begin - 1)
        begin += len(f.readline()) - 1
    if begin >= end:
        return begin, b""
    f.seek(begin)
    data = f.read(end - begin)
    return begin, data if data.endswith(b"\n") else data + f.readline()


class FolderReading:
    """What batch and stream readers share."""

    def __init__(self, options: dict, parsers: dict[str, Callable[[bytes], str]]):
        if "path" not in options:
            raise ValueError("a folder is needed: load(path) or the option path")
        self.address, self.glob = options["path"], options.get("glob", "*")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.piece_bytes, self.part_bytes = int(options.get("pieceBytes", PIECE_BYTES)), int(options.get("partBytes", PART_BYTES))
        if self.piece_bytes < 1:
            raise ValueError("pieceBytes is 1 or more")
        self.parsers = parsers

    def listed(self) -> list[tuple[str, int, int]]:
        """(path, size, time of change in nanoseconds) by path; names that begin with "_" or "." are hidden."""
        from pyarrow import fs

        system, path = opened(self.address)
        found = system.get_file_info(fs.FileSelector(path, recursive=self.recursive))
        plain = [i for i in found if i.is_file and fnmatch.fnmatchcase(i.base_name, self.glob)]
        root = path.rstrip("/")
        seen = [i for i in plain if not any(p.startswith(("_", ".")) for p in i.path[len(root):].split("/") if p)]
        return sorted((i.path, i.size, i.mtime_ns or 0) for i in seen)

    def parts(self, found: list[tuple[str, int]]) -> list[Pieces]:
        return dealt(found, self.piece_bytes, self.part_bytes)

    def read(self, part: Pieces | None) -> Iterator[tuple]:
        """The rows of a part. Spark asks for none where there are no files."""
        if part is None:
            return
        system, _ = opened(self.address)
        for path, size, piece, begin, end in part.pieces:
            kind, text, problem = file_type(path), "", None
            try:
                with _buffered(system, path) as f:
                    if end is not None:
                        begin, data = lines_in(f, begin, end)
                        if not data:
                            continue  # a line longer than the range is the range's before it
                        text = files.parse_text(data) if begin == 0 else data.decode("utf-8", "replace")
                    elif kind in self.parsers:
                        text = self.parsers[kind](f.read())
                    elif kind in BY_LINES:
                        text = files.parse_text(f.read())
                    else:
                        problem = "no parser for this type"
            except Exception as e:  # one broken file does not stop the others
                text, problem = "", f"{type(e).__name__}: {e}"
            yield path, path.rsplit("/", 1)[-1], kind.upper(), size, piece, begin, text, problem


def _buffered(system, path):
    import io

    return io.BufferedReader(system.open_input_file(path), 1 << 16)


class FolderReader(FolderReading, DataSourceReader):
    def partitions(self) -> list[Pieces]:
        return self.parts([(p, n) for p, n, _ in self.listed()])


class FolderStream(FolderReading, DataSourceStreamReader):
    def __init__(self, options: dict, parsers: dict):
        super().__init__(options, parsers)
        folder = options.get("log")
        if not folder:
            raise ValueError("a stream needs the option log, a folder that driver and executors share")
        self.most = int(options.get("maxFiles", MAX_FILES))
        self.log, self.log_path = opened(folder)
        self.log.create_dir(self.log_path, recursive=True)
        self.lists, self.seen = 0, set()

    def __getstate__(self) -> dict:
        """Tasks need neither the log nor the names seen."""
        return {**self.__dict__, "seen": set(), "lists": 0}

    def _entry(self, n: int) -> str:
        return f"{self.log_path.rstrip('/')}/{n:012d}.json"

    def _list(self, n: int) -> list[list]:
        with self.log.open_input_stream(self._entry(n)) as f:
            return json.loads(f.read())

    def _known(self, n: int) -> bool:
        from pyarrow import fs

        return self.log.get_file_info(self._entry(n)).type != fs.FileType.NotFound

    def _caught_up(self) -> None:
        """Read the lists made since this reader last looked."""
        while self._known(self.lists):
            self.seen.update(map(tuple, self._list(self.lists)))
            self.lists += 1

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        """Make a list of what is new. It is written beside and moved to its place, so a list is whole or not there."""
        self._caught_up()
        new = [i for i in self.listed() if i not in self.seen][: self.most]
        if new:
            beside = f"{self._entry(self.lists)}.made"
            with self.log.open_output_stream(beside) as f:
                f.write(json.dumps(new).encode())
            self.log.move(beside, self._entry(self.lists))
            self._caught_up()
        return {"lists": self.lists}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return self.parts([(p, n) for k in range(start["lists"], end["lists"]) for p, n, _ in self._list(k)])

    def commit(self, end: dict) -> None:
        """Lists stay: they are what was seen."""


def register(spark: SparkSession) -> str:
    """Make the source known to a session, with the parsers registered so far; its name."""
    known = dict(files.PARSERS)

    class Folder(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return FolderReader(self.options, known)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return FolderStream(self.options, known)

    spark.dataSource.register(Folder)
    return NAME


def documents_of(pieces: DataFrame) -> DataFrame:
    """The frame of ``files.read_documents`` from files of one piece. Larger ones stay
    in pieces: they are for what works on lines, and are not put together in a task."""
    name = F.col("file_name")
    stem = F.when(F.col("file_type") == "", name).otherwise(F.substr(name, F.lit(1), F.length(name) - F.length("file_type") - 1))
    return pieces.select(F.sha2("file_path", 256).alias("document_id"), stem.alias("title"), "file_name", "file_path", "file_type", "file_size", F.lit("pending").alias("status"), "text", "problem", "piece", "start")
