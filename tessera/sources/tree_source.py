"""File trees as a Spark data source: listing, ranged reads and digests from executors, and copies with a commit.

    spark.read.format("tree").load(root)                                     every entry: folders, files, links, specials
    spark.read.format("tree").option("read", "sha256" | "size" | "tail")     what is read of each file besides,
                              .option("only", '["a.log"]')                   or of these files alone
    df.write.format("tree").mode("append").save(root)                        files, from content or from other files

Reading has one partition for each folder down to a level, so a large tree is walked by many tasks. Files are read in place
and in parts: a digest streams through a megabyte at a time, image sizes are found by jumping from header to header, and
the last lines by reading backwards; bytes_read tells how much that took.

Writing puts everything into a staging folder beside the target, by tasks of about TASK_FILES files dealt by path. Each file
is written under a name of its own attempt, its digest taken from the bytes as they pass, and renamed; a row that tells size or
hash and gets others fails its task. What a task wrote is forced to disk at once before it is done. When all tasks are done the staging folder is renamed to the target, which must not exist: readers see
all of it or nothing. A failed job deletes the staging folder; a task that is tried again writes the same files again.

Local folders (also as file:) are read with the operating system's calls, which tell links from what they point to; other
file systems through Arrow's, where links do not exist.
"""

from __future__ import annotations

import json
import os
import stat
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ENTRY = "relative_path string, kind string, file_size bigint, modified_at timestamp"
READS = {"": "", "sha256": ", hash string, bytes_read bigint", "size": ", width int, height int, bytes_read bigint", "tail": ", lines array<string>, bytes_read bigint"}
CHUNK = 1 << 20
#: Files of a task that writes.
TASK_FILES = 20_000
FOLDER, FILE, LINK, SPECIAL = "folder", "file", "link", "special"


class Local:
    """A folder of this machine, or one that it shares."""

    def __init__(self, root: str):
        self.root = root

    def at(self, path: str) -> str:
        return os.path.join(self.root, path) if path else self.root

    def entries(self, folder: str) -> list[tuple[str, str, int, float]]:
        """(path, kind, size, seconds) of what is in a folder; links are not followed."""
        found = []
        with os.scandir(self.at(folder)) as inside:
            for e in inside:
                told = e.stat(follow_symlinks=False)
                mode = told.st_mode
                kind = LINK if stat.S_ISLNK(mode) else FOLDER if stat.S_ISDIR(mode) else FILE if stat.S_ISREG(mode) else SPECIAL
                found.append((f"{folder}/{e.name}" if folder else e.name, kind, told.st_size if kind == FILE else 0, told.st_mtime))
        return sorted(found)

    def open(self, path: str):
        return open(self.at(path), "rb")

    def create(self, path: str):
        try:
            return open(self.at(path), "wb")
        except FileNotFoundError:
            os.makedirs(os.path.dirname(self.at(path)), exist_ok=True)
            return open(self.at(path), "wb")

    @contextmanager
    def forced(self, folder: str) -> Iterator[None]:
        """Forces to disk what is written below a folder meanwhile: one call at the end for its file system, which tells write errors."""
        import ctypes

        self.make(folder)
        opened = os.open(self.at(folder), os.O_RDONLY)
        try:
            yield
            force = getattr(ctypes.CDLL(None, use_errno=True), "syncfs", None)
            if force is None:
                os.sync()
            elif force(opened):
                raise OSError(ctypes.get_errno(), os.strerror(ctypes.get_errno()), self.at(folder))
        finally:
            os.close(opened)

    def make(self, folder: str) -> None:
        os.makedirs(self.at(folder), exist_ok=True)

    def move(self, old: str, new: str) -> None:
        os.replace(self.at(old), self.at(new))

    def exists(self, path: str) -> bool:
        return os.path.lexists(self.at(path))

    def delete(self, path: str) -> None:
        import shutil

        shutil.rmtree(self.at(path), ignore_errors=True)


class Remote:
    """A folder of any file system that Arrow reads."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def at(self, path: str) -> str:
        return f"{self.root.rstrip('/')}/{path}" if path else self.root

    def entries(self, folder: str) -> list[tuple[str, str, int, float]]:
        from pyarrow import fs

        found = []
        for i in self.fs.get_file_info(fs.FileSelector(self.at(folder))):
            kind = {fs.FileType.Directory: FOLDER, fs.FileType.File: FILE}.get(i.type, SPECIAL)
            found.append((f"{folder}/{i.base_name}" if folder else i.base_name, kind, (i.size or 0) if kind == FILE else 0, i.mtime.timestamp() if i.mtime else 0.0))
        return sorted(found)

    def open(self, path: str):
        return self.fs.open_input_file(self.at(path))

    def create(self, path: str):
        self.fs.create_dir(self.at(path).rpartition("/")[0], recursive=True)
        return self.fs.open_output_stream(self.at(path))

    def forced(self, folder: str):
        return nullcontext()

    def make(self, folder: str) -> None:
        self.fs.create_dir(self.at(folder), recursive=True)

    def move(self, old: str, new: str) -> None:
        self.fs.move(self.at(old), self.at(new))

    def exists(self, path: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self.at(path)).type != fs.FileType.NotFound

    def delete(self, path: str) -> None:
        self.fs.delete_dir(self.at(path))


def place(uri: str):
    import re

    scheme = re.match(r"([a-z][a-z0-9+.-]+):", uri)
    if scheme is None or scheme[1] == "file":
        return Local(re.sub("^file:/*", "/", uri).rstrip("/") or "/")
    return Remote(uri.rstrip("/"))


# What is read of a file


class Counted:
    """A file that tells how many bytes were read of it."""

    def __init__(self, file):
        self.file, self.n = file, 0

    def read(self, n: int) -> bytes:
        data = self.file.read(n)
        self.n += len(data)
        return data

    def part(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.read(n)


def digest_of(file: Counted, size: int) -> tuple:
    from hashlib import sha256

    seen = sha256()
    while data := file.read(CHUNK):
        seen.update(data)
    return (seen.hexdigest(),)


def size_of(file: Counted, size: int) -> tuple:
    """Width and height from PNG, JPEG and WebP headers, nulls where there is none. Pixels and metadata are jumped over."""
    head = file.part(0, 30)
    big, little = (lambda b: int.from_bytes(b, "big")), (lambda b: int.from_bytes(b, "little"))
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return big(head[16:20]), big(head[20:24])
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= size:
            marker = file.part(at, 9)
            if len(marker) < 9 or marker[0] != 0xFF:
                break
            if 0xC0 <= marker[1] <= 0xCF and marker[1] not in (0xC4, 0xC8, 0xCC):
                return big(marker[7:9]), big(marker[5:7])
            at += 2 + big(marker[2:4])
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        if head[12:16] == b"VP8X":
            return little(head[24:27]) + 1, little(head[27:30]) + 1
        if head[12:16] == b"VP8 ":
            return little(head[26:28]) & 0x3FFF, little(head[28:30]) & 0x3FFF
        if head[12:16] == b"VP8L":
            bits = little(head[21:25])
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return None, None


def tail_of(file: Counted, size: int, lines: int, step: int = 1 << 14) -> tuple:
    """The last lines of a text, read backwards; a last line may lack its end."""
    data, at = b"", size
    while at > 0 and data.count(b"\n") <= lines:
        n = min(step, at)
        at -= n
        data = file.part(at, n) + data
        step *= 2
    text = data.decode("utf-8", "replace").removesuffix("\n")
    return ([line.removesuffix("\r") for line in text.split("\n")][-lines:] if size else [],)


@dataclass
class Part(InputPartition):
    """A folder with all below it, or (deep False) what lies in it but for its folders' own entries."""

    folder: str
    deep: bool

    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.read_, self.lines = options["path"], options.get("read", ""), int(options.get("lines", 200))
        self.levels, self.only = int(options.get("levels", 1)), set(json.loads(options.get("only", "[]")))

    def partitions(self) -> Sequence[InputPartition]:
        """A part for every folder down to `levels`; those of the last level take all below them."""
        where, parts, folders = place(self.root), [Part("", self.levels == 0)], [""]
        for level in range(self.levels):
            folders = [p for f in folders for p, kind, _, _ in where.entries(f) if kind == FOLDER]
            parts += [Part(f, level == self.levels - 1) for f in folders]
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        where, waiting = place(self.root), [partition.folder]
        while waiting:
            for path, kind, size, seconds in where.entries(waiting.pop()):
                yield (path, kind, size, datetime.fromtimestamp(seconds, timezone.utc), *self._found(where, path, kind, size))
                if kind == FOLDER and partition.deep:
                    waiting.append(path)

    def _found(self, where, path: str, kind: str, size: int) -> tuple:
        if not self.read_:
            return ()
        none = (None, None) if self.read_ == "size" else (None,)
        if kind != FILE or (self.only and path not in self.only):
            return (*none, 0)
        with where.open(path) as opened:
            file = Counted(opened)
            found = digest_of(file, size) if self.read_ == "sha256" else size_of(file, size) if self.read_ == "size" else tail_of(file, size, self.lines)
            return (*found, file.n)


@dataclass
class Copied(WriterCommitMessage):
    files: int
    bytes: int


class TreeWriter(DataSourceWriter):
    """Rows: relative_path, and content (bytes) or source (another file's path), or neither for a folder; size and hash as expected, if told."""

    def __init__(self, options, schema: StructType):
        self.target, self.names, self.staging = options["path"].rstrip("/"), schema.names, f".staging-{uuid.uuid4().hex}"

    def _parent(self):
        parent, _, name = self.target.rpartition("/")
        return place(parent), name

    def write(self, rows: Iterator) -> Copied:
        where, name = self._parent()
        with where.forced(f"{name}{self.staging}"):
            return self._written(where, f"{name}{self.staging}", rows)

    def _written(self, where, staging: str, rows: Iterator) -> Copied:
        from hashlib import sha256

        files = written = 0
        for row in rows:
            told = dict(zip(self.names, row))
            path = f"{staging}/{checked(told['relative_path'])}"
            if told.get("content") is None and told.get("source") is None:
                where.make(path)
                continue
            part, seen, size = f"{path}.{uuid.uuid4().hex}.part", sha256(), 0
            with where.create(part) as out:
                for data in chunks(told):
                    seen.update(data)
                    size += len(data)
                    out.write(data)
            for what, got in (("size", size), ("hash", seen.hexdigest())):
                if told.get(what) not in (None, got):
                    raise ValueError(f"{told['relative_path']}: {what} is {got}, expected {told[what]}")
            where.move(part, path)
            files, written = files + 1, written + size
        return Copied(files, written)

    def commit(self, messages) -> None:
        where, name = self._parent()
        where.make(f"{name}{self.staging}")
        if where.exists(name):
            where.delete(f"{name}{self.staging}")
            raise FileExistsError(f"{self.target} is there already")
        where.move(f"{name}{self.staging}", name)

    def abort(self, messages) -> None:
        where, name = self._parent()
        if where.exists(f"{name}{self.staging}"):
            where.delete(f"{name}{self.staging}")


def chunks(told: dict) -> Iterator[bytes]:
    if told.get("content") is not None:
        yield bytes(told["content"])
        return
    folder, _, name = told["source"].rpartition("/")
    with place(folder).open(name) as file:
        while data := file.read(CHUNK):
            yield data


def checked(path: str) -> str:
    """A relative path that stays below its root."""
    parts = path.replace("\\", "/").split("/")
    if not path or path.startswith(("/", "\\")) or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a path below its root: {path!r}")
    return "/".join(parts)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        read = self.options.get("read", "")
        if read not in READS:
            raise ValueError(f"read is one of {sorted(READS)}")
        return ENTRY + READS[read]

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options, schema)


def entries(spark, root: str, read: str = "", levels: int = 1, lines: int = 200, only: Sequence[str] = ()):
    """The tree under root as a table; see the module."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("read", read).option("levels", levels).option("lines", lines).option("only", json.dumps(list(only))).load(root)


def write_tree(rows, root: str) -> None:
    """Writes rows as files under root, which must not be there yet; see the module. rows is evaluated twice: it is counted first."""
    spark = rows.sparkSession
    spark.dataSource.register(TreeSource)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_FILES))
    rows.repartition(tasks, "relative_path").write.format("tree").mode("append").save(root)
