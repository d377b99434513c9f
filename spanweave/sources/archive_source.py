"""Archives as a data source: spark.read.format("spanweave-archive") and df.write.format("spanweave-archive").

Reading gives (name, content), content being an entry without its closing zero byte. Options:
``path`` or ``data``, the data files, and ``index``, theirs (both: a file, a folder or a
pattern of names in one), and ``task_bytes``. A task takes a range of an index file, sized
so that its entries have about task_bytes, and seeks each; the driver lists files and reads none.
Filters on the name (= and in) are pushed down, so that a lookup reads the index
and the bytes of what it asks for.

Writing takes (name, content) or (shard, name, content), in the order in which entries shall
stand; a shard is one data and one index file, named by its number, or by the
task without one. Tasks write to a folder of the job's own; the driver moves files to their
names when all tasks have ended, and removes the folder if the job fails, so that a
failed job leaves nothing. The store must be one pyarrow opens (local or mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

FORMAT = "spanweave-archive"
TASK_BYTES = 128 << 20
_BLOCK = 1 << 20


def open_path(path: str):
    """(file system, path in it) of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str, kind: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files of a folder that have this extension, or of those a pattern fits."""
    system, inner = open_path(path)
    start = path[: len(path) - len(inner)] if "://" in path else ""
    folder, _, last = inner.rpartition("/")
    pattern = last if set("*?[") & set(last) else None
    found = fs.FileSelector(folder or ".", recursive=False) if pattern else inner
    info = system.get_file_info(found)
    if not pattern and info.type == fs.FileType.Directory:
        info, pattern = system.get_file_info(fs.FileSelector(inner, recursive=False)), f"*.{kind}"
    infos = info if isinstance(info, list) else [info]
    if not pattern and infos[0].type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((start + i.path, i.size) for i in infos if i.type == fs.FileType.File and (not pattern or fnmatch.fnmatch(i.base_name, pattern)))


def pairs(data: str, index: str) -> list[tuple[str, int, str, int]]:
    """(data, its size, index, its size) of files that belong together.

    One of each do whatever their names; of more, those whose names agree up to the
    extension. An index without a data file is refused.
    """
    of_data, of_index = _files(data, "ffdata"), _files(index, "ffindex")
    if len(of_data) == 1 and len(of_index) <= 1:
        return [(*of_data[0], *i) for i in of_index]
    stem = lambda p: p.rpartition("/")[2].rpartition(".")[0] or p.rpartition("/")[2]
    known = {stem(p): (p, n) for p, n in of_data}
    lost = [p for p, _ in of_index if stem(p) not in known]
    if lost:
        raise ValueError(f"{len(lost)} of {len(of_index)} index files have no data file of their name")
    return [(*known[stem(p)], p, n) for p, n in of_index]


@dataclass
class _Range(InputPartition):
    """Lines of an index file that begin at bytes start to end - 1."""

    data: str
    index: str
    start: int
    end: int


def _lines(index: str, start: int, end: int) -> Iterator[bytes]:
    system, inner = open_path(index)
    with system.open_input_file(inner) as file:
        at, rest = max(start - 1, 0), b""
        begin = at  # of rest
        if start:
            while block := file.read_at(_BLOCK, at):
                at += len(block)
                cut = block.find(b"\n")
                if cut >= 0:
                    rest, begin = block[cut + 1 :], at - len(block) + cut + 1
                    break
            else:
                return
        while begin < end:
            cut = rest.find(b"\n")
            if cut < 0:
                block = file.read_at(_BLOCK, at)
                if not block:
                    if rest:
                        yield rest
                    return
                at, rest = at + len(block), rest + block
                continue
            yield rest[:cut]
            rest, begin = rest[cut + 1 :], begin + cut + 1


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.data, self.index = options.get("data") or options["path"], options["index"]
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is None or f.attribute != ("name",):
                yield f
            else:
                self.names = asked if self.names is None else self.names & asked

    def partitions(self) -> list[_Range]:
        out = []
        for data, size, index, lines in pairs(self.data, self.index):
            n = max(1, -(-size // self.task_bytes))
            out += [_Range(data, index, lines * i // n, lines * (i + 1) // n) for i in range(n)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names, contents, held, file = [], [], 0, None
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])
        for line in _lines(partition.index, partition.start, partition.end):
            if not line.strip():
                continue
            name, offset, length = line.decode().split("\t")
            if self.names is not None and name not in self.names:
                continue
            if file is None:
                system, inner = open_path(partition.data)
                file = system.open_input_file(inner)
            size = max(int(length) - 1, 0)
            content = file.read_at(size, int(offset))
            if len(content) != size:
                raise ValueError(f"{partition.data} ends before entry {name}")
            names.append(name)
            contents.append(content)
            held += size
            if held > 16 << 20:
                yield batch()
                names, contents, held = [], [], 0
        yield batch()


@dataclass
class _Written(WriterCommitMessage):
    """(shard, file without extension) of what a task wrote."""

    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.out = options["path"].rstrip("/")
        self.own = f"{self.out}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        now, streams, at, files = None, None, 0, []
        system, own = open_path(self.own)
        system.create_dir(own, recursive=True)
        task = uuid.uuid4().hex
        try:
            for b in iterator:
                shards = b.column("shard").to_pylist() if "shard" in b.schema.names else [None] * b.num_rows
                for shard, name, content in zip(shards, b.column("name").to_pylist(), b.column("content").to_pylist()):
                    if streams is None or shard != now:
                        for s in streams or ():
                            s.close()
                        files.append((task if shard is None else f"{shard:05d}", f"{own}/{task}-{len(files)}"))
                        streams, now, at = [system.open_output_stream(f"{files[-1][1]}.{kind}") for kind in ("ffdata", "ffindex")], shard, 0
                    payload = (content or b"")[:-1] + b"\0"
                    streams[0].write(payload)
                    streams[1].write(f"{name[:64]}\t{at}\t{len(payload)}\n".encode())
                    at += len(payload)
        finally:
            for s in streams or ():
                s.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        system, out = open_path(self.out)
        for m in messages:
            for shard, file in m.files if m else ():
                for kind in ("ffdata", "ffindex"):
                    system.move(f"{file}.{kind}", f"{out}/part-{shard}.{kind}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, own = open_path(self.own)
        if system.get_file_info(own).type != fs.FileType.NotFound:
            system.delete_dir(own)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session, with filters pushed to it."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def open_archive(spark: SparkSession, data: str, index: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(name, content) of an archive; names are looked up in the index."""
    return register(spark).read.format(FORMAT).option("data", data).option("index", index).option("task_bytes", str(task_bytes)).load()
