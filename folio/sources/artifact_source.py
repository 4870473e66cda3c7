"""Artifacts as a Spark data source: ``spark.read.format("folio_artifacts")`` and ``df.write.format("folio_artifacts")``.

Below the path, ``data`` holds Parquet files of one family each and ``commits`` one small JSON file for each write, which names that write's
files with their family and range of entities. Readers see the files of commits only, so a lost or failed write is never seen in part; they open
those files only that the query's filters leave. An overwriting write's commit makes readers forget those before it.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "folio_artifacts"
SCHEMA = "document_id string, family string, scope string, entity_id string, content_hash string, body string"
COLUMNS = ("document_id", "family", "scope", "entity_id", "content_hash", "body")
#: Bytes of bodies after which a task begins a new file, and bytes of files that a task reads.
FILE_BYTES, TASK_BYTES = 64 << 20, 64 << 20
_ARROW = pa.schema([(c, pa.string()) for c in COLUMNS])


@dataclass(frozen=True)
class File:
    name: str
    family: str
    first: str
    last: str
    rows: int
    size: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


def committed(path: str) -> list[File]:
    """The files that readers of ``path`` see, in order of their commits."""
    system, root = _open(path)
    found: list[File] = []
    infos = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    for info in sorted((i for i in infos if i.path.endswith(".json")), key=lambda i: i.path):
        with system.open_input_stream(info.path) as source:
            commit = json.loads(source.read())
        found = [*([] if commit["overwrite"] else found), *(File(**f) for f in commit["files"])]
    return found


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class ArtifactReader(DataSourceReader):
    """Opens the committed files that filters on family and entity_id leave."""

    def __init__(self, path: str):
        self.path = path
        self.filters: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Notes what files can be told apart by; Spark still applies every filter to the rows."""
        signs = {EqualTo: "in", In: "in", GreaterThan: "over", GreaterThanOrEqual: "over", LessThan: "under", LessThanOrEqual: "under"}
        for f in filters:
            sign = signs.get(type(f))
            if sign and f.attribute in (("family",), ("entity_id",)):
                self.filters.append((f.attribute[0], sign, tuple(v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None)))
        return filters

    def _may_hold(self, file: File) -> bool:
        for column, sign, values in self.filters:
            low, high = (file.family, file.family) if column == "family" else (file.first, file.last)
            if sign == "in" and not any(low <= v <= high for v in values):
                return False
            if sign == "over" and not all(high >= v for v in values):
                return False
            if sign == "under" and not all(low <= v for v in values):
                return False
        return True

    def partitions(self) -> Sequence[Files]:
        groups: list[list[str]] = []
        size = TASK_BYTES
        for file in filter(self._may_hold, committed(self.path)):
            if size >= TASK_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(file.name)
            size += file.size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = _open(self.path)
        for name in partition.names:
            with system.open_input_file(f"{root}/data/{name}") as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=1024, columns=list(COLUMNS)):
                    yield batch.cast(_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[File, ...]


class _Output:
    """A file that is being written."""

    def __init__(self, system: fs.FileSystem, root: str, family: str):
        self.name, self.family = f"{uuid.uuid4().hex}.parquet", family
        self.writer = pq.ParquetWriter(f"{root}/data/{self.name}", _ARROW, filesystem=system)
        self.first = self.last = None
        self.rows = self.size = 0

    def add(self, rows: pa.Table) -> None:
        names = rows.column("entity_id").to_pylist()
        low, high = min(names), max(names)
        self.first = low if self.first is None else min(self.first, low)
        self.last = high if self.last is None else max(self.last, high)
        self.rows += len(names)
        self.size += rows.nbytes
        self.writer.write_table(rows)

    def close(self) -> File:
        self.writer.close()
        return File(self.name, self.family, self.first, self.last, self.rows, self.size)


class ArtifactWriter(DataSourceArrowWriter):
    """Tasks write files of their own; the driver's commit makes all of them visible at once."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(f"{root}/data", recursive=True)
        outputs: dict[str, _Output] = {}
        done: list[File] = []
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            for column in ("family", "entity_id"):
                if table.column(column).null_count:
                    raise ValueError(f"an artifact needs a {column}")
            bodies = table.column("body").to_pylist()
            hashes = pa.array([None if b is None else hashlib.sha256(b.encode()).hexdigest()[:12] for b in bodies], pa.string())
            table = pa.Table.from_arrays([hashes if c == "content_hash" else table.column(c).cast(pa.string()) for c in COLUMNS], schema=_ARROW)
            for family in table.column("family").unique().to_pylist():
                if family not in outputs:
                    outputs[family] = _Output(system, root, family)
                outputs[family].add(table.filter(pa.compute.equal(table.column("family"), family)))
                if outputs[family].size >= FILE_BYTES:
                    done.append(outputs.pop(family).close())
        return Written((*done, *(o.close() for o in outputs.values())))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(f"{root}/commits", recursive=True)
        files = [f.__dict__ for m in messages if m is not None for f in m.files]
        name = f"{root}/commits/{time.time_ns():020d}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps({"overwrite": self.overwrite, "files": files}).encode())
        system.move(f"{name}.tmp", f"{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for message in messages:
            for file in message.files if message is not None else ():
                system.delete_file(f"{root}/data/{file.name}")


class ArtifactSource(DataSource):
    """Options: path, a folder that driver and executors share. Rows: SCHEMA; the content hash is made on writing, of the body, 12 hex digits."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArtifactReader:
        return ArtifactReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        missing = {"document_id", "family", "scope", "entity_id", "body"} - set(schema.names)
        if missing:
            raise ValueError(f"artifacts need {', '.join(sorted(missing))}")
        return ArtifactWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArtifactSource)
