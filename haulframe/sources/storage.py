"""Files and shared scratch space, through the Hadoop file system Spark itself uses."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from haulframe.functions.names import col

# Largest key set we broadcast, measured in uncompressed bytes.
BROADCAST_BYTES = 32 * 1024 * 1024

_local_scratch: dict[str, str] = {}


class Storage:
    """The file system a path lives on."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._root = self._path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_dir(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isDirectory()

    def list(self, path: str) -> list[str]:
        """Names of the direct children of a directory."""
        return [status.getPath().getName() for status in self._fs.listStatus(self._path(path))]

    def has_files(self, path: str) -> bool:
        """True if any file below the path is data, judged by its name."""
        if not self.exists(path):
            return False
        walk = self._fs.listFiles(self._path(path), True)
        while walk.hasNext():
            if not walk.next().getPath().getName().startswith(("_", ".")):
                return True
        return False

    def files(self, path: str) -> list[str]:
        """Files at any depth, relative to the directory."""
        base = self._fs.makeQualified(self._path(path)).toString().rstrip("/") + "/"
        found, walk = [], self._fs.listFiles(self._path(path), True)
        while walk.hasNext():
            found.append(walk.next().getPath().toString()[len(base):])
        return found

    def stamps(self, path: str) -> dict[str, tuple[int, int]]:
        """Size and time of change of the data files at any depth, by their full paths."""
        found, walk = {}, self._fs.listFiles(self._path(path), True)
        while walk.hasNext():
            status = walk.next()
            if not status.getPath().getName().startswith(("_", ".")):
                found[status.getPath().toString()] = (status.getLen(),
                                                      status.getModificationTime())
        return found

    def spellings(self, paths: list[str]) -> list[str]:
        """The paths as Spark may spell them: plain, and with odd characters encoded."""
        encoded = {self._path(p).toUri().toString() for p in paths}
        return [*paths, *sorted(encoded - set(paths))]

    def make_dir(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def create_empty(self, path: str) -> None:
        self._fs.create(self._path(path), True).close()

    def write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        """A small file, whole."""
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rename(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"could not rename {source} to {target}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def delete_on_exit(self, path: str) -> None:
        self._fs.deleteOnExit(self._path(path))


def is_local(spark: SparkSession) -> bool:
    """True where driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: the session's checkpoint folder.

    Only a local session, which has no other machine, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="haulframe-")
        context.setCheckpointDir(_local_scratch[context.applicationId])
    return _local_scratch[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder, removed when the application ends."""
    root = f"{shared_dir(spark).rstrip('/')}/haulframe-{spark.sparkContext.applicationId}"
    storage = Storage(spark, root)
    if not storage.exists(root):
        storage.make_dir(root)
        storage.delete_on_exit(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Staged:
    """A frame written to shared storage, with its measured size."""

    df: DataFrame
    rows: int
    bytes: int

    @property
    def broadcastable(self) -> bool:
        return self.bytes <= BROADCAST_BYTES


def stage(df: DataFrame, name: str) -> Staged:
    """Write a frame once, measure it on the way, and read it back.

    The written table cuts lineage and survives lost executors; the measured size is what
    decides whether a join may broadcast it.
    """
    path = scratch_path(df.sparkSession, name)
    size = Observation()
    observed = df.observe(size, F.count(F.lit(1)).alias("rows"),
                          F.sum(_row_bytes(df.schema)).alias("bytes"))
    observed.write.parquet(path)
    counts = size.get
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return Staged(back, counts["rows"], counts["bytes"] or 0)


def _row_bytes(schema: T.StructType) -> Column:
    """Upper bound of a row's memory: fixed widths plus the length of text and binary; nested
    values count as twice their JSON text, which spells out every number and name."""
    total = F.lit(16)
    for field in schema.fields:
        total = total + F.lit(16)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            json = F.to_json(F.struct(col(field.name)))
            total = total + 2 * F.coalesce(F.octet_length(json), F.lit(0))
    return total.cast("long")
