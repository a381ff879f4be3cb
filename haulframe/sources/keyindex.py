"""Key indexes: which files of a folder table may hold a key.

A key column's smallest and largest value tell little where keys arrive in no order. An index
keeps, for each file, the range of its keys and a Bloom filter of them, so that the keys of a delta
open only the files that may hold them.

The filters are rows of a Parquet table, one for each word of 64 bits that is not empty. A key sets
all its bits in one word, so building a filter is one partial aggregation without an explosion, and
looking keys up is a join on the word's place. The place begins with one of 64 buckets of the key's hash,
by which the table is partitioned: a few keys read a few buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, functions as F, types as T

from haulframe.functions.names import col
from haulframe.operators.references import key_conflicts
from haulframe.sources.storage import Storage, stage
from haulframe.sources.tables import PathTable

BUCKETS = 64
# Keys that share a word, and the bits each of them sets: about one in ten thousand other keys
# finds its bits set by chance.
KEYS_PER_WORD = 2
BITS = 6
FILES = "id long, path string, size long, modified long, width long, low {k}, high {k}"


@dataclass(frozen=True)
class Candidates:
    """The files a lookup has to open, and how many the table has."""

    paths: list[str]
    files: int

    @property
    def skipped(self) -> int:
        return self.files - len(self.paths)


class KeyIndex:
    """An index of a plain folder table over some key columns, beside the table.

    ``refresh`` adds the files that are not in it yet, by two scans of their key columns alone.
    Files without an entry, or whose size or time has changed since, are always opened, so answers
    are exact however old the index is. Rows with a NULL among their keys have no key.
    """

    def __init__(self, table: PathTable, keys: Sequence[str]):
        if table.format == "delta" or not keys:
            raise ValueError("a key index needs a plain folder and at least one key column")
        self.table = table
        self.spark = table.spark
        self.keys = list(keys)
        name = "-".join(quote(k, safe="") for k in self.keys)
        self.path = f"{table.beside}.keys-{name}"
        self._storage = Storage(self.spark, self.path)

    def refresh(self) -> int:
        """Index the files that are new; returns their number."""
        known = self._known()
        fresh = [p for p, stamp in self._stamps().items() if known.get(p) != stamp]
        if not fresh:
            return 0
        rows = self.table.read()
        if known:
            rows = rows.where(F.col("_metadata.file_path").isin(self._storage.spellings(fresh)))
        # Rows spell odd characters of their path as a URL does.
        path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
        keyed = rows.select(
            F.xxhash64("_metadata.file_path").alias("id"), path.alias("path"), F.col("_metadata.file_size").alias("size"),
            F.unix_millis("_metadata.file_modification_time").alias("modified"),
            *[col(k).alias(f"key_{i}") for i, k in enumerate(self.keys)])
        key = F.when(_whole(self.keys), _key(self.keys))
        words = F.ceil(F.count(key) / F.lit(KEYS_PER_WORD * BUCKETS))
        # Widths are powers of two, so that there are few of them to look keys up in.
        width = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(words, F.lit(1))))).cast("long")
        files = stage(keyed.groupBy("id", "path", "size", "modified").agg(
            width.alias("width"), F.min(key).alias("low"), F.max(key).alias("high")), "key-files")
        seen = {r[0] for r in files.df.select("path").collect()}
        stamps = self._stamps()
        empty = self.spark.createDataFrame(
            [(0, p, *stamps[p], 1, None, None) for p in fresh if p not in seen and p in stamps],
            files.df.schema)
        widths = files.df.select("path", "width")
        widths = F.broadcast(widths) if files.broadcastable else widths
        filters = (_hashed(keyed.where(_whole(self.keys)), self.keys).join(widths, "path")
                   .withColumn("word", _word())
                   .groupBy("bucket", "id", "width", "word").agg(F.bit_or("mask").alias("bits")))
        # Filters first: a file counts as indexed once its row is there, and a filter that is
        # written twice does no harm.
        (filters.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "width", "word")
         .write.mode("append").partitionBy("bucket").parquet(f"{self.path}/words"))
        files.df.unionAll(empty).coalesce(1).write.mode("append").parquet(f"{self.path}/files")
        return len(fresh)

    def candidates(self, delta: DataFrame) -> Candidates:
        """The files that may hold a key of ``delta``."""
        stamps, known = self._stamps(), self._known()
        current = [p for p, stamp in stamps.items() if known.get(p) == stamp]
        if not current:
            return Candidates(sorted(stamps), len(stamps))
        kinds = self._kinds()
        for k, kind in zip(self.keys, kinds):
            got = delta.schema[k].dataType
            if got != kind and not (isinstance(got, T.IntegralType)
                                    and isinstance(kind, T.IntegralType)):
                raise ValueError(f"{k} is {got.simpleString()} in the delta and "
                                 f"{kind.simpleString()} in the table")
        new = delta.select(*[col(k).try_cast(kind).alias(f"key_{i}")
                             for i, (k, kind) in enumerate(zip(self.keys, kinds))])
        new = stage(_hashed(new.where(_whole(self.keys)).distinct(), self.keys), "looked-up")
        # At most one number for each bucket and each power of two.
        buckets = [r[0] for r in new.df.select("bucket").distinct().collect()]
        files = self._files()
        widths = [r[0] for r in files.select("width").distinct().collect()]
        probes = (new.df.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
                  .withColumn("word", _word()).select(
                      "bucket", "width", "word", "mask", _key(self.keys).alias("key")))
        words = self.spark.read.schema(
            "id long, width long, word long, bits long, bucket int").parquet(f"{self.path}/words")
        if new.broadcastable:
            probes = F.broadcast(probes)
        hits = (words.where(F.col("bucket").isin(buckets))
                .join(probes, ["bucket", "width", "word"])
                .where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
                .groupBy("id").agg(F.min("key").alias("first"), F.max("key").alias("last"),
                                   F.count(F.lit(1)).alias("n")))
        # The keys a filter lets through must also reach into the file's range.
        found = files.join(hits, "id").where(
            (F.col("last") >= F.col("low")) & (F.col("first") <= F.col("high")))
        held = {r[0] for r in found.select("path").distinct().collect()}
        unknown = [p for p in stamps if known.get(p) != stamps[p]]
        return Candidates(sorted([p for p in current if p in held] + unknown), len(stamps))

    def read(self, candidates: Candidates) -> DataFrame:
        """The table's rows in those files; Spark leaves the others out of its listing."""
        rows = self.table.read()
        if not candidates.skipped:
            return rows
        if not candidates.paths:
            return rows.where(F.lit(False))
        paths = self._storage.spellings(candidates.paths)
        return rows.where(F.col("_metadata.file_path").isin(paths)).select(
            *[col(c) for c in rows.columns])

    def conflicts(self, delta: DataFrame) -> DataFrame:
        """Distinct keys of ``delta`` that the table already holds."""
        return key_conflicts(delta, self.read(self.candidates(delta)), self.keys)

    def _kinds(self) -> list[T.DataType]:
        schema = self.table.columns()
        return [schema[k].dataType for k in self.keys]

    def _files(self) -> DataFrame:
        key = T.StructType([T.StructField(f"key_{i}", kind)
                            for i, kind in enumerate(self._kinds())]).simpleString()
        return self.spark.read.schema(FILES.format(k=key)).parquet(f"{self.path}/files")

    def _known(self) -> dict[str, tuple[int, int]]:
        """Size and time of the files when they were indexed: one small row a file, as many as
        the driver lists for any read of the table."""
        if not self._storage.has_files(f"{self.path}/files"):
            return {}
        rows = self._files().groupBy("path").agg(
            F.max(F.struct("modified", "size")).alias("last")).collect()
        return {r.path: (r.last.size, r.last.modified) for r in rows}

    def _stamps(self) -> dict[str, tuple[int, int]]:
        return self._storage.stamps(self.table.path)


def _whole(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"key_{i}").isNotNull() for i in range(len(keys))])


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[f"key_{i}" for i in range(len(keys))])


def _hashed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their key's bucket, the number that picks its word, and its bits."""
    plain = []
    for i in range(len(keys)):
        kind = rows.schema[f"key_{i}"].dataType
        value = F.col(f"key_{i}")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            # Zeros of both signs are equal.
            value = F.when(value == 0, F.lit(0.0).cast(kind)).otherwise(value)
        plain.append(value)
    hashed, other = F.xxhash64(*plain), F.xxhash64(F.lit("bits"), *plain)
    bits = [F.expr(f"shiftleft(1L, int(shiftright(other, {6 * i}) & 63))") for i in range(BITS)]
    return (rows.withColumn("bucket", F.pmod(hashed, F.lit(BUCKETS)).cast("int"))
            .withColumn("pick", F.shiftrightunsigned(hashed, 8)).withColumn("other", other)
            .withColumn("mask", reduce(lambda a, b: a.bitwiseOR(b), bits)).drop("other"))


def _word() -> Column:
    return F.pmod(F.col("pick"), F.col("width"))
