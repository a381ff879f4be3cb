"""Token ids in files of fixed-width bit packing (operator 13).

Documents are dealt out by ranges of their id and sorted, each range is one shard, and a task
encodes its shard in order. Every id takes the bits that the largest id of the vocabulary needs.
A block holds whole documents, ``BLOCK_IDS`` ids or little more:

    8 bytes   "HFBITS1" and a line feed
    7 x int64 block bytes, shard, ids of the shard before the block, ids, documents, bits, flags
    documents x int64  document ids (0 for NULL, with a bit in the next array)
    documents x uint8  1 where the document has an id
    documents x int64  offset of each document's first id in the block
    ids x bits         packed from the lowest bit, filled up to a byte
    1 byte    line feed

All numbers are little-endian. Blocks follow one another, as records of Spark's text writer (the
last byte is its line end), so files are committed as any Spark output, on any store; each file
has at most ``FILE_BLOCKS`` blocks. Eight ids fill whole bytes, so packing and unpacking are a
few array operations for each of eight lanes, and any run of ids is read without those before it.
``block_index`` lists where blocks lie; ``read_documents`` reads the blocks of wanted ids alone.

Defined cases: NULL text is empty and has the end id alone; rows without an id come first; rows
repeated with one id follow one another, by a hash of their text; an empty table gives files without
blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.llm.common import literal_array, prepare_python, stage, take_over, whole_text
from haulframe.llm.encode import encoder
from haulframe.sources.storage import scratch_path

END_ID = 2
BLOCK_IDS = 65_536
FILE_BLOCKS = 64
MAGIC = b"HFBITS1\n"
HEAD = 7


def default_path() -> str:
    """The word vocabulary these files are written with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_file_report(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the documents' ids, read the files back: doc_id, start, n_tokens, ids_crc32."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, **options)
    return (read_tokens(docs.sparkSession, path)
            .select("doc_id", "start", "n_tokens", "ids_crc32"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_IDS) -> None:
    """Files of the ids of all documents, in the order of their id, below ``path``."""
    prepare_python(docs.sparkSession)

    def write(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer or default_path())
        largest = max(enc.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        block_of = _Writer(TaskContext.get().partitionId(), max(1, largest.bit_length()))
        for batch in batches:
            first, known = 0, batch["id"]
            for flat, offsets in enc.ids(batch["text"], end_id):
                n = len(offsets) - 1
                block_of.add(known.slice(first, n), flat, np.diff(offsets))
                first += n
                yield from block_of.blocks(block)
        yield from block_of.blocks(0)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    rows = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie")
            .sortWithinPartitions("id", "tie").drop("tie"))
    (rows.mapInArrow(write, "block binary").select(F.col("block").cast("string"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS)
     .option("compression", "none").text(path))


class _Writer:
    """Documents that wait for their block."""

    def __init__(self, shard: int, bits: int):
        self.shard, self.bits, self.written = shard, bits, 0
        self.ids, self.flat, self.sizes, self.held = [], [], [], 0

    def add(self, ids: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.ids.append(ids)
        self.flat.append(flat)
        self.sizes.append(sizes)
        self.held += len(flat)

    def blocks(self, block: int):
        """Blocks of whole documents; what does not fill one waits, unless ``block`` is 0."""
        if self.held < max(1, block):
            return
        ids, flat = pa.concat_arrays(self.ids), np.concatenate(self.flat)
        sizes = np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        first = done = 0
        while first < len(sizes) and (not block or len(flat) - done >= block):
            last = int(np.searchsorted(ends, done + block)) + 1 if block else len(sizes)
            found = pack_block(self.shard, self.written, ids[first:last], sizes[first:last],
                               flat[done:ends[last - 1]], self.bits)
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["block"])
            self.written += int(ends[last - 1]) - done
            first, done = last, int(ends[last - 1])
        self.ids, self.flat = [ids[first:]], [flat[done:]]
        self.sizes, self.held = [sizes[first:]], len(flat) - done


def pack_block(shard: int, start: int, ids: pa.Array, sizes: np.ndarray, flat: np.ndarray,
               bits: int) -> bytes:
    """One block, without the line feed that ends it."""
    has_id = ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    payload = pack_bits(flat, bits)
    parts = [numbers.tobytes(), has_id.astype(np.uint8).tobytes(),
             (np.cumsum(sizes) - sizes).astype("<i8").tobytes(), payload.tobytes()]
    size = len(MAGIC) + 8 * HEAD + sum(map(len, parts)) + 1
    head = np.array([size, shard, start, len(flat), len(sizes), bits, 0], "<i8")
    return b"".join([MAGIC, head.tobytes(), *parts])


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes that hold each id in ``bits`` bits, from the lowest bit on."""
    groups = -(-len(ids) // 8)
    lanes = np.zeros((groups, 8), np.uint64)
    lanes.reshape(-1)[:len(ids)] = ids
    out = np.zeros((groups, bits + 8), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for i in range(-(-(bits + shift) // 8)):
            out[:, byte + i] |= (value >> np.uint64(8 * i)).astype(np.uint8)
    return out[:, :bits].reshape(-1)[:-(-len(ids) * bits // 8)]


def unpack_bits(data: np.ndarray, first: int, n: int, bits: int) -> np.ndarray:
    """``n`` ids from the one with number ``first`` on; only their bytes are read."""
    group = first // 8
    groups = -(-(first + n) // 8) - group
    part = data[group * bits:(group + groups) * bits]
    rows = np.zeros((groups, bits), np.uint8)
    rows.reshape(-1)[:len(part)] = part
    out = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, np.uint64)
        for i in range(-(-(bits + shift) // 8)):
            value |= rows[:, byte + i].astype(np.uint64) << np.uint64(8 * i)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[first - 8 * group:first - 8 * group + n]


class Block:
    """A block within the bytes of its file."""

    def __init__(self, data: np.ndarray, at: int):
        head = at + len(MAGIC)
        if data[at:head].tobytes() != MAGIC:
            raise ValueError(f"no block at byte {at}")
        (self.bytes, self.shard, self.start, self.n_ids, docs, self.bits, _) = (
            data[head:head + 8 * HEAD].view("<i8").tolist())
        place = head + 8 * HEAD
        numbers = data[place:place + 8 * docs].view("<i8")
        known = data[place + 8 * docs:place + 9 * docs].astype(bool)
        self.ids = pa.array(numbers, pa.int64(), mask=~known)
        place += 9 * docs
        self.offsets = np.append(data[place:place + 8 * docs].view("<i8"), self.n_ids)
        self.payload = data[place + 8 * docs:at + self.bytes - 1]

    def tokens(self, first: int = 0, n: int | None = None) -> np.ndarray:
        """Ids from a place in the block on."""
        return unpack_bits(self.payload, first, self.n_ids - first if n is None else n, self.bits)


def blocks_of(content: bytes | pa.BinaryScalar) -> Iterable[tuple[int, Block]]:
    """(byte offset, block) of every block of a file."""
    data = np.frombuffer(content, np.uint8)
    at = 0
    while at < len(data):
        found = Block(data, at)
        yield at, found
        at += found.bytes


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .filter("length > 0"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; ``with_ids`` adds
    ``ids``. The driver sees one number for each shard."""
    prepare_python(spark)

    def read(batches):
        take_over("token-files")
        for batch in batches:
            for content in batch["content"]:
                for _, block in blocks_of(content.as_buffer()):
                    yield _rows(block, with_ids)

    found = _files(spark, path).select("content").mapInArrow(
        read, "doc_id long, shard long, place long, n_tokens long, ids_crc32 long"
        + ", ids array<int>" * with_ids)
    found = stage(found, "token-rows").df
    totals = {r[0]: r[1] for r in found.groupBy("shard").agg(F.sum("n_tokens")).collect()}
    before, total = [], 0
    for shard in range(max(totals, default=-1) + 1):
        before.append(total)
        total += totals.get(shard, 0)
    base = F.element_at(literal_array(before or [0], "bigint"), F.col("shard").cast("int") + 1)
    return found.select("doc_id", (base + F.col("place")).alias("start"), "n_tokens", "ids_crc32",
                        *["ids"] * with_ids)


def _rows(block: Block, with_ids: bool) -> pa.RecordBatch:
    flat = block.tokens().astype("<u4", copy=False)
    data = memoryview(flat).cast("B")
    bounds = block.offsets.tolist()
    crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    n = len(block.ids)
    columns = [block.ids, pa.array(np.full(n, block.shard, np.int64)),
               pa.array(block.start + block.offsets[:-1]), pa.array(np.diff(block.offsets)),
               pa.array(crcs, pa.int64())]
    names = ["doc_id", "shard", "place", "n_tokens", "ids_crc32"]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(block.offsets.astype(np.int32)),
                                                pa.array(flat.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each block lies: path, byte_offset, bytes, shard, start (in its shard), n_ids,
    n_docs, first_doc and last_doc (NULL where no document has an id)."""
    prepare_python(spark)

    def index(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for at, block in blocks_of(content.as_buffer()):
                    ids = block.ids.drop_null()
                    yield pa.RecordBatch.from_pylist([{
                        "path": name.as_py(), "byte_offset": at, "bytes": block.bytes,
                        "shard": block.shard, "start": block.start, "n_ids": block.n_ids,
                        "n_docs": len(block.ids), "first_doc": ids[0].as_py() if ids else None,
                        "last_doc": ids[-1].as_py() if ids else None}], schema)

    schema = pa.schema([("path", pa.string())] + [(c, pa.int64()) for c in (
        "byte_offset", "bytes", "shard", "start", "n_ids", "n_docs", "first_doc", "last_doc")])
    return _files(spark, path).select("path", "content").mapInArrow(
        index, "path string, byte_offset long, bytes long, shard long, start long, n_ids long, "
        "n_docs long, first_doc long, last_doc long")


def read_documents(index: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id and ids (array) of some documents: only files with a block that may hold one are
    opened, and only that block's documents unpacked."""
    spark = index.sparkSession
    ids = np.array(sorted(set(wanted)), np.int64)
    near = None
    for i in ids.tolist():
        inside = F.lit(i).between(F.col("first_doc"), F.col("last_doc"))
        near = inside if near is None else near | inside
    picked = index.filter(near if near is not None else F.lit(False))
    places = {}
    for r in picked.select("path", "byte_offset").collect():
        places.setdefault(r["path"], []).append(r["byte_offset"])

    def read(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                for at in places[name.as_py()]:
                    block = Block(data, at)
                    for k in np.flatnonzero(np.isin(block.ids.fill_null(-1), ids)).tolist():
                        if not block.ids[k].is_valid:
                            continue
                        a, b = block.offsets[k:k + 2].tolist()
                        yield pa.RecordBatch.from_arrays(
                            [block.ids[k:k + 1],
                             pa.array([block.tokens(a, b - a)], pa.list_(pa.int32()))],
                            names=["doc_id", "ids"])

    if not places:
        return spark.createDataFrame([], "doc_id long, ids array<int>")
    files = spark.read.format("binaryFile").load(sorted(places))
    return files.select("path", "content").mapInArrow(read, "doc_id long, ids array<int>")
