"""Best-fit packing (operator 9): large-item matching over the histogram of lengths.

Pieces of one length are interchangeable, so bins are chosen from the counts of the ``capacity``
lengths alone: at most ``capacity`` numbers reach the driver, whatever the input. Pieces above a
third of the capacity are matched greedily, at most two in a bin: the longest with the longest
that still fits. Shorter pieces, longest first, best-fit the gaps that remain, then new bins. The
plan is a list of runs (length, first rank, sequences, offset), whose number depends on the
capacity, not on the rows. Each piece's rank among those of its length comes from bucketed sums,
so that a length that many copies share is not one task; an Arrow function then looks its run up.

Defined cases: NULL text is empty, and is one piece of the end id alone; an empty table gives no
rows; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.common import positions, prepare_python, stage, take_over, whole_text
from haulframe.llm.encode import encoder

CAPACITY = 2048
END_ID = 0


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", tokenizer: str | None = None,
         with_ids: bool = False, kept: int | None = None) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than ``capacity`` are cut into pieces of ``capacity`` ids, of which the
    first may be shorter. ``with_ids`` adds ``ids``, the piece as little-endian 32-bit numbers.
    A worker remembers the ids of ``kept`` chunks: fewer take less memory and more time.
    """
    prepare_python(docs.sparkSession)
    cut = stage(_pieces(docs, capacity, end_id, id_col, text_col, tokenizer, with_ids,
                        kept), "pieces").df
    counts = [0] * (capacity + 1)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    runs = plan_bins(counts, capacity)
    ranked = positions(cut.withColumn("_group", F.col("length").cast("int")), "_group", counts,
                       ["_id", "piece", "ids_crc32"], F.lit(1), "_rank")
    return _placed(ranked, runs, id_col, with_ids)


def _pieces(docs, capacity, end_id, id_col, text_col, tokenizer, with_ids, kept) -> DataFrame:
    def cut(batches):
        enc = encoder(tokenizer, kept)
        for batch in batches:
            first = 0
            for flat, offsets in enc.ids(batch["text"], end_id):
                flat = flat.astype("<u4", copy=False)
                sizes = np.diff(offsets)
                pieces = -(-sizes // capacity)
                rows = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = sizes - (pieces - 1) * capacity
                start = np.where(number, head[rows] + (number - 1) * capacity, 0)
                length = np.where(number, capacity, head[rows])
                at = offsets[rows] + start
                data = memoryview(flat).cast("B")
                blobs = [data[4 * a:4 * b] for a, b in
                         zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [batch["id"].take(pa.array(first + rows)),
                           pa.array(number.astype(np.int32)), pa.array(start.astype(np.int64)),
                           pa.array(length.astype(np.int64)),
                           pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(b) for b in blobs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                first += len(sizes)

    names = ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(cut, "_id long, piece int, start long, length long, ids_crc32 long"
                           + ", ids binary" * with_ids)


def plan_bins(counts: Sequence[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) for ``counts[length]`` pieces.

    The pieces of a run have consecutive ranks and go to consecutive sequences, at one offset.
    """
    left = list(counts)
    taken = [0] * (capacity + 1)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = {}  # gap -> [first sequence, sequences]
    open_gaps: list[int] = []  # sorted keys of gaps
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, taken[length], n, sequence, offset))
        taken[length] += n
        left[length] -= n

    def free(gap: int, sequence: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append([sequence, n])

    large = [n for n in range(capacity + 1) if 3 * n > capacity and left[n]]
    while large:
        first = large[-1]
        i = bisect.bisect_right(large, capacity - first) - 1
        if i < 0:
            n = left[first]
            put(first, n, sequences, 0)
            free(capacity - first, sequences, n)
        else:
            second = large[i]
            n = left[first] // 2 if second == first else min(left[first], left[second])
            if not n:  # one piece left that would pair with itself
                i -= 1
                second = large[i] if i >= 0 else 0
                n = 1
            put(first, n, sequences, 0)
            if second:
                put(second, n, sequences, first)
            free(capacity - first - second, sequences, n)
        sequences += n
        large = [x for x in large if left[x]] if not left[first] or (
            i >= 0 and not left[large[i]]) else large
    for length in range(capacity // 3, 0, -1):
        while left[length]:
            i = bisect.bisect_left(open_gaps, length)
            if i == len(open_gaps):
                each = capacity // length
                whole, rest = divmod(left[length], each)
                for k in range(each if whole else 0):
                    put(length, whole, sequences, k * length)
                free(capacity - each * length, sequences, whole)
                sequences += whole
                for k in range(rest):
                    put(length, 1, sequences, k * length)
                if rest:
                    free(capacity - rest * length, sequences, 1)
                    sequences += 1
                break
            gap = open_gaps[i]
            sequence, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(i)
            each = gap // length
            whole, rest = divmod(left[length], each)
            used = min(n, whole)
            for k in range(each if used else 0):
                put(length, used, sequence, capacity - gap + k * length)
            free(gap - each * length, sequence, used)
            if used < n:
                rest = left[length]
                for k in range(rest):
                    put(length, 1, sequence + used, capacity - gap + k * length)
                if rest:
                    free(gap - rest * length, sequence + used, 1)
                free(gap, sequence + used + bool(rest), n - used - bool(rest)) if (
                    n > used + bool(rest)) else None
    return runs


def _placed(ranked: DataFrame, runs, id_col: str, with_ids: bool) -> DataFrame:
    """Look up each piece's run; ``runs`` is small whatever the input (see ``plan_bins``)."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    # Lengths are below 2**20 and ranks below 2**43.
    keys = (table[:, 0] << 43) + table[:, 1]
    shared = ranked.sparkSession.sparkContext.broadcast((keys, table))

    def place(batches):
        take_over("packing")
        keys, table = shared.value
        for batch in batches:
            rank = batch["_rank"].to_numpy(zero_copy_only=False)
            key = (batch["length"].to_numpy(zero_copy_only=False) << 43) + rank
            run = table[np.searchsorted(keys, key, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in names[:-2]]
                + [pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                names=[id_col if c == "_id" else c for c in names])

    names = (["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
             + ["sequence_id", "offset"])
    return ranked.select(*names[:-2], "_rank").mapInArrow(
        place, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long"
        + ", ids binary" * with_ids + ", sequence_id long, offset long")
