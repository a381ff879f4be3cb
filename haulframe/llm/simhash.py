"""SimHash near-dedup (operator 4): tiled exact comparison of 64-bit fingerprints.

Fingerprints of all texts are made in Arrow batches; documents with equal ones form a class. A
tile holds the fingerprints with the same four population counts, one for each 16 bits. Two
fingerprints within ``radius`` differ by at most ``radius`` in the sum of these counts, so a
tile meets only itself and the tiles that near; every other pair of tiles is skipped. Large tiles
are cut into blocks. Each block is one group of a shuffle: it keeps its own fingerprints and
streams the visitors past them, comparing by numpy exclusive-or and bit counts. A block emits its
links as a forest, so a dense group yields no more rows than it has members, and none is lost.
Components follow from minimum labels with pointer jumping over written tables.

Defined cases: NULL and empty texts have fingerprint zero and link like any other; texts of fewer
words than a shingle are one shingle; repeated rows share a class; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm.common import (
    join_groups,
    prepare_python,
    stage,
    take_over,
    unpacked,
    whole_row,
    whole_text,
)

SHINGLE = 3
RADIUS = 2
# Fingerprints a block keeps, and the side of a compared square.
BLOCK = 16_384
SQUARE = 1024
# Shingles hashed at once.
RUN = 65_536


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (hex), component_id (smallest id reachable) for each document."""
    prints = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    grouped = stage(_components(prints.df, radius), "components").df
    named = join_groups(prints.df, grouped, "_print", "_rows", prints.rows)
    return named.select(F.col("_id").alias(id_col),
                        F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"),
                        "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, with all their columns.

    Of rows repeated with one id and text, one stays.
    """
    found = near_groups(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                        shingle, radius, id_col="id")
    found = stage(found.select("id", "component_id"), "near-groups").df
    gone = stage(found.filter(F.col("id") != F.col("component_id"))
                 .select(F.col("id").alias("_gone")), "near-copies")
    dropped = F.broadcast(gone.df) if gone.broadcastable else gone.df
    again = stage(found.groupBy(F.col("id").alias("_id")).count().filter("count > 1")
                  .select("_id", F.lit(True).alias("_again")), "repeated-ids")
    repeated = F.broadcast(again.df) if again.broadcastable else again.df
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"),
                       whole_row(docs))
    rows = (rows.join(dropped, F.col("_id") == F.col("_gone"), "left_anti")
            .join(repeated, "_id", "left"))
    once = rows.filter(F.col("_again").isNull())
    return (once.unionByName(rows.filter("_again").dropDuplicates(["_id", "_text"]))
            .select(*unpacked(docs)))


def text_fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:] - 1
    ones = np.zeros(64, np.int64)
    for i in range(0, n, RUN):
        pairs = zip(starts[i:min(n, i + RUN)].tolist(), ends[i:i + RUN].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """_id and _print (the fingerprint as a signed long)."""
    prepare_python(docs.sparkSession)

    def make(batches):
        take_over("simhash")
        for batch in batches:
            found = np.fromiter((text_fingerprint(t, shingle) for t in
                                 map(str, batch["text"])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found.view(np.int64))],
                                             names=["_id", "_print"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(make, "_id long, _print long")


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """_print, _rows, component_id of every class."""
    classes = stage(prints.groupBy("_print").agg(F.min("_id").alias("_first"),
                                                 F.count(F.lit(1)).alias("_rows")), "classes").df
    links = stage(_links(classes.select("_print"), radius), "links")
    labels = _labels(links.df, classes)
    return (classes.join(labels, "_print", "left")
            .select("_print", "_rows",
                    F.coalesce(F.col("_label._first"), F.col("_first")).alias("component_id")))


def _tile(counts) -> Column:
    tile = F.lit(0)
    for c in counts:
        tile = tile * 17 + c
    return tile


def _near_tiles(radius: int) -> list[tuple[int, ...]]:
    """Differences of counts to the later tiles that may hold a link."""
    from itertools import product

    steps = product(range(-radius, radius + 1), repeat=4)
    return [d for d in steps if 0 < sum(map(abs, d)) <= radius and next(x for x in d if x) > 0]


def _links(classes: DataFrame, radius: int) -> DataFrame:
    """Forest of the links between fingerprints: _a, _b, both ways."""
    counts = [F.bit_count(F.shiftrightunsigned("_print", 16 * i).bitwiseAND(F.lit(0xFFFF)))
              for i in range(4)]
    own = classes.select("_print", *[c.alias(f"_c{i}") for i, c in enumerate(counts)])
    own = own.withColumn("_tile", _tile([F.col(f"_c{i}") for i in range(4)]))
    # At most 17 ** 4 tiles, so this table can be broadcast whatever the input.
    tiles = (own.groupBy("_tile").count()
             .select("_tile", F.ceil(F.col("count") / BLOCK).cast("int").alias("_blocks")))
    tiles = stage(tiles, "tiles").df
    block = F.pmod(F.xxhash64("_print"), F.col("_blocks")).cast("int")
    own = own.join(F.broadcast(tiles), "_tile").withColumn("_block", block)
    owners = own.select("_tile", "_block", F.lit(0).alias("_role"), "_print")
    later = own.filter(F.col("_blocks") > 1).select(
        "_tile", F.explode(F.when(F.col("_block") + 1 < F.col("_blocks"), F.sequence(
            F.col("_block") + 1, F.col("_blocks") - 1))).alias("_block"),
        F.lit(1).alias("_role"), "_print")
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)])
                      for d in _near_tiles(radius)])
    moved = own.select("_print", *[f"_c{i}" for i in range(4)], F.explode(moves).alias("_d"))
    shifted = [F.col(f"_c{i}") + F.col(f"_d.d{i}") for i in range(4)]
    inside = shifted[0].between(0, 16)
    for c in shifted[1:]:
        inside = inside & c.between(0, 16)
    visitors = (moved.filter(inside).select("_print", _tile(shifted).alias("_tile"))
                .join(F.broadcast(tiles), "_tile")
                .select("_tile", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
                        .alias("_block"), F.lit(1).alias("_role"), "_print"))
    dealt = owners.unionByName(later).unionByName(visitors)
    # An exchange by key, and a sort that brings a block's own fingerprints first.
    dealt = (dealt.repartition("_tile", "_block")
             .sortWithinPartitions("_tile", "_block", "_role")
             .select((F.col("_tile").cast("long") * 2**32 + F.col("_block")).alias("_key"),
                     "_role", "_print"))

    def compare(batches):
        take_over("simhash")
        block = None
        for batch in batches:
            keys, roles, values = (batch[c].to_numpy(zero_copy_only=False)
                                   for c in ("_key", "_role", "_print"))
            values = values.view(np.uint64)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(roles) != 0)) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if block is None or block.key != keys[a]:
                    out += block.forest() if block else []
                    block = _Block(keys[a], radius)
                if roles[a] == 0:
                    block.own.append(values[a:b].copy())
                else:
                    out += block.meet(values[a:b])
            yield _edges(out)
        if block:
            yield _edges(block.forest())

    found = dealt.mapInArrow(compare, "_a long, _b long")
    return found.unionByName(found.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))


def _edges(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = [np.zeros(0, np.uint64)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([p[i] for p in parts] or none).view(np.int64)) for i in (0, 1)],
        names=["_a", "_b"])


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int):
    """Index pairs of fingerprints within the radius, square by square; where both are the same
    array, squares on one side of the diagonal say all."""
    for i in range(0, len(a), SQUARE):
        for j in range(i if a is b else 0, len(b), SQUARE):
            near = np.bitwise_count(a[i:i + SQUARE, None] ^ b[None, j:j + SQUARE]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                yield x + i, y + j


class _Block:
    """The fingerprints of a block and how they hang together so far."""

    def __init__(self, key: int, radius: int):
        self.key, self.radius = key, radius
        self.own: list[np.ndarray] = []
        self.root: np.ndarray | None = None

    def _begin(self) -> None:
        if self.root is None:
            self.values = np.concatenate(self.own or [np.zeros(0, np.uint64)])
            self.root = np.arange(len(self.values))
            for x, y in close_pairs(self.values, self.values, self.radius):
                join_roots(self.root, x, y)

    def meet(self, visitors: np.ndarray) -> list:
        """Links of visitors: each to one of the own it is close to; those then hang together."""
        self._begin()
        first = np.full(len(visitors), -1)
        for x, y in close_pairs(visitors, self.values, self.radius):
            fresh = first[x] < 0
            # The first pair of a visitor in this square names its link.
            at, where = np.unique(x[fresh], return_index=True)
            first[at] = y[fresh][where]
            join_roots(self.root, first[x], y)
        linked = np.flatnonzero(first >= 0)
        return [(visitors[linked], self.values[first[linked]])] if len(linked) else []

    def forest(self) -> list:
        self._begin()
        linked = np.flatnonzero(self.root != np.arange(len(self.root)))
        return [(self.values[linked], self.values[self.root[linked]])] if len(linked) else []


def join_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the trees of each pair; ``root`` names the smallest place of every tree."""
    while True:
        a, b = root[x], root[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _labels(links: DataFrame, classes: DataFrame) -> DataFrame:
    """_print and _label (_first, _print of the smallest member) for each linked fingerprint."""
    label = F.struct("_first", "_print").alias("_label")
    nodes = links.select(F.col("_a").alias("_print")).distinct()
    labels = stage(nodes.join(classes.select("_print", label), "_print"), "labels").df
    while True:
        near = (links.join(labels, links["_b"] == labels["_print"])
                .groupBy(F.col("_a").alias("_print")).agg(F.min("_label").alias("_near")))
        lower = labels.join(near, "_print").select(
            "_print", F.col("_label").alias("_old"), F.least("_label", "_near").alias("_label"))
        lower = stage(lower, "lower").df
        # Jump: take over what the label's own fingerprint is labelled with. All members of a
        # large component come to carry one label, so those are met by broadcast.
        at = F.col("_label._print").alias("_at")
        sizes = lower.groupBy(at).agg(F.count(F.lit(1)).alias("_members"))
        ahead = stage(sizes.join(lower.select(F.col("_print").alias("_at"),
                                              F.col("_label").alias("_next")), "_at"), "ahead")
        rows = lower.select("_print", "_old", at)
        total = ahead.df.agg(F.sum("_members")).first()[0] or 0
        jumped = join_groups(rows, ahead.df, "_at", "_members", total).select(
            "_print", "_old", F.col("_next").alias("_label"))
        jumped = stage(jumped, "labels").df
        labels = jumped.select("_print", "_label")
        if jumped.filter(F.col("_old") != F.col("_label")).isEmpty():
            return labels
