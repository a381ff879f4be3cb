"""Sharding (operator 8): a k-d tree over document metadata, cut at weighted medians.

Every document is a point: its bytes, its bytes beyond one per code point, and its text's CRC-32,
all functions of the text, so equal texts share a point and stay together. Points are
pre-aggregated. A node is cut along its widest dimension where the bytes to the left match the
leaves to the left; the place is found from histograms with a fixed number of buckets that are
refined until the bucket at the cut weighs next to nothing. Along each dimension points are
ordered by coordinate, then by CRC-32. A point too heavy for one shard (its mean bytes) is
also ordered by a salt of the document id, so that it can be cut as well.

DataFrame functions only; the driver sees histograms and the tree.

Defined cases: NULL text has no bytes (and CRC-32 0); repeated rows share a point; NULL ids are
allowed; an empty table gives no rows; shards may stay empty when there are fewer documents; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm.common import positions, stage, whole_text

SHARDS = 24
# Bytes a document costs besides its text.
ROW_BYTES = 8
BUCKETS = 1024
# A cut is close enough when its bucket holds this part of a leaf's bytes.
CLOSE = 0.002
# A point stays whole up to this part of a leaf's bytes: only what no leaf can hold is cut.
WHOLE = 1.0
SALTS = 10  # bits
CRC = 32  # bits
STEPS = 2**15  # coordinate steps for each doubling

DIMENSIONS = ("_k0", "_k1", "_k2")


@dataclass
class Node:
    """A part of the tree: the way to it, and how many leaves it will have."""

    leaves: int
    first: int
    way: list[tuple[str, int, bool]] = field(default_factory=list)  # key, cut, below or equal

    def holds(self) -> Column:
        out = F.lit(True)
        for key, cut, low in self.way:
            out = out & ((F.col(key) <= cut) if low else (F.col(key) > cut))
        return out

    def split(self, key: str, cut: int) -> list[Node]:
        left = self.leaves // 2
        return [Node(left, self.first, [*self.way, (key, cut, True)]),
                Node(self.leaves - left, self.first + left, [*self.way, (key, cut, False)])]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard for each document."""
    text = whole_text(text_col)
    size = F.octet_length(text).cast("long")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_uid"), F.col(id_col).cast("long").alias("_id"),
        size.alias("_bytes"), (size - F.length(text)).alias("_wide"),
        F.crc32(text.cast("binary")).alias("_crc"))
    rows = stage(rows, "shard-rows").df
    weight = F.col("_bytes") + ROW_BYTES
    point = ["_bytes", "_wide", "_crc"]
    points = rows.groupBy(*point).agg(F.sum(weight).alias("_w"))
    points = stage(points, "shard-points").df
    total = points.agg(F.sum("_w")).first()[0] or 0
    # At most shards / WHOLE points are heavy, so the list can be broadcast.
    heavy = points.filter(F.col("_w") > WHOLE * total / shards).select(
        *point, F.lit(True).alias("_heavy"))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64("_id"), F.lit(2**SALTS)))
    salted = rows.join(F.broadcast(heavy), point, "left").withColumn(
        "_salt", F.coalesce(salt, F.lit(0)))
    keyed = stage(_with_keys(salted).drop("_heavy"), "shard-keys").df
    places = stage(keyed.groupBy(*DIMENSIONS).agg(F.sum(weight).alias("_w")), "shard-places").df
    leaves = grow(places, shards, total)
    number = F.lit(0)
    for leaf in leaves[1:]:
        number = F.when(leaf.holds(), leaf.first).otherwise(number)
    placed = stage(keyed.select("_uid", "_id", weight.alias("size"), "_crc",
                                number.cast("int").alias("shard")), "shard-placed").df
    counts = [0] * shards
    for r in placed.groupBy("shard").count().collect():
        counts[r["shard"]] = r["count"]
    out = positions(placed, "shard", counts, ["_id", "_crc"], F.lit(1), "slot", ["_uid"])
    return out.select(F.col("_id").alias(id_col), "size", F.col("_crc").alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def _with_keys(rows: DataFrame) -> DataFrame:
    """Coordinates with their tie-breaks, in 63 bits."""
    tie = F.shiftleft(F.col("_crc"), SALTS) + F.col("_salt")

    def key(column: str) -> Column:
        step = F.floor(F.log2(F.col(column) + 1) * STEPS).cast("long")
        return F.shiftleft(step, CRC + SALTS) + tie

    return rows.withColumns({"_k0": key("_bytes"), "_k1": key("_wide"), "_k2": tie})


def grow(places: DataFrame, shards: int, total: int) -> list[Node]:
    """Cut until every node is one leaf; the leaves in order."""
    nodes, done, whole = [Node(shards, 0)], [], None
    while nodes:
        done += [n for n in nodes if n.leaves == 1]
        nodes = [n for n in nodes if n.leaves > 1]
        if not nodes:
            break
        spans = _spans(places, nodes)
        whole = whole or spans[0]
        cuts = _cuts(places, nodes, spans, whole, CLOSE * total / shards)
        nodes = [part for n, (key, cut) in zip(nodes, cuts, strict=True)
                 for part in n.split(key, cut)]
    return sorted(done, key=lambda n: n.first)


def _numbered(places: DataFrame, nodes: list[Node]) -> DataFrame:
    number = F.lit(-1)
    for i, node in enumerate(nodes):
        number = F.when(node.holds(), i).otherwise(number)
    return places.withColumn("_node", number).filter(F.col("_node") >= 0)


def _spans(places: DataFrame, nodes: list[Node]) -> list[dict]:
    """Lowest and highest key of each dimension, and the weight, of each node."""
    sides = [f(k).alias(k + s) for k in DIMENSIONS for s, f in (("low", F.min), ("high", F.max))]
    found = _numbered(places, nodes).groupBy("_node").agg(F.sum("_w").alias("_w"), *sides)
    empty = {"_w": 0} | {f"{k}{s}": 0 for k in DIMENSIONS for s in ("low", "high")}
    out = [empty for _ in nodes]
    for r in found.collect():
        out[r["_node"]] = r.asDict()
    return out


def _widest(span: dict, whole: dict) -> str:
    """The dimension in which the node takes most of the whole range; ties: the first."""
    def width(key: str) -> float:
        shift = SALTS if key == "_k2" else SALTS + CRC
        low, high = (span[key + s] >> shift for s in ("low", "high"))
        least, most = (whole[key + s] >> shift for s in ("low", "high"))
        return (high - low) / max(1, most - least)

    best = max(DIMENSIONS, key=width)
    return best if width(best) else "_k2"


def _cuts(places, nodes, spans, whole, close: float) -> list[tuple[str, int]]:
    """Dimension and last key to the left, for each node."""
    search = []
    for node, span in zip(nodes, spans, strict=True):
        key = _widest(span, whole)
        search.append({"key": key, "low": span[key + "low"], "high": span[key + "high"],
                       "before": 0, "goal": span["_w"] * (node.leaves // 2) / node.leaves,
                       "cut": None if span["_w"] else span[key + "high"]})
    numbered = _numbered(places, nodes)
    while any(s["cut"] is None for s in search):
        bucket, inside = F.lit(0).cast("long"), F.lit(False)
        for i, s in enumerate(search):
            if s["cut"] is None:
                s["step"] = (s["high"] - s["low"]) // BUCKETS + 1
                here = ((F.col("_node") == i) & (F.col(s["key"]) >= s["low"])
                        & (F.col(s["key"]) <= s["high"]))
                inside = inside | here
                place = F.expr(f"({s['key']} - {s['low']}L) div {s['step']}L")
                bucket = F.when(F.col("_node") == i, place).otherwise(bucket)
        found = (numbered.filter(inside).groupBy("_node", bucket.alias("_bucket"))
                 .agg(F.sum("_w").alias("_w")).collect())
        for i, s in enumerate(search):
            if s["cut"] is None:
                _narrow(s, sorted((r["_bucket"], r["_w"]) for r in found if r["_node"] == i),
                        close)
    return [(s["key"], s["cut"]) for s in search]


def _narrow(s: dict, buckets: list[tuple[int, int]], close: float) -> None:
    """Go into the bucket where the goal is reached, or cut on its nearer side."""
    for bucket, weight in buckets:
        if s["before"] + weight >= s["goal"]:
            first = s["low"] + bucket * s["step"]
            last = min(s["high"], first + s["step"] - 1)
            if weight <= close or first == last:
                over = s["before"] + weight - s["goal"]
                s["cut"] = last if over <= s["goal"] - s["before"] else first - 1
            else:
                s["low"], s["high"] = first, last
            return
        s["before"] += weight
    s["cut"] = s["high"]
