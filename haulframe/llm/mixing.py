"""Mixing sources to target weights (operator 6): blocks, multinomial draws, index permutations.

The words of each source form one stream (documents in the order of a hash of their id), cut into
blocks of a fixed number of words, to within one word. The mix is a row of slots, dealt over
output shards. Each shard draws how many of its slots each source gets from a multinomial
distribution over what the sources still have to give, so the totals meet the targets. A source's
slot is mapped to one of its blocks by a pseudorandom permutation of the block indices, another
one for each pass over the source, so no block is taken more often than there are passes. Slots
and blocks are joined by index. Only one row for each source reaches the driver.

Defined cases: NULL text has size 0 and is never taken; a NULL source is a source of its own, the
last; an empty table gives no rows; rows repeated with one id are separate documents; the result
depends on ids, texts' sizes, sources and the seed alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.common import (
    WORD,
    positions,
    prepare_python,
    stage,
    take_over,
    unpacked,
    whole_row,
    whole_text,
)

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
BLOCK_WORDS = 256
SHARDS = 64
SEED = 6


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``id_col``, size, source_size, target and taken (words the mix takes) for each document."""
    sizes, sources, spans = _mixed(docs, id_col=id_col, **options)
    taken = spans.groupBy("_uid").agg(F.sum(F.col("_to") - F.col("_from")).alias("taken"))
    plan = docs.sparkSession.createDataFrame(pa.table({
        "_rank": pa.array([s["rank"] for s in sources], pa.int32()),
        "source_size": pa.array([s["size"] for s in sources], pa.int64()),
        "target": pa.array([float(s["target"]) for s in sources], pa.float64())}))
    return (sizes.join(taken, "_uid", "left").join(plan, "_rank")
            .select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size",
                    "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The mix as documents with the given columns: each pass that takes some of a document's
    words gives a row with those; a whole document keeps its text as it is."""
    kept = stage(docs.select(F.monotonically_increasing_id().alias("_uid"), whole_row(docs)),
                 "mix-documents").df
    text = F.col("_row").getField(text_col)
    flat = kept.select("_uid", F.col("_row").getField(id_col).alias("doc_id"),
                       text.alias("text"), F.col("_row").getField(source_col).alias("source"))
    _, _, spans = _mixed(flat, uid="_uid", **options)
    spans = (spans.groupBy("_uid", "_pass")
             .agg(F.sort_array(F.collect_list(F.struct("_from", "_to"))).alias("_spans"),
                  F.first("_size").alias("_size")))
    rows = kept.join(spans, "_uid")
    whole = (F.aggregate("_spans", F.lit(0).cast("long"),
                         lambda n, s: n + s["_to"] - s["_from"]) == F.col("_size"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        take_over("mixing")
        out = []
        for text, taken in zip(texts, spans, strict=True):
            words = str(text).encode("utf-8", "surrogatepass").split()
            out.append(b" ".join([w for s in taken.as_py()
                                  for w in words[s["_from"]:s["_to"]]]).decode())
        return pa.array(out, pa.string())

    parts = (rows.filter(~whole).withColumn("_text", cut(text, F.col("_spans")))
             .unionByName(rows.filter(whole).withColumn("_text", text)))
    return parts.select(*[
        F.col("_text").alias(c) if c == text_col else
        F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else kept_column
        for c, kept_column in zip(docs.columns, unpacked(docs), strict=True)])


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            passes: float = PASSES) -> list[float]:
    """Words for each source: by weight, at most ``passes`` times its size, the rest reshared."""
    n = len(sizes)
    weight = [weights[i % len(weights)] for i in range(n)]
    out, free, left = [0.0] * n, set(range(n)), share * sum(sizes)
    while free:
        unit = left / sum(weight[i] for i in free)
        full = {i for i in free if weight[i] * unit > passes * sizes[i]}
        if not full:
            for i in free:
                out[i] = weight[i] * unit
            break
        for i in full:
            out[i] = float(passes * sizes[i])
            left -= out[i]
        free -= full
    return out


def draw_slots(slots: Sequence[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each shard: multinomial over what is left, to exact totals."""
    left = np.array(slots, np.int64)
    out = np.zeros((shards, len(left)), np.int64)
    total = int(left.sum())
    for k in range(shards):
        draw = np.random.default_rng([seed, k])
        want = total * (k + 1) // shards - total * k // shards
        while want:
            got = np.minimum(draw.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for each key: Feistel rounds, walking cycles."""
    half = np.uint64(1)
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + half) // 2)
    mask = (half << bits) - half
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> b, out[todo] & m
        for r in range(4):
            mixed = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
           passes: int = PASSES, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED,
           uid: str | None = None):
    """Sizes, the plan for each source, and the spans taken (_uid, _size, _pass, _shard, _slot,
    _from, _to in words of the document)."""
    spark = docs.sparkSession
    prepare_python(spark)
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        (F.col(uid) if uid else F.monotonically_increasing_id()).alias("_uid"),
        F.col(f"`{id_col}`").cast("long").alias("_id"), source.isNull().alias("_none"),
        F.coalesce(source, F.lit("")).alias("_source"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("_size"))
    rows = stage(rows, "mix-sizes").df
    found = rows.groupBy("_none", "_source").agg(F.sum("_size"), F.count(F.lit(1))).collect()
    found.sort(key=lambda r: (r[0], r[1]))  # by code point, NULL last
    wanted = targets([r[2] for r in found], weights, share, passes)
    sources = []
    for i, (r, t) in enumerate(zip(found, wanted, strict=True)):
        blocks = -(-r[2] // block)
        turns, rest = divmod(round(t), r[2]) if r[2] else (0, 0)
        mean = r[2] / blocks if blocks else 1
        last = int(-(-rest // mean))
        sources.append({"rank": i, "none": r[0], "source": r[1], "size": r[2], "rows": r[3],
                        "target": t, "blocks": blocks, "slots": turns * blocks + last,
                        # Words that the last slot of a part pass may take.
                        "tail": round(rest - (last - 1) * mean) if last else -1})
    ranks = spark.createDataFrame(pa.table({
        "_none": pa.array([s["none"] for s in sources], pa.bool_()),
        "_source": pa.array([s["source"] for s in sources], pa.string()),
        "_rank": pa.array([s["rank"] for s in sources], pa.int32()),
        "_words": pa.array([s["size"] for s in sources], pa.int64()),
        "_blocks": pa.array([s["blocks"] for s in sources], pa.int64())}))
    # Staged, since positions reads its input twice.
    sizes = stage(rows.join(ranks, ["_none", "_source"]).drop("_none", "_source"), "mix-ranked").df
    placed = positions(sizes, "_rank", [s["rows"] for s in sources], ["_id", "_size"],
                       F.col("_size"), "_start", ["_uid"]).filter(F.col("_size") > 0)
    pieces = _block_pieces(placed)
    slots = _slots(spark, sources, shards, seed)
    spans = (slots.join(pieces, ["_rank", "_block"])
             .withColumn("_to", F.when(F.col("_limit") < 0, F.col("_to")).otherwise(
                 F.least("_to", F.col("_first") + F.col("_limit"))))
             .filter(F.col("_to") > F.col("_from")))
    return sizes, sources, spans.drop("_rank", "_block", "_limit", "_first")


def _block_pieces(placed: DataFrame) -> DataFrame:
    """The part of each document in each block, as words of the document; ``_first`` is where the
    block begins."""
    base = F.expr("_words div _blocks")
    extra = F.col("_words") % F.col("_blocks")  # so many first blocks have a word more

    def block_of(word):
        long = extra * (base + 1)
        return (F.when(word < long, F.floor(word / (base + 1)))
                .otherwise(extra + F.floor((word - long) / base)).cast("long"))

    def begin(block):
        return block * base + F.least(block, extra)

    last = F.col("_start") + F.col("_size") - 1
    cut = placed.withColumn("_block", F.explode(F.sequence(block_of(F.col("_start")),
                                                           block_of(last))))
    first = begin(F.col("_block")) - F.col("_start")
    until = begin(F.col("_block") + 1) - F.col("_start")
    return cut.select("_rank", "_block", "_uid", "_size",
                      first.alias("_first"),
                      F.greatest(first, F.lit(0).cast("long")).alias("_from"),
                      F.least(until, F.col("_size")).alias("_to"))


def _slots(spark, sources: list[dict], shards: int, seed: int) -> DataFrame:
    """_rank, _block, _shard, _slot, _pass, _limit (-1: none) of every slot."""
    drawn = draw_slots([s["slots"] for s in sources], shards, seed)
    counts = drawn.reshape(-1)  # shard by shard, source by source
    first = (np.cumsum(drawn, axis=0) - drawn).reshape(-1)
    begin = np.cumsum(counts) - counts
    total = int(counts.sum())
    n = max(1, len(sources))
    shared = spark.sparkContext.broadcast({
        "begin": begin, "first": first, "counts": counts,
        "blocks": np.array([s["blocks"] for s in sources] or [1], np.int64),
        "slots": np.array([s["slots"] for s in sources] or [0], np.int64),
        "tail": np.array([s["tail"] for s in sources] or [-1], np.int64)})

    def deal(batches):
        take_over("mixing")
        plan = shared.value
        live = np.flatnonzero(plan["counts"])
        for batch in batches:
            slot = batch["id"].to_numpy(zero_copy_only=False)
            cell = live[np.searchsorted(plan["begin"][live], slot, "right") - 1]
            rank = cell % n
            mine = plan["first"][cell] + slot - plan["begin"][cell]
            blocks = plan["blocks"][rank]
            turn = mine // blocks
            key = np.uint64(seed) * np.uint64(1_000_003) + (rank * 64 + turn).astype(np.uint64)
            block = permute(mine % blocks, blocks, key * np.uint64(0x94D049BB133111EB))
            ends = mine == plan["slots"][rank] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank.astype(np.int32)), pa.array(block),
                 pa.array((cell // n).astype(np.int32)), pa.array(slot),
                 pa.array(turn.astype(np.int32)),
                 pa.array(np.where(ends, plan["tail"][rank], -1))],
                names=["_rank", "_block", "_shard", "_slot", "_pass", "_limit"])

    return spark.range(total).mapInArrow(
        deal, "_rank int, _block long, _shard int, _slot long, _pass int, _limit long")
