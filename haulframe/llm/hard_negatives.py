"""Hard-negative mining by exact integer scores (operator 12): Kronecker-packed products.

Components become integers. Candidates are taken in groups: their components, made non-negative
by a bias, lie side by side in separate fields of one wide integer, so one multiplication by an
anchor's (biased) component multiplies all of them. Fields are so wide that the sum over all
components cannot carry into the next; after it, fields are unpacked and the biases taken off,
which leaves exact inner products. Where two fields or more fit in 53 bits, the wide integers are
whole doubles and the sums a matrix product, exact in any order; otherwise they are Python's
integers of any width.

1. Rows that take part are written with their integers. Anchors are dealt into chunks of at most
   ``CHUNK_VALUES`` components; every chunk in turn is broadcast and all rows pass by it.
2. A task keeps the best rows of each anchor's own label; the best over all tasks are its
   positives.
3. Rows pass again: a task keeps, for each anchor and positive, the best rows of other labels with
   a score in the positive's window; the best over all tasks are the answer.

Tasks hand on at most ``count`` rows for each anchor and positive, so no group grows with the
rows, and rows are never shuffled.

Defined cases: NULL ids, labels or vectors and NULL or non-finite components take no part; only
vectors of one length are compared; rows repeated with one id are separate rows, each anchor row
with its own answer; an empty table gives no rows; other columns are ignored. A score beyond 64
bits is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.common import prepare_python, stage, take_over

POSITIVES = NEGATIVES = 5
LOWEST, HIGHEST = 80, 100
# Components of the anchors that are broadcast at once (32 MB).
CHUNK_VALUES = 4 * 1024**2
# Candidates packed at once, and anchors they are multiplied with at once.
ROWS, TILE = 4096, 1024
# Whole numbers that a double holds exactly have so many bits.
EXACT_BITS = 53


def hard_negatives(rows: DataFrame, label: Column | None = None, anchor: Column | None = None,
                   scale: float = 256.0, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, embedding and label. ``label`` replaces the label, ``anchor`` says which
    rows are anchors (every one whose id is divisible by 100). Negatives of a positive have
    ``lowest`` to ``highest`` hundredths of its score.
    """
    prepare_python(rows.sparkSession)
    kept = stage(_integers(rows, F.col("label") if label is None else label, scale), "vectors")
    ids = kept.df.filter(F.col("vec_id") % 100 == 0 if anchor is None else anchor)
    near = []
    for chunk in _chunks(ids):
        near.append(stage(_positives(kept.df, chunk, positives), "positives").df)
    if not near:
        return rows.sparkSession.createDataFrame([], (
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
            "negative_score long"))
    found = None
    for chunk, mine in zip(_chunks(ids), near, strict=True):
        part = stage(_negatives(kept.df, chunk, mine, negatives, lowest, highest),
                     "negatives").df
        found = part if found is None else found.unionByName(part)
    return found


def _integers(rows: DataFrame, label: Column, scale: float) -> DataFrame:
    """_uid, vec_id, label, v (whole numbers as doubles) of the rows that take part."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    scaled = F.transform("v", lambda x: F.when(
        # Larger doubles are whole already.
        F.abs(x * scale) < 2.0**EXACT_BITS, F.floor(x * scale).cast("double"))
        .otherwise(x * scale))
    return (rows.select(F.monotonically_increasing_id().alias("_uid"),
                        F.col("vec_id").cast("long").alias("vec_id"),
                        label.cast("long").alias("label"),
                        F.col("embedding").cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                    & F.col("v").isNotNull() & finite)
            .withColumn("v", scaled))


def _chunks(anchors: DataFrame) -> Iterator[dict]:
    """Anchors with their vectors by length, at most about ``CHUNK_VALUES`` components at once."""
    total = anchors.agg(F.sum(F.size("v") + 4)).first()[0]
    chunks = -(-(total or 0) // CHUNK_VALUES)
    for i in range(chunks):
        part = anchors.filter(F.pmod(F.xxhash64("_uid"), F.lit(chunks)) == i).toArrow()
        part = part.combine_chunks()
        yield {"uid": _numbers(part, "_uid"), "id": _numbers(part, "vec_id"),
               "label": _numbers(part, "label"), "vectors": _by_length(part)}


def _numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return table[name].to_numpy() if isinstance(table, pa.Table) else table[name].to_numpy(
        zero_copy_only=False)


def _by_length(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors (one in a row) of each length."""
    vectors = table["v"]
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == n)
        out[n] = places, (vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
                          .reshape(len(places), n))
    return out


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows) of whole numbers given as doubles."""
    (n, d), m = anchors.shape, len(rows)
    if not (n and m and d):
        return np.zeros((n, m), np.int64)
    low_a, low_r = anchors.min(), rows.min()
    a, r = anchors - low_a, rows - low_r
    largest = int(a.max()) * int(r.max()) * d
    width = max(1, largest.bit_length())
    # Biased components, biases and sums must be exact as well.
    most = max(abs(int(x)) for x in (low_a, low_r, anchors.max(), rows.max()))
    if width > EXACT_BITS or d * most * most >= 2**62:
        return _wide_scores(anchors, rows)
    fields = EXACT_BITS // width
    groups = -(-m // fields)
    padded = np.zeros((groups * fields, d))
    padded[:m] = r
    shifts = 2.0 ** (width * np.arange(fields))
    packed = np.einsum("f,fgd->gd", shifts, padded.reshape(fields, groups, d))
    product = (a @ packed.T).astype(np.int64)
    out = np.empty((n, fields, groups), np.int64)
    for f in range(fields):
        out[:, f] = (product >> (width * f)) & ((1 << width) - 1)
    out = out.reshape(n, -1)[:, :m]
    out += (int(low_r) * a.sum(axis=1).astype(np.int64))[:, None]
    out += int(low_a) * r.sum(axis=1).astype(np.int64) + d * int(low_a) * int(low_r)
    return out


def _wide_scores(anchors: np.ndarray, rows: np.ndarray, fields: int = 16) -> np.ndarray:
    """The same with Python's integers, whatever their size."""
    d = anchors.shape[1]
    a, r = ([[int(x) for x in v] for v in part.tolist()] for part in (anchors, rows))
    low_a, low_r = min(map(min, a)), min(map(min, r))
    high = (max(map(max, a)) - low_a) * (max(map(max, r)) - low_r) * d
    width = max(1, high.bit_length())
    mask = (1 << width) - 1
    out = np.empty((len(a), len(r)), np.int64)
    for first in range(0, len(r), fields):
        group = r[first:first + fields]
        packed = [sum((v[j] - low_r) << (width * f) for f, v in enumerate(group))
                  for j in range(d)]
        sums = [sum(v) - d * low_r for v in group]
        for i, anchor in enumerate(a):
            total = sum((x - low_a) * p for x, p in zip(anchor, packed, strict=True))
            own = sum(anchor) - d * low_a
            for f, s in enumerate(sums):
                out[i, first + f] = (((total >> (width * f)) & mask) + low_a * s + low_r * own
                                     + d * low_a * low_r)
    return out


class _Best:
    """The best ``n`` (score, id) of each key: higher scores first, then smaller ids."""

    NONE = -(2**63 - 1)

    def __init__(self, keys: int, n: int):
        self.n = n
        self.score = np.full((keys, n), self.NONE)
        self.id = np.zeros((keys, n), np.int64)

    def floor(self, keys) -> np.ndarray:
        """What a score must reach to count."""
        return self.score[keys, -1]

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        touched = np.unique(key)
        keys = np.concatenate([key, np.repeat(touched, self.n)])
        scores = np.concatenate([score, self.score[touched].reshape(-1)])
        ids = np.concatenate([ids, self.id[touched].reshape(-1)])
        order = np.lexsort((ids, -scores, keys))
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        order = order[rank < self.n]
        self.score[touched] = scores[order].reshape(-1, self.n)
        self.id[touched] = ids[order].reshape(-1, self.n)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, score and id of all that is held."""
        key, place = np.nonzero(self.score > self.NONE)
        return key, self.score[key, place], self.id[key, place]


def _meetings(batches, anchors: dict):
    """Squares of (places of anchors, rows' uid, id and label, scores)."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            columns = [_numbers(part, c) for c in ("_uid", "vec_id", "label")]
            for n, (places, vectors) in _by_length(part).items():
                mine, own = anchors["vectors"].get(n, (np.zeros(0, np.int64), None))
                for i in range(0, len(mine), TILE):
                    yield (mine[i:i + TILE], *[c[places] for c in columns],
                           packed_scores(own[i:i + TILE], vectors))


def _best_over_tasks(rows: DataFrame, search: Callable, anchors: dict, keys: list[str],
                     n: int) -> DataFrame:
    """``search`` in every task, then the best of each key, with their rank."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        take_over("hard-negatives")
        columns = search(batches, shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns],
                                         names=[*keys, "id", "score"])

    found = rows.mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "id", "score"]))
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def _positives(rows: DataFrame, anchors: dict, n: int) -> DataFrame:
    """anchor (place in the chunk), id, score, rank."""
    def search(batches, anchors):
        best = _Best(len(anchors["uid"]), n)
        for mine, uid, ids, label, scores in _meetings(batches, anchors):
            fits = ((anchors["label"][mine][:, None] == label)
                    & (anchors["uid"][mine][:, None] != uid)
                    & (scores >= best.floor(mine)[:, None]))
            a, r = np.nonzero(fits)
            best.add(mine[a], scores[a, r], ids[r])
        key, score, ids = best.found()
        return key, ids, score

    return _best_over_tasks(rows, search, anchors, ["anchor"], n)


def _negatives(rows: DataFrame, anchors: dict, positives: DataFrame, n: int, lowest: int,
               highest: int) -> DataFrame:
    """The result for the anchors of a chunk; ``positives`` has a few rows for each of them."""
    table = positives.toArrow()
    of, rank, pid, score = (table[c].to_numpy() for c in ("anchor", "rank", "id", "score"))
    place = np.full((len(anchors["uid"]), int(rank.max(initial=0))), -1)
    place[of, rank - 1] = np.arange(len(of))
    # Whole scores that satisfy lowest * p <= 100 * s <= highest * p.
    low = np.array([-(-lowest * p // 100) for p in score.tolist()], np.int64)
    high = np.array([highest * p // 100 for p in score.tolist()], np.int64)
    wide = anchors | {"place": place, "low": low, "high": high}

    def search(batches, anchors):
        place, low, high = anchors["place"], anchors["low"], anchors["high"]
        best = _Best(len(low), n)
        # Bounds of all windows of an anchor; empty where it has no positive.
        some = place >= 0
        least = np.where(some, low[place] if len(low) else 0, 2**62).min(axis=1, initial=2**62)
        most = np.where(some, high[place] if len(low) else 0, -2**62).max(axis=1, initial=-2**62)
        for mine, _, ids, label, scores in _meetings(batches, anchors):
            fits = ((scores >= least[mine][:, None]) & (scores <= most[mine][:, None])
                    & (anchors["label"][mine][:, None] != label))
            a, r = np.nonzero(fits)
            found, ids = scores[a, r], ids[r]
            for j in range(place.shape[1]):
                key = place[mine[a], j]
                ok = np.flatnonzero(key >= 0)
                ok = ok[(found[ok] >= np.maximum(low[key[ok]], best.floor(key[ok])))
                        & (found[ok] <= high[key[ok]])]
                best.add(key[ok], found[ok], ids[ok])
        key, score, ids = best.found()
        return key, ids, score

    found = _best_over_tasks(rows, search, wide, ["positive"], n)
    names = rows.sparkSession.createDataFrame(pa.table({
        "positive": np.arange(len(of)), "anchor_id": anchors["id"][of], "positive_id": pid,
        "positive_score": score})) if len(of) else rows.sparkSession.createDataFrame(
            [], "positive long, anchor_id long, positive_id long, positive_score long")
    return found.join(F.broadcast(names), "positive").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
