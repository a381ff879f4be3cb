"""Quality rules (operator 2): an isolation forest over rule statistics.

Statistics of every whole text are counted in Arrow batches and written once. The forest is fitted
on at most ``TRAIN_ROWS`` rows that are labelled good and pass the base rules: random splits of
ratios made from the statistics. Documents that such splits set apart early are anomalous. The
score that still counts as good is calibrated over all such rows, through a histogram of fixed
size.

Defined cases: NULL text has no words, so all its counts are 0 and it fails the base rules;
without good labels nothing but the base rules drops a document; NULL or repeated labels are
ignored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm.common import prepare_python, stage, take_over, whole_text

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

TRAIN_ROWS = 4096
TREES = 100
SUBSAMPLE = 256
# Share of good rows that may fall beyond the threshold.
GOOD_LOSS = 0.005
# A split may lie this many spans of its node beyond the node's rows.
BEYOND = 2.0
BINS = 10_000
SEED = 20_231

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper",
         "n_marks", "n_lines", "n_distinct", "n_top")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
            text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col``, the rule statistics, base_failed, kept and the forest's score."""
    stats = stage(statistics(docs, id_col, text_col), "quality-statistics").df
    marks = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("_id"))
             .agg(F.min(label_col).alias("_label")))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    good = stage(stats.filter(~failed).join(marks.filter(F.col("_label") == 1), "_id"),
                 "quality-good").df
    rows = (good.orderBy(F.xxhash64("_id"), "_id", *STATS).limit(TRAIN_ROWS)
            .select(*STATS).toPandas())
    forest = grow(ratios(rows.to_numpy(np.float64).reshape(-1, len(STATS))))
    limit = _threshold(_scored(good, forest, ["_id"]))
    scored = _scored(stats, forest, ["_id", *STATS[:5]])
    return scored.select(
        F.col("_id").alias(id_col), *STATS[:5], failed.alias("base_failed"),
        (~failed & (F.col("score") <= limit)).alias("kept"), "score")


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < 20) | (100 * repeated > 30 * words)


def text_statistics(text: str) -> tuple[int, ...]:
    """The counts of ``STATS`` for a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    places: dict[bytes, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(ids), upper,
            sum(map(text.count, "!?")), len(lines), len(places),
            int(np.bincount(ids).max()) if n else 0)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` (a power of two) words found twice or more."""
    if len(ids) < window + 1:
        return 0
    runs, width = ids, 1
    while width < window:
        pairs = runs[:-width] * (int(runs.max()) + 1) + runs[width:]
        _, runs, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(runs):
            return 0
        width *= 2
    starts = np.flatnonzero(counts[runs] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and the counts of ``STATS`` for each document."""
    prepare_python(docs.sparkSession)

    def count(batches):
        take_over("quality")
        for batch in batches:
            rows = np.array([text_statistics(str(t)) for t in batch["text"]], np.int64)
            rows = rows.reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *[pa.array(rows[:, i]) for i in range(len(STATS))]],
                names=["_id", *STATS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(count, "_id long, " + ", ".join(f"{s} long" for s in STATS))


def ratios(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on; one row per document."""
    words, chars, symbols, dup, repeat, upper, marks, lines, distinct, top = stats.T
    n = np.maximum(words, 1)
    return np.stack([
        np.minimum(chars / n, 40), symbols / n,
        np.maximum(dup / np.maximum(lines, 1), repeat / n),
        np.maximum(upper / np.maximum(chars, 1), marks / n), top / (n + 20),
    ], axis=1)


def grow(rows: np.ndarray, trees: int = TREES, sample: int = SUBSAMPLE) -> dict | None:
    """Trees as flat arrays: feature (-1: leaf), cut, left child, and path length at a leaf."""
    if not len(rows):
        return None
    draw = np.random.default_rng(SEED)
    feature, cut, left, length, roots = [], [], [], [], []

    def node() -> int:
        for column, value in ((feature, -1), (cut, 0.0), (left, 0), (length, 0.0)):
            column.append(value)
        return len(feature) - 1

    deepest = int(np.ceil(np.log2(max(2, min(sample, len(rows))))))
    for _ in range(trees):
        part = rows[draw.choice(len(rows), min(sample, len(rows)), replace=False)]
        roots.append(node())
        todo = [(roots[-1], part, 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(wide):
                length[at] = depth + average_path(len(part))
                continue
            # Splits are drawn over a span wider than the sample, so what lies beyond is set apart.
            f = int(draw.choice(wide))
            span = high[f] - low[f]
            cut[at] = draw.uniform(low[f], high[f] + BEYOND * span)
            feature[at] = f
            left[at] = node()
            node()
            below = part[:, f] < cut[at]
            for child, rest in ((left[at], part[below]), (left[at] + 1, part[~below])):
                if len(rest):
                    todo.append((child, rest, depth + 1))
                else:
                    length[child] = depth + 1
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left),
            "length": np.array(length), "roots": np.array(roots),
            "scale": average_path(min(sample, len(rows)))}


def average_path(n: int) -> float:
    """Mean path of an unsuccessful search among n."""
    if n < 2:
        return 0.0
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def anomaly(forest: dict | None, rows: np.ndarray) -> np.ndarray:
    """Score from 0 (deep) to 1 (set apart at once)."""
    if forest is None:
        return np.zeros(len(rows))
    total = np.zeros(len(rows))
    everyone = np.arange(len(rows))
    for root in forest["roots"]:
        at = np.full(len(rows), root)
        while True:
            f = forest["feature"][at]
            inner = f >= 0
            if not inner.any():
                break
            right = rows[everyone, f] >= forest["cut"][at]
            at = np.where(inner, forest["left"][at] + right, at)
        total += forest["length"][at]
    return 2.0 ** (-total / len(forest["roots"]) / max(forest["scale"], 1e-9))


def _scored(stats: DataFrame, forest: dict | None, keep: Sequence[str]) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    kinds = dict(stats.dtypes)

    def score(batches):
        for batch in batches:
            rows = np.stack([batch[s].to_numpy(zero_copy_only=False) for s in STATS], axis=1)
            found = anomaly(shared.value, ratios(rows.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(found)],
                                             names=[*keep, "score"])

    return stats.mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double")


def _threshold(good: DataFrame) -> float:
    """Lowest score beyond which at most ``GOOD_LOSS`` of the good rows lie."""
    bins = (good.groupBy(F.ceil(F.col("score") * BINS).cast("int").alias("bin"))
            .count().collect())
    total, beyond = sum(r["count"] for r in bins), 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        beyond += r["count"]
        if beyond > GOOD_LOSS * total:
            return r["bin"] / BINS
    return 1.0
