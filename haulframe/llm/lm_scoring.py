"""LM scoring (operator 7): a gated recurrent word model over counts of the whole corpus.

1. The words of all training documents are counted. Words that are not frequent are modelled by
   their tail class (from their first two bytes) and, within it, by their counts plus one.
2. The recurrent model (``gru``) starts as the unigram model. The rounds share out all training
   documents by a hash of the id, so each is learned from once. In a round every task trains a
   replica on its documents; the replicas are averaged in a tree of tasks.
3. Every whole document is scored in lanes that carry the state from window to window. Counts of
   the most frequent words are broadcast (``HEAD_WORDS`` of bounded length); the other words are
   joined with the count table, so no document needs the whole vocabulary in memory.

Texts are turned into the model's symbols once, in a written table that training and scoring read.

The replicas, and so the model and ``score``, depend on how the rows fall into partitions; the
counts and ``base_score`` do not.

Defined cases: NULL text is empty, one token (the end); without training documents the counts are
empty and every word is unseen; NULL ids are neither held out nor learned from; repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm import gru
from haulframe.llm.common import (
    keep_freed,
    prepare_python,
    return_freed,
    stage,
    take_over,
    whole_text,
)
from haulframe.sources.storage import scratch_path

VOCABULARY = 1023
TAILS = 64
# Words whose counts are broadcast, and their longest.
HEAD_WORDS = 131_072
HEAD_BYTES = 64
# Rounds of training; each learns from its share of the documents, together from all of them.
ROUNDS = 3
# Where Adagrad's sums of squares begin.
SEEN = 1e-5
# Tokens that a task holds at once, and distinct words it counts before it hands them on.
BUFFER = 4_000_000
DISTINCT = 200_000
# Counts, and bytes of them, that a task holds before it adds up those of the same word.
HELD = 4 * DISTINCT
HELD_BYTES = 32 * 1024**2
# Replicas that one task averages.
FAN_IN = 32


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    prepare_python(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_uid"), F.col(id_col).cast("long").alias("_id"),
        held_out(id_col).alias("_held"), whole_text(text_col).alias("text"))
    training = rows.filter(~F.col("_held") & F.col("_id").isNotNull())
    counts = stage(count_words(training), "word-counts").df
    plan = _plan(counts, training.count())
    path = scratch_path(docs.sparkSession, "lm-symbols")
    _read(rows, plan).write.parquet(path)
    read = docs.sparkSession.read.schema(READ).parquet(path)
    model = _trained(read.filter(~F.col("_held") & F.col("_id").isNotNull()), plan)
    scored = stage(_scored(read, model), "lm-scored").df
    rare = (_counted(read, counts, plan["tokens"])
            .groupBy("_uid").agg(
                F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
                F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more")))
    every = plan["tokens"] + plan["distinct"] + 1
    known = F.col("known") + F.coalesce("more_known", F.lit(0))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(rare, "_uid", "left").select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(plan["tokens"]).cast("long").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * float(np.log10(every))).alias("base_score"),
        (F.col("modelled") + more).alias("score"))


def _counted(read: DataFrame, counts: DataFrame, tokens: int) -> DataFrame:
    """_uid, times and n (NULL: never seen) of each document's rare words.

    A word is rare, or longer than ``HEAD_BYTES``. Of the long ones fewer than a thousand can each
    be over a thousandth of all tokens: these are met by broadcast, by their digests, so no task
    of the join gets all rows of a frequent word.
    """
    long = F.when(F.octet_length("word") > HEAD_BYTES, F.sha2("word", 256))
    hot = (counts.filter((F.octet_length("word") > HEAD_BYTES) & (F.col("n") * 1000 > tokens))
           .select(long.alias("_sha"), F.col("n").alias("_hot")))
    rows = (read.select("_uid", F.explode("rare").alias("r"))
            .select("_uid", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
            .withColumn("_sha", long).join(F.broadcast(hot), "_sha", "left"))
    rest = rows.filter(F.col("_hot").isNull()).join(counts, "word", "left")
    return (rest.select("_uid", "times", "n").unionByName(
        rows.filter(F.col("_hot").isNotNull()).select("_uid", "times", F.col("_hot").alias("n"))))


def _begin() -> None:
    """Called in a worker before any work here."""
    take_over("lm-scoring", return_freed)
    keep_freed()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the words of all in a row by their numbers, and the words
    of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    found = parts.flatten().dictionary_encode()
    ids = found.indices.to_numpy(zero_copy_only=False)
    words = found.dictionary.cast(pa.binary())
    # White space at either end of a text leaves an empty word.
    none = pc.index(words, pa.scalar(b"", pa.binary())).as_py()
    if none >= 0:
        full = ids != none
        rows = np.repeat(np.arange(len(sizes)), sizes)[full]
        ids, sizes = ids[full], np.bincount(rows, minlength=len(sizes))
    return words, ids, sizes


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[:2]) % TAILS


def count_words(rows: DataFrame) -> DataFrame:
    """word (binary) and n over all rows."""
    def count(batches):
        _begin()
        held = []
        for batch in batches:
            words, ids, _ = words_of(batch["text"])
            n = np.bincount(ids, minlength=len(words))
            held.append(pa.table([words, pa.array(n, pa.int64())], names=["word", "n"])
                        .filter(pa.array(n > 0)))
            if sum(map(len, held)) > HELD or sum(part.nbytes for part in held) > HELD_BYTES:
                held = [added(held)]
                if len(held[0]) > DISTINCT or held[0].nbytes > HELD_BYTES // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from added(held).to_batches()

    def added(held):
        return (pa.concat_tables(held).group_by("word", use_threads=False)
                .aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]))

    return (rows.select("text").mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _plan(counts: DataFrame, documents: int) -> dict:
    """What every task needs: totals, frequent words with their counts, tail classes."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"),
                                                      F.sum("n").alias("n")).collect()
    lowest, room = 1 << 20, HEAD_WORDS
    for r in sorted(levels, key=lambda r: -r["level"]):
        room -= r["words"]
        if room < 0:
            break
        lowest = r["level"]
    head = (counts.filter((level >= lowest) & (F.octet_length("word") <= HEAD_BYTES))
            .toArrow().to_pydict())
    head = sorted(zip(head["word"], head["n"], strict=True), key=lambda x: (-x[1], x[0]))
    # Classes are runs of the alphabet, so words of a kind share one.
    vocabulary = sorted(w for w, _ in head[:VOCABULARY])
    of = dict(head)
    tail = F.pmod(F.crc32(F.substring("word", 1, 2)), F.lit(TAILS)).cast("int")
    sums = counts.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"),
                                                  F.count(F.lit(1)).alias("v")).collect()
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    for r in sums:
        tail_n[r["tail"]], tail_v[r["tail"]] = r["n"], r["v"]
    for w in vocabulary:
        tail_n[tail_of(w)] -= of[w]
        tail_v[tail_of(w)] -= 1
    words = np.array([of[w] for w in vocabulary] + [documents], np.float64)
    return {"tokens": sum(r["n"] for r in levels) + documents,
            "distinct": sum(r["words"] for r in levels) + (documents > 0),
            "documents": documents, "head": head, "vocabulary": vocabulary,
            "word_counts": words, "tail_counts": tail_n,
            "tail_total": np.log10(tail_n + tail_v + 1)}


# A document: its symbols with the end (16 bits each), tokens, known ones, the sum of log counts,
# what its tail words add to the model's part, and its words beyond the head.
READ = ("_uid long, _id long, _held boolean, symbols binary, n_tokens long, known long, "
        "counted double, tails double, rare array<struct<word: binary, n: long>>")


class _Symbols:
    """Turns words into symbols and counts; made once in each task."""

    def __init__(self, plan: dict):
        vocabulary = {w: i for i, w in enumerate(plan["vocabulary"])}
        self.end = len(vocabulary)
        self.first_tail = -(-(self.end + 1) // gru.CLASS) * gru.CLASS
        self.head = pa.array([w for w, _ in plan["head"]], pa.binary())
        self.log_count = np.log10(np.array([n for _, n in plan["head"]] + [0], np.float64) + 1)
        self.symbol = np.array(
            [vocabulary[w] if w in vocabulary else self.first_tail + tail_of(w)
             for w, _ in plan["head"]] + [0], np.int16)
        self.end_log_count = float(np.log10(plan["documents"] + 1))
        self.end_known = int(plan["documents"] > 0)
        self.tail_total = plan["tail_total"]

    def read(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The texts of a batch, as rows of ``READ``."""
        words, ids, sizes = words_of(batch["text"])
        distinct, rows = len(words), np.repeat(np.arange(len(sizes)), sizes)
        place = pc.index_in(words, value_set=self.head).fill_null(-1).to_numpy()
        symbol, logs = self.symbol[place], self.log_count[place]  # place -1 has count 0
        unknown = np.flatnonzero(place < 0)
        starts = pc.binary_slice(words.take(pa.array(unknown)), 0, 2).dictionary_encode()
        tails = [self.first_tail + tail_of(start) for start in starts.dictionary.to_pylist()]
        symbol[unknown] = np.array(tails, np.int16)[starts.indices.to_numpy()]
        # What a tail word adds to the model's part: its share of its class.
        inner = np.zeros(distinct)
        in_tail = symbol >= self.first_tail
        inner[in_tail] = logs[in_tail] - self.tail_total[symbol[in_tail] - self.first_tail]
        rare = place[ids] < 0
        # Rare words of each text, each once.
        keys, times = np.unique(rows[rare] * distinct + ids[rare], return_counts=True)
        rare_row, rare_word = np.divmod(keys, max(1, distinct))
        n = len(sizes)
        ends = np.cumsum(sizes + 1)
        symbols = np.full(ends[-1] if n else 0, self.end, "<i2")
        symbols[np.arange(len(ids)) + rows] = symbol[ids]
        counted = np.bincount(rows, logs[ids], n) + self.end_log_count
        known = sizes - np.bincount(rows[rare], minlength=n) + self.end_known
        offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(np.bincount(rare_row, minlength=n))])
        return pa.RecordBatch.from_arrays(
            [batch["_uid"], batch["_id"], batch["_held"],
             pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets),
                                                    pa.py_buffer(symbols)]),
             pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(counted),
             pa.array(np.bincount(rows, inner[ids], n), pa.float64()),
             pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.StructArray.from_arrays(
                 [words.take(pa.array(rare_word)), pa.array(times, pa.int64())], ["word", "n"]))],
            names=["_uid", "_id", "_held", "symbols", "n_tokens", "known", "counted", "tails",
                   "rare"])


def _read(rows: DataFrame, plan: dict) -> DataFrame:
    """All documents, as rows of ``READ``."""
    shared = rows.sparkSession.sparkContext.broadcast(
        {k: plan[k] for k in ("head", "vocabulary", "documents", "tail_total")})

    def run(batches):
        _begin()
        symbols = _Symbols(shared.value)
        for batch in batches:
            yield symbols.read(batch)

    return rows.mapInArrow(run, READ)


def _trained(training: DataFrame, plan: dict) -> dict[str, np.ndarray]:
    """Rounds of replicas, averaged."""
    model = gru.new_model(plan["word_counts"], plan["tail_counts"])
    seen = {k: np.full_like(v, SEEN) for k, v in model.items()}
    context = training.sparkSession.sparkContext
    for i in range(ROUNDS):
        start = context.broadcast((model, seen))

        def learn(batches, start=start):
            _begin()
            model, seen = ({k: v.copy() for k, v in part.items()} for part in start.value)
            docs, held, used = [], 0, 0
            for batch in batches:
                for symbols in batch["symbols"]:
                    docs.append(np.frombuffer(symbols.as_buffer(), "<i2"))
                    held += len(docs[-1])
                    if held > BUFFER:
                        used += gru.train(model, seen, docs)
                        docs, held = [], 0
            used += gru.train(model, seen, docs)
            if used:
                yield _replica(used * np.concatenate([gru.flatten(model), gru.flatten(seen)])
                               .astype(np.float64), used)

        part = F.pmod(F.xxhash64("_id"), F.lit(ROUNDS)) == i
        replicas = stage(training.filter(part).select("symbols").mapInArrow(
            learn, "sums binary, used double"), "replicas")
        flat, used = _added(replicas)
        if used:
            half = len(flat) // 2
            model = gru.unflatten(flat[:half] / used, model)
            seen = gru.unflatten(flat[half:] / used, seen)
    return model


def _replica(sums: np.ndarray, used: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([sums.astype("<f8").tobytes()], pa.binary()), pa.array([float(used)])],
        names=["sums", "used"])


def _added(replicas) -> tuple[np.ndarray, float]:
    """Sum of all replicas, in a tree; at most ``FAN_IN`` reach the driver."""
    def add(batches):
        total, used = None, 0.0
        for batch in batches:
            for sums, n in zip(batch["sums"], batch["used"], strict=True):
                values = np.frombuffer(sums.as_py(), "<f8")
                total = values.copy() if total is None else total + values
                used += n.as_py()
        if total is not None:
            yield _replica(total, used)

    while replicas.rows > FAN_IN:
        fewer = replicas.df.repartition(-(-replicas.rows // FAN_IN))
        replicas = stage(fewer.mapInArrow(add, "sums binary, used double"), "replicas")
    total, used = np.zeros(0), 0.0
    for r in replicas.df.toLocalIterator():
        values = np.frombuffer(r["sums"], "<f8")
        total = values.copy() if not len(total) else total + values
        used += r["used"]
    return total, used


def _scored(read: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The documents' numbers, and the model's part of their score."""
    shared = read.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        _begin()
        held, docs, size = [], [], 0
        for batch in batches:
            held.append(batch.drop_columns(["symbols"]))
            found = [np.frombuffer(x.as_buffer(), "<i2") for x in batch["symbols"]]
            docs += found
            size += sum(len(x) for x in found)
            if size > BUFFER:
                yield scored(held, docs)
                held, docs, size = [], [], 0
        if held:
            yield scored(held, docs)

    def scored(held, docs):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        modelled = gru.score(shared.value, docs) + rows["tails"].to_numpy()
        return rows.drop_columns(["tails"]).append_column("modelled", pa.array(modelled))

    return read.drop("rare").mapInArrow(run, (
        "_uid long, _id long, _held boolean, n_tokens long, known long, counted double, "
        "modelled double"))
