"""Phrase collocation mining by dynamic itemset counting (operator 11).

Texts are split into words once, in runs of some megabytes that keep their words as numbers of a
list, and the runs are dealt into shards, which are scanned in a cycle, one in each step. Words are counted from
the first step on; a longer phrase becomes active in the step after both its subphrases (without
its last, and without its first word) have been counted often enough, however far their own count
has come, and is counted through one full cycle of shards. So lengths interleave in each scan, and
the search ends when no active phrase has shards left.

Tasks know active phrases from a table of a fixed number of slots: a phrase is hashed to two of
them, and each slot keeps the first step after which a phrase in it was frequent. Slots only ever
fill, so a phrase that enters by chance (of its hashes) also stays for one full cycle: false
entries cost time, and change no count. Words are told the same way: while texts are split, every
task adds its words' counts up by hash, and a word whose slot stays below the threshold in all tasks
together cannot be frequent and is not counted. Counts are exact and kept by the phrase's words, in a
written table that one shuffle a step brings up to date; what has completed its cycle below the
threshold leaves it. Table and shuffle hold phrases in compressed blocks, one for each of many
buckets of the phrases' hashes, and a task brings one bucket at a time up to date. There is a bucket
for every ``BUCKET_RUNS`` runs of a scan, so buckets become more with the input. They also become
larger as more phrases are active, so a large one is brought up to date part by part.

Defined cases: NULL text is empty, NULL lang is ``und``; an empty table gives no rows; repeated
rows count each; ids may be NULL or repeated; other columns are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.common import prepare_python, stage, take_over, whole_text
from haulframe.sources.storage import Storage, scratch_path

THRESHOLD = 100
LONGEST = 5
TOP = 2000
SHARDS = 3
# Slots of the table of frequent phrases (one byte each), and its mark of an empty one.
SLOTS = 2**23
NEVER = 255
# Text that is counted together.
RUN_BYTES = 6 * 1024**2
SALTS = 64
# Slots of the counts of words by hash (one byte each, full at 255), and parts they are summed in.
WORD_SLOTS = 2**23
WORD_PARTS = 64
# Bytes of a word's hash: they take much of the room of a run, and equal hashes change no count.
HASH_BYTES = 5
# Shard of the rows that hold such counts.
COUNTED = -1
BREAKS = r"[.,;:!?\n\x0b\x0c\r]"
# A run's words, joined by spaces, with their hashes, the numbers of its words in a row (-1 between pieces),
# and the length and language of each text.
RUNS = ("shard int, words string, hashes binary, ids binary, langs array<string>, "
        "lengths binary, text_langs binary")
# Row groups of a run or a few, so that a scan opens only those of its shard.
RUN_FILES = {"parquet.block.size": str(4 * 1024**2), "parquet.block.size.row.check.min": "1",
             "parquet.enable.dictionary": "false", "compression": "zstd"}
COUNTS = "lang string, phrase string, k int, n long"
# Runs of a scan for each bucket of phrases.
BUCKET_RUNS = 2
# Phrases of a bucket, compressed: ``HELD`` serialized, then the bytes of all keys in a row (size:
# bytes before, head: those of the first part), and the slots of those that became frequent in the
# step.
BLOCKS = "bucket int, size long, head long, block binary, slots array<long>"
HELD = pa.schema({"bytes": pa.int32(), "k": pa.uint8(), "n": pa.int64(), "first": pa.uint8(),
                  "reached": pa.uint8()})
PHRASES = pa.schema([pa.field("key", pa.string()), *list(HELD)[1:]])
LEVEL = 6
# What a task holds at once, however many phrases are active: phrases of a run by their places,
# phrases of them spelled out, bytes of a bucket that are brought up to date together, and
# phrases of a block that it leaves.
FOUND_ROWS = 2**20
SPELLED_ROWS = 2**17
PASS_BYTES = 20 * 1024**2
HELD_ROWS = 2**18
BLOCK_FILES = RUN_FILES | {"compression": "none"}


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP,
                 lang_col: str = "lang", text_col: str = "text", shards: int = SHARDS,
                 longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    frequent = phrase_counts(docs, threshold, lang_col, text_col, shards, longest)
    return best_phrases(frequent, top)


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, lang_col: str = "lang",
                  text_col: str = "text", shards: int = SHARDS, longest: int = LONGEST,
                  slots: int = SLOTS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """lang, phrase, k (words), n: all phrases of up to ``longest`` words counted ``threshold``
    times or more, and for each language the number of its words, with k = 0."""
    spark = docs.sparkSession
    prepare_python(spark)
    path = scratch_path(spark, "phrase-runs")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        whole_text(text_col).alias("text"))
    (texts.mapInArrow(_splitter(shards, run_bytes), RUNS)
     .write.options(**RUN_FILES).parquet(path))
    runs = spark.read.schema(RUNS).parquet(path)
    ages = np.full(slots, NEVER, np.uint8)
    likely = spark.sparkContext.broadcast(_likely_words(runs, threshold))
    texts_runs = runs.filter(F.col("shard") != COUNTED).count()
    buckets = max(1, -(-texts_runs // (shards * BUCKET_RUNS)))
    counted, before = None, None
    step, end = 0, shards
    while step < end:
        shared = spark.sparkContext.broadcast(ages)
        scan = runs.filter(F.col("shard") == step % shards).drop("shard")
        found = scan.mapInArrow(_counter(shared, likely, step, shards, longest, buckets), BLOCKS)
        if counted is not None:
            found = found.unionByName(counted)
        path = scratch_path(spark, "phrase-counts")
        (found.groupBy("bucket").applyInArrow(_merger(step, shards, threshold, longest, slots), BLOCKS)
         .write.options(**BLOCK_FILES).parquet(path))
        counted = spark.read.schema(BLOCKS).parquet(path)
        shared.destroy()
        if before:
            Storage(spark, before).delete(before)
        before = path
        fresh = (counted.select(F.explode("slots").alias("slot")).distinct()
                 .toArrow()["slot"].to_numpy())
        if len(fresh):
            ages[fresh] = np.minimum(ages[fresh], step + 1)
            end = max(end, step + 1 + shards)
        step += 1
    likely.destroy()
    return stage(counted.select("size", "head", "block").mapInArrow(_unpacker(threshold), COUNTS),
                 "phrases").df


def word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11) >> 64 - 8 * HASH_BYTES


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one word more."""
    return _mixed(h * np.uint64(0xBF58476D1CE4E5B9) + word)


def _two_slots(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(slots - 1)
    return ((h & mask).astype(np.int64),
            ((h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(20) & mask)
            .astype(np.int64))


def _slots(lang: pa.Array, phrase: pa.Array, k: int, slots: int) -> np.ndarray:
    """Slots of phrases of ``k`` words, each once."""
    def hashed(values):
        values = values.dictionary_encode()
        of = np.array([word_hash(w) for w in values.dictionary.to_pylist()], np.uint64)
        return of[values.indices.to_numpy(zero_copy_only=False)]

    words = hashed(pc.split_pattern(phrase, " ").flatten()).reshape(-1, k)
    h = _mixed(words[:, 0] ^ hashed(lang))
    for i in range(1, k):
        h = _longer(h, words[:, i])
    return np.unique(np.concatenate(_two_slots(h, slots)))


def _block(bucket: int, rows: pa.RecordBatch, slots: np.ndarray | None = None) -> pa.RecordBatch:
    """The phrases (``PHRASES``) of a bucket as a row of ``BLOCKS``."""
    keys = rows["key"]
    head = pa.RecordBatch.from_arrays([pc.binary_length(keys), *rows.columns[1:]],
                                      schema=HELD).serialize()
    plain = b"".join([head, _letters(keys)[0]])
    fresh = [] if slots is None else slots
    packed = pa.Codec("zstd", compression_level=LEVEL).compress(plain, asbytes=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([len(plain)], pa.int64()),
         pa.array([len(head)], pa.int64()), pa.array([packed], pa.binary()),
         pa.ListArray.from_arrays(pa.array([0, len(fresh)], pa.int32()),
                                  pa.array(fresh, pa.int64()))],
        names=["bucket", "size", "head", "block", "slots"])


def _letters(keys: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all keys in a row, and where each begins."""
    if not len(keys):
        return memoryview(b""), np.zeros(0, np.int32)
    ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + len(keys) + 1]
    return memoryview(keys.buffers()[2] or b"")[ends[0]:ends[-1]], ends[:-1] - ends[0]


def _phrases_of(blocks, part: int = 0, parts: int = 1) -> pa.Table:
    """The phrases of all blocks of a batch or table, or those of one of ``parts``."""
    found = []
    for block, size, at in zip(blocks["block"], blocks["size"].to_pylist(),
                               blocks["head"].to_pylist(), strict=True):
        plain = pa.decompress(block.as_buffer(), size, codec="zstd")
        rows = pa.ipc.read_record_batch(plain.slice(0, at), HELD)
        ends = np.concatenate([[0], np.cumsum(rows["bytes"].to_numpy())]).astype(np.int32)
        keys = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(ends),
                                                              plain.slice(at)])
        rows = pa.RecordBatch.from_arrays([keys, *rows.columns[1:]], schema=PHRASES)
        if parts > 1 and len(rows):
            rows = rows.take(pa.array(np.flatnonzero(_parts(keys, parts) == part)))
        found.append(rows)
    return pa.Table.from_batches(found, PHRASES)


def _parts(keys: pa.Array, parts: int) -> np.ndarray:
    """The part of each key, by the sum of its bytes up to a space: phrases with one first word
    stay together, which takes less room."""
    letters, starts = _letters(keys)
    until = pc.find_substring(keys, " ").to_numpy()
    ends = np.append(starts[1:], len(letters))
    cuts = np.column_stack([starts, np.where(until < 0, ends, starts + until)]).ravel()
    # The last cut may stand behind all letters.
    letters = np.append(np.frombuffer(letters, np.uint8), np.uint8(0))
    return np.add.reduceat(letters, cuts, dtype=np.uint32)[::2] % np.uint32(parts)


def _split_keys(keys: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Language and phrase of the keys: a phrase holds no line feed."""
    parts = pc.split_pattern(keys, "\n", max_splits=1, reverse=True)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def _blocks(found: list[tuple[pa.RecordBatch | _Places, np.ndarray, np.ndarray]], step: int,
            buckets: int):
    """Rows of ``COUNTS`` with their hashes and the numbers of their first words, as blocks of the
    buckets of the hashes. Phrases with one first word stand together: they take less room so.
    Some buckets' rows are spelled out at a time; a bucket of more rows comes in several blocks."""
    h = np.concatenate([x for _, x, _ in found])
    bucket = ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(bucket << 32 | np.concatenate([x for _, _, x in found]), kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    del h, bucket
    starts = np.cumsum([0, *[len(x) for _, x, _ in found]])

    def spelled(low, high):
        """These rows of the order, as ``PHRASES``."""
        at = order[low:high]
        source = np.searchsorted(starts, at, side="right") - 1
        places = [np.flatnonzero(source == i) for i in range(len(found))]
        rows = pa.Table.from_batches(
            [x.take(pa.array(at[w] - starts[i])) for i, ((x, _, _), w) in
             enumerate(zip(found, places, strict=True)) if len(w)]).combine_chunks().to_batches()[0]
        back = np.empty(len(at), np.int64)
        back[np.concatenate(places)] = np.arange(len(at))
        back = pa.array(back)
        keys = pc.binary_join_element_wise(rows["lang"], rows["phrase"], "\n")
        return pa.RecordBatch.from_arrays(
            [keys.take(back), rows["k"].take(back).cast(pa.uint8()), rows["n"].take(back),
             pa.array(np.full(len(at), step, np.uint8)), pa.array(np.full(len(at), NEVER, np.uint8))],
            schema=PHRASES)

    cuts, done = [], 0
    for b in np.flatnonzero(sizes).tolist():
        end = done + int(sizes[b])
        while done < end:
            cuts.append((b, done, min(done + SPELLED_ROWS, end)))
            done = cuts[-1][2]
    while cuts:
        low, n = cuts[0][1], 1
        while n < len(cuts) and cuts[n][2] - low <= SPELLED_ROWS:
            n += 1
        rows = spelled(low, cuts[n - 1][2])
        for b, begin, end in cuts[:n]:
            yield _block(b, rows.slice(begin - low, end - begin))
        del cuts[:n]


def _merger(step: int, shards: int, threshold: int, longest: int, slots: int):
    """Brings the phrases of a bucket up to date with what a step has counted."""
    def merge(key, table):
        take_over("phrases")
        # A bucket of very many phrases is brought up to date part by part.
        parts = max(1, -(-sum(table["size"].to_pylist()) // PASS_BYTES))
        blocks = [b for part in range(parts) for b in merged(key[0].as_py(), table, part, parts)]
        return pa.Table.from_batches(blocks)

    def merged(bucket, table, part, parts):
        found = pa.TableGroupBy(_phrases_of(table, part, parts), "key", use_threads=False).aggregate(
            [("k", "min"), ("n", "sum"), ("first", "min"), ("reached", "min")])
        k, n, first, reached = (found[x].to_numpy() for x in ("k_min", "n_sum", "first_min",
                                                               "reached_min"))
        keys = found["key"].combine_chunks()
        del found
        often = (n >= threshold) & (k > 0)
        reached = np.where(often & (reached == NEVER), np.uint8(step + 1), reached)
        # A phrase seen in step ``first`` has completed its cycle ``shards`` steps later.
        open_ = first.astype(np.int64) + shards > step + 1
        kept = np.flatnonzero(often | open_ | (k == 0))
        for low in range(0, max(1, len(kept)), HELD_ROWS):
            at = kept[low:low + HELD_ROWS]
            rows = pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at)), *[pa.array(x[at]) for x in (k, n, first, reached)]],
                schema=PHRASES)
            fresh = [np.zeros(0, np.int64)]
            for size in range(1, longest):
                which = np.flatnonzero((reached[at] == step + 1) & (k[at] == size))
                if len(which):
                    fresh.append(_slots(*_split_keys(rows["key"].take(pa.array(which))), size,
                                        slots))
            yield _block(bucket, rows, np.concatenate(fresh))

    return merge


def _unpacker(threshold: int):
    """The frequent phrases and the totals of blocks, as rows of ``COUNTS``."""
    def unpack(batches):
        take_over("phrases")
        for batch in batches:
            for rows in _phrases_of(batch).to_batches():
                rows = rows.filter((pc.field("n") >= threshold) | (pc.field("k") == 0))
                lang, phrase = _split_keys(rows["key"])
                yield pa.RecordBatch.from_arrays(
                    [lang, phrase, rows["k"].cast(pa.int32()), rows["n"]],
                    names=["lang", "phrase", "k", "n"])

    return unpack


def _splitter(shards: int, run_bytes: int):
    """Splits a task's texts into runs of words, each of the next shard."""
    def split(batches):
        from pyspark import TaskContext

        take_over("phrases")
        shard = TaskContext.get().partitionId()
        tally = np.zeros(WORD_SLOTS, np.uint32)
        texts, langs, held = [], [], 0
        for batch in batches:
            texts.append(batch["text"])
            langs.append(batch["lang"])
            held += batch["text"].nbytes
            if held >= run_bytes:
                yield from written(texts, langs, shard % shards, tally)
                texts, langs, held = [], [], 0
                shard += 1
        if texts:
            yield from written(texts, langs, shard % shards, tally)

        if tally.any():
            yield _tally_row(tally)

    def written(texts, langs, shard, tally):
        run = _Run(pa.concat_arrays(texts), pa.concat_arrays(langs))
        if run.word.any():
            lang, ids, n = run.word_counts()
            np.add.at(tally, run.word_slots(lang, ids), n.astype(np.uint32))
            yield run.row(shard)

    return split


def _tally_row(tally: np.ndarray) -> pa.RecordBatch:
    """A task's counts of words by hash, as a row of ``RUNS`` without words."""
    held = np.minimum(tally, 255).astype(np.uint8)
    none = pa.array([b""], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([COUNTED], pa.int32()), pa.array([""]), pa.array([held.tobytes()], pa.binary()),
         none, pa.array([[]], pa.list_(pa.string())), none, none],
        names=["shard", "words", "hashes", "ids", "langs", "lengths", "text_langs"])


def _likely_words(runs: DataFrame, threshold: int) -> np.ndarray:
    """For each slot of words, whether all tasks together counted as often as the threshold: what
    is clipped at 255 has reached it as far as this can tell."""
    wide = WORD_SLOTS // WORD_PARTS

    def added(batches):
        """A partition's counts in parts."""
        total = np.zeros(WORD_SLOTS, np.uint32)
        for batch in batches:
            for i in range(batch.num_rows):
                total += np.frombuffer(batch["hashes"][i].as_buffer(), np.uint8)
        if total.any():
            parts = np.minimum(total, 255).astype(np.uint8).reshape(WORD_PARTS, wide)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(WORD_PARTS), pa.int32()),
                 pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def decided(batches):
        """The slots of some parts that are full enough, as bits."""
        totals = {}
        for batch in batches:
            for i, part in enumerate(batch["part"].to_pylist()):
                total = totals.setdefault(part, np.zeros(wide, np.uint32))
                total += np.frombuffer(batch["counts"][i].as_buffer(), np.uint8)
        bits = [np.packbits(t >= min(threshold, 255)).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array(bits, pa.binary())],
            names=["part", "counts"])

    schema = "part int, counts binary"
    found = (runs.filter(F.col("shard") == COUNTED).select("hashes").mapInArrow(added, schema)
             .repartition(WORD_PARTS, "part").mapInArrow(decided, schema).toArrow())
    likely = np.zeros(WORD_SLOTS, bool)
    for part, bits in zip(found["part"].to_pylist(), found["counts"].to_pylist(), strict=True):
        likely[part * wide:(part + 1) * wide] = np.unpackbits(np.frombuffer(bits, np.uint8))
    return likely


def _counter(shared, likely, step: int, shards: int, longest: int, buckets: int):
    """Counts the active phrases of a task's runs."""
    def count(batches):
        take_over("phrases")
        for batch in batches:
            for i in range(batch.num_rows):
                yield from blocks(_Run.of_row(batch, i))

    def blocks(run):
        found, held = [], 0
        for rows in counted(run, shared.value):
            if found and held + len(rows[1]) > FOUND_ROWS:
                yield from _blocks(found, step, buckets)
                found, held = [], 0
            found.append(rows)
            held += len(rows[1])
        if found:
            yield from _blocks(found, step, buckets)

    def counted(run, ages):
        if step < shards:
            yield run.totals(), _mixed(run.seeds), np.zeros(len(run.seeds), np.int32)
            lang, ids, n = run.likely_words(likely.value)
            yield run.word_rows(lang, ids, n), run.word_hashes(lang, ids), ids.astype(np.int32)
        h = run.first
        reached = run.reached(h, np.flatnonzero(run.word), ages)
        for k in range(2, longest + 1):
            # Both subphrases: without the last word, and without the first. Few places are left
            # from one length to the next, and only those are looked at.
            begin = np.maximum(reached[:-1], reached[1:])
            live = np.flatnonzero(begin <= step).astype(np.int32)
            h[live] = _longer(h[live], run.hashes[live + np.int32(k - 1)])
            active = live[begin[live].astype(np.int16) > step - shards]
            if len(active):
                first, n = run.distinct(active, h, k)
                yield _Places(run, first, n, k), h[first], run.ids[first]
            if k < longest:
                # Slots that others filled must not make a phrase older than its subphrases.
                reached = run.reached(h, live, ages)
                reached[live] = np.maximum(reached[live], begin[live])

    return count


class _Run:
    """The words of some texts, in a row, with marks between the pieces."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = pc.replace_substring(pc.ascii_lower(texts), "\t", " ")
        texts = pc.replace_substring_regex(texts, BREAKS, " . ")
        parts = pc.split_pattern(pc.binary_join_element_wise(texts, ".", " "), " ")
        found = parts.flatten().dictionary_encode()
        ids = found.indices.to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(parts), dtype=np.int32),
                         pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        many = len(parts)
        del texts, parts
        words = found.dictionary.to_pylist()
        # No word has a full stop; runs of spaces leave empty ones.
        mark = words.index(".")
        if "" in words:
            full = ids != words.index("")
            ids, rows = ids[full], rows[full]
        langs = langs.dictionary_encode()
        self._fill(found.dictionary, np.array([word_hash(w) for w in words], np.uint64),
                   np.where(ids == mark, np.int32(-1), ids), langs.dictionary,
                   np.bincount(rows, minlength=many).astype(np.int32),
                   langs.indices.to_numpy(zero_copy_only=False).astype(np.int32))

    def _fill(self, words, hashes, ids, langs, lengths, text_langs):
        self.words, self.hashes_of, self.ids, self.langs = words, hashes, ids, langs
        self.lengths, self.text_langs = lengths, text_langs
        self.lang = np.repeat(text_langs, lengths)
        self.word = ids >= 0
        self.seeds = np.array([word_hash(x) for x in langs.to_pylist()], np.uint64)

    @cached_property
    def hashes(self) -> np.ndarray:
        # Marks get the hash of some word: no phrase holds one.
        return self.hashes_of[self.ids]

    @cached_property
    def first(self) -> np.ndarray:
        return _mixed(self.hashes ^ self.seeds[self.lang])

    def row(self, shard: int) -> pa.RecordBatch:
        """The run as one row of ``RUNS``."""
        def numbers(values):
            return pa.array([values.tobytes()], pa.binary())

        def listed(values):
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()),
                                            values.cast(pa.string()))

        hashes = self.hashes_of.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pc.binary_join(listed(self.words), " "), numbers(hashes),
             numbers(self.ids), listed(self.langs), numbers(self.lengths),
             numbers(self.text_langs)],
            names=["shard", "words", "hashes", "ids", "langs", "lengths", "text_langs"])

    @classmethod
    def of_row(cls, batch: pa.RecordBatch, i: int) -> _Run:
        def numbers(name, dtype):
            return np.frombuffer(batch[name][i].as_buffer(), dtype)

        kept = numbers("hashes", np.uint8).reshape(-1, HASH_BYTES)
        hashes = np.zeros((len(kept), 8), np.uint8)
        hashes[:, :HASH_BYTES] = kept
        run = cls.__new__(cls)
        run._fill(pc.split_pattern(batch["words"].slice(i, 1), " ").flatten(),
                  hashes.view(np.uint64).ravel(),
                  numbers("ids", np.int32), batch["langs"][i].values,
                  numbers("lengths", np.int32), numbers("text_langs", np.int32))
        return run

    def reached(self, h: np.ndarray, places: np.ndarray, ages: np.ndarray) -> np.ndarray:
        """The step from which the phrase at each of the places counts as frequent."""
        out = np.full(len(h), NEVER, np.uint8)
        for low in range(0, len(places), SPELLED_ROWS):
            at = places[low:low + SPELLED_ROWS]
            a, b = _two_slots(h[at], len(ages))
            out[at] = np.maximum(ages[a], ages[b])
        return out

    def totals(self) -> pa.RecordBatch:
        """Words of each language, as rows without a phrase."""
        n = np.bincount(self.lang[self.word], minlength=len(self.langs))
        return _rows(self.langs, pa.array([""] * len(self.langs)), 0, n)

    def word_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, number and count of all words; those of a language stand together."""
        keys = self.lang[self.word].astype(np.int64) * len(self.words) + self.ids[self.word]
        if len(self.langs) * len(self.words) <= 4 * len(keys):
            n = np.bincount(keys)
            keys = np.flatnonzero(n)
            n = n[keys]
        else:
            keys, n = np.unique(keys, return_counts=True)
        return *np.divmod(keys, len(self.words)), n

    def word_hashes(self, lang: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return _mixed(self.hashes_of[ids] ^ self.seeds[lang])

    def word_slots(self, lang: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (self.word_hashes(lang, ids) >> np.uint64(13)
                & np.uint64(WORD_SLOTS - 1)).astype(np.int64)

    def likely_words(self, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``word_counts``, the words that may be frequent."""
        lang, ids, n = self.word_counts()
        kept = likely[self.word_slots(lang, ids)]
        return lang[kept], ids[kept], n[kept]

    def word_rows(self, lang: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return _rows(self.langs.take(pa.array(lang)), self.words.take(pa.array(ids)), 1, n)

    def singles(self) -> pa.RecordBatch:
        """All words with their counts."""
        return self.word_rows(*self.word_counts())

    def distinct(self, places: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A place of each phrase of ``k`` words at some places, and its count there; a phrase that
        shares its hash with another may come repeatedly."""
        found = h[places]
        order = np.argsort(found, kind="stable")
        found, places = found[order], places[order]
        del order
        begins = np.flatnonzero(np.append(True, found[1:] != found[:-1])[:len(found)])
        del found
        n = np.diff(begins, append=len(places))
        first = places[begins]
        # Hashes only sort: words decide what is equal.
        of = np.repeat(first, n)
        same = self.lang[of] == self.lang[places]
        for i in range(k):
            same &= self.ids[of + i] == self.ids[places + i]
        if not same.all():
            other = places[~same]
            n = np.concatenate([n - np.add.reduceat(~same, begins, dtype=np.int64),
                                np.ones(len(other), np.int64)])
            first = np.concatenate([first, other])
        return first, n

    def summed(self, places: np.ndarray, h: np.ndarray, k: int) -> pa.RecordBatch:
        """The phrases of ``k`` words at some places, with their counts."""
        return self.phrase_rows(*self.distinct(places, h, k), k)

    def phrase_rows(self, first: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
        words = [self.words.take(pa.array(self.ids[first + i])) for i in range(k)]
        phrases = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0]
        return _rows(self.langs.take(pa.array(self.lang[first])), phrases, k, n)


class _Places:
    """Phrases of ``k`` words of a run, each at one of its places, with their counts."""

    def __init__(self, run: _Run, first: np.ndarray, n: np.ndarray, k: int):
        self.run, self.k = run, k
        self.first, self.n = first.astype(np.int32), n.astype(np.int32)

    def take(self, at: pa.Array) -> pa.RecordBatch:
        """Some of them, spelled out."""
        at = at.to_numpy()
        return self.run.phrase_rows(self.first[at], self.n[at], self.k)


def _rows(lang: pa.Array, phrase: pa.Array, k: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [lang, phrase, pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64))],
        names=["lang", "phrase", "k", "n"])


def best_phrases(frequent: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score from ``phrase_counts``.

    Arithmetic is in decimals of 38 digits, exact for up to 10 to the 17 words.
    """
    words = F.split("phrase", " ")
    found = frequent.filter("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"),
                                             words.alias("w"))
    # Phrases inside a longer one that is as frequent go.
    inner = (found.filter("k >= 3")
             .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
             .select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ")
                     .alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (found.join(inner, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))))
    parts = frequent.filter("k >= 1").select("lang", "phrase", "n")
    cuts = (kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", "a", "cut",
                    F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
                    F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ")
                    .alias("right"))
            .join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")),
                  ["lang", "left"])
            .join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")),
                  ["lang", "right"]))
    totals = stage(frequent.filter("k = 0").select("lang", F.col("n").alias("words")), "words")
    cuts = cuts.join(F.broadcast(totals.df) if totals.broadcastable else totals.df, "lang")
    a, n, left, right = (F.col(c).cast("decimal(18,0)") for c in ("a", "words", "l", "r"))
    cuts = cuts.withColumn("above", a * F.lit(1000).cast("decimal(4,0)") * n)
    cuts = cuts.withColumn("below", left * right).withColumn("score", F.expr("above div below"))
    lowest = (cuts.groupBy("lang", "phrase", "a", "words")
              .agg(F.min(F.struct("score", "cut", "l", "r")).alias("low")))
    scored = lowest.select("lang", "phrase", "a", F.col("low.l").alias("l"),
                           F.col("low.r").alias("r"), F.col("words").alias("n"),
                           F.col("low.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that no task sorts a whole language.
    part = Window.partitionBy("lang", "_salt").orderBy(*order)
    best = (scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
            .withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= top))
    whole = Window.partitionBy("lang").orderBy(*order)
    return (best.withColumn("rank", F.row_number().over(whole).cast("long"))
            .filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
