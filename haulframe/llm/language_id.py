"""Language ID (operator 3): interpolated Kneser-Ney character models, one per language.

The models are counted on a bounded sample of labelled documents: about ``TRAIN_DOCS`` documents
of each language, taken by a hash, with at most ``TRAIN_CHARS`` characters; rows that agree in id
and text count once. Texts are whole unless they exceed that together; then each gives its first
characters up to an even share, so a long text displaces no other. The models are stored as sorted
arrays of n-gram hashes with one column for each language (the driver builds them, so languages
must be few: some hundreds): an n-gram that any language knows has its interpolated probability in
every one, so scoring takes one search for most characters, and shorter histories only where none
knows it. A text belongs to the language with the lowest cross-entropy for each character. It is
rejected if that lies farther above the language's usual value than the calibration documents'
did, allowing more for short texts.

Defined cases: a NULL text, or one without a letter, is ``und``, rejected, with score 0; without
training rows every text is; ties go to the smaller language code; an empty table gives no rows;
repeated rows get the same result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm.common import (
    prepare_python,
    stage,
    take_over,
    unpacked,
    whole_row,
    whole_text,
)

ORDER = 4
TRAIN_DOCS = 400
TRAIN_CHARS = 2_000_000
# Characters scored at once.
RUN = 1 << 17
PAD = 32
UNKNOWN = "und"
# Spread of short texts counts up to this many characters.
STEADY = 400
# With fewer labelled documents, each is cut in halves, to count and to calibrate; with fewer
# different calibration values, the spread of all languages counts too.
FEW = 16
# Least limit of such a language.
LEAST = 6.0


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose label the models may not see."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``id_col``, held_out, lang_pred, score, accepted for each document.

    Every text with a letter gets a learned language; ``accepted`` tells whether it is like it.
    """
    found = _tagger(docs, fit(docs, id_col, text_col, lang_col))(whole_text(text_col))
    held = F.coalesce(held_out(id_col), F.lit(False))
    tagged = docs.select(F.col(id_col).alias("_id"), held.alias("_held"), found.alias("_found"))
    return tagged.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"),
                         "_found.lang_pred", "_found.score", "_found.accepted")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> DataFrame:
    """The documents that are accepted, with all their columns."""
    found = _tagger(docs, fit(docs, id_col, text_col, lang_col))(whole_text(text_col))
    tagged = docs.select(whole_row(docs), found.alias("_found"))
    return tagged.filter("_found.accepted").select(*unpacked(docs))


def _tagger(docs: DataFrame, model: dict):
    prepare_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def tag(texts: pa.Array) -> pa.Array:
        take_over("language-id", _letters.cache_clear)
        model = shared.value
        total, n = cross_entropy(model, map(str, texts))
        lang, score, good = decide(model, total, n)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score),
                                           pa.array(good)], ["lang_pred", "score", "accepted"])

    return tag


# --- characters


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point's lower-case letter; a space for whatever is no letter."""
    table = np.full(0x110000, PAD, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def normalise(text: str) -> np.ndarray:
    """Lower-case letters, everything between them as one space; empty without a letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _letters()[raw]
    space = codes == PAD
    space[1:] &= space[:-1].copy()
    if len(space):
        space[0] = codes[0] == PAD
    codes = codes[~space]
    return codes if len(codes) and (codes != PAD).any() else codes[:0]


def gram_hashes(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at each place from ``order - 1`` on."""
    codes = codes.astype(np.uint64)
    n = len(codes) - order + 1
    out, value = [], None
    for size in range(1, order + 1):
        # Horner's rule over the last ``size`` codes, oldest first.
        value = np.full(n, size, np.uint64)
        for k in range(size):
            at = order - size + k
            value = value * np.uint64(0x9E3779B97F4A7C15) + codes[at:at + n]
            value ^= value >> np.uint64(29)
        out.append(value)
    return out


# --- fitting


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> dict:
    """Models, and what cross-entropy is usual, from the documents that are not held out."""
    prepare_python(docs.sparkSession)
    lang = F.col(lang_col).cast("string")
    labelled = docs.filter(~held_out(id_col) & F.col(id_col).isNotNull() & lang.isNotNull()
                           & F.col(text_col).isNotNull())
    # Each document's place in [0, 1) by a hash of all it is; the first places train, the next
    # ones calibrate. Equal rows are one document.
    place = F.shiftrightunsigned(F.xxhash64(id_col, text_col), 11) / F.lit(float(1 << 53))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).agg(
        F.approx_count_distinct(place, 0.01)).collect()}
    if not counts:
        return {"languages": []}
    share = F.lit(0.0)
    for code, n in counts.items():
        share = F.when(lang == F.lit(code), F.lit(min(0.5, TRAIN_DOCS / n))).otherwise(share)
    chosen = labelled.select(lang.alias("lang"), F.substring(text_col, 1, TRAIN_CHARS).alias("text"),
                             place.alias("place"), share.alias("share"))
    chosen = chosen.filter(F.col("place") < 2 * F.col("share")).dropDuplicates(["lang", "place"])
    chosen = stage(chosen, "language-sample").df
    # A few documents must not all fall to one part by chance.
    both = {r[0] for r in chosen.groupBy("lang").agg(
        F.min(F.col("place") < F.col("share")).alias("low"),
        F.max(F.col("place") < F.col("share")).alias("high")).collect() if r[1] != r[2]}
    few = F.col("lang").isin([code for code, n in counts.items() if n < FEW or code not in both])
    half = F.ceil(F.length("text") / 2).cast("int")
    part = F.when(few, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array((F.col("place") >= F.col("share")).cast("int")))
    chosen = (chosen.withColumn("part", F.explode(part))
              .withColumn("text", F.when(~few, F.col("text")).when(
                  F.col("part") == 0, F.substring("text", F.lit(1), half)).otherwise(
                  F.substring("text", half + 1, F.length("text"))))
              .withColumn("chars", F.length("text")))
    # One row for each language and part.
    sizes = chosen.groupBy("lang", "part").agg(F.sum("chars").alias("chars"),
                                               F.count(F.lit(1)).alias("rows")).collect()
    room = F.lit(TRAIN_CHARS)
    for r in sizes:
        if r["chars"] > TRAIN_CHARS:
            here = (F.col("lang") == r["lang"]) & (F.col("part") == r["part"])
            room = F.when(here, F.lit(max(1, TRAIN_CHARS // r["rows"]))).otherwise(room)
    chosen = chosen.withColumn("text", F.substring("text", F.lit(1), room))

    def count(batches):
        for batch in batches:
            found = defaultdict(Counter)
            for code, text in zip(batch["lang"], batch["text"], strict=True):
                codes = normalise(str(text))
                if len(codes):
                    s = " " * (ORDER - 1) + "".join(map(chr, codes))
                    found[str(code)].update(s[i:i + ORDER] for i in range(len(s) - ORDER + 1))
            rows = [(c, g, n) for c, grams in found.items() for g, n in grams.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in
                 enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

    grams = (chosen.filter("part = 0").select("lang", "text")
             .mapInArrow(count, "lang string, gram string, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    table = defaultdict(dict)
    for code, gram, n in grams.collect():
        table[code][gram] = n
    model = build(table)
    return calibrate(model, chosen.filter("part = 1").select("lang", "text"))


def build(table: dict[str, dict[str, int]]) -> dict:
    """Sorted hash arrays from the counts of the highest order."""
    languages = sorted(table)
    probability: list[list[dict]] = []  # by language, by order: gram -> log2 probability
    backoff: list[list[dict]] = []  # by language, by order: history -> log2 weight
    floor = []
    for code in languages:
        counts = [Counter() for _ in range(ORDER)]
        counts[-1] = Counter(table[code])
        for size in range(ORDER - 1, 0, -1):
            counts[size - 1] = Counter(g[1:] for g in counts[size])  # distinct histories before
        below, p_all, b_all = {}, [], []
        uniform = 1.0 / (len(counts[0]) + 1)
        floor.append(np.log2(uniform))
        for size in range(1, ORDER + 1):
            level = counts[size - 1]
            of = Counter(level.values())
            discount = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
            total, kinds = Counter(), Counter()
            for g, n in level.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            weight = {h: discount * kinds[h] / total[h] for h in total}
            p = {g: max(n - discount, 0) / total[g[:-1]]
                 + weight[g[:-1]] * (below[g[1:]] if size > 1 else uniform)
                 for g, n in level.items()}
            below = p
            p_all.append({g: np.log2(x) for g, x in p.items()})
            b_all.append({h: np.log2(x) for h, x in weight.items()})
        probability.append(p_all)
        backoff.append(b_all)

    def of_language(i: int, gram: str) -> float:
        gone = 0.0
        while gram:
            if gram in probability[i][len(gram) - 1]:
                return gone + probability[i][len(gram) - 1][gram]
            gone += backoff[i][len(gram) - 1].get(gram[:-1], 0.0)
            gram = gram[1:]
        return gone + floor[i]

    model = {"languages": languages, "grams": [], "histories": [],
             "floor": np.array(floor, np.float32)}
    for size in range(1, ORDER + 1):
        grams = sorted(set().union(*(p[size - 1] for p in probability)))
        rows = [[of_language(i, g) for i in range(len(languages))] for g in grams]
        model["grams"].append(_sorted(grams, size, rows, len(languages)))
        histories = sorted(set().union(*(b[size - 1] for b in backoff)))
        rows = [[b[size - 1].get(h, 0.0) for b in backoff] for h in histories]
        model["histories"].append(_sorted(histories, size - 1, rows, len(languages)))
    return model


def _sorted(grams: list[str], size: int, rows: list, width: int):
    if not size:
        return np.zeros(1, np.uint64), np.array(rows, np.float32).reshape(-1, width)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = codes.reshape(-1, size)
    keys = np.array([gram_hashes(c, size)[-1][0] for c in codes], np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array(rows, np.float32).reshape(-1, width)[order]


def calibrate(model: dict, rows: DataFrame) -> dict:
    """Usual cross-entropy and spread of each language, from documents not counted."""
    def score(batches):
        for batch in batches:
            total, n = cross_entropy(model, map(str, batch["text"]))
            at = [model["languages"].index(str(x)) if str(x) in model["languages"] else -1
                  for x in batch["lang"]]
            ok = np.flatnonzero((n > 0) & (np.array(at, int) >= 0))
            at = np.array(at, int)[ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(total[ok, at] / n[ok]), pa.array(n[ok])],
                names=["at", "entropy", "n"])

    found = rows.mapInArrow(score, "at long, entropy double, n long").collect()
    usual, spread, farthest, alike = [], [], [], []
    for i in range(len(model["languages"])):
        h = np.array([r["entropy"] for r in found if r["at"] == i])
        n = np.array([r["n"] for r in found if r["at"] == i], float)
        usual.append(np.average(h, weights=np.minimum(n, STEADY)) if len(h) else np.inf)
        off = (h - usual[-1]) * np.sqrt(np.minimum(n, STEADY)) if len(h) else np.zeros(0)
        spread.append(np.sqrt(np.mean(off**2)) if len(h) else 0.0)
        farthest.append(off.max() if len(h) else 0.0)
        alike.append(len(np.unique(h.round(6))) < FEW)
    # Nothing to calibrate by (a letter or two): as far from likely as any other language.
    known = [u for u in usual if np.isfinite(u)]
    usual = [u if np.isfinite(u) else max(known, default=np.inf) for u in usual]
    steady = [s for s, few in zip(spread, alike, strict=True) if not few] or spread
    pooled = 6 * np.sqrt(np.mean(np.square(steady))) if steady else 0.0
    limit = [max(6 * s, 1.25 * f, *([LEAST, pooled] if few else []))
             for s, f, few in zip(spread, farthest, alike, strict=True)]
    return model | {"usual": np.array(usual), "limit": np.array(limit)}


# --- scoring


def cross_entropy(model: dict, texts) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text in each language, and its number of characters."""
    total, counts, parts, size = [], [], [], 0
    width = max(1, len(model["languages"]))

    def flush() -> None:
        if parts:
            rows, codes = zip(*parts, strict=True)
            bits = _bits(model, np.concatenate(codes))
            starts = np.cumsum([0] + [len(c) for c in codes[:-1]])
            bits = np.concatenate([np.zeros((ORDER - 1, width), np.float32), bits])
            inner = np.ones(len(bits), bool)
            for k in range(ORDER - 1):
                inner[starts + k] = False
            bits[~inner] = 0
            np.add.at(sums, np.array(rows), np.add.reduceat(bits, starts, axis=0))
            parts.clear()

    texts = list(texts)
    sums = np.zeros((len(texts), width))
    for i, text in enumerate(texts):
        codes = normalise(text)
        counts.append(len(codes))
        if not len(codes) or not model["languages"]:
            continue
        codes = np.concatenate([np.full(ORDER - 1, PAD, np.uint32), codes])
        for a in range(0, len(codes) - ORDER + 1, RUN):
            parts.append((i, codes[a:a + RUN + ORDER - 1]))
            size += len(parts[-1][1])
            if size >= RUN:
                flush()
                size = 0
    flush()
    return sums, np.array(counts, np.int64)


def _bits(model: dict, codes: np.ndarray) -> np.ndarray:
    """Minus log2 probability of each code after the ``ORDER - 1`` before it, by language."""
    hashes = gram_hashes(codes)
    histories = [np.zeros_like(hashes[0])]
    ahead = gram_hashes(np.concatenate([[PAD], codes]).astype(np.uint32))
    histories += [h[:len(hashes[0])] for h in ahead[:-1]]
    out = np.zeros((len(hashes[0]), len(model["languages"])), np.float32)
    left = np.arange(len(out))
    for size in range(ORDER, 0, -1):
        keys, rows = model["grams"][size - 1]
        found, at = _search(keys, hashes[size - 1][left])
        out[left[found]] -= rows[at[found]]
        left = left[~found]
        if not len(left):
            return out
        keys, rows = model["histories"][size - 1]
        known, at = _search(keys, histories[size - 1][left])
        out[left[known]] -= rows[at[known]]
    out[left] -= model["floor"]
    return out


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted, at


def decide(model: dict, total: np.ndarray, n: np.ndarray):
    """Language, score and acceptance from the bits in each language."""
    some = (n > 0) & bool(model["languages"])
    h = total / np.maximum(n, 1)[:, None]
    best = h.argmin(axis=1)
    # How likely the language is among all, were the text no longer than a few words.
    odds = np.exp2(-(h - h.min(axis=1, keepdims=True)) * 8)
    score = np.where(some, 1 / odds.sum(axis=1), 0.0)
    names = np.array(model["languages"] or [UNKNOWN], object)
    lang = np.where(some, names[best], UNKNOWN)
    good = np.zeros(len(n), bool)
    if model["languages"]:
        off = (h.min(axis=1) - model["usual"][best]) * np.sqrt(np.minimum(n, STEADY))
        good = some & ~(off > model["limit"][best])
    return lang, score, good
