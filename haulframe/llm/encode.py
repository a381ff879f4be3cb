"""Token ids of whole texts, through the tokenizers library, one distinct chunk at a time.

Texts are cut at safe boundaries, whatever their length, and only chunks not met before are
encoded. A text's ids are its chunks' ids in a row. Where a boundary is safe depends on the file:

- A byte-level pre-tokenizer without a normalizer never joins what stands on both sides of a
  single space (or newline) between two characters that are not white space. Texts with other
  white space (runs, tabs, at an end) are cut at single spaces alone.
- A pre-tokenizer that drops white space, after the normalizer ``WORDS`` lists, is cut at white
  space, and between a letter and a mark that ends a clause: fewer chunks differ then.
- With any other file a whole text is one chunk, and nothing is remembered.

New chunks that are letters, with or without punctuation after them, are handed to the file's BPE
model itself, letters and punctuation each once; all others go through the whole tokenizer, in
batches balanced by bytes.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from haulframe.llm.common import take_over

# Texts are handled in slices of about so many bytes, chunks encoded in calls of so many.
SLICE_BYTES = 1024**2
CALL_BYTES = 64 * 1024
# A worker remembers so many chunks, or chunks of so many characters; others only for a slice.
KEPT_CHUNKS = 600_000
KEPT_CHARS = 10_000_000

SAFE = re.compile(r"(?<=\S)(?= \S)")
# Chunks are kept by their text after this mark, those that begin with a space by the rest alone.
BARE = "\x00"
# Texts that single spaces and newlines do not part into runs of other characters.
UNEVEN = (r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\x00\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}"
          r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Letters, then punctuation: two units of both pre-tokenizers below.
LETTERS = re.compile("(\x00?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)"
                     r"([!-/:-@\[-`{-~]*)")

# Between a letter and such a mark the word pre-tokenizer always cuts, so a space changes nothing.
MARKED = r"([a-z\x{e0}-\x{f6}\x{f8}-\x{ff}])([,.;:!?])"

# The settings of the files whose boundaries are known.
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORDS = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {
            "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        BYTES | {"use_regex": False}]})


def default_path() -> str:
    """The byte-level vocabulary this engine packs with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _encoder(path: str, kept: int | None) -> Encoder:
    return Encoder(path, kept)


def encoder(path: str | None = None, kept: int | None = None) -> Encoder:
    """This worker's encoder; kept between tasks, until another operator works here."""
    take_over("encode", _encoder.cache_clear)
    return _encoder(path or default_path(), kept)


class Encoder:
    """Chunk ids, cached in flat arrays; ``kept`` chunks at most stay beyond a slice."""

    def __init__(self, path: str, kept: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = _kind(self.tokenizer)
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks_apart = not pc.any(pc.match_substring_regex(
            pa.array(added, pa.string()), MARKED)).as_py()
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if self.kind == "bytes" and len(newline) == 1 else None
        self.known: dict[str, int] = {}
        # Punctuation after letters, and its ids.
        self.tails: dict[str, list[int]] = {"": []}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int32)
        self.lens = np.zeros(1 << 14, np.int32)
        self.used = self.chars = 0
        # Chunks beyond the bounds, and the ids in use before them.
        self.passing: list[str] = []
        self.kept_ids = 0
        self.kept = KEPT_CHUNKS if kept is None else kept

    def slices(self, texts: pa.Array):
        """Runs of texts of bounded bytes, as (first, last + 1)."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        first = 0
        while first < len(texts):
            done = sizes[first - 1] if first else 0
            last = int(np.searchsorted(sizes, done + SLICE_BYTES)) + 1
            yield first, (last := min(max(last, first + 1), len(texts)))
            first = last

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text; NULL counts as empty."""
        out = [np.zeros(0, np.int64)]
        for first, last in self.slices(texts):
            chunks, offsets = self._chunks(texts.slice(first, last - first))
            out.append(_sums(self.lens[chunks], offsets))
        return np.concatenate(out)

    def ids(self, texts: pa.Array, end: int | None = None):
        """For each slice: flat ids of its texts and their offsets; ``end`` follows each text."""
        for first, last in self.slices(texts):
            chunks, offsets = self._chunks(texts.slice(first, last - first))
            lens = self.lens[chunks]
            sizes = _sums(lens, offsets)
            total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
            at = np.repeat(self.starts[chunks] - total[:-1], lens) + np.arange(total[-1])
            flat = self.flat[at]
            ends = np.cumsum(sizes)
            if end is not None:
                flat = np.insert(flat, ends, end)
                ends = ends + np.arange(1, len(ends) + 1)
            yield flat, np.concatenate([[0], ends])

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cache places of all chunks, and the offsets of the texts in them."""
        for key in self.passing:
            del self.known[key]
        if self.passing:
            self.passing, self.used = [], self.kept_ids
        texts = pc.fill_null(texts, "")
        if self.kind == "words":
            even = np.ones(len(texts), bool)
            texts = pc.ascii_lower(texts)
            for space in "\t\n\r":
                texts = pc.replace_substring(texts, space, " ")
            if self.marks_apart:
                texts = pc.replace_substring_regex(texts, MARKED, r"\1 \2")
        elif self.newline is not None:
            even = ~pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        else:
            even = np.zeros(len(texts), bool)
        # Even texts are cut and their chunks told apart by Arrow, the others one by one.
        simple = texts.filter(pa.array(even))
        if self.kind == "bytes":
            simple = pc.replace_substring(simple, "\n", " \n " + BARE)
            simple = pc.binary_join_element_wise(BARE, simple, "")
        parts = pc.split_pattern(simple, " ")
        chunks = parts.flatten().dictionary_encode()
        odd = [self._cut(t) for t in texts.filter(pa.array(~even)).to_pylist()]
        places = self._places(chunks.dictionary.to_pylist())
        found = [places[chunks.indices.to_numpy(zero_copy_only=False)],
                 self._places(list(chain.from_iterable(odd)))]
        counts = np.zeros(len(texts), np.int64)
        counts[even] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        counts[~even] = np.fromiter(map(len, odd), np.int64, len(odd))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offsets[-1], np.int32)
        for rows, values in zip((even, ~even), found, strict=True):
            n = counts[rows]
            out[np.repeat(offsets[:-1][rows] - np.cumsum(n) + n, n)
                + np.arange(len(values))] = values
        return out, offsets

    def _places(self, keys: list[str]) -> np.ndarray:
        places = list(map(self.known.get, keys))
        if None in places:
            self._learn([*dict.fromkeys(k for k, p in zip(keys, places, strict=True)
                                        if p is None)])
            places = list(map(self.known.__getitem__, keys))
        return np.array(places, np.int32)

    def _cut(self, text: str) -> list[str]:
        """The keys of an uneven text's chunks."""
        if self.kind == "whole" or not text:
            return [text] if text else []
        return [BARE + c for c in SAFE.split(text)]

    def _learn(self, keys: list[str]) -> None:
        """Encode chunks: letters by the model, the others through the whole tokenizer."""
        simple, others = [], []
        for k in keys:
            found = LETTERS.fullmatch(k) if self.kind != "whole" else None
            if found:
                simple.append(found)
            else:
                others.append(k)
        if simple:
            ids = [self._letters(f) + self._tail(f[3]) for f in simple]
            self._store([f[0] for f in simple], ids)
        for batch in _balanced(others):
            found = self.tokenizer.encode_batch_fast([self._text(k) for k in batch],
                                                     add_special_tokens=False)
            self._store(batch, [e.ids for e in found])

    def _text(self, key: str) -> str:
        if self.kind != "bytes":
            return key
        return key[1:] if key[0] == BARE else key if key == "\n" else " " + key

    def _letters(self, found: re.Match) -> list[int]:
        """Ids of a run of letters, with the space before it."""
        text = found[2]
        if found[3]:
            place = self.known.get(found[1] + text)
            if place is not None:
                first = self.starts[place]
                return self.flat[first:first + self.lens[place]].tolist()
        if self.kind == "words":
            text = text.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(BYTE_SIGNS)
        if self.kind == "bytes" and not found[1]:
            text = SPACE_SIGN + text
        return [t.id for t in self.model.tokenize(text)]

    def _tail(self, text: str) -> list[int]:
        if text not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {"": []}
            self.tails[text] = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.tails[text]

    def _store(self, chunks: list[str], found: list[list[int]]) -> None:
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self.known)
        self.flat = _room(self.flat, self.used + len(ids))
        self.starts = _room(self.starts, first + len(chunks))
        self.lens = _room(self.lens, first + len(chunks))
        self.flat[self.used:self.used + len(ids)] = ids
        self.lens[first:first + len(chunks)] = lens
        self.starts[first:first + len(chunks)] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.known.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.chars += sum(map(len, chunks))
        if self.kind == "whole" or first + len(chunks) > self.kept or self.chars > KEPT_CHARS:
            self.passing += chunks
            self.chars -= sum(map(len, chunks))
        else:
            self.kept_ids = self.used


def _byte_signs() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be
    printed, else the next one from 256 on."""
    printed = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printed]
    return {b: 256 + i for i, b in enumerate(others)}


BYTE_SIGNS = _byte_signs()
SPACE_SIGN = chr(BYTE_SIGNS[ord(" ")])


def _kind(tokenizer) -> str:
    """Where texts of a file may be cut: at ``bytes``' or ``words``' boundaries, or not at all."""
    added = tokenizer.get_added_tokens_decoder().values()
    parts = json.loads(tokenizer.to_str())
    model = parts["model"]
    plain = (model["type"] == "BPE" and not model.get("dropout")
             and not any(t.lstrip or t.rstrip or t.single_word or t.normalized
                         or set(t.content) & set(string.whitespace)
                         or LETTERS.fullmatch(t.content) for t in added))
    if plain and parts["normalizer"] is None and parts["pre_tokenizer"] == BYTES:
        return "bytes"
    if plain and (parts["normalizer"], parts["pre_tokenizer"]) == WORDS:
        return "words"
    return "whole"


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.resize(array, max(size, 2 * len(array)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _balanced(chunks: list[str]):
    """Runs of chunks of about equal bytes."""
    batch, size = [], 0
    for c in chunks:
        batch.append(c)
        size += len(c)
        if size >= CALL_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch
