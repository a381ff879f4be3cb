import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import rows_of
from tokenizers import Tokenizer

from haulframe.llm import token_files
from haulframe.llm.encode import Encoder
from haulframe.llm.token_files import (
    block_index,
    default_path,
    pack_bits,
    read_documents,
    read_tokens,
    token_file_report,
    unpack_bits,
    write_tokens,
)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(default_path())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 31])
def test_bits_come_back(bits):
    draw = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = draw.integers(0, 2**bits, n).astype(np.uint32)
        data = pack_bits(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert unpack_bits(data, 0, n, bits).tolist() == ids.tolist()
        for first in (0, 3, 8, n // 2):
            if first < n:
                assert unpack_bits(data, first, n - first, bits).tolist() == ids[first:].tolist()


def test_words_match_the_library(library):
    draw = np.random.default_rng(3)
    parts = [" ", "\n", "A", "bé", "the", "'s", "Ü", "\t", "  ", "<|endoftext|>", "1", "!", "\r",
             "中文", " ", "é", "İ", "\x00", "😀", "ß", ",", "don't"]
    texts = ["".join(draw.choice(parts, draw.integers(0, 25))) for _ in range(1500)]
    flat, offsets = next(iter(Encoder(default_path()).ids(pa.array(texts), 2)))
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [
        library(t) for t in texts]


def test_files_give_back_the_documents(spark, library, given, edge_docs, no_docs, tmp_path,
                                       monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 3)
    for name, docs in (("given", given), ("edge", edge_docs)):
        path = f"{tmp_path}/{name}"
        write_tokens(docs, path, block=500)
        got = rows_of(read_tokens(spark, path, with_ids=True), "doc_id", "start", "n_tokens",
                      "ids_crc32", "ids")
        want = Counter((i, tuple(library(t))) for i, t in rows_of(docs, "doc_id", "text"))
        assert Counter((g[0], tuple(g[4])) for g in got) == want
        at, last = 0, None
        for i, start, n, crc, ids in sorted(got, key=lambda g: g[1]):
            assert start == at and n == len(ids)
            assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())
            assert last is None or last <= i  # rows without an id come first
            at, last = at + n, i
        index = block_index(spark, path)
        assert index.count() > 3
        some = read_documents(index, [4, 7, 10**9])
        assert Counter((r[0], tuple(r[1])) for r in rows_of(some, "doc_id", "ids")) == Counter(
            {k: n for k, n in want.items() if k[0] in (4, 7)})
    assert token_file_report(no_docs).count() == 0
    assert read_documents(index, []).count() == 0


def test_a_word_and_its_marks_are_chunks_apart():
    """A word is learned once, whatever mark follows it; ids are the library's."""
    path = token_files.default_path()
    whole = Tokenizer.from_file(path)
    texts = ["word word, word. word; Word!? word... it's, a.b",
             "\u00c9t\u00e9, \u00e9t\u00e9. e\u0301, 1,5 x,y"]
    enc = Encoder(path)
    got = [flat[o[i]:o[i + 1]].tolist() for flat, o in enc.ids(pa.array(texts))
           for i in range(len(o) - 1)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert "word," not in enc.known and "word" in enc.known
