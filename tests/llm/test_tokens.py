import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import rows_of
from tokenizers import Tokenizer

from haulframe.llm import encode
from haulframe.llm.encode import Encoder, default_path
from haulframe.llm.packing import pack, plan_bins
from haulframe.llm.token_counts import token_counts


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(library, edge_docs, given, no_docs):
    for docs in (edge_docs, given):
        want = []
        for i, text in rows_of(docs, "doc_id", "text"):
            n = len(library(text))
            want.append((i, len((text or "").encode()), n, n > 1024))
        got = rows_of(token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit")
        assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(no_docs).count() == 0


def test_any_white_space(library, monkeypatch):
    draw = random.Random(1)
    parts = [" ", "\n", "a", "B", " the", "'s", "é", "\t", "  ", "<|endoftext|>", "1", "!", "\r\n",
             "中文", "\u00a0", "\u2003", "'", "\x1c", "\x00", "😀"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 25))) for _ in range(1500)]
    texts += [" ".join(draw.choices(["ab", "c<|endoftext|>", "it's", "x"], k=9)) for _ in range(50)]
    # Forgetting chunks must not change anything.
    monkeypatch.setattr(encode, "KEPT_CHUNKS", 100)
    monkeypatch.setattr(encode, "SLICE_BYTES", 2000)
    enc = Encoder(default_path())
    got = [flat[o[i]:o[i + 1]].tolist() for flat, o in enc.ids(pa.array(texts))
           for i in range(len(o) - 1)]
    assert got == [library(t) for t in texts]
    assert enc.lengths(pa.array(texts)).tolist() == [len(g) for g in got]


def check_plan(counts, capacity):
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, offset in plan_bins(counts, capacity):
        ranks[length].append((rank, n))
        for k in range(n):
            bins[sequence + k].append((offset, length))
    for length, n in enumerate(counts):
        at = 0
        for rank, part in sorted(ranks[length]):
            assert rank == at
            at += part
        assert at == n
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in content) <= 2
    return len(bins)


def test_plans_hold_every_piece_once():
    draw = random.Random(2)
    for _ in range(150):
        capacity = draw.choice([1, 2, 3, 7, 10, 64])
        counts = [0] + [draw.choice([0, 0, 1, 2, draw.randint(0, 40)]) for _ in range(capacity)]
        check_plan(counts, capacity)
    wide = [0] + [int(40 * 2.7 ** (-i / 700)) for i in range(2048)]
    least = sum(i * n for i, n in enumerate(wide)) / 2048
    assert check_plan(wide, 2048) <= 1.01 * least + 1


def test_pieces_give_back_the_documents(library, edge_docs, no_docs):
    got = defaultdict(list)
    places = defaultdict(list)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    for r in rows_of(pack(edge_docs, with_ids=True), *columns):
        ids = np.frombuffer(bytes(r[7]), "<u4")
        assert len(ids) == r[3] and zlib.crc32(bytes(r[7])) == r[4]
        got[r[0]].append((r[1], r[2], ids))
        places[r[5]].append((r[6], r[3]))
    texts = defaultdict(list)
    for i, text in rows_of(edge_docs, "doc_id", "text"):
        texts[i].append(text)
    for i, same in texts.items():
        want = [*library(same[0]), 0]
        pieces = sorted(got[i], key=lambda p: p[:2])[::len(same)]  # repeated rows
        assert np.concatenate([p[2] for p in pieces]).tolist() == want
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert [p[1] for p in pieces] == np.cumsum([0] + [len(p[2]) for p in pieces[:-1]]).tolist()
        assert all(len(p[2]) == 2048 for p in pieces[1:])
    for content in places.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(no_docs).count() == 0


def test_a_worker_may_remember_fewer_chunks(library, edge_docs):
    texts = pa.array([t or "" for _, t in rows_of(edge_docs, "doc_id", "text")])
    few = Encoder(default_path(), kept=10)
    for _ in range(2):
        assert few.lengths(texts).tolist() == [len(library(t)) for t in texts.to_pylist()]
    assert len(few.known) - len(few.passing) <= 10
    rows = [rows_of(pack(edge_docs, **o), "doc_id", "piece", "length", "ids_crc32")
            for o in ({}, {"kept": 10})]
    assert sorted(rows[0], key=str) == sorted(rows[1], key=str)
