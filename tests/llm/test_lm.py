import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import rows_of
from pyspark.sql import functions as F

from haulframe.llm import gru, lm_scoring
from haulframe.llm.common import GIVE_BACK
from haulframe.llm.lm_scoring import score_documents

COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def brute(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    training = [t for i, t in rows if i is not None and not held[i]]
    counts = Counter(w for t in training for w in words(t))
    total = sum(counts.values()) + len(training)
    every = total + len(counts) + bool(training) + 1
    out = []
    for i, text in rows:
        found = [counts[w] for w in words(text)] + [len(training)]
        out.append((i, held[i], len(found), sum(c > 0 for c in found), total,
                    sum(math.log10((c + 1) / every) for c in found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("head", [131_072, 20])
def test_base_matches_brute_force(edge_docs, given, head, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", head)
    for docs in (edge_docs, given):
        got = sorted(rows_of(score_documents(docs), *COLUMNS), key=str)
        for have, want in zip(got, brute(rows_of(docs, "doc_id", "text")), strict=True):
            assert have[:5] == want[:5]
            assert have[5] == pytest.approx(want[5], rel=1e-9)
            assert have[6] < 0


def test_model_beats_counts_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = score_documents(docs).toPandas()
    held = out[out.held_out]
    assert len(held) > 80
    assert held.score.sum() > held.base_score.sum()


def test_every_training_token_is_learned_from_once(edge_docs, given, monkeypatch):
    learned, added = [], lm_scoring._added
    monkeypatch.setattr(lm_scoring, "_added",
                        lambda replicas: learned.append(added(replicas)) or learned[-1])
    for docs in (edge_docs, given):
        learned.clear()
        tokens = score_documents(docs).first()["train_tokens"]
        assert sum(used for _, used in learned) == tokens > 0


def test_empty(no_docs, edge_docs):
    assert score_documents(no_docs).count() == 0
    untrained = score_documents(edge_docs.filter("doc_id IS NULL"))
    assert rows_of(untrained, "n_known", "train_tokens", "base_score") == [(0, 0, 0.0)]


@pytest.fixture(scope="module")
def small():
    draw = np.random.default_rng(0)
    model = gru.new_model(np.array([5.0, 3, 2, 9] * 10), np.array([4.0, 2, 1]), hidden=5)
    for k in model:
        model[k] = model[k].astype(np.float64)
        if k != "word_bias":
            model[k] += draw.normal(0, 0.3, model[k].shape)
    docs = [np.where(draw.random(n) < 0.3, 64 + draw.integers(0, 3, n), draw.integers(0, 40, n))
            for n in draw.integers(3, 12, 6)]
    return model, docs


def test_windows_and_lanes_do_not_change_scores(small):
    model, docs = small
    whole = gru.score(model, docs, lanes=3, steps=1000)
    assert np.allclose(whole, gru.score(model, docs, lanes=1, steps=2))
    assert np.allclose(whole, [gru.score(model, [d])[0] for d in docs])
    assert gru.score(model, []).tolist() == []


def test_probabilities_sum_to_one(small):
    model, docs = small
    first = docs[0][:2]
    symbols = [*range(40), 64, 65, 66]
    ends = gru.score(model, [np.append(first, s) for s in symbols])
    base = gru.score(model, [first])[0]
    assert (10 ** (ends - base)).sum() == pytest.approx(1, abs=1e-6)


def test_gradients(small):
    model, docs = small
    run = gru.Lanes(docs, 3, len(model["inputs"]) - 1)
    active, place, valid = next(iter(run.windows(1000)))
    _, slopes = gru.gradients(model, run, np.zeros((3, 5)), place, valid)
    draw = np.random.default_rng(1)
    for k, values in model.items():
        rows = values.shape[0] if k != "word_bias" else 40
        for _ in range(4):
            at = (int(draw.integers(0, rows)), *(int(draw.integers(0, s)) for s in values.shape[1:]))
            kept, loss = values[at], []
            for step in (1e-3, -1e-3):
                values[at] = kept + step
                loss.append(-gru.score(model, docs, 3, 1000).sum() * gru.LOG10 / len(run.targets))
            values[at] = kept
            assert slopes[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-6)


def test_a_long_document_leaves_few_lanes_idle(small, monkeypatch):
    model, _ = small
    used, windows = [], gru.Lanes.windows

    def noted(run, steps):
        for active, place, valid in windows(run, steps):
            used.append((valid.sum(), len(place) * len(run.lengths)))
            yield active, place, valid

    monkeypatch.setattr(gru.Lanes, "windows", noted)
    docs = [np.full(n, 3) for n in [4000, *[100] * 2000]]
    assert np.isfinite(gru.score(model, docs)).all()
    tokens, places = np.sum(used, axis=0)
    assert tokens == sum(map(len, docs)) and tokens > 0.8 * places


def test_words_are_counted_once_however_often_they_are_handed_on(spark, given, monkeypatch):
    want = Counter(w for (t,) in rows_of(given, "text") for w in words(t))
    rows = given.select(F.coalesce("text", F.lit("")).alias("text"))
    for held, distinct in ((lm_scoring.HELD, lm_scoring.DISTINCT), (50, 10), (50, 1_000_000)):
        monkeypatch.setattr(lm_scoring, "HELD", held)
        monkeypatch.setattr(lm_scoring, "DISTINCT", distinct)
        got = {bytes(w).decode(): n for w, n in rows_of(lm_scoring.count_words(rows), "word", "n")}
        assert got == want


def test_reading_uses_its_memory_again(tmp_path):
    """With the workers' settings alone, every array of 128 KB or more costs its pages anew."""
    script = tmp_path / "run.py"
    script.write_text("""
import resource
import numpy as np
import pyarrow as pa
from haulframe.llm import lm_scoring

words = np.random.default_rng(0).integers(0, 50_000, (1000, 400)).astype(str)
ids = pa.array(range(1000), pa.int64())
batch = pa.RecordBatch.from_arrays(
    [ids, ids, pa.array([False] * 1000), pa.array([" ".join(w) for w in words])],
    names=["_uid", "_id", "_held", "text"])
symbols = lm_scoring._Symbols({"head": [(b"1", 9), (b"2", 8)], "vocabulary": [b"1"],
                               "documents": 5, "tail_total": np.ones(lm_scoring.TAILS)})
if hasattr(lm_scoring, "_begin"):
    lm_scoring._begin()
for _ in range(4):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    symbols.read(batch)
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
""")
    root = str(Path(lm_scoring.__file__).parents[2])
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, check=True,
                          env={**os.environ, **GIVE_BACK, "PYTHONPATH": root})
    assert int(done.stdout) < 2000


def test_words_by_number_are_the_words_of_each_text():
    import pyarrow as pa

    texts = ["", " \t a\x0bB\x0ca\r\n", "\x1c a\x85b \u00a0c", "É é", "  "]
    words, ids, sizes = lm_scoring.words_of(pa.array(texts))
    found = words.take(pa.array(ids)).to_pylist()
    ends = np.cumsum(sizes).tolist()
    for text, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert found[a:b] == text.encode().lower().split()
