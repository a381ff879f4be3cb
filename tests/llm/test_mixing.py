import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import rows_of
from pyspark.sql import functions as F

from haulframe.llm.mixing import draw_slots, mix_report, mixed_documents, permute, targets

COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_targets():
    assert targets([100, 100, 100]) == [200, 2 / 3 * 250, 1 / 3 * 250]
    assert sum(targets([10, 1000, 5, 70])) == pytest.approx(1.5 * 1085)
    assert targets([]) == [] and targets([0, 0]) == [0, 0]


def test_permutations():
    for n in (1, 2, 3, 17, 256, 1000):
        out = [permute(np.arange(n), np.full(n, n), np.full(n, k, np.uint64)) for k in (1, 2)]
        assert all(sorted(o.tolist()) == list(range(n)) for o in out)
    assert out[0].tolist() != out[1].tolist()


def test_draws_meet_totals():
    drawn = draw_slots([0, 10, 1000, 333], shards=7)
    assert drawn.sum(axis=0).tolist() == [0, 10, 1000, 333]
    assert set(drawn.sum(axis=1)) <= {191, 192}


def check(docs):
    out = rows_of(mix_report(docs), *COLUMNS)
    assert Counter((r[0], r[1]) for r in out) == Counter(
        (i, len(words(t))) for i, t in rows_of(docs, "doc_id", "text"))
    source = dict(rows_of(docs, "doc_id", "source"))
    sizes, wanted, taken = defaultdict(int), {}, defaultdict(int)
    for i, size, total, target, n in out:
        sizes[source[i]] += size
        taken[source[i]] += n
        wanted[source[i]] = (total, target)
        assert 0 <= n <= 2 * size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, targets([sizes[s] for s in order]), strict=True):
        assert wanted[s] == (sizes[s], pytest.approx(t))
        assert abs(taken[s] - t) <= 2 + 0.01 * t
    return sorted(out, key=str)


def test_mix_meets_targets_and_reruns_agree(edge_docs, given):
    distinct = edge_docs.filter("doc_id <> 4 OR doc_id IS NULL")
    assert check(distinct) == sorted(rows_of(mix_report(distinct.repartition(5)), *COLUMNS), key=str)
    assert check(given) == sorted(rows_of(mix_report(given.repartition(3)), *COLUMNS), key=str)


def test_empty(no_docs):
    assert mix_report(no_docs).count() == 0
    assert mixed_documents(no_docs).count() == 0


def test_documents_hold_the_words_taken(given, edge_docs):
    mixed = mixed_documents(given)
    assert mixed.columns == given.columns
    got = defaultdict(int)
    original = {i: words(t) for i, t in rows_of(given, "doc_id", "text")}
    for i, text in rows_of(mixed, "doc_id", "text"):
        got[i] += len(words(text))
        assert not Counter(words(text)) - Counter(original[i])
    want = {r[0]: r[4] for r in rows_of(mix_report(given), *COLUMNS) if r[4]}
    assert got == want
    assert mixed_documents(edge_docs).columns == edge_docs.columns


def test_hot_source(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("some words in a row").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50))
        .alias("source"))
    check(docs)
