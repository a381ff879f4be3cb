import re
from collections import Counter

import numpy as np
from conftest_llm import rows_of

from haulframe.llm.quality_forest import STATS, anomaly, grow, quality, ratios, statistics

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed")


def brute(i, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts(spark, edge_docs, given, no_docs):
    given_labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd_labels = labels(spark, [(4, 1, 0), (4, 1, 0), (None, 1, 0), (7, None, None), (5, 0, 0)])
    for docs, marks in ((edge_docs, odd_labels), (given, given_labels)):
        out = quality(docs, marks)
        want = sorted((brute(*r) for r in rows_of(docs, "doc_id", "text")), key=str)
        assert sorted(rows_of(out, *BASE), key=str) == want
        assert out.filter("base_failed AND kept").count() == 0
    assert quality(no_docs, given_labels).count() == 0
    unmarked = quality(edge_docs, labels(spark, []))
    assert unmarked.filter("NOT base_failed AND NOT kept").count() == 0


def test_forest_drops_junk_and_keeps_good(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality(docs, marks).join(marks, "doc_id").toPandas()
    good, bad = out[(out.quality == 1) & ~out.base_failed], out[out.quality == 0]
    assert good.kept.mean() >= 0.97
    assert bad.kept.mean() <= 0.2


def test_isolation_depth():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(500, 5))
    forest = grow(rows)
    scores = anomaly(forest, np.vstack([np.zeros(5), np.full(5, 30.0)]))
    assert scores[0] < 0.5 < scores[1]
    assert anomaly(grow(rows[:0]), rows).tolist() == [0.0] * 500
    assert np.isfinite(ratios(np.zeros((2, len(STATS))))).all()


def test_statistics_work_in_a_worker_that_served_another_operator(spark):
    """Counting takes a worker over by a name that the module must have imported."""
    docs = spark.createDataFrame([(1, "a b\na b"), (2, None)], "doc_id long, text string")
    found = rows_of(statistics(docs), "_id", "n_words", "n_dup_lines")
    assert sorted(found) == [(1, 4, 1), (2, 0, 0)]
