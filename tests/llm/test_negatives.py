import numpy as np
import pytest
from conftest_llm import rows_of

from haulframe.llm import hard_negatives as module
from haulframe.llm.hard_negatives import hard_negatives, packed_scores

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
           "negative_score")


def slow(rows):
    """All answers, from (vec_id, embedding, label) rows."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(
                x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(256 * float(x))) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other)
                        for b, (j, w, other) in enumerate(kept) if b != a and len(w) == len(v))
        for p, j, _ in [s for s in scores if s[2] == label][:5]:
            near = [s for s in scores if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(i, j, r + 1, k, -p, -q) for r, (q, k, _) in enumerate(near[:5])]
    return sorted(out)


@pytest.mark.parametrize("big", [3, 300, 2**20, 2**25, 2**28])
def test_packed_scores_are_exact(big):
    draw = np.random.default_rng(big)
    a, b = (draw.integers(-big, big, (n, 7)).astype(float) for n in (5, 9))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    assert packed_scores(a, b).tolist() == want
    assert module._wide_scores(a, b).tolist() == want


def test_matches_brute_force(spark, monkeypatch):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = rows_of(given, "vec_id", "embedding", "label")
    assert sorted(rows_of(hard_negatives(given), *COLUMNS)) == slow(rows)
    # Anchors in several chunks and squares give the same.
    monkeypatch.setattr(module, "CHUNK_VALUES", 200)
    monkeypatch.setattr(module, "TILE", 2)
    monkeypatch.setattr(module, "ROWS", 64)
    assert sorted(rows_of(hard_negatives(given), *COLUMNS)) == slow(rows)


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    draw = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in draw.integers(-4, 5, 3)], int(i % 3)) for i in range(250)]
    rows += [(300, None, 1), (400, [1.0, None, 2.0], 1), (500, [1.0, nan, 2.0], 1),
             (600, [inf, 1.0, 1.0], 1), (700, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1),
             (800, [1.0, 2.0], 0), (801, [2.0, 2.0], 0), (802, [2.0, 1.9], 1), (900, [], 0),
             (901, [], 0), (902, [], 2), (200, [4.0, 4.0, 4.0], 1), (5, [4.0, 4.0, 4.0], 1)]
    docs = spark.createDataFrame([(*r, "?") for r in rows],
                                 "vec_id long, embedding array<float>, label int, score string")
    assert sorted(rows_of(hard_negatives(docs), *COLUMNS)) == slow(rows)
    assert hard_negatives(docs.limit(0)).count() == 0
    assert hard_negatives(docs.filter("vec_id % 100 > 0")).count() == 0
