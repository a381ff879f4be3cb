import re

import numpy as np
import pytest
import xxhash
from conftest_llm import rows_of
from pyspark.sql import functions as F

from haulframe.llm import simhash
from haulframe.llm.simhash import drop_near_copies, join_roots, near_groups


def slow_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """fingerprint and smallest id reachable, for distinct ids."""
    prints = {i: slow_print(t) for i, t in rows}
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return sorted((i, f"{prints[i]:016x}", least[i]) for i in prints)


def test_matches_brute_force(edge_docs, given, no_docs):
    for docs in (edge_docs.filter("doc_id IS NOT NULL"), given):
        got = rows_of(near_groups(docs).distinct(), "doc_id", "fingerprint", "component_id")
        assert sorted(got) == brute(rows_of(docs, "doc_id", "text"))
        assert near_groups(docs).count() == docs.count()
    assert near_groups(no_docs).count() == 0


@pytest.fixture(scope="module")
def chained(spark):
    """Fingerprints in chains and balls, as classes."""
    draw = np.random.default_rng(4)
    prints = set()
    for center in draw.integers(0, 2**63, 12).tolist():
        at = center
        for _ in range(40):
            at ^= 1 << int(draw.integers(0, 64))
            prints.add(at if at < 2**63 else at - 2**64)
    return sorted(prints)


def test_links_in_small_blocks(spark, chained, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    monkeypatch.setattr(simhash, "SQUARE", 2)
    classes = spark.createDataFrame([(p, i) for i, p in enumerate(chained)], "_print long, _id long")
    got = {r["_print"]: r["component_id"]
           for r in simhash._components(classes, 2).collect()}
    bits = [p % 2**64 for p in chained]
    root = np.arange(len(bits))
    near = [(i, j) for i in range(len(bits)) for j in range(i)
            if (bits[i] ^ bits[j]).bit_count() <= 2]
    join_roots(root, np.array([i for i, _ in near]), np.array([j for _, j in near]))
    assert [got[p] for p in chained] == root.tolist()


def test_drop_leaves_one_of_each(edge_docs, given):
    left = drop_near_copies(edge_docs)
    assert left.columns == edge_docs.columns
    rows = [r for r in rows_of(edge_docs, "doc_id", "text") if r[0] is not None]
    want = sorted({c for _, _, c in brute(rows)})
    assert sorted(r[0] for r in rows_of(left.filter("doc_id IS NOT NULL"), "doc_id")) == want
    assert drop_near_copies(given).count() == len({c for _, _, c in brute(rows_of(
        given, "doc_id", "text"))})


def test_one_large_group(spark):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    assert rows_of(near_groups(docs).select("component_id").distinct(), "component_id") == [(0,)]
