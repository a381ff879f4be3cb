import hashlib
import re
from collections import defaultdict

from conftest_llm import rows_of
from pyspark.sql import functions as F

from haulframe.llm.exact_dedup import advance_state, drop_exact_copies, exact_dedup
from haulframe.sources.storage import scratch_path

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append(
            (-len(t), float("inf") if i is None else i, n, i))
    out = []
    for text, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], best[3], len(members), m == best, sha) for m in members]
    return sorted(out, key=str)


def test_matches_brute_force(edge_docs, given):
    for docs in (edge_docs, given):
        want = brute(rows_of(docs, "doc_id", "text"))
        assert sorted(rows_of(exact_dedup(docs), *COLUMNS), key=str) == want


def test_digest_collisions_are_found_on_full_bytes(edge_docs):
    def weak(text):
        return F.pmod(F.crc32(text.cast("binary")), F.lit(2)).cast("string")

    want = brute(rows_of(edge_docs, "doc_id", "text"))
    assert sorted(rows_of(exact_dedup(edge_docs, digest=weak), *COLUMNS), key=str) == want


def test_drop_keeps_columns_and_one_of_each(edge_docs, no_docs):
    left = drop_exact_copies(edge_docs)
    assert left.columns == edge_docs.columns
    want = [r[0] for r in brute(rows_of(edge_docs, "doc_id", "text")) if r[3]]
    assert sorted((r[0] for r in rows_of(left, "doc_id")), key=str) == sorted(want, key=str)
    assert drop_exact_copies(no_docs).count() == 0
    assert exact_dedup(no_docs).count() == 0


def test_one_large_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    out = exact_dedup(docs)
    assert out.filter("kept").count() == 1
    assert rows_of(out.distinct().filter("NOT kept").limit(1), "keep_id", "group_size") == [(0, 3000)]


def test_state_takes_later_files(spark):
    folder, state = scratch_path(spark, "arrivals"), scratch_path(spark, "state")
    schema = "_uid long, _id long, _points long, _key string"
    spark.createDataFrame([(0, 5, 3, "k")], schema).write.parquet(folder)
    first = spark.read.parquet(folder)
    assert rows_of(advance_state(spark, folder, first.schema, state), "_key", "keeper.id",
                   "group_size") == [("k", 5, 1)]
    spark.createDataFrame([(1, 9, 4, "k"), (2, 1, 3, "k")], schema).write.mode("append").parquet(folder)
    assert rows_of(advance_state(spark, folder, first.schema, state), "_key", "keeper.id",
                   "group_size") == [("k", 9, 3)]
