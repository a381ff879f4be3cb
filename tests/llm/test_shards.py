import zlib
from collections import Counter, defaultdict

from conftest_llm import rows_of
from pyspark.sql import functions as F

from haulframe.llm.kd_shards import shard

COLUMNS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def check(docs, shards=24):
    out = rows_of(shard(docs, shards), *COLUMNS)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
                   for i, t in rows_of(docs, "doc_id", "text"))
    assert Counter(r[:3] for r in out) == want
    slots, sizes, places = defaultdict(list), Counter(), defaultdict(list)
    for _, size, crc, law, at, slot, grown in out:
        assert law == "bytes" and grown is None and 0 <= at < shards
        slots[at].append(slot)
        sizes[at] += size
        places[crc, size].append(at)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, places


def test_edges(edge_docs, no_docs, given):
    sizes, places = check(edge_docs)
    assert shard(no_docs).count() == 0
    check(given)


def test_sizes_are_near_equal_and_small_groups_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    five = docs.crossJoin(spark.range(5)).select(
        (F.col("doc_id") * 5 + F.col("id")).alias("doc_id"),
        F.when(F.col("id") < 2, F.col("text")).otherwise(F.concat("text", F.col("id")))
        .alias("text"))
    sizes, places = check(five)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24
    assert max(sizes.values()) <= 1.05 * mean and min(sizes.values()) >= 0.95 * mean
    whole = [p for (_, size), p in places.items() if 16 * size * len(p) < mean]
    assert len(whole) > 1000 and all(len(set(p)) == 1 for p in whole)


def test_a_group_of_a_third_is_cut(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, "the same text everywhere").otherwise(
        F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    sizes, _ = check(docs)
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) <= 1.1 * mean and min(sizes.values()) >= 0.9 * mean
