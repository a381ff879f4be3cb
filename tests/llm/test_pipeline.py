import corpus_pipeline
from conftest_llm import rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from haulframe.llm.queries import QUERIES, SQL
from haulframe.sources.storage import scratch_path


def test_stages_in_order_and_effective(spark, given):
    docs, seen = given, {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        out = spark.read.parquet(path)
        seen[name] = out
        if name != "best_fit_packing":
            assert out.columns == given.columns
        docs = out
    tagged, exact = seen["language_id"], seen["exact_dedup"]
    assert tagged.count() >= 0.97 * given.count()
    norm = F.regexp_replace("text", r"[\x20\x09-\x0D]", "")
    assert exact.count() == tagged.select(norm).distinct().count()
    near = seen["simhash_near_dedup"]
    assert near.count() <= exact.count()
    pieces = rows_of(seen["best_fit_packing"], "sequence_id", "offset", "length")
    assert {p[0] for p in pieces} == set(range(len({p[0] for p in pieces})))
    assert len({p[:2] for p in pieces}) == len(pieces)


def test_registered():
    names = entry_module.queries()
    assert [n for n in names if n.startswith("op")] == list(QUERIES)
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert names["pipeline"] is corpus_pipeline.run
    assert set(SQL) <= set(QUERIES)


def test_exact_dedup_matches_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = duck.sql(SQL["op10_exact_dedup"]).df()[columns]
    got = QUERIES["op10_exact_dedup"](spark, folder).toPandas()[columns]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
