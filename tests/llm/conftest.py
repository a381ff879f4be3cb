import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside or return.
CLASHING = ", ".join(f"`{c}` string" for c in (
    "_uid", "_row", "_id", "_text", "_found", "_gone", "_again", "_spans", "keep_id", "score",
    "shard", "size", "slot", "rule", "kept", "fingerprint", "target", "a.b"))

LONG = " ".join(f"word{i % 997} und{i % 31}" for i in range(12_000))

TEXTS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n\r\x0b\x0c", None, "b"),
    (4, "Hello world", "en", "a"), (4, "Hello world", "en", "a"), (5, "Hello  world", "de", "é"),
    (6, "hello world", "de", None), (7, LONG, "en", "a"), (8, LONG, None, "Z"),
    (9, "ñandú 中文 😀 a\tb\u00a0c", "fr", ""), (10, "### 12 $$", "fr", "b"),
    (None, "a row without id", "en", "a"), (11, "one\ntwo\none\n\none", "en", None),
    (12, "x" * 30_000, "en", "b"), (13, "<|endoftext|> a <|endoftext|>", "en", "b"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """NULLs, empty and long texts, ties, repeated rows and clashing column names."""
    rows = [(i, t, lang, s, len(t) if t else None, *["?"] * CLASHING.count("string"))
            for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASHING}")


@pytest.fixture(scope="session")
def given(spark):
    """The given documents at the smallest size."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
