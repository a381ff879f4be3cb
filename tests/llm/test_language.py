import zlib

import numpy as np
import pytest
from conftest_llm import rows_of
from pyspark.sql import functions as F

from haulframe.llm import language_id
from haulframe.llm.language_id import build, cross_entropy, drop_rejected, identify, normalise

COLUMNS = ("doc_id", "held_out", "lang_pred", "score", "accepted")


@pytest.fixture(scope="module")
def found(given):
    return identify(given).toPandas().set_index("doc_id").sort_index()


def test_held_out_accuracy(found, given):
    lang = given.toPandas().set_index("doc_id").lang
    out = found[found.held_out]
    assert len(out) > 40
    assert (out.lang_pred == lang[out.index]).mean() >= 0.95
    assert found.accepted.mean() >= 0.97
    assert found.score.between(0, 1).all()


def test_held_out_labels_are_never_read(found, given):
    hidden = given.withColumn("lang", F.when(~language_id.held_out(), F.col("lang"))).withColumn(
        "source", F.lit("x"))
    again = identify(hidden).toPandas().set_index("doc_id").sort_index()
    assert again.lang_pred.tolist() == found.lang_pred.tolist()


def test_strange_text_is_rejected(given):
    odd = given.limit(3).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn(
        "text", F.lit("中文 текст ελληνικά κείμενο " * 20)).withColumn("lang", F.lit(None).cast("string"))
    both = given.unionByName(odd)
    assert rows_of(identify(both).filter("doc_id >= 10000 AND accepted"), "doc_id") == []
    assert drop_rejected(both).filter("doc_id >= 10000").count() == 0


def test_edges(edge_docs, no_docs):
    got = {r[0]: r for r in rows_of(identify(edge_docs), *COLUMNS)}
    for i in (1, 2, 3, 10):  # no letter
        assert got[i][2:] == ("und", 0.0, False)
    assert got[7][2] in ("en", "de", "fr")
    assert identify(edge_docs).count() == edge_docs.count()
    assert identify(no_docs).count() == 0
    left = drop_rejected(edge_docs)
    assert left.columns == edge_docs.columns


def counted(text, order=language_id.ORDER):
    s = " " * (order - 1) + text
    out = {}
    for i in range(len(s) - order + 1):
        out[s[i:i + order]] = out.get(s[i:i + order], 0) + 1
    return out


def test_probabilities_sum_to_one():
    text = "the rain in spain stays mainly in the plain again and again"
    model = build({"en": counted(text), "xx": counted("zq zq qz zz")})
    letters = sorted(set(text))
    for history in ("the", " in", "xyz"):
        bits = [language_id._bits(model, np.array([ord(c) for c in history + x], np.uint32))[0, 0]
                for x in letters]
        unseen = language_id._bits(model, np.array([ord(c) for c in history + "é"], np.uint32))[0, 0]
        assert sum(2.0 ** -np.array(bits)) + 2.0 ** -unseen == pytest.approx(1, abs=1e-4)


def test_long_texts_score_alike_in_runs(monkeypatch):
    model = build({"en": counted("some words of a language"), "de": counted("ein paar wörter")})
    text = "some wörter of a längere language " * 50
    whole, n = cross_entropy(model, [text, "a", ""])
    monkeypatch.setattr(language_id, "RUN", 37)
    parts, m = cross_entropy(model, [text, "a", ""])
    assert np.allclose(whole, parts, rtol=1e-5) and n.tolist() == m.tolist()
    assert n[0] == len(normalise(text))


def few_docs(spark, rows):
    """Labelled documents whose labels are not held out, from (lang, text)."""
    ids = [i for i in range(10 * len(rows) + 10) if zlib.crc32(str(i).encode()) % 3 != 1]
    return spark.createDataFrame([(i, t, c) for i, (c, t) in zip(ids, rows, strict=False)],
                                 "doc_id long, text string, lang string")


def test_long_texts_displace_no_others(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_CHARS", 2000)
    rows = [("en", "some words of a language " * 100 + "abcdefghij"[k % 10] * 9) for k in range(40)]
    rows += [("de", f"ein paar wörter {'abcdefghij'[k % 10]}") for k in range(40)]
    model = language_id.fit(few_docs(spark, rows))
    assert model["languages"] == ["de", "en"]
    assert np.isfinite(model["usual"]).all()


def test_languages_of_few_or_equal_documents(spark):
    text = "some words of a language and a few more words of the same kind "
    rows = [("en", text + "abcdefghij"[k % 10] * 3) for k in range(60)]
    rows += [("de", "ein paar wörter der deutschen sprache und noch ein paar dazu")] * 5
    rows += [("xx", "zwei gleiche texte")] * 2 + [("fr", "quelques mots")] * 40
    rows += [(f"l{k}", chr(0x3b1 + k) * 3 + " " + chr(0x430 + k) * 5) for k in range(8)]
    model = language_id.fit(few_docs(spark, rows))
    assert set(model["languages"]) == {c for c, _ in rows}
    assert np.isfinite(model["usual"]).all()
    assert (model["limit"] > 0).all()
