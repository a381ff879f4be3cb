import re
from collections import Counter

import numpy as np
from conftest_llm import rows_of

from haulframe.llm import phrases
from haulframe.llm.phrases import collocations, phrase_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows):
    """f of every phrase of up to five words, and the words of each language."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    return f, n


def slow(rows, threshold, top):
    f, n = slow_counts(rows)
    found = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= threshold}
    inside = set()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if a >= found[lang, w[i:i + size]]:
                    inside.add((lang, w[i:i + size]))
    ranked = {}
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            cuts = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min((1000 * a * n[lang] // (x * y), i, x, y)
                                        for i, (x, y) in enumerate(cuts))
            ranked.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s)
                  for lang, best in ranked.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(best)[:top]))


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_matches_brute_force(given, edge_docs, no_docs):
    for docs, threshold, top in ((given, 40, 30), (edge_docs, 2, 2000)):
        rows = rows_of(docs, "lang", "text")
        got = rows_of(collocations(docs, threshold, top), *COLUMNS)
        assert sorted(got) == slow(rows, threshold, top)
    assert collocations(no_docs).count() == 0


def test_slots_shards_and_runs_change_no_count(given):
    """With almost no slots every phrase seems frequent; with small runs nothing is gathered."""
    docs = given.limit(60)
    f, n = slow_counts(rows_of(docs, "lang", "text"))
    want = {(x, " ".join(w)): a for (x, w), a in f.items() if a >= 12}
    for shards, slots, run_bytes in ((1, 2**16, 2**20), (2, 2**10, 20_000), (3, 2**16, 1)):
        spread = docs.repartition(5)
        got = rows_of(phrase_counts(spread, 12, shards=shards, slots=slots, run_bytes=run_bytes),
                      "lang", "phrase", "n", "k")
        assert {(x, p): a for x, p, a, k in got if k} == want
        assert {x: a for x, _, a, k in got if not k} == +n


def test_equal_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "word_hash", lambda word: 1)
    run = phrases._Run(pa.array(["a b a. b c", "a b"]), pa.array(["x", "y"]))
    batch = run.summed(np.flatnonzero(run.word), run.first, 1).to_pylist()
    found = Counter()
    for r in batch:
        found[r["lang"], r["phrase"]] += r["n"]
    assert +found == {("x", "a"): 2, ("x", "b"): 2, ("x", "c"): 1, ("y", "a"): 1, ("y", "b"): 1}


def test_runs_come_back_as_written():
    import pyarrow as pa

    texts, langs = pa.array(["A b\ta. b  c", "", " a b ", "..", "é b"]), pa.array(list("xyyxz"))
    run = phrases._Run(texts, langs)
    back = phrases._Run.of_row(run.row(2), 0)
    assert run.row(2).to_pylist() == back.row(2).to_pylist()
    assert (run.first == back.first).all() and (run.lang == back.lang).all()
    words = {(r["lang"], r["phrase"]): r["n"] for r in back.singles().to_pylist()}
    assert words == {("x", "a"): 2, ("x", "b"): 2, ("x", "c"): 1, ("y", "a"): 1, ("y", "b"): 1,
                     ("z", "é"): 1, ("z", "b"): 1}
    assert {r["lang"]: r["n"] for r in back.totals().to_pylist()} == {"x": 5, "y": 2, "z": 2}


def test_blocks_give_back_their_phrases_and_take_little_room():
    import pyarrow as pa

    texts = [" ".join(f"word{i * j % 997}" for j in range(1, 400)) for i in range(1, 100)]
    run = phrases._Run(pa.array([*texts, "é b"]), pa.array([*["x\ny"] * 99, ""]))
    rows, first = run.singles(), run.word_counts()
    found = list(phrases._blocks([(rows, run.word_hashes(*first[:2]), first[1])], 1, 8))
    assert len(found) <= 8
    back = Counter()
    for block in found:
        for r in phrases._phrases_of(block).to_pylist():
            lang, phrase = phrases._split_keys(pa.array([r["key"]]))
            back[lang[0].as_py(), phrase[0].as_py(), r["k"]] += r["n"]
    assert back == {(r["lang"], r["phrase"], 1): r["n"] for r in rows.to_pylist()}
    pairs, n = run.distinct(np.flatnonzero(run.word[:-1] & run.word[1:]),
                            phrases._longer(run.first[:-1], run.hashes[1:]), 2)
    many = [(run.phrase_rows(pairs, n, 2), run.first[pairs], run.ids[pairs].astype(np.int64))]
    held = sum(len(b["block"][0].as_py()) for b in phrases._blocks(many, 1, 8))
    # A row of the shuffle took more than 20 bytes.
    assert len(pairs) > 10_000 and held < 10 * len(pairs)


class _Shared:
    def __init__(self, value):
        self.value = value


def _dense(words, vocabulary):
    """A run in which about every phrase stands once, and its counter with all phrases active."""
    import pyarrow as pa

    ids = np.random.default_rng(5).integers(0, vocabulary, words)
    text = " ".join(f"word{i}" for i in ids.tolist())
    batch = phrases._Run(pa.array([text, "a b. a b a b"]), pa.array(["x", "y z\nw"])).row(0)
    return text, lambda buckets: list(phrases._counter(
        _Shared(np.zeros(2**10, np.uint8)), _Shared(np.ones(phrases.WORD_SLOTS, bool)), 2, 3, 5,
        buckets)(iter([batch])))


def test_what_is_done_at_once_changes_no_count(monkeypatch):
    import pyarrow as pa

    text, counted = _dense(3000, 40)
    want = slow_counts([("x", text), ("y z\nw", "a b. a b a b")])
    for name, value in (("FOUND_ROWS", 2000), ("SPELLED_ROWS", 500), ("PASS_BYTES", 20_000),
                        ("HELD_ROWS", 300)):
        monkeypatch.setattr(phrases, name, value)
    for buckets in (1, 7):
        got, slots = Counter(), set()
        found = counted(buckets)
        for b in range(buckets):
            blocks = pa.Table.from_batches([x for x in found if x["bucket"][0].as_py() == b])
            assert all(len(phrases._phrases_of(x)) <= 500 for x in blocks.to_batches())
            # What a step leaves comes back in the next one.
            for step in (2, 3):
                blocks = phrases._merger(step, 3, 2, 5, 2**10)((pa.scalar(b),), blocks)
                assert set(blocks["bucket"].to_pylist()) == {b} and blocks.num_rows > 1
                assert all(len(phrases._phrases_of(x)) <= 300 for x in blocks.to_batches())
                slots |= {x for y in blocks["slots"].to_pylist() for x in y}
            for r in phrases._phrases_of(blocks).to_pylist():
                lang, phrase = phrases._split_keys(pa.array([r["key"]]))
                assert (lang[0].as_py(), phrase[0].as_py()) not in got
                got[lang[0].as_py(), phrase[0].as_py()] = r["n"]
        assert {p: n for p, n in got.items() if p[1]} == {
            (x, " ".join(w)): n for (x, w), n in want[0].items()}
        assert {x: n for (x, p), n in got.items() if not p} == +want[1]
        often = Counter()
        for (x, w), n in want[0].items():
            if n >= 2 and len(w) < 5:
                often.update(phrases._slots(pa.array([x]), pa.array([" ".join(w)]), len(w),
                                            2**10).tolist())
        assert slots == set(often)


def test_parts_hold_all_phrases_once():
    import pyarrow as pa

    keys = pa.array(["x\n", "x\na", "x\na b", "x\na b c", " \nb", "\n", "\né b", "x y\nz b"])
    for some in (keys, keys.slice(2, 5), keys.slice(0, 0)):
        parts = phrases._parts(some, 3) if len(some) else np.zeros(0, np.uint32)
        assert len(parts) == len(some) and (parts < 3).all()
        alone = [int(phrases._parts(some.slice(i, 1), 3)[0]) for i in range(len(some))]
        assert parts.tolist() == alone


def test_a_dense_run_or_bucket_is_never_held_whole(monkeypatch):
    """Once all phrases are active, as on large inputs, a run has four phrases a word."""
    import pyarrow as pa

    spelled, merged = [], []
    rows_of_places, grouped = phrases._Run.phrase_rows, pa.TableGroupBy

    def phrase_rows(self, first, n, k):
        spelled.append(len(n))
        return rows_of_places(self, first, n, k)

    def group_by(table, *args, **options):
        merged.append(table.nbytes)
        return grouped(table, *args, **options)

    monkeypatch.setattr(phrases._Run, "phrase_rows", phrase_rows)
    monkeypatch.setattr(pa, "TableGroupBy", group_by)
    _, counted = _dense(250_000, 40_000)
    found = pa.Table.from_batches(counted(1))
    blocks = phrases._merger(2, 3, 100, 5, 2**10)((pa.scalar(0),), found)
    rows = sum(len(phrases._phrases_of(x)) for x in blocks.to_batches())
    assert rows == sum(len(phrases._phrases_of(x)) for x in found.to_batches()) > 900_000
    assert max(spelled) <= 2**17 and max(merged) < 25 * 1024**2
    # The JVM gets no block of a whole bucket.
    assert max(len(b.as_py()) for b in [*found["block"], *blocks["block"]]) < 4 * 1024**2


def test_hashes_of_a_run_take_five_bytes_a_word():
    import pyarrow as pa

    row = phrases._Run(pa.array(["a b c. a é"]), pa.array(["x"])).row(0)
    words = row["words"][0].as_py().split(" ")
    held = row["hashes"][0].as_py()
    assert [int.from_bytes(held[5 * i:5 * i + 5], "little") for i in range(len(words))] == [
        phrases.word_hash(w) for w in words] and len(held) == 5 * len(words)
