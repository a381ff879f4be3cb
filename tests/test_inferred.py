import random
from itertools import combinations

import pytest

import haulframe as hf
from haulframe.operators import inferred


def found(frames, **options):
    return sorted(map(tuple, hf.infer_keys(frames, **options).collect()), key=str)


def brute(tables):
    """Keys and inclusions by comparing columns one by one; tables are lists of dicts."""
    rows, keys = [], {}
    for t, held in tables.items():
        names = list(held[0]) if held else []
        def unique(cols):
            got = [tuple(r[c] for c in cols) for r in held]
            return all(None not in g for g in got) and len(set(got)) == len(got)
        keys[t] = [(c,) for c in names if unique((c,))]
        if names and not keys[t]:
            keys[t] = [p for p in combinations(names, 2) if unique(p)]
        rows += [("key", t, ",".join(k)) for k in keys[t]]
    for t, held in tables.items():
        for c in (held[0] if held else []):
            values = {r[c] for r in held} - {None}
            for p, ks in keys.items():
                for (k,) in (k for k in ks if len(k) == 1):
                    other = {r[k] for r in tables[p]}
                    same = {type(v) for v in values} == {type(v) for v in other}
                    if p != t and values and same and values <= other:
                        rows.append(("reference", t, c, p, k))
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_columns(spark, seed):
    random.seed(seed)
    tables = {
        "parent": [{"id": i, "code": f"c{i % 4}", "low": i % 3} for i in range(8)],
        "child": [{"id": random.choice([0, 1]), "line": random.randrange(6),
                   "parent_id": random.choice([1, 3, 5, None]), "code": f"c{random.randrange(4)}"}
                  for _ in range(12)],
        "codes": [{"code": f"c{i}", "n": None if i == 2 else i} for i in range(5)],
        "lines": [{"a": i // 5, "b": i % 5, "z": "x"} for i in range(20)],
    }
    kinds = {"parent": "id int, code string, low long", "codes": "code string, n int",
             "child": "id int, line int, parent_id long, code string",
             "lines": "a int, b long, z string"}
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], kinds[t])
              for t, rows in tables.items()}
    got = sorted((tuple(v for v in r[:5] if v is not None) for r in found(frames)), key=str)
    assert got == brute(tables)


def test_names_that_agree(spark):
    frames = {"users": spark.range(5).withColumnRenamed("id", "id"),
              "acts": spark.createDataFrame([(1, 2, 1), (1, 3, 3)], "user_id int, n int, id int")}
    named = {r[2] for r in found(frames) if r[0] == "reference" and r[5]}
    assert named == {"user_id", "id"}
    declared = [hf.contract_of(t, df.schema) for t, df in frames.items()]
    users, acts = hf.with_inferred(declared, hf.infer_keys(frames))
    assert users.primary_key == ["id"]
    assert {c: k.table for c, k in acts.foreign_keys} == {"user_id": "users", "id": "users"}


def test_nothing_to_infer(spark):
    empty = spark.createDataFrame([], "a int, b string")
    odd = spark.createDataFrame([(1.5, [1], None)], "x double, l array<int>, n int")
    assert found({"empty": empty, "odd": odd}) == []
    rows = spark.createDataFrame([(1, 2), (1, 2)], "a int, b int")
    assert found({"rows": rows}) == [] and found({"rows": rows}, pairs=False) == []


def test_more_columns_than_a_mask_holds(spark):
    wide = spark.createDataFrame([tuple(range(70)), tuple(range(1, 71))],
                                 ", ".join(f"c{i} int" for i in range(70)))
    ids = spark.range(71).withColumnRenamed("id", "k")
    got = [r for r in found({"wide": wide.union(wide), "ids": ids}, pairs=False)
           if r[0] == "reference"]
    assert len(got) == 70 and {r[4] for r in got} == {"k"}
    fewer = [r for r in found({"wide": wide.union(wide), "ids": ids.where("k < 66")},
                                 pairs=False) if r[0] == "reference"]
    assert {r[2] for r in fewer} == {f"c{i}" for i in range(65)}


def test_pairs_are_refuted_by_a_slice_of_keys_and_confirmed_by_all(spark):
    """One repeat anywhere refutes; many repeats are found without reading all keys."""
    once = [(a, a % 7) for a in range(2000)]
    for extra, often in (([], False), ([once[0]], False), (once, True)):
        frames = {"t": spark.createDataFrame(once + extra, "a long, b int")}
        groups = {0: ("t", ("a", "b"))}
        assert not often or inferred._repeated(frames, groups, inferred.SLICES) == {0}
        assert inferred._repeated(frames, groups) == ({0} if extra else set())
        want = [] if extra else [("a", "b")]
        assert inferred._tested(frames, {"t": [("a", "b")]}) == {"t": want}
