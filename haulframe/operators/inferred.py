"""Keys and references that the rows themselves show, for lakes, which declare none."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from haulframe.contract import Contract, ForeignKey
from haulframe.functions.names import col

# Size of the distinct-count sketches (2 to the 12 registers: an error of 1.6 %), and the share of
# rows a key's estimate must reach: six times that error below all of them.
SKETCH = 12
NEARLY_ALL = 0.9
# Pairs of columns that one scan sketches.
PAIRS_AT_ONCE = 64
# Slices of a pair's key space, of which the first is looked at before all.
SLICES = 64
# Bits of a mask of columns; a sign bit is left out.
MASK = 63
FOUND = "kind string, table string, columns string, parent string, parent_column string, named boolean"


def infer_keys(frames: dict[str, DataFrame], pairs: bool = True) -> DataFrame:
    """``(kind, table, columns, parent, parent_column, named)`` of the keys and references that
    hold for all rows.

    ``key``: columns without NULL whose values never repeat, single ones, and with ``pairs`` two
    together in tables without a single one. ``reference``: a column all of whose values another
    table's single key has; ``named`` if the names agree as well (the same name, the same name
    after prefixes of one or two letters, or the parent's name and its key). Small whole numbers
    lie in many keys, so references that are not named are only candidates. Tables without rows
    show nothing. Numbers with fractions and nested columns are no keys.

    Each table is read by one pass of distinct-count sketches, which leaves out most columns, and
    one that tests what is left; another pass over each column that may refer tests all pairs of
    columns at once: every value becomes the set of columns that hold it, so one shuffle of
    distinct values for each kind serves all references. Hot values are one row a task by then.
    """
    spark = next(iter(frames.values())).sparkSession
    known = {t: _sketched(df) for t, df in frames.items()}
    singles = {t: [(c,) for c, (full, unique, _) in seen.items() if full and unique]
               for t, seen in known.items()}
    keys = _tested(frames, singles)
    if pairs:
        wide = {t: _likely_pairs(frames[t], known[t]) for t in frames
                if not keys[t] and known[t]}
        keys |= {t: found for t, found in _tested(frames, wide).items() if found}
    rows = [("key", t, ",".join(k), None, None, None) for t, found in keys.items() for k in found]
    # Only columns of the same kind that have no more values than the key may refer to it.
    refers = []
    for parent, found in keys.items():
        for key in (k[0] for k in found if len(k) == 1):
            _, _, (kind, size) = known[parent][key]
            refers += [((child, c), (parent, key)) for child, seen in known.items()
                       for c, (_, _, (other, n)) in seen.items()
                       if child != parent and other == kind and 0 < n * NEARLY_ALL <= size]
    rows += [("reference", child, c, parent, key, _alike(c, parent, key))
             for (child, c), (parent, key) in _included(frames, refers)]
    return spark.createDataFrame(rows, FOUND)


def with_inferred(contracts: list[Contract], found: DataFrame) -> list[Contract]:
    """Contracts with inferred keys and named references, where they declare none.

    A table's key is its first one; a column that might refer to several parents is left alone.
    """
    rows = found.collect()  # as many as there are keys and references
    result = []
    for contract in contracts:
        mine = [r for r in rows if r["table"] == contract.table]
        keys = [r["columns"].split(",") for r in mine if r["kind"] == "key"]
        places = [c.name for c in contract.columns]
        keys = sorted((k for k in keys if all(n in places for n in k)),
                      key=lambda k: [places.index(n) for n in k])
        primary = keys[0] if keys and not contract.primary_key else contract.primary_key
        columns = []
        for spec in contract.columns:
            parents = [ForeignKey(r["parent"], r["parent_column"]) for r in mine
                       if r["kind"] == "reference" and r["columns"] == spec.name and r["named"]]
            reference = spec.foreign_key or (parents[0] if len(parents) == 1 else None)
            columns.append(replace(spec, primary_key=spec.name in primary, foreign_key=reference))
        result.append(replace(contract, columns=tuple(columns)))
    return result


def _kind(data_type: T.DataType) -> str | None:
    """Columns of one kind can hold the same values."""
    if isinstance(data_type, T.IntegralType):
        return "whole number"
    if isinstance(data_type, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return data_type.typeName()
    return None


def _sketched(df: DataFrame) -> dict[str, tuple[bool, bool, tuple[str, int]]]:
    """For each column that may be a key: no NULLs, nearly all distinct, kind and distinct values."""
    names = [f.name for f in df.schema.fields if _kind(f.dataType)]
    if not names:
        return {}
    row = df.agg(F.count(F.lit(1)).alias("all"), *[
        m for i, n in enumerate(names)
        for m in (F.count(col(n)).alias(f"n{i}"),
                  _distinct(n).alias(f"d{i}"))]).first()
    if not row["all"]:
        return {}
    return {n: (row[f"n{i}"] == row["all"], row[f"d{i}"] >= NEARLY_ALL * row["all"],
                (_kind(df.schema[n].dataType), row[f"d{i}"])) for i, n in enumerate(names)}


def _likely_pairs(df: DataFrame, known: dict) -> list[tuple[str, str]]:
    """Pairs of columns without NULL that are nearly all distinct together."""
    full = {n: size for n, (whole, _, (_, size)) in known.items() if whole}
    rows = df.count()
    pairs = [(a, b) for a, b in combinations(full, 2) if full[a] * full[b] >= NEARLY_ALL * rows]
    likely = []
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        some = pairs[at:at + PAIRS_AT_ONCE]
        found = df.agg(*[_distinct(*p).alias(f"d{i}") for i, p in enumerate(some)]).first()
        likely += [p for p, n in zip(some, found) if n >= NEARLY_ALL * rows]
    return likely


def _distinct(*names: str) -> Column:
    values = F.xxhash64(*[col(n) for n in names])
    present = reduce(lambda a, b: a & b, [col(n).isNotNull() for n in names])
    sketch = F.hll_sketch_agg(F.when(present, values), F.lit(SKETCH))
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def _tested(frames: dict[str, DataFrame],
            groups: dict[str, list[tuple[str, ...]]]) -> dict[str, list[tuple[str, ...]]]:
    """The groups of columns that never repeat: one shuffle a group.

    Columns that are only together nearly all distinct seldom are a key, so a slice of their key
    space, with every row of the keys in it, is looked at before all of it: one repeat refutes.
    """
    numbered = {i: (t, g) for i, (t, g) in enumerate((t, g) for t, found in groups.items()
                                                     for g in found)}
    broken = _repeated(frames, {i: n for i, n in numbered.items() if len(n[1]) > 1}, SLICES)
    broken |= _repeated(frames, {i: n for i, n in numbered.items() if i not in broken})
    return {t: [g for i, (u, g) in numbered.items() if u == t and i not in broken]
            for t in groups}


def _repeated(frames: dict[str, DataFrame], numbered: dict[int, tuple[str, tuple[str, ...]]],
              slices: int = 1) -> set[int]:
    """Numbers of the groups of columns that repeat in the first of so many slices of keys."""
    found = []
    for number, (table, group) in numbered.items():
        df = frames[table]
        keys = [f"k{i}" for i in range(len(group))]
        rows = df.select(*[_plain(df, c).alias(k) for c, k in zip(group, keys)]).dropna()
        if slices > 1:
            rows = rows.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == 0)
        found.append(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                     .select(F.lit(number).alias("number")))
    return {r[0] for r in reduce(DataFrame.unionAll, found).distinct().collect()} if found else set()


def _plain(df: DataFrame, name: str) -> Column:
    """The values of a column in the widest type of its kind."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return col(name).cast("long")
    return col(name).cast("string") if isinstance(kind, T.StringType) else col(name)


def _included(frames: dict[str, DataFrame], refers: list) -> list:
    """The pairs of columns of which the first has no value the second lacks."""
    if not refers:
        return []
    columns = list(dict.fromkeys(c for pair in refers for c in pair))
    number = {c: i for i, c in enumerate(columns)}
    masks = [f"m{i}" for i in range(-(-len(columns) // MASK))]
    values = {}
    for (table, name), i in number.items():
        df = frames[table]
        word, bit = divmod(i, MASK)
        values.setdefault(_kind(df.schema[name].dataType), []).append(
            df.select(_plain(df, name).alias("value"),
                      *[F.lit(1 << bit if j == word else 0).cast("long").alias(m)
                        for j, m in enumerate(masks)]).where("value is not null"))
    holders = reduce(DataFrame.unionAll, [
        reduce(DataFrame.unionAll, held).groupBy("value").agg(*[F.bit_or(m).alias(m)
                                                               for m in masks]).select(*masks)
        for held in values.values()]).distinct()

    def bit(which):
        word, at = divmod(which, MASK)
        return f"(m{word} & {1 << at}L) != 0"

    lacking = [F.when(F.expr(f"{bit(number[c])} and not {bit(number[p])}"), F.lit(i))
               for i, (c, p) in enumerate(refers)]
    broken = holders.select(F.explode(F.array_compact(F.array(*lacking))).alias("pair")).distinct()
    lost = {r[0] for r in broken.collect()}
    return [pair for i, pair in enumerate(refers) if i not in lost]


def _alike(column: str, parent: str, key: str) -> bool:
    column, parent, key = column.lower(), parent.lower(), key.lower()
    if column == key or column in (f"{parent}_{key}", f"{parent.removesuffix('s')}_{key}"):
        return True
    stems = [name.partition("_") for name in (column, key)]
    return all(0 < len(head) <= 2 and tail for head, _, tail in stems) and (
        stems[0][2] == stems[1][2])
