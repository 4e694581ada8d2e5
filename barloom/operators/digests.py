"""Digests that merge (N1, H10, H11): canonical JSON of rows, and hash trees over ranges of them.

A row's digest is that of its canonical JSON: keys sorted at every depth, nulls written, and an error for a
number that is not finite. A tree has a level for each of some columns, from coarse ranges to fine ones. A
leaf is a finest range and digests its rows in order; a node digests its children in order; the root has
the empty path. Each level is one aggregation, a task holds the children of single nodes, and rows may be
laid out in any way. Two trees are compared from the root: of a level only children of nodes that differ
are looked at, so what is equal is left alone after one comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def _ordered(value: Column, kind: DataType) -> Column:
    """The value with the keys of all structs and maps in order."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        made = F.struct(*[_ordered(value.getField(f.name), f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _ordered(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def _unsound(value: Column, kind: DataType) -> Column:
    """Whether a number in the value is not finite."""
    if isinstance(kind, DoubleType | FloatType):
        return F.isnan(value) | (F.abs(value) == float("inf"))
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a | b, [F.coalesce(_unsound(value.getField(f.name), f.dataType), F.lit(False)) for f in kind.fields], F.lit(False))
    if isinstance(kind, ArrayType):
        return F.exists(value, lambda x: F.coalesce(_unsound(x, kind.elementType), F.lit(False)))
    if isinstance(kind, MapType):
        return F.exists(F.map_values(value), lambda x: F.coalesce(_unsound(x, kind.valueType), F.lit(False)))
    return F.lit(False)


def canonical(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """The canonical JSON of some columns of these rows, or of all; reading one that is not finite fails."""
    kinds = {f.name: f.dataType for f in rows.schema.fields if columns is None or f.name in columns}
    bad = reduce(lambda a, b: a | b, [F.coalesce(_unsound(F.col(c), kind), F.lit(False)) for c, kind in kinds.items()], F.lit(False))
    text = F.to_json(F.struct(*[_ordered(F.col(c), kinds[c]).alias(c) for c in sorted(kinds)]), {"ignoreNullFields": "false"})
    return F.when(bad, F.raise_error(F.lit("a number is not finite"))).otherwise(text)


def spread(key: str, digits: int = 2, levels: int = 2) -> list[Column]:
    """Ranges of a key's hash, so that no node has more children than 16 to the power of `digits` and its own share of keys."""
    return [F.substring(F.sha2(F.col(key), 256), 1, digits * (i + 1)).alias(f"hash_{i}") for i in range(levels)]


def tree(rows: DataFrame, path: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """level, path (its columns' texts down to there), digest, n (rows): a row a node, level 0 the root.

    `order` makes the rows of a leaf unique, as the digest depends on their sequence.
    """
    whole = columns or rows.columns
    row = rows.select(F.array(*[F.col(c).cast("string") for c in path]).alias("path"), F.struct(*order, F.sha2(canonical(rows, whole), 256).alias("digest")).alias("held"))

    def joined(parts: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda x: x["digest"]), ","), 256)

    level = row.groupBy("path").agg(joined(F.collect_list("held")).alias("digest"), F.count("*").alias("n"))
    out = [level.select(F.lit(len(path)).alias("level"), "path", "digest", "n")]
    for depth in range(len(path) - 1, -1, -1):
        up = F.slice("path", 1, depth) if depth else F.array().cast("array<string>")
        level = level.groupBy(up.alias("up")).agg(joined(F.collect_list(F.struct(F.element_at("path", -1).alias("at"), "digest"))).alias("digest"), F.sum("n").alias("n")).withColumnRenamed("up", "path")
        out.append(level.select(F.lit(depth).alias("level"), "path", "digest", "n"))
    return reduce(lambda a, b: a.union(b), out)


def differing(one: DataFrame, other: DataFrame, depth: int) -> DataFrame:
    """path, n_one and n_other of the leaves that differ; a leaf that one side lacks has null there. `depth` is that of the leaves.

    Both trees are tables that have been written; a level is met by path, below nodes that differ alone.
    """
    found = None
    for level in range(depth + 1):
        a, b = (t.where(F.col("level") == level).select("path", F.col("digest").alias(f"d_{n}"), F.col("n").alias(f"n_{n}")) for t, n in ((one, "one"), (other, "other")))
        if found is not None:
            up = F.slice("path", 1, level - 1) if level > 1 else F.array().cast("array<string>")
            a, b = (x.withColumn("up", up).join(found.select(F.col("path").alias("up")), "up", "left_semi").drop("up") for x in (a, b))
        met = a.join(b, "path", "full_outer")
        found = met.where(~F.col("d_one").eqNullSafe(F.col("d_other"))).select("path", "n_one", "n_other")
    return found
