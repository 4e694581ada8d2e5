"""Exact quantiles of any number of rows by counting.

A value is a whole number of 64 bits that keeps its order. The ranks wanted of each group are found by
the leading 16 bits first: counts by group and leading bits say which of these hold a rank, and only
rows with such leading bits are looked at for the next 16, and so on. Four passes of partial aggregation
for all groups and ranks at once; a task holds counts, 65,536 for a group and rank at most, and never the
values of a group, so memory does not depend on the rows. The values are written once, and no pass moves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stages

STEP, PASSES = 16, 4
LOW = (1 << 63) - 1


def code_of(value: Column) -> Column:
    """A double's order as a long: NaN after all others, both zeros equal."""
    known = F.coalesce(value.cast("double"), F.lit(0.0)) + F.lit(0.0)  # the method takes no null
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), known).cast("long")
    return F.when(value.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit(LOW))).otherwise(bits))


def value_of(code: Column) -> Column:
    bits = F.when(code < 0, code.bitwiseXOR(F.lit(LOW))).otherwise(code)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _found(coded: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """(keys, rank) to (keys, rank, value)."""
    at = targets.withColumns({"rest": F.col("rank"), "prefix": F.lit(0).cast("long")})
    for turn in range(PASSES):
        shift = 64 - STEP * (turn + 1)
        rows = coded.withColumn("bucket", F.shiftright("code", shift))
        rows = rows.withColumn("prefix", F.shiftright("code", shift + STEP) if turn else F.lit(0).cast("long"))
        if turn:
            rows = rows.join(at.select(*keys, "prefix").distinct(), [*keys, "prefix"], "left_semi")
        counts = rows.groupBy(*keys, "prefix", "bucket").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy(*keys, "prefix").orderBy("bucket")) - F.col("n")
        spans = counts.withColumn("before", before)
        hit = at.join(spans, [*keys, "prefix"]).where((F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("n")))
        at = hit.select(*keys, "rank", (F.col("rest") - F.col("before")).alias("rest"), F.col("bucket").alias("prefix"))
    return at.select(*keys, "rank", value_of(F.col("prefix")).alias("value"))


def exact(rows: DataFrame, keys: list[str], value: Column | str, shares: tuple[float, ...]) -> DataFrame:
    """keys, n and q, an array of the quantiles at `shares`, with linear interpolation between ranks; nulls don't count.

    A group without values has no row, nor has one with a null key. Without keys there is one row, or none.
    """
    value = F.col(value) if isinstance(value, str) else value
    whole = keys or ["__all"]
    named = rows if keys else rows.withColumn("__all", F.lit(1))
    coded = stages.written(named.select(*whole, code_of(value).alias("code")).where("code is not null"), "codes")
    sizes = coded.groupBy(*whole).agg(F.count("*").alias("n"))
    place = lambda share: (F.col("n") - 1) * F.lit(float(share))
    ends = F.array(*[end(place(share)).cast("long") for share in shares for end in (F.floor, F.ceil)])
    found = _found(coded, whole, sizes.select(*whole, F.explode(F.array_distinct(ends)).alias("rank")))
    # of a group two ranks a share at most
    values = found.groupBy(*whole).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    low, high = (lambda share: F.floor(place(share)).cast("long")), (lambda share: F.ceil(place(share)).cast("long"))
    one = lambda share: F.when(F.col("at")[low(share)] == F.col("at")[high(share)], F.col("at")[low(share)]).otherwise((high(share) - place(share)) * F.col("at")[low(share)] + (place(share) - low(share)) * F.col("at")[high(share)])
    return sizes.join(values, whole).select(*keys, "n", F.array(*[one(s) for s in shares]).alias("q"))
