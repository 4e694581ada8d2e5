"""Long histories in slices of bars with borrowed borders (D8, E1, C4, F16 for hot symbols).

An operator whose windows reach back and forward by known numbers of bars needs a symbol's bars together
only so far. Bars are numbered without a window over the whole symbol: within a calendar unit where it
is, plus what came before, which is a sum over a row a unit. A slice is `size` consecutive bars, with as
many of the neighbours' as windows reach. Each slice stands for a symbol of its own, so operators run as
they are; of their rows those of a slice's own bars are kept, and their numbers are made those of the
symbol. The rows are the same for every size, and no task holds more than a slice, or a unit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Between a symbol and its slice's number.
SIGN = "\x1f"


def numbered(bars: DataFrame, unit: str = "month") -> DataFrame:
    """Adds idx, the bar's number in its symbol from 0; a window holds a symbol's bars of one unit alone."""
    cell = bars.withColumn("__cell", F.date_trunc(unit, "ts"))
    sizes = cell.groupBy("symbol", "__cell").agg(F.count("*").alias("n"))
    before = sizes.select("symbol", "__cell", (F.sum("n").over(Window.partitionBy("symbol").orderBy("__cell")) - F.col("n")).alias("__before"))  # a row a unit
    within = F.row_number().over(Window.partitionBy("symbol", "__cell").orderBy("ts")) - 1
    return cell.withColumn("__at", within).join(before, ["symbol", "__cell"]).withColumn("idx", (F.col("__before") + F.col("__at")).cast("long")).drop("__cell", "__at", "__before")


def sliced(bars: DataFrame, size: int, back: int, ahead: int, unit: str = "month") -> DataFrame:
    """The bars of all slices, symbol, SIGN and number as their symbol, with __symbol, idx and whether they are the slice's own."""
    if size < max(back, ahead):
        raise ValueError(f"slices of {size} bars are shorter than what they borrow")
    block = F.floor(F.col("idx") / size)
    near = F.array(
        F.struct(block.alias("block"), F.lit(True).alias("own")),
        F.when(F.col("idx") >= (block + 1) * size - back, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
        F.when((block > 0) & (F.col("idx") < block * size + ahead), F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
    )
    rows = numbered(bars, unit).withColumn("__s", F.explode(F.array_compact(near)))
    return rows.withColumn("__symbol", F.col("symbol")).withColumn("symbol", F.concat("symbol", F.lit(SIGN), F.col("__s.block").cast("string"))).withColumn("__own", F.col("__s.own")).drop("__s")


def by_slices(bars: DataFrame, benchmark: str | DataFrame, operator: Callable[[DataFrame, str | DataFrame], DataFrame], size: int, back: int, ahead: int, unit: str = "month") -> DataFrame:
    """What `operator(bars, benchmark)` gives, by slices; it has symbol and ts, and idx if it numbers bars.

    Windows may reach `back` bars before and `ahead` bars after. Benchmarks are met by date and stay whole.
    """
    if isinstance(benchmark, str):
        marks, own = bars.where(F.col("symbol") == benchmark), bars.where(F.col("symbol") != benchmark)
    else:
        names = benchmark.select(F.col("benchmark_symbol").alias("symbol")).distinct()
        marks, own = bars.join(names, "symbol", "left_semi"), bars.join(benchmark.select("symbol"), "symbol", "left_semi")
    cut = sliced(own, size, back, ahead, unit)
    spans = cut.groupBy("symbol").agg(F.first("__symbol").alias("__symbol"), F.min("idx").alias("__first"), F.min(F.when(F.col("__own"), F.col("ts"))).alias("__from"), F.max(F.when(F.col("__own"), F.col("ts"))).alias("__to")).where("__from is not null")
    chosen = benchmark if isinstance(benchmark, str) else spans.select("symbol", "__symbol").join(benchmark.select(F.col("symbol").alias("__symbol"), "benchmark_symbol"), "__symbol").select("symbol", "benchmark_symbol")
    made = operator(cut.select(*bars.columns).unionByName(marks.select(*bars.columns)), chosen)
    kept = made.join(spans, "symbol").where(F.col("ts").between(F.col("__from"), F.col("__to")))
    back_to = {"symbol": F.col("__symbol")} | ({"idx": F.col("idx") + F.col("__first")} if "idx" in made.columns else {})
    return kept.withColumns(back_to).select(*made.columns)
