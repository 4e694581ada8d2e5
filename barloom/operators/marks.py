"""Every asset with its own benchmark (D6, D7, and the alignment of all windows and labels).

Operators take `benchmark` as one symbol, the benchmark of all others, or as a table (symbol,
benchmark_symbol) of the assets and what each is compared with, which may be of several calendars.
A benchmark is aligned by the asset's own dates: its bar of the same day, or nothing.

The benchmarks' bars are few (a row a benchmark and date), so where they are small enough Spark
broadcasts them, and no bar moves. Where they are not, they are replicated: each of their rows goes
out REPLICAS times, and the bars of a day that most symbols share are dealt over as many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import consistent, transitions

REPLICAS = 16
#: Kinds of securities that may be targets.
TARGETS = ("stock", "etf")


def marked(bars: DataFrame, benchmark: str | DataFrame, columns: dict[str, Column], how: str = "left") -> DataFrame:
    """The assets' bars with `columns`, made from their benchmark's bar of the same ts; with a table, also benchmark_symbol."""
    made = [column.alias(name) for name, column in columns.items()]
    if isinstance(benchmark, str):
        marks = bars.where(F.col("symbol") == benchmark).select("ts", *made)
        return bars.where(F.col("symbol") != benchmark).join(marks, "ts", how)
    pairs = benchmark.select("symbol", "benchmark_symbol")
    names = pairs.select(F.col("benchmark_symbol").alias("symbol")).distinct()
    copies = F.explode(F.array([F.lit(i).cast("long") for i in range(REPLICAS)])).alias("__replica")
    marks = bars.join(names, "symbol").select(F.col("symbol").alias("benchmark_symbol"), "ts", *made, copies)
    own = bars.join(pairs, "symbol").withColumn("__replica", F.pmod(F.xxhash64("symbol"), F.lit(REPLICAS)))
    return own.join(marks, ["benchmark_symbol", "ts", "__replica"], how).drop("__replica")


def decided(index: DataFrame, by_market: dict[str, str], explicit: DataFrame | None = None, funds: DataFrame | None = None) -> DataFrame:
    """B6 for an index of (symbol, asset_type, market): benchmark_symbol, eligible and reason, by the first rule that applies.

    `explicit` (symbol, benchmark_symbol) goes before the market's benchmark. `funds` (symbol, market) are
    the funds that may be targets (B5); without it, all may.
    """
    rows = index.join(explicit.select("symbol", F.col("benchmark_symbol").alias("__own")), "symbol", "left") if explicit is not None else index.withColumn("__own", F.lit(None).cast("string"))
    if funds is not None:
        rows = rows.join(funds.select("symbol", "market", F.lit(True).alias("__listed")), ["symbol", "market"], "left")
    else:
        rows = rows.withColumn("__listed", F.lit(True))
    of_market = F.coalesce(*[F.when(F.col("market") == market, name) for market, name in by_market.items()], F.lit(None).cast("string"))
    wanted = F.coalesce("__own", of_market)
    rules = [
        ("inconsistent_symbol_metadata", F.col("asset_type").isNull() | F.col("market").isNull()),
        ("index", F.col("asset_type") == "index"),
        ("unsupported_type", ~F.col("asset_type").isin(*TARGETS)),
        ("fund_not_listed", (F.col("asset_type") == "etf") & F.col("__listed").isNull()),
        ("unmapped", wanted.isNull()),
        ("benchmark_self", wanted == F.col("symbol")),
        ("explicit", F.col("__own").isNotNull()),
    ]
    reason = reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules), F.lit("market"))
    found = rows.withColumn("reason", reason).withColumn("eligible", F.col("reason").isin("explicit", "market"))
    return found.withColumn("benchmark_symbol", F.when(F.col("eligible") | (F.col("reason") == "benchmark_self"), wanted)).drop("__own", "__listed")


def without_missing(index: DataFrame) -> DataFrame:
    """Eligible symbols whose benchmark has no bars are missing_benchmark."""
    there = index.select(F.col("symbol").alias("benchmark_symbol"), F.lit(True).alias("__there"))
    joined = index.join(there, "benchmark_symbol", "left")
    gone = F.col("eligible") & F.col("__there").isNull()
    return joined.withColumn("reason", F.when(gone, "missing_benchmark").otherwise(F.col("reason"))).withColumn("eligible", F.col("eligible") & ~gone).drop("__there")


def market_index(bars: DataFrame, threshold: float, by_market: dict[str, str], explicit: DataFrame | None = None, funds: DataFrame | None = None) -> DataFrame:
    """A row a symbol: counts, dates, asset_type and market ('unknown' where its bars do not agree),
    its benchmark, and whether it is eligible or the first reason why not."""
    totals = [F.count("*").alias("row_count"), F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count_if("extreme").alias("extreme_count"), F.count_if(F.col("gap_days") > 10).alias("long_gap_count")]
    made = transitions(bars, threshold).groupBy("symbol").agg(*totals, consistent("asset_type").alias("asset_type"), consistent("market").alias("market"))
    found = without_missing(decided(made, by_market, explicit, funds))
    return found.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("asset_type", "market")})


def targets(index: DataFrame) -> DataFrame:
    """(symbol, benchmark_symbol, market) of the eligible symbols."""
    return index.where("eligible").select("symbol", "benchmark_symbol", "market")
