"""Windows, orders, samples and batches of cutoffs (E)."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_reasons(bars: DataFrame, benchmark: str | DataFrame, size: int, horizon: int, threshold: float, stride: int = 1) -> DataFrame:
    """Every cutoff with a whole context and label, and the first reason against it or `valid`."""
    from .marks import marked
    from .store import transitions

    own = transitions(marked(bars, benchmark, {"missing": F.lit(0)}), threshold).withColumn("missing", F.coalesce("missing", F.lit(1)))
    w = Window.partitionBy("symbol").orderBy("ts")
    total = lambda c, first, last: F.sum(c).over(w.rowsBetween(first, last))
    made = own.select("symbol", "ts", (F.row_number().over(w) - 1).alias("idx"), F.lead("ts", horizon).over(w).alias("label_end"), total(F.col("extreme").cast("int"), 2 - size, horizon).alias("jumps"), total("missing", 1 - size, 0).alias("context_gaps"), total("missing", 1, horizon).alias("label_gaps"))
    made = made.where((F.col("idx") >= size - 1) & F.col("label_end").isNotNull() & ((F.col("idx") - (size - 1)) % stride == 0))
    reason = F.when(F.col("jumps") > 0, "extreme_transition").when(F.col("context_gaps") > 0, "benchmark_context_gap").when(F.col("label_gaps") > 0, "benchmark_label_gap").otherwise("valid")
    return made.select("symbol", "ts", "idx", "label_end", reason.alias("reason"))


def window_audit(reasons: DataFrame) -> DataFrame:
    """E2."""
    return reasons.groupBy("reason").agg(F.count("*").alias("windows"), F.count_distinct("symbol").alias("symbols"))


def ordinals(cutoffs: DataFrame) -> DataFrame:
    """Every cutoff's number in the order of symbol and time.

    Numbers within a symbol are made where the symbol is; only a count a symbol is summed in order.
    """
    counts = cutoffs.groupBy("symbol").agg(F.count("*").alias("n"))
    starts = counts.select("symbol", (F.sum("n").over(Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    within = cutoffs.withColumn("at", F.row_number().over(Window.partitionBy("symbol").orderBy("idx")) - 1)
    return within.join(starts, "symbol").withColumn("ordinal", F.col("start") + F.col("at")).drop("start", "at")


def time_features(rows: DataFrame) -> DataFrame:
    """Weekday from Monday 0, day and month."""
    return rows.select("symbol", "ts", F.weekday("ts").alias("weekday"), F.dayofmonth("ts").alias("day"), F.month("ts").alias("month"))


@dataclass(frozen=True)
class BlockSample:
    """A fixed share of ordinals by whole blocks, whose order is an affine map of their numbers."""

    count: int
    fraction: float = 1.0
    most: int | None = None
    block: int = 128
    multiplier: int = 7919
    offset: int = 13

    @property
    def blocks(self) -> int:
        return -(-self.count // self.block)

    @property
    def step(self) -> int:
        m = self.multiplier % max(1, self.blocks) or 1
        while gcd(m, max(1, self.blocks)) != 1:
            m += 1
        return m

    @property
    def target(self) -> int:
        n = max(1, int(self.count * self.fraction))
        return min(n, self.most) if self.most else n


def block_sample(numbered: DataFrame, sample: BlockSample) -> DataFrame:
    """The rows of the sample with their place in it; a row's block alone says whether it is in."""
    b, size, inverse = sample.blocks, sample.block, pow(sample.step, -1, sample.blocks) if sample.blocks > 1 else 0
    block = F.floor(F.col("ordinal") / size)
    rank = F.pmod((block - sample.offset) * inverse, F.lit(b))
    last_rank = (b - 1 - sample.offset) * inverse % b
    short = b * size - sample.count  # rows that the last block lacks
    before = rank * size - F.when(rank > last_rank, short).otherwise(0)
    place = before + F.col("ordinal") % size
    return numbered.withColumn("place", place.cast("long")).where(F.col("place") < sample.target)


def batches(numbered: DataFrame, size: int, count: int) -> DataFrame:
    """Batch and slot of each ordinal; the last batch is filled up with the first ordinals."""
    missing = -count % size
    filled = numbered.withColumn("turn", F.lit(0)).union(numbered.where(F.col("ordinal") < missing).withColumn("turn", F.lit(1)))
    at = F.col("ordinal") + F.col("turn") * count
    return filled.select("ordinal", F.floor(at / size).alias("batch"), (at % size).alias("slot"))


def date_market_order(numbered: DataFrame, market: str = "symbol") -> DataFrame:
    """By day, market code and ordinal; the number within the day is made where the day is."""
    return numbered.select("ts", F.col(market).alias("market"), "ordinal", F.row_number().over(Window.partitionBy("ts").orderBy(market, "ordinal")).alias("at"))


def top_by(rows: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k best rows, ties to the larger `tie`."""
    return rows.orderBy(F.desc(value), F.desc(tie)).limit(k)


def per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """N rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
