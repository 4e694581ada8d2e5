"""Samples, resumable batches, whole windows and padded arrays (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .marks import marked

TINY = 1e-12


def seeded_order(key: Column, seed: int) -> Column:
    """A hash that orders keys alike everywhere, by a seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def uniform_sample(numbered: DataFrame, size: int, seed: int) -> DataFrame:
    """`size` ordinals without replacement, by their seeded hashes."""
    return numbered.withColumn("__at", seeded_order(F.col("ordinal"), seed)).orderBy("__at", "ordinal").limit(size).drop("__at")


def window_arrays(bars: DataFrame, benchmark: str | DataFrame, size: int) -> DataFrame:
    """E5: for each cutoff with a whole window on the benchmark's dates the as-of adjusted closes and
    volumes of both, and the dates. One shuffle by symbol, after a join by date."""
    own = marked(bars, benchmark, {"bench": F.col("adjusted_close"), "bench_raw": F.col("close")})
    w = Window.partitionBy("symbol").orderBy("ts")
    over = w.rowsBetween(1 - size, 0)
    row = F.struct("ts", "adjusted_close", "split_adjusted_volume", "bench")
    held = own.withColumn("idx", F.row_number().over(w) - 1).withColumn("n", F.count("bench").over(over)).withColumn("w", F.collect_list(row).over(over)).where(F.col("n") == size)
    price = lambda x: ratio(x["adjusted_close"], F.col("adjusted_close")) * F.col("close")
    shares = F.when(F.col("volume") > 0, F.col("split_adjusted_volume") / F.col("volume")).otherwise(1.0)
    return held.select(
        "symbol", "ts", "idx",
        F.transform("w", price).alias("closes"),
        F.transform("w", lambda x: x["split_adjusted_volume"] / shares).alias("volumes"),
        F.transform("w", lambda x: ratio(x["bench"], F.col("bench")) * F.col("bench_raw")).alias("bench_closes"),
        F.transform("w", lambda x: x["ts"]).alias("dates"),
    )


def training_rows(bars: DataFrame, benchmark: str | DataFrame, size: int, horizons: list[int]) -> DataFrame:
    """E5 whole: each cutoff's context arrays of both, weekday, day and month of its dates, and for each horizon
    the alpha, null where it has none, whether it is valid, and the date at which it ends. All of a row is made
    where the symbol is: after the benchmark has met the bars by date, one shuffle and one chain of windows."""
    price = F.col("open") * F.col("adjusted_close") / F.greatest("close", F.lit(TINY))
    own = marked(bars, benchmark, {"bench": F.col("adjusted_close"), "bench_raw": F.col("close"), "bench_open": price})
    w = Window.partitionBy("symbol").orderBy("ts")
    over = w.rowsBetween(1 - size, 0)
    lead = lambda c, n: F.lead(c, n).over(w)
    legs = F.array(*[F.struct(lead("adjusted_close", h).alias("x"), lead("bench", h).alias("b"), lead("ts", h).alias("end_at")) for h in horizons])
    held = own.withColumns({"idx": F.row_number().over(w) - 1, "n": F.count("bench").over(over), "w": F.collect_list(F.struct("ts", "adjusted_close", "split_adjusted_volume", "bench")).over(over), "entry": F.lead(price, 1).over(w), "bench_entry": lead("bench_open", 1), "legs": legs}).where(F.col("n") == size)
    shares = F.when(F.col("volume") > 0, F.col("split_adjusted_volume") / F.col("volume")).otherwise(1.0)
    sound = lambda g: (g["x"] > 0) & (F.col("entry") > 0) & (g["b"] > 0) & (F.col("bench_entry") > 0)
    alpha = lambda g: F.when(sound(g), F.ln(g["x"] / F.col("entry")) - F.ln(g["b"] / F.col("bench_entry")))
    return held.select(
        "symbol", "ts", "idx",
        F.transform("w", lambda x: ratio(x["adjusted_close"], F.col("adjusted_close")) * F.col("close")).alias("closes"),
        F.transform("w", lambda x: x["split_adjusted_volume"] / shares).alias("volumes"),
        F.transform("w", lambda x: ratio(x["bench"], F.col("bench")) * F.col("bench_raw")).alias("bench_closes"),
        F.transform("w", lambda x: F.struct(F.weekday(x["ts"]).alias("weekday"), F.dayofmonth(x["ts"]).alias("day"), F.month(x["ts"]).alias("month"))).alias("times"),
        F.transform("legs", alpha).alias("targets"),
        F.transform("legs", lambda g: alpha(g).isNotNull()).alias("valid"),
        F.transform("legs", lambda g: g["end_at"]).alias("end_at"),
    )


def gather(sample: DataFrame, arrays: DataFrame) -> DataFrame:
    """E5: the arrays of sampled cutoffs; a cutoff that is asked for twice comes twice."""
    return sample.join(arrays, ["symbol", "idx"])


def targets_of(sample: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of sampled cutoffs alone; contexts are never read."""
    return sample.select("symbol", "ts", "ordinal").join(labels.select("symbol", "ts", "h", "alpha"), ["symbol", "ts"])


def past_only(cutoffs: DataFrame, least: int = 61) -> DataFrame:
    """Cutoffs with enough history for the scale features; labels play no part."""
    return cutoffs.where(F.col("idx") >= least - 1).select("symbol", "ts", "idx")


def resumed(batches: DataFrame, done: int) -> DataFrame:
    """The batches that are left after so many."""
    return batches.where(F.col("batch") >= done)


def cursor_batches(placed: DataFrame, count: int, size: int, evaluations: int, cursor: int = 0) -> DataFrame:
    """Batches of places from a cursor on that never cross a boundary, one at every count * i / evaluations rounded up."""
    bounds = sorted({-(-count * i // evaluations) for i in range(1, evaluations + 1)} | {cursor})
    starts = F.array(*[F.lit(b) for b in [cursor, *bounds] if b >= cursor])
    start = F.array_max(F.filter(starts, lambda b: b <= F.col("place")))
    made = placed.where(F.col("place") >= cursor).withColumn("section", start)
    return made.withColumn("batch_in_section", F.floor((F.col("place") - F.col("section")) / size))


def padded(rows: DataFrame, values: str, filler: float = 0.0) -> DataFrame:
    """Arrays filled up on the right to the longest one, with their lengths and masks."""
    longest = rows.agg(F.max(F.size(values)).alias("longest"))
    both = rows.crossJoin(F.broadcast(longest)).withColumn("length", F.size(values))  # one row
    mask = F.transform(F.sequence(F.lit(1), F.col("longest")), lambda i: i <= F.col("length"))
    filled = F.concat(values, F.array_repeat(F.lit(filler), F.col("longest") - F.col("length")))
    return both.withColumn("mask", mask).withColumn(values, filled).drop("longest")


def joined_batches(parts: list[DataFrame]) -> DataFrame:
    """Batches as one; other columns, and so other horizons, are an error at once."""
    if len({tuple(p.columns) for p in parts}) != 1:
        raise ValueError("the batches have not the same columns")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pooled(rows: DataFrame, key: str, place: str, value: str, valid: str) -> DataFrame:
    """The mean and the last of the valid values of a key."""
    return rows.groupBy(key).agg(F.avg(F.when(F.col(valid), F.col(value))).alias("mean"), F.max_by(value, F.when(F.col(valid), F.col(place))).alias("last"))


def set_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Cutoffs, symbols, dates, first and last date of a set."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("ts").alias("dates"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def near_best(rows: DataFrame, group: str, size: str, rate: str, share: float = 0.03) -> DataFrame:
    """I8: by group the smallest size whose rate is within a share of the best."""
    best = F.max(rate).over(Window.partitionBy(group))
    return rows.withColumn("best", best).where(F.col(rate) >= (1 - share) * F.col("best")).groupBy(group).agg(F.min(size).alias("size"), F.max("best").alias("best"))


def aligned_steps(a: Column, b: Column) -> Column:
    """Two schedules of the same length, step by step."""
    return F.arrays_zip(a.alias("canonical"), b.alias("runtime"))
