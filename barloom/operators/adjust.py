"""Corporate actions, execution returns and labels (C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from . import quantiles

TINY = 1e-12


def merge_actions(actions: DataFrame) -> DataFrame:
    """One action for each symbol and day: products of the factors, distinct sources joined by +."""
    good = actions.where("price_factor > 0 and share_multiplier > 0 and trim(symbol) <> ''")
    return good.groupBy(F.upper(F.trim("symbol")).alias("symbol"), "ts").agg(F.product("price_factor").alias("price_factor"), F.product("share_multiplier").alias("share_multiplier"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"))


def back_adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """A bar's prices and volume take the factors of all later actions of its symbol.

    Actions and bars are one sequence, walked back in time; of a day the bar comes before the
    action, so an action never touches its own day. One sort by symbol, no range join.
    """
    both = bars.withColumn("action", F.lit(0)).withColumn("pf", F.lit(1.0)).withColumn("sm", F.lit(1.0))
    events = merge_actions(actions).select("symbol", "ts", F.lit(1).alias("action"), F.col("price_factor").alias("pf"), F.col("share_multiplier").alias("sm"))
    later = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.asc("action")).rowsBetween(Window.unboundedPreceding, 0)
    walked = both.unionByName(events, allowMissingColumns=True).withColumn("price_cum", F.product("pf").over(later)).withColumn("share_cum", F.product("sm").over(later))
    out = walked.where("action = 0").drop("action", "pf", "sm")
    return out.withColumn("adjusted_close", F.col("close") * F.col("price_cum")).withColumn("split_adjusted_volume", F.col("volume") * F.col("share_cum")).drop("price_cum", "share_cum")


def walked_back(bars: DataFrame) -> DataFrame:
    """C3 where all actions are on days with bars, which hold their factors pf and sm: no union, and no shuffle but that by symbol."""
    later = Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    after = lambda c: F.coalesce(F.product(c).over(later), F.lit(1.0))
    return bars.withColumns({"adjusted_close": F.col("close") * after("pf"), "split_adjusted_volume": F.col("volume") * after("sm")}).drop("pf", "sm")


def ensure_anchors(bars: DataFrame) -> DataFrame:
    """Where the adjusted columns are missing, the raw ones."""
    for name, raw in (("adjusted_close", "close"), ("split_adjusted_volume", "volume")):
        if name not in bars.columns:
            bars = bars.withColumn(name, F.col(raw))
    return bars


def factors(bars: DataFrame) -> DataFrame:
    """C4: p and v, a bar's price and volume factors; window values are rescaled by those of the cutoff."""
    price = F.col("adjusted_close") / F.greatest("close", F.lit(TINY))
    volume = F.when(F.col("volume") > 0, F.try_divide("split_adjusted_volume", "volume")).otherwise(1.0)
    return bars.withColumn("p", price).withColumn("v", volume)


def asof_windows(bars: DataFrame, size: int) -> DataFrame:
    """C4: the last `size` bars up to each bar, adjusted as of it: an array of (ts, close, volume), and the bar's own volume factor."""
    over = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - size, 0)
    held = factors(bars).withColumn("held", F.collect_list(F.struct("ts", F.col("adjusted_close").alias("c"), F.col("split_adjusted_volume").alias("n"))).over(over)).where(F.size("held") == size)
    return held.select("symbol", "ts", F.transform("held", lambda x: F.struct(x["ts"].alias("ts"), ratio(x["c"], F.col("p")).alias("close"), ratio(x["n"], F.col("v")).alias("volume"))).alias("window"), F.col("v").alias("volume_factor"))


def execution_returns(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Bought at the next bar's open, sold at the close `h` bars on, both adjusted: gross return."""
    later = Window.partitionBy("symbol").orderBy("ts")
    entry = F.lead(F.col("open") * F.col("adjusted_close") / F.greatest("close", F.lit(TINY)), 1).over(later)
    legs = [F.struct(F.lit(h).alias("h"), F.lead("adjusted_close", h).over(later).alias("exit"), F.lead("ts", h).over(later).alias("end_at")) for h in horizons]
    made = bars.select("symbol", "ts", entry.alias("entry"), F.array(*legs).alias("legs")).select("symbol", "ts", "entry", F.explode("legs").alias("x"))
    return made.where("x.exit is not null and entry is not null").select("symbol", "ts", "x.h", "x.end_at", (F.col("x.exit") / F.greatest("entry", F.lit(TINY))).alias("gross"))


def alphas(bars: DataFrame, benchmark: str | DataFrame, horizons: list[int], also: dict[str, Column] | None = None) -> DataFrame:
    """Log gross return less that of the benchmark on the asset's own dates.

    The benchmark is joined by date before the leads, so its bars are those of the asset's calendar;
    a label whose first or last date the benchmark lacks is left out. `also` are columns of the same chain of
    windows, made of the asset's columns and of b_open and b_close; they come before alpha.
    """
    from .marks import marked

    own = marked(bars, benchmark, {"b_open": F.col("open") * F.col("adjusted_close") / F.greatest("close", F.lit(TINY)), "b_close": F.col("adjusted_close")})
    w = Window.partitionBy("symbol").orderBy("ts")
    entry = F.col("open") * F.col("adjusted_close") / F.greatest("close", F.lit(TINY))
    legs = [F.struct(F.lit(h).alias("h"), F.lead("adjusted_close", h).over(w).alias("exit"), F.lead("b_close", h).over(w).alias("b_exit"), F.lead("ts", h).over(w).alias("end_at")) for h in horizons]
    made = own.select("symbol", "ts", F.lead(entry, 1).over(w).alias("entry"), F.lead("b_open", 1).over(w).alias("b_entry"), F.array(*legs).alias("legs"), *[c.alias(n) for n, c in (also or {}).items()]).withColumn("x", F.explode("legs"))
    good = made.where("x.exit > 0 and entry > 0 and x.b_exit > 0 and b_entry > 0")
    return good.select("symbol", "ts", "x.h", "x.end_at", *(also or {}), (F.ln(F.col("x.exit") / F.col("entry")) - F.ln(F.col("x.b_exit") / F.col("b_entry"))).alias("alpha"))


def robust_scales(labels: DataFrame, floor: float = 1e-4) -> DataFrame:
    """By horizon the larger of quartile distance, scaled median deviation and a floor; four labels at least."""
    mid = quantiles.exact(labels, ["h"], "alpha", (0.25, 0.5, 0.75))
    away = labels.join(F.broadcast(mid.select("h", F.col("q")[1].alias("__m"))), "h").select("h", F.abs(F.col("alpha") - F.col("__m")).alias("x"))  # a row a horizon
    spread = quantiles.exact(away, ["h"], "x", (0.5,)).select("h", F.col("q")[0].alias("mad"))
    return mid.join(spread, "h").where("n >= 4").select("h", "n", F.greatest(F.col("q")[2] - F.col("q")[0], 1.4826 * F.col("mad"), F.lit(floor)).alias("scale"))
