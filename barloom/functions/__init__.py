"""Column functions for vendor payloads, dates and schedules (K, P)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that vendors write for a missing number.
MISSING = ("", "--", "---", "N/A", "nan", "None")
#: The forms of the exchanges' codes of stocks.
LISTED_STOCK, COUNTER_STOCK = "^(?:[1-9][0-9]{3}|91[0-9]{4})[.]TW$", "^[1-9][0-9]{3}[.]TWO$"


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles by IEEE 754: a zero divisor gives an infinity or NaN, and no error. Factors of a thousand
    splits and more leave the range of a double, so adjusted closes may be zero and adjusted volumes infinite."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def log(x: Column) -> Column:
    """The natural logarithm, with minus infinity for zero; null below it."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def rounded(x: Column, digits: int) -> Column:
    """x in so many decimal places, as DuckDB has it: scaled, rounded and divided in doubles, which from 2^53 on differs from decimals."""
    made = F.round(x * 10.0**digits, 0) / 10.0**digits
    return F.when(F.isnan(made) | (F.abs(made) == float("inf")), x).otherwise(made)


def lenient_number(text: Column) -> Column:
    """K3: commas and plus signs are dropped; texts for a missing number and what is none give null."""
    plain = F.trim(F.regexp_replace(text, "[,+]", ""))
    return F.when(~plain.isin(*MISSING), plain.try_cast("double"))


def minguo_date(text: Column) -> Column:
    """K4: 6 or 7 digits with years from 1911, 8 digits, the same with slashes or year, month and day signs."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.trim(text), "[年月]", "/"), "日", ""), "/")
    digits = F.trim(text)
    n = F.length(digits)
    plain = digits.rlike("^[0-9]{6,8}$")
    cut = lambda a, b: F.substring(digits, a, b).try_cast("int")
    year = F.when(plain & (n == 6), cut(1, 2) + 1911).when(plain & (n == 7), cut(1, 3) + 1911).when(plain, cut(1, 4)).when(F.size(parts) == 3, F.when(F.length(F.get(parts, F.lit(0))) <= 3, F.get(parts, F.lit(0)).try_cast("int") + 1911).otherwise(F.get(parts, F.lit(0)).try_cast("int")))
    month = F.when(plain, F.substring(digits, n - 3, F.lit(2)).try_cast("int")).otherwise(F.get(parts, F.lit(1)).try_cast("int"))
    day = F.when(plain, F.substring(digits, n - 1, F.lit(2)).try_cast("int")).otherwise(F.get(parts, F.lit(2)).try_cast("int"))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def split_ratio(text: Column) -> Column:
    """`new/old` or `new:old` as price_factor and share_multiplier; null unless both are over zero."""
    parts = F.split(F.regexp_replace(text, ":", "/"), "/")
    new, old = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    good = (F.size(parts) == 2) & (new > 0) & (old > 0)
    return F.when(good, F.struct(F.try_divide(old, new).alias("price_factor"), F.try_divide(new, old).alias("share_multiplier")))


def training_scope(symbol: Column, asset_type: Column, market: Column) -> Column:
    """B5 without the fund lists: which stocks are training targets, by market and symbol form."""
    stock = (
        F.when(market == "US", symbol.endswith(".US") & (F.length(symbol) > 3))
        .when(market == "TWSE", symbol.rlike(LISTED_STOCK))
        .when(market == "TPEX", symbol.rlike(COUNTER_STOCK))
        .otherwise(F.lit(False))
    )
    return (asset_type == "stock") & stock


def benchmark_of(symbol: Column, asset_type: Column, market: Column, explicit: Column) -> Column:
    """Benchmark, eligible and reason, by the first rule that applies."""
    out = lambda b, ok, why: F.struct(b.alias("benchmark"), F.lit(ok).alias("eligible"), F.lit(why).alias("reason"))
    none = F.lit(None).cast("string")
    of_market = F.when(market == "US", "VTI.US").when(market == "TWSE", "TAIEX.TW").when(market == "TPEX", "TPEX.TWO")
    return (
        F.when(asset_type == "index", out(none, False, "index"))
        .when(~asset_type.isin("stock", "etf"), out(none, False, "unsupported_type"))
        .when((asset_type == "stock") & ~training_scope(symbol, asset_type, market), out(none, False, "out_of_scope"))
        .when(explicit.isNotNull() & (explicit == symbol), out(explicit, False, "benchmark_self"))
        .when(explicit.isNotNull(), out(explicit, True, "explicit"))
        .when(of_market.isNull(), out(none, False, "unmapped"))
        .when(of_market == symbol, out(of_market, False, "benchmark_self"))
        .otherwise(out(of_market, True, "market"))
    )


def even_steps(start: int, steps: int, count: int) -> Column:
    """`count` evenly spaced steps, the last at start + steps."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: (start + F.ceil(i * steps / count)).cast("long"))


def early_stop(values: Column, patience: int, least_gain: float) -> Column:
    """Best value, its place, and the place at which the fold stops, for values that shall fall."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).alias("at"), F.lit(0).alias("stale"), F.lit(-1).alias("stopped"), F.lit(0).alias("i"))

    def step(s, x):
        better = x < s["best"] - least_gain
        stale = F.when(better, 0).otherwise(s["stale"] + 1)
        moved = F.struct(F.when(better, x).otherwise(s["best"]).alias("best"), F.when(better, s["i"]).otherwise(s["at"]).alias("at"), stale.alias("stale"), F.when(stale >= patience, s["i"]).otherwise(-1).alias("stopped"), (s["i"] + 1).alias("i"))
        return F.when(s["stopped"] >= 0, s).otherwise(moved)

    return F.aggregate(values, start, step)


def warm_cosine(step: Column, warm: int, total: int) -> Column:
    """P5: a linear rise and then half a cosine."""
    import math

    part = F.least(F.lit(1.0), (step - warm) / float(max(1, total - warm)))
    return F.when(step < warm, step / float(max(1, warm))).otherwise(0.5 * (1 + F.cos(part * math.pi)))


def plateau_rate(values: Column, patience: int = 2, cut: float = 0.3, floor: float = 0.09) -> Column:
    """The learning-rate factor after each value, cut when `patience` values have brought no new least."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("stale"), F.lit(1.0).alias("rate"), F.array().cast("array<double>").alias("rates"))

    def step(s, x):
        better = x < s["best"]
        stale = F.when(better, 0).otherwise(s["stale"] + 1)
        due = stale >= patience
        rate = F.when(due, F.greatest(s["rate"] * cut, F.lit(floor))).otherwise(s["rate"])
        return F.struct(F.least(s["best"], x).alias("best"), F.when(due, 0).otherwise(stale).alias("stale"), rate.alias("rate"), F.concat(s["rates"], F.array(rate)).alias("rates"))

    return F.aggregate(values, start, step)["rates"]


def months(first: Column, last: Column) -> Column:
    """K6: the first and last day of every month from one date to another."""
    days = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.transform(days, lambda d: F.struct(d.cast("date").alias("first_day"), F.last_day(d).alias("last_day")))


def powers_of_two(most: Column) -> Column:
    """The powers of two up to a number."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.log2(most)).cast("int")), lambda i: F.pow(F.lit(2), i).cast("long"))
