"""Rule forecasts and their evaluation (G, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles

QUANTILES = (0.1, 0.5, 0.9)
NAMES = ("q10", "q50", "q90")


def bought(train: DataFrame, scales: DataFrame) -> DataFrame:
    """G1: by horizon m, what always_buy forecasts: the training median, a quarter of the scale at least."""
    mid = quantiles.exact(train, ["h"], "alpha", (0.5,)).select("h", F.col("q")[0].alias("m"))
    return mid.join(scales.select("h", "scale"), "h").select("h", F.greatest("m", 0.25 * F.col("scale")).alias("m"))


def rule_medians(signals: DataFrame, always: DataFrame) -> DataFrame:
    """G1: by cutoff, horizon and rule the central forecast: always_buy, zero, or momentum by h / 5. `always` has (h, m)."""
    made = {"always_buy": F.col("m"), "zero": F.lit(0.0), "momentum": F.col("mom") * F.col("h") / 5}
    return _each_rule(signals, always, made)


def _each_rule(signals: DataFrame, always: DataFrame, made: dict) -> DataFrame:
    """Only always_buy needs `always`: horizons without training labels have the other rules alone."""
    placed = signals.join(F.broadcast(always.withColumn("fitted", F.lit(True))), "h", "left")  # a row a horizon
    rows = [F.struct(F.lit(rule).alias("rule"), q.cast("double").alias("q50")) for rule, q in made.items() if rule != "always_buy"]
    bought = F.struct(F.lit("always_buy").alias("rule"), made["always_buy"].cast("double").alias("q50"))
    each = F.explode(F.array_compact(F.array(F.when(F.col("fitted"), bought), *rows))).alias("x")
    return placed.select("symbol", "ts", "h", "alpha", each).select("symbol", "ts", "h", "alpha", "x.rule", "x.q50")


def offsets(medians: DataFrame) -> DataFrame:
    """By rule and horizon n and r, the quantiles of the residuals of (training) rows."""
    rows = medians.select("rule", "h", (F.col("alpha") - F.col("q50")).alias("x"))
    return quantiles.exact(rows, ["rule", "h"], "x", QUANTILES).withColumnRenamed("q", "r")


def calibrated(medians: DataFrame, resid: DataFrame) -> DataFrame:
    """The residuals' quantiles, added to each central forecast and put in order."""
    made = medians.join(F.broadcast(resid.select("rule", "h", "r")), ["rule", "h"])  # a row a rule and horizon
    spread = F.array_sort(F.array(*[F.col("q50") + F.col("r")[i] for i in range(3)]))
    return made.select("rule", "symbol", "ts", "h", "alpha", *[spread[i].alias(n) for i, n in enumerate(NAMES)])


def pinball(truth: str = "alpha") -> F.Column:
    """H1 for one row: the mean over the quantiles."""
    parts = [F.greatest(q * (F.col(truth) - F.col(n)), (q - 1) * (F.col(truth) - F.col(n))) for q, n in zip(QUANTILES, NAMES, strict=True)]
    return (parts[0] + parts[1] + parts[2]) / 3


def correlation(x: F.Column, y: F.Column) -> F.Column:
    """H4: from sums, zero for a constant, within one."""
    return _correlation(F.count(x * y), *(F.sum(v) for v in (x, y, x * x, y * y, x * y)))


def _correlation(n, sx, sy, sxx, syy, sxy) -> F.Column:
    below = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(below <= 1e-20, 0.0).otherwise(F.greatest(F.least(F.try_divide(n * sxy - sx * sy, F.sqrt(below)), F.lit(1.0)), F.lit(-1.0)))


def partial_sums() -> dict[str, F.Column]:
    """H4: what of a set of predictions its metrics are made of; the sums of two sets are those of both."""
    a, q = F.col("alpha"), F.col("q50")
    hit, same = F.col("alpha").between(F.col("q10"), F.col("q90")), F.signum(F.round("alpha", 9)) == F.signum(F.round("q50", 9))
    of_row = {"pin": pinball(), "norm": pinball() / F.col("scale"), "gap": F.abs(a - q), "x": a, "y": q, "xx": a * a, "yy": q * q, "xy": a * q, "same": same.cast("double"), "hit": hit.cast("double"), "wide": F.col("q90") - F.col("q10")}
    return {"n": F.count("*")} | {name: F.sum(value) for name, value in of_row.items()}


def metrics_of(total=F.col) -> dict[str, F.Column]:
    """H2 from the sums, which `total` gives by name."""
    n = total("n")
    mean = lambda name: total(name) / n
    corr = _correlation(n, *(total(name) for name in ("x", "y", "xx", "yy", "xy")))
    return {"n": n, "pinball": mean("pin"), "norm_pinball": mean("norm"), "mae": mean("gap"), "corr": corr, "sign": mean("same"), "coverage": mean("hit"), "width": mean("wide"), "coverage_error": F.abs(mean("hit") - 0.8)}


def by_horizon(predictions: DataFrame, *keys: str) -> DataFrame:
    """H2: one pass of sums by horizon, which partial aggregation takes."""
    sums = predictions.groupBy(*keys, "h").agg(*[s.alias(n) for n, s in partial_sums().items()])
    return sums.select(*keys, "h", *[c.alias(n) for n, c in metrics_of().items()])


def over_horizons(per_h: DataFrame, *keys: str) -> DataFrame:
    """H3: unweighted means of the horizons; the selection score is the mean normalised pinball."""
    names = [c for c in per_h.columns if c not in (*keys, "h", "n")]
    return per_h.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names]).withColumn("selection_score", F.col("norm_pinball"))


def daily(predictions: DataFrame, *keys: str) -> DataFrame:
    """H8."""
    return predictions.groupBy(*keys, "ts").agg(F.avg(pinball() / F.col("scale")).alias("loss"), F.count("*").alias("n"))


def subgroups(predictions: DataFrame) -> DataFrame:
    """Totals by horizon, and by horizon with symbol, month or year, in one pass of grouping sets."""
    seen = predictions.select("h", "symbol", F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy").alias("year"), "alpha", "q10", "q50", "q90", "scale")
    sets = [["h"], ["h", "symbol"], ["h", "month"], ["h", "year"]]
    return seen.groupingSets([[F.col(c) for c in s] for s in sets], "h", "symbol", "month", "year").agg(F.count("*").alias("n"), F.avg(pinball() / F.col("scale")).alias("norm_pinball"))


def signals(predictions: DataFrame, threshold: float) -> DataFrame:
    """Five levels, strongest rule first, counted."""
    level = F.when(F.col("q10") > threshold, 4).when(F.col("q50") > threshold, 3).when(F.col("q90") < -threshold, 0).when(F.col("q50") < -threshold, 1).otherwise(2)
    return predictions.withColumn("level", level).groupBy("h", "level").agg(F.count("*").alias("n"))


def ranked(cross: DataFrame, *keys: str) -> DataFrame:
    """H5: ordinal ranks of truth and signal on each date of the keys; ties by symbol."""
    day = Window.partitionBy(*keys, "ts")
    rank = lambda c: F.row_number().over(day.orderBy(c, "symbol")).cast("double")
    return cross.withColumn("ry", rank("alpha")).withColumn("rs", rank("q50")).withColumn("n", F.count("*").over(day))


def rank_ic(cross: DataFrame, *keys: str) -> DataFrame:
    """H5: correlation of ranks on dates with three rows or more whose signal differs."""
    made = ranked(cross, *keys).where("n >= 3").groupBy(*keys, "ts").agg(F.count("*").alias("n"), (F.max("q50") > F.min("q50")).alias("varies"), correlation(F.col("ry"), F.col("rs")).alias("ic"))
    return made.where("varies").select(*keys, "ts", "n", "ic")


def long_short(cross: DataFrame, *keys: str, cost_bps: float = 10.0) -> DataFrame:
    """H6: by keys and date returns of the last fifth less the first by signal, and turnover against the date before it."""
    r = ranked(cross, *keys).where("n >= 3").withColumn("bucket", F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    side = F.when(F.col("rs") > F.col("n") - F.col("bucket"), 1).when(F.col("rs") <= F.col("bucket"), -1)
    held = r.withColumn("side", side).where("side is not null").withColumn("weight", F.col("side") * 0.5 / F.col("bucket"))
    days = Window.partitionBy(*keys).orderBy("ts")  # a row a date
    dates = held.groupBy(*keys, "ts").agg((F.avg(F.when(F.col("side") == 1, F.col("alpha"))) - F.avg(F.when(F.col("side") == -1, F.col("alpha")))).alias("gross")).withColumn("before", F.lag("ts").over(days)).withColumn("after", F.lead("ts").over(days))
    own = Window.partitionBy(*keys, "symbol").orderBy("ts")
    placed = held.select(*keys, "ts", "symbol", "weight").join(dates, [*keys, "ts"])
    old = F.when(F.lag("ts").over(own) == F.col("before"), F.lag("weight").over(own)).otherwise(0.0)
    stays = F.coalesce(F.lead("ts").over(own) == F.col("after"), F.lit(False))
    # a position changes on its own date, and if it isn't held on the next one, it is closed there
    moved = placed.select(*keys, "ts", "gross", F.abs(F.col("weight") - old).alias("now"), F.when(~stays, F.col("after")).alias("closed_at"), F.abs("weight").alias("closed"))
    moves = moved.select(*keys, F.explode(F.array(F.struct("ts", "gross", F.col("now").alias("x")), F.struct(F.col("closed_at").alias("ts"), F.lit(None).cast("double").alias("gross"), F.col("closed").alias("x")))).alias("m")).where("m.ts is not null")
    made = moves.groupBy(*keys, "m.ts").agg(F.max("m.gross").alias("gross"), F.sum("m.x").alias("turnover"))
    return made.select(*keys, "ts", "gross", "turnover", (F.col("gross") - F.col("turnover") * cost_bps / 10000).alias("net"))


def portfolio(days: DataFrame, ic: DataFrame, *keys: str, horizon: str = "h") -> DataFrame:
    """H7: by keys, of which one is the horizon: mean return, Sharpe ratio of a year, deepest drawdown, mean turnover, mean IC and its ratio."""
    w = Window.partitionBy(*keys).orderBy("ts")  # a row a date
    wealth = days.withColumn("wealth", F.exp(F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    fall = wealth.withColumn("fall", F.col("wealth") / F.greatest(F.max("wealth").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)) - 1)
    spread = F.stddev_samp("net")
    out = fall.groupBy(*keys).agg(F.count("*").alias("dates"), F.avg("net").alias("mean_return"), F.when(spread > 0, F.try_divide(F.avg("net"), spread)).otherwise(0.0).alias("ratio"), F.least(F.min("fall"), F.lit(0.0)).alias("max_drawdown"), F.avg("turnover").alias("turnover"))
    dev = F.stddev_samp("ic")
    ics = ic.groupBy(*keys).agg(F.avg("ic").alias("ic_mean"), F.when(dev > 0, F.try_divide(F.avg("ic"), dev)).otherwise(0.0).alias("ic_ratio"))
    return out.withColumn("sharpe", F.col("ratio") * F.sqrt(252.0 / F.col(horizon))).drop("ratio").join(ics, [*keys], "left")


def paired(candidates: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """H9: by candidate the mean daily difference over the dates that both have, and how many only one has."""
    marks = reference.select("ts", F.col("loss").alias("b"))
    n = reference.agg(F.count("*").alias("n"))
    both = candidates.join(marks, "ts", "left").groupBy(key).agg(F.avg(F.col("loss") - F.col("b")).alias("difference"), F.count("b").alias("dates"), F.count("*").alias("own"))
    return both.crossJoin(F.broadcast(n)).select(key, "difference", "dates", (F.col("own") + F.col("n") - 2 * F.col("dates")).alias("unmatched"))  # one row


def block_intervals(differences: DataFrame, key: str, block: int = 14, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """H9: by key the 2.5 and 97.5 percent points of a circular moving-block bootstrap over its dates.

    Each round draws its blocks by hashes of seed, round and block, and is a row for each of its dates;
    with fewer than two blocks of dates a key has no interval.
    """
    numbered = differences.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("ts")) - 1)  # a row a date
    sizes = differences.groupBy(key).agg(F.count("*").alias("n"))
    drawn = sizes.where(F.col("n") >= 2 * block).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1)))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    placed = drawn.select(key, "n", "round", "b", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j")).where(F.col("b") * block + F.col("j") < F.col("n"))
    taken = placed.select(key, "round", ((F.col("start") + F.col("j")) % F.col("n")).cast("int").alias("at")).join(numbered.select(key, "at", "difference"), [key, "at"])
    found = taken.groupBy(key, "round").agg(F.avg("difference").alias("mean")).groupBy(key).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return sizes.join(found, key, "left").select(key, F.col("n").alias("dates"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def membership(predictions: DataFrame) -> DataFrame:
    """By month a digest of its (symbol, date) pairs in order, their count and first and last date.

    The dates of a symbol and month are digested first, and then the symbols' digests, so no task
    holds the pairs of a month.
    """
    pairs = predictions.select("symbol", "ts").distinct().withColumn("month", F.date_format("ts", "yyyy-MM"))
    days = F.array_join(F.transform(F.array_sort(F.collect_list("ts")), lambda x: x.cast("string")), ",")
    of_symbol = pairs.groupBy("month", "symbol").agg(F.sha2(days, 256).alias("d"), F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "d"))), lambda x: F.concat_ws(",", x["symbol"], x["d"])), ";")
    return of_symbol.groupBy("month").agg(F.sha2(text, 256).alias("digest"), F.sum("n").alias("samples"), F.min("a").alias("first_at"), F.max("b").alias("last_at"))


def same_membership(predictions: DataFrame, model: str = "rule") -> DataFrame:
    """One row: how many models there are, how many different memberships they have, and how many horizons with more than one scale."""
    days = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "ts"))), lambda x: F.concat_ws(" ", x["h"].cast("string"), x["ts"].cast("string"))), ",")
    of_symbol = predictions.groupBy(model, "symbol").agg(F.sha2(days, 256).alias("d"))
    of_model = of_symbol.groupBy(model).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "d"))), lambda x: F.concat_ws(",", x["symbol"], x["d"])), ";"), 256).alias("digest"))
    scales = predictions.groupBy("h").agg(F.count_distinct("scale").alias("n")).agg(F.count_if(F.col("n") > 1).alias("unequal_scales"))
    return of_model.agg(F.count("*").alias("models"), F.count_distinct("digest").alias("memberships")).crossJoin(scales)  # one row each


def masked_loss(predictions: DataFrame, *keys: str) -> DataFrame:
    """The mean normalised pinball loss over all levels of the rows whose truth is known."""
    known = F.col("alpha").isNotNull() & ~F.isnan("alpha")
    return predictions.groupBy(*keys).agg(F.coalesce(F.avg(F.when(known, pinball() / F.col("scale"))), F.lit(0.0)).alias("loss"), F.count_if(known).alias("valid"))


def flattened(metrics: DataFrame, *keys: str) -> DataFrame:
    """A row for each number, by its path: keys and name with slashes."""
    names = [c for c in metrics.columns if c not in keys]
    pairs = F.explode(F.array(*[F.struct(F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.lit(n)).alias("path"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")
    return metrics.select(pairs).select("x.*")


def unflattened(paths: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """The rows that `flattened` had; two values of one path are an error when it is read."""
    parts = F.split("path", "/")
    cut = paths.select(*[parts[i].alias(k) for i, k in enumerate(keys)], parts[len(keys)].alias("name"), "value")
    one = lambda n: F.when(F.count_if(F.col("name") == n) > 1, F.raise_error(F.lit("a path has two values"))).otherwise(F.max(F.when(F.col("name") == n, F.col("value")))).cast("double")
    return cut.groupBy(*keys).agg(*[one(n).alias(n) for n in names])


def median_metric(paths: DataFrame) -> DataFrame:
    """By name the median of its finite values over all paths, and how many there are."""
    name = F.element_at(F.split("path", "/"), -1)
    finite = F.when(~F.isnan("value") & (F.abs(F.col("value")) != float("inf")), F.col("value"))
    return paths.groupBy(name.alias("name")).agg(F.count(finite).alias("n"), F.median(finite).alias("median"))


def all_rules(signals: DataFrame, always: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """G1 with every rule: always_buy, zero_return, and each named signal by h / 5. `always` has (h, m)."""
    made = {"always_buy": F.col("m"), "zero_return": F.lit(0.0)} | {n: F.col(n) * F.col("h") / 5 for n in names}
    return _each_rule(signals, always, made)


def rule_models(medians: DataFrame) -> DataFrame:
    """By rule and horizon the training residuals' quantiles, which make the rule a model; no sorting of rows by hand."""
    return offsets(medians).select("rule", "h", "n", *[F.col("r")[i].alias(f"offset_{q}") for i, q in enumerate(NAMES)])


def pair_losses(cross: DataFrame, *keys: str, most: int, margin: float = 0.01) -> DataFrame:
    """By keys and date, pairs of symbols whose scaled truths differ enough.

    The loss is defined on a sample: `most` symbols of a date, those with the smallest hashes. It is a
    parameter of what is computed, without a default; a date with fewer symbols is taken whole.
    """
    day = Window.partitionBy(*keys, "ts").orderBy(F.md5("symbol"), "symbol")
    chosen = cross.withColumn("__at", F.row_number().over(day)).where(F.col("__at") <= most)
    a = chosen.select(*keys, "ts", "scale", *[F.col(c).alias(f"{c}_a") for c in ("symbol", "alpha", "q50")])
    b = chosen.select(*keys, "ts", *[F.col(c).alias(f"{c}_b") for c in ("symbol", "alpha", "q50")])
    pairs = a.join(b, [*keys, "ts"]).where("symbol_a < symbol_b")
    gap = (F.col("alpha_a") - F.col("alpha_b")) / F.col("scale")
    loss = F.ln(1 + F.exp(-F.signum(gap) * (F.col("q50_a") - F.col("q50_b")) / F.col("scale")))
    return pairs.where(F.abs(gap) > margin).groupBy(*keys, "ts").agg(F.count("*").alias("pairs"), F.avg(loss).alias("loss"))


def regression(rows: DataFrame, truth: str, prediction: str, *keys: str) -> DataFrame:
    """Mean absolute error, root mean square error, and r2 (null for a constant truth)."""
    e = F.col(truth) - F.col(prediction)
    return rows.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(F.max(truth) > F.min(truth), 1 - F.try_divide(F.avg(e * e), F.var_pop(truth))).alias("r2"))


def comparison(scores: DataFrame) -> DataFrame:
    """Scores of several runs by model: count, median, least, most; ranked by the median."""
    made = scores.groupBy("model").agg(F.count("score").alias("runs"), F.median("score").alias("median"), F.min("score").alias("least"), F.max("score").alias("most"))
    return made.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("median"), "model")))  # a row a model


def output_scales(signals: DataFrame, scales: DataFrame) -> DataFrame:
    """By horizon the relative volatility of so many days, between a tenth and ten times the robust scale."""
    both = signals.select("symbol", "ts", "relvol").crossJoin(F.broadcast(scales))  # a row a horizon
    return both.select("symbol", "ts", "h", F.least(F.greatest(F.col("relvol") * F.sqrt("h"), 0.1 * F.col("scale")), 10 * F.col("scale")).alias("anchor"))


def codes(rows: DataFrame) -> DataFrame:
    """Dense numbers of dates and of symbols, in their order; the lists of both are small."""
    dates = rows.select("ts").distinct().withColumn("group_code", F.row_number().over(Window.orderBy("ts")) - 1)
    names = rows.select("symbol").distinct().withColumn("security_code", F.row_number().over(Window.orderBy("symbol")) - 1)
    return rows.select("symbol", "ts").join(dates, "ts").join(names, "symbol")


def forecast_payload(predictions: DataFrame, *keys: str) -> DataFrame:
    """By the keys one JSON text of the horizons' quantiles, in four digits."""
    one = F.format_string('{"h":%d,"q10":%.4f,"q50":%.4f,"q90":%.4f}', F.col("h"), *[F.round(n, 4) + 0.0 for n in NAMES])
    by_h = F.transform(F.array_sort(F.collect_list(F.struct(F.col("h"), one.alias("text")))), lambda x: x["text"])
    return predictions.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(by_h, ","), F.lit("]")).alias("forecast"), F.count("*").alias("horizons"))
