"""Queries of features, rules, losses and comparisons (F, G, H)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import adjust, features, metrics
from . import market as m
from .catalogue import EMA, METRICS, NAMED, SIGNALS, query
from .oracle import BARS, FEATURES, LABELS, PREDICTIONS, RSI, SCALES, r

# features


@query(
    f"""
WITH {BARS}, w AS (SELECT symbol, ts, adjusted_close AS z, list(adjusted_close) OVER y AS c, list(ln(1 + split_adjusted_volume)) OVER y AS n FROM adj WINDOW y AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol, ts, round(list_sum(list_transform(c, lambda x: ln(greatest(x, 1e-12) / z))), 5) + 0 AS closes, round((n[20] - list_avg(n)) / greatest(list_stddev_pop(n), 1e-6), 3) + 0 AS last_volume FROM w WHERE len(c) = 20 AND list_stddev_pop(n) > 1e-4""",
    digits=None,
)
def f8_relative_sequence(spark, folder):
    made = features.relative_windows(m.bars(spark, folder), 20, floored=True)
    spread = F.aggregate("volumes", F.lit(0.0), lambda s, x: s + x * x)
    total = F.aggregate("closes", F.lit(0.0), lambda s, x: s + x)
    return made.where(spread > 10).select("symbol", "ts", (F.round(total, 5) + 0.0).alias("closes"), (F.round(F.element_at("volumes", -1), 3) + 0.0).alias("last_volume"))


HISTORY = (
    BARS
    + """,
hj AS (SELECT a.symbol, a.ts, a.adjusted_close AS ac, a.volume AS av, a.split_adjusted_volume AS asv, b.adjusted_close AS bc, b.volume AS bv, b.split_adjusted_volume AS bsv, a.l AS la, b.l AS lb FROM lp a JOIN (SELECT * FROM lp WHERE symbol = 'ALL') b ON a.ts = b.ts WHERE a.symbol <> 'ALL'),
hd AS (SELECT *, la - lag(la) OVER w AS a, lb - lag(lb) OVER w AS b, (la - lag(la) OVER w) - (lb - lag(lb) OVER w) AS d FROM hj WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
hf AS (SELECT symbol, ts, """
    + ", ".join(f"stddev_pop({c}) OVER (w ROWS {n - 1} PRECEDING) AS std_{c}_{n}" for n in (20, 60) for c in "abd")
    + ", "
    + ", ".join(f"avg({c}) OVER (w ROWS {n - 1} PRECEDING) AS mean_{c}_{n}" for n in (5, 20) for c in "abd")
    + """, stddev_pop(ac) OVER (w ROWS 63 PRECEDING) / avg(ac) OVER (w ROWS 63 PRECEDING) AS cv_a, stddev_pop(bc) OVER (w ROWS 63 PRECEDING) / avg(bc) OVER (w ROWS 63 PRECEDING) AS cv_b,
      covar_pop(a, b) OVER (w ROWS 59 PRECEDING) AS cov, sqrt(avg(least(d, 0) * least(d, 0)) OVER (w ROWS 19 PRECEDING)) AS downside_20,
      ln((av + 1) / (avg(asv) OVER (w ROWS 19 PRECEDING) / CASE WHEN av > 0 THEN asv / av ELSE 1 END + 1)) AS volume_a, ln((bv + 1) / (avg(bsv) OVER (w ROWS 19 PRECEDING) / CASE WHEN bv > 0 THEN bsv / bv ELSE 1 END + 1)) AS volume_b,
      ln(bc / greatest(max(bc) OVER (w ROWS 59 PRECEDING), 1e-8)) AS drawdown_b, count(a) OVER (w ROWS 59 PRECEDING) AS n FROM hd WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
hs AS (SELECT *, cov / greatest(std_a_60 * std_b_60, 1e-8) AS corr, cov / greatest(std_b_60 * std_b_60, 1e-8) AS beta FROM hf WHERE n = 60)"""
)


@query(f"WITH {HISTORY} SELECT symbol, ts, {r(*features.SCALE_NAMES, digits=4)} FROM hs", digits=4)
def f16_scales(spark, folder):
    return features.historical_scales(m.bars(spark, folder), m.BENCHMARK)


SHAPED = " UNION ALL ".join(f"SELECT '{c}' AS feature, {f'ln({c} + 1e-8)' if i < 8 else f'asinh({c})'} AS x FROM hs WHERE ts < DATE '1996-01-01'" for i, c in enumerate(features.SCALE_NAMES))


@query(f"WITH {HISTORY}, sh AS ({SHAPED}) SELECT feature, count(*) AS n, round(quantile_cont(x, 0.5), 4) + 0 AS center, round(greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-3), 4) + 0 AS scale FROM sh GROUP BY feature", digits=4)
def f18_scale_calibration(spark, folder):
    """The statistics of all cutoffs before the training end."""
    rows = features.historical_scales(m.bars(spark, folder), m.BENCHMARK)
    return features.scale_calibration(rows.where(F.col("ts") < F.lit(m.TRAIN_END).cast("date")))


def _projected(j: int) -> str:
    sines = [math.sin(i * 3 + j + 1.0) for i in range(2)]
    norm = math.sqrt(sum(x * x for x in sines))
    return " + ".join(f"{c} * {x / norm!r}::DOUBLE" for c, x in zip(("x", "y"), sines, strict=True))


@query(
    f"""
WITH {FEATURES}, p AS (SELECT symbol, ts, ret_1 AS x, sma_20 AS y FROM ft),
q AS (SELECT symbol, ts, """
    + ", ".join(f"{c} + 0.5 * avg({c}) OVER w + 0.25 * ({c} - coalesce(lag({c}) OVER w, {c})) AS {c}" for c in "xy")
    + " FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts, "
    + ", ".join(f"round(tanh({_projected(j)}), 5) + 0 AS hidden_{j}" for j in range(3))
    + " FROM q",
    digits=5,
)
def f22_causal(spark, folder):
    b = m.bars(spark, folder)
    rows = features.chosen(b, "ret_1", "sma_20")
    return features.causal_features(rows, ["ret_1", "sma_20"], 3)


# rules

ALL_SIGNALS = (
    SIGNALS
    + f""",
sx AS (SELECT *, list(rel) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING) AS x, greatest(stddev_pop(rel) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING), 1e-6) AS spread FROM s2),
se AS (SELECT *, list_transform(list_zip({EMA.format(x='x', k='(2.0 / 13)::DOUBLE')}, {EMA.format(x='x', k='(2.0 / 27)::DOUBLE')}), lambda v: v[1] - v[2]) AS y FROM sx WHERE mom IS NOT NULL),
sy AS (SELECT *, greatest(least((y[len(y)] - ({EMA.format(x='y', k='0.2::DOUBLE')})[len(y)]) / spread, 4), -4) AS gap FROM se),
rf AS (SELECT symbol, ts, {RSI} AS rsi FROM ft),
sa AS (SELECT sy.symbol, sy.ts, mom AS momentum_5d, -mom AS reversal_5d, cr * relvol AS ma_crossover, greatest(least((b.rsi - a.rsi) / 20, 2.5), -2.5) * relvol AS rsi, gap * relvol AS macd, greatest(least(mom / relvol, 4), -4) * relvol AS volatility_scaled
       FROM sy JOIN rf a ON a.symbol = sy.symbol AND a.ts = sy.ts JOIN (SELECT * FROM rf WHERE symbol = 'ALL') b ON b.ts = sy.ts)"""
)


@query(f"WITH {FEATURES}{ALL_SIGNALS} SELECT symbol, ts, {r(*features.SIGNALS, digits=5)} FROM sa", digits=5)
def f13_all_signals(spark, folder):
    return features.all_signals(m.bars(spark, folder), m.BENCHMARK)


RULES = (
    FEATURES
    + ALL_SIGNALS
    + LABELS.replace(BARS, "")
    + SCALES.format(where="ts < DATE '1996-01-01'")
    + """,
ab AS (SELECT lab.h, greatest(quantile_cont(alpha, 0.5), 0.25 * any_value(scale)) AS m FROM lab JOIN sc ON lab.h = sc.h WHERE ts < DATE '1996-01-01' GROUP BY lab.h),
al AS (SELECT sa.*, lab.h, alpha FROM sa JOIN lab ON sa.symbol = lab.symbol AND sa.ts = lab.ts),
am AS (SELECT 'always_buy' AS rule, symbol, ts, al.h, alpha, m AS c FROM al JOIN ab ON al.h = ab.h UNION ALL SELECT 'zero_return', symbol, ts, h, alpha, 0 FROM al """
    + " ".join(f"UNION ALL SELECT '{n}', symbol, ts, h, alpha, {n} * h / 5 FROM al" for n in features.SIGNALS)
    + ")"
)


def all_medians(spark, folder):
    signals = m.labels(spark, folder).join(features.all_signals(m.bars(spark, folder), m.BENCHMARK), ["symbol", "ts"])
    return metrics.all_rules(signals, m.always(spark, folder), features.SIGNALS)


@query(f"WITH {RULES} SELECT rule, symbol, ts, CAST(h AS BIGINT) AS h, round(c, 5) + 0 AS q50 FROM am", digits=5)
def g1_all_rules(spark, folder):
    return all_medians(spark, folder).select("rule", "symbol", "ts", "h", "q50")


@query(f"WITH {RULES} SELECT rule, CAST(h AS BIGINT) AS h, count(*) AS n, round(quantile_cont(alpha - c, 0.1), 5) + 0 AS offset_q10, round(quantile_cont(alpha - c, 0.5), 5) + 0 AS offset_q50, round(quantile_cont(alpha - c, 0.9), 5) + 0 AS offset_q90 FROM am WHERE ts < DATE '1996-01-01' GROUP BY rule, h", digits=5)
def g3_rule_models(spark, folder):
    return metrics.rule_models(m.training(all_medians(spark, folder)))


# losses and comparisons


@query(f"WITH {PREDICTIONS} SELECT rule, CAST(h AS BIGINT) AS h, round(coalesce(avg(pin / scale) FILTER (day(ts) % 7 <> 0), 0), 6) + 0 AS loss, count(*) FILTER (day(ts) % 7 <> 0) AS valid FROM pd GROUP BY rule, h")
def g9_masked_loss(spark, folder):
    rows = m.predictions(spark, folder).withColumn("alpha", F.when(F.dayofmonth("ts") % 7 != 0, F.col("alpha")))
    return metrics.masked_loss(rows, "rule", "h")


DIFFERENCES = ", dl AS (SELECT rule, ts, avg(pin / scale) AS loss FROM pd GROUP BY rule, ts), dd AS (SELECT a.rule, a.ts, a.loss - b.loss AS difference FROM dl a JOIN dl b ON a.ts = b.ts WHERE a.rule <> 'zero' AND b.rule = 'zero')"


@query(
    f"""
WITH {PREDICTIONS}{DIFFERENCES}, se AS (SELECT rule, list(difference ORDER BY ts) AS x, count(*) AS n FROM dd GROUP BY rule),
st AS (SELECT rule, x, n, k, b, CAST(concat('0x', substr(md5('42:' || k || ':' || b), 1, 8)) AS UBIGINT) % n AS start FROM se, range(0, 200) r(k), range(0, 100000) q(b) WHERE b < ceil(n / 14.0) AND n >= 28),
mn AS (SELECT rule, k, sum(x[CAST((start + j) % n AS BIGINT) + 1]) / any_value(n) AS mean FROM st, range(0, 14) t(j) WHERE b * 14 + j < n GROUP BY rule, k),
iv AS (SELECT rule, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM mn GROUP BY rule)
SELECT se.rule, n AS dates, {r('low', 'high')} FROM se LEFT JOIN iv ON se.rule = iv.rule"""
)
def h9_interval(spark, folder):
    losses = m.losses(spark, folder).select("rule", "ts", "loss")
    zero = losses.where("rule = 'zero'").select("ts", F.col("loss").alias("b"))
    differences = losses.where("rule <> 'zero'").join(zero, "ts").select("rule", "ts", (F.col("loss") - F.col("b")).alias("difference"))
    return metrics.block_intervals(differences, "rule", rounds=200)


@query(f"WITH {PREDICTIONS}, k AS (SELECT rule, sha256(string_agg(symbol || ' ' || h || ' ' || CAST(ts AS VARCHAR), ';' ORDER BY symbol, h, ts)) AS d FROM pd GROUP BY rule) SELECT count(*) AS models, count(DISTINCT d) AS memberships, (SELECT count(*) FROM (SELECT h FROM pd GROUP BY h HAVING count(DISTINCT scale) > 1)) AS unequal_scales FROM k")
def h11_same_membership(spark, folder):
    return metrics.same_membership(m.predictions(spark, folder))


@query(f"WITH {PREDICTIONS}, px AS (SELECT rule, symbol, h, ts, CASE WHEN rule = 'zero' AND h = 5 THEN 2 * scale ELSE scale END AS scale FROM pd WHERE NOT (rule = 'momentum' AND symbol = 'ASIA' AND day(ts) = 9)), k AS (SELECT rule, sha256(string_agg(symbol || ' ' || h || ' ' || CAST(ts AS VARCHAR), ';' ORDER BY symbol, h, ts)) AS d FROM px GROUP BY rule) SELECT count(*) AS models, count(DISTINCT d) AS memberships, (SELECT count(*) FROM (SELECT h FROM px GROUP BY h HAVING count(DISTINCT scale) > 1)) AS unequal_scales FROM k")
def h11_other_membership(spark, folder):
    """A model that lacks some cutoffs of one symbol, and one with another scale at a horizon."""
    rows = m.predictions(spark, folder)
    lacks = (F.col("rule") == "momentum") & (F.col("symbol") == "ASIA") & (F.dayofmonth("ts") == 9)
    other = F.when((F.col("rule") == "zero") & (F.col("h") == 5), 2 * F.col("scale")).otherwise(F.col("scale"))
    return metrics.same_membership(rows.where(~lacks).withColumn("scale", other))


PATHS = " UNION ALL ".join(f"SELECT rule || '/' || h || '/{c}' AS path, CAST({c} AS DOUBLE) AS value FROM mt" for c in ("n", *NAMED))


@query(f"WITH {PREDICTIONS}, mt AS (SELECT rule, h, {METRICS} FROM pd GROUP BY rule, h), ps AS ({PATHS}) SELECT path, round(value, 5) + 0 AS value FROM ps", digits=5)
def h16_flattened(spark, folder):
    return metrics.flattened(metrics.by_horizon(m.predictions(spark, folder), "rule"), "rule", "h")


@query(f"WITH {PREDICTIONS} SELECT rule, CAST(h AS VARCHAR) AS h, {r(*NAMED, digits=5)} FROM (SELECT rule, h, {METRICS} FROM pd GROUP BY rule, h)", digits=5)
def h16_unflattened(spark, folder):
    paths = metrics.flattened(metrics.by_horizon(m.predictions(spark, folder), "rule"), "rule", "h")
    return metrics.unflattened(paths, list(NAMED), "rule", "h")


@query(f"WITH {PREDICTIONS}, mt AS (SELECT rule, h, {METRICS} FROM pd GROUP BY rule, h), ps AS ({PATHS}) SELECT string_split(path, '/')[3] AS name, count(value) AS n, round(median(value), 5) + 0 AS median FROM ps GROUP BY 1", digits=5)
def h17_median_metric(spark, folder):
    return metrics.median_metric(metrics.flattened(metrics.by_horizon(m.predictions(spark, folder), "rule"), "rule", "h"))
