"""SQL for DuckDB that gives the rows of the queries on the same tables."""

from __future__ import annotations

BARS = """
o AS (SELECT r_name AS symbol, n_name AS nation, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS price, o_orderkey AS k
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
bars AS (SELECT symbol, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, CAST(count(*) AS DOUBLE) AS volume FROM o GROUP BY symbol, ts
      UNION ALL SELECT 'ALL', ts, arg_min(price, k), max(price), min(price), arg_max(price, k), CAST(count(*) AS DOUBLE) FROM o WHERE dayofyear(ts) % 97 <> 0 GROUP BY ts),
acts AS (SELECT symbol, ts, product(CAST(0.5 AS DOUBLE)) AS price_factor, product(CAST(2 AS DOUBLE)) AS share_multiplier, array_to_string(list_sort(list(DISTINCT 's' || CAST(k % 3 AS VARCHAR))), '+') AS source FROM o WHERE k % 501 = 0 GROUP BY symbol, ts),
later AS (SELECT b.symbol, b.ts, product(a.price_factor) AS pf, product(a.share_multiplier) AS sm FROM bars b JOIN acts a ON a.symbol = b.symbol AND a.ts > b.ts GROUP BY b.symbol, b.ts),
adj AS (SELECT b.symbol, b.ts, open, high, low, close, volume, close * coalesce(pf, 1) AS adjusted_close, volume * coalesce(sm, 1) AS split_adjusted_volume FROM bars b LEFT JOIN later l ON b.symbol = l.symbol AND b.ts = l.ts),
lp AS (SELECT *, ln(greatest(adjusted_close, 1e-12)) AS l, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM adj),
tr AS (SELECT *, coalesce(abs(l - lag(l) OVER w) > 4.0, false) AS extreme, coalesce(date_diff('day', lag(ts) OVER w, ts), 0) AS gap_days FROM lp WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""

CUTOFFS = (
    BARS
    + """,
ms AS (SELECT t.*, CASE WHEN b.ts IS NULL THEN 1 ELSE 0 END AS missing FROM tr t LEFT JOIN (SELECT ts FROM bars WHERE symbol = 'ALL') b ON t.ts = b.ts WHERE t.symbol <> 'ALL'),
cc AS (SELECT symbol, ts, idx, lead(ts, 14) OVER w AS label_end, sum(CAST(extreme AS INT)) OVER (w ROWS BETWEEN 18 PRECEDING AND 14 FOLLOWING) AS bad, sum(missing) OVER (w ROWS BETWEEN 19 PRECEDING AND 14 FOLLOWING) AS absent,
      sum(missing) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS context_gaps, sum(missing) OVER (w ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS label_gaps FROM ms WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
cand AS (SELECT symbol, ts, idx, label_end FROM cc WHERE idx >= 19 AND label_end IS NOT NULL AND bad = 0 AND absent = 0),
num AS (SELECT *, row_number() OVER (ORDER BY symbol, idx) - 1 AS ordinal FROM cand)"""
)

LABELS = (
    BARS
    + """,
pr AS (SELECT a.symbol, a.ts, a.adjusted_close AS ac, a.open * a.adjusted_close / greatest(a.close, 1e-12) AS eo, b.adjusted_close AS bc, b.open * b.adjusted_close / greatest(b.close, 1e-12) AS bo
      FROM adj a LEFT JOIN (SELECT * FROM adj WHERE symbol = 'ALL') b ON a.ts = b.ts WHERE a.symbol <> 'ALL'),
ld AS ("""
    + " UNION ALL ".join(f"SELECT symbol, ts, {h} AS h, lead(ts, {h}) OVER w AS end_at, lead(ac, {h}) OVER w AS x, lead(eo, 1) OVER w AS e, lead(bc, {h}) OVER w AS bx, lead(bo, 1) OVER w AS be FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY ts)" for h in (1, 5, 14))
    + """),
lab AS (SELECT symbol, ts, h, end_at, ln(x / e) - ln(bx / be) AS alpha FROM ld WHERE x > 0 AND e > 0 AND bx > 0 AND be > 0)"""
)

SCALES = """,
md AS (SELECT h, quantile_cont(alpha, 0.5) AS m, quantile_cont(alpha, 0.75) - quantile_cont(alpha, 0.25) AS iqr, count(*) AS n FROM lab WHERE {where} GROUP BY h),
sc AS (SELECT md.h, n, greatest(iqr, 1.4826 * mad, 1e-4) AS scale FROM md JOIN (SELECT lab.h, quantile_cont(abs(alpha - m), 0.5) AS mad FROM lab JOIN md ON lab.h = md.h WHERE {where} GROUP BY lab.h) d ON md.h = d.h WHERE n >= 4)"""

MOMENTUM = """,
rel AS (SELECT a.symbol, a.ts, a.l - b.l AS rel FROM lp a LEFT JOIN (SELECT * FROM lp WHERE symbol = 'ALL') b ON a.ts = b.ts WHERE a.symbol <> 'ALL'),
mom AS (SELECT * FROM (SELECT symbol, ts, rel - lag(rel, 5) OVER (PARTITION BY symbol ORDER BY ts) AS mom FROM rel) WHERE mom IS NOT NULL)"""

PREDICTIONS = (
    LABELS
    + SCALES.format(where="ts < DATE '1996-01-01'")
    + MOMENTUM
    + """,
ab AS (SELECT lab.h, greatest(quantile_cont(alpha, 0.5), 0.25 * any_value(scale)) AS m FROM lab JOIN sc ON lab.h = sc.h WHERE ts < DATE '1996-01-01' GROUP BY lab.h),
sg AS (SELECT lab.symbol, lab.ts, lab.h, alpha, mom FROM lab JOIN mom ON lab.symbol = mom.symbol AND lab.ts = mom.ts),
rm AS (SELECT 'always_buy' AS rule, symbol, ts, sg.h, alpha, m AS c FROM sg JOIN ab ON sg.h = ab.h UNION ALL SELECT 'zero', symbol, ts, h, alpha, 0 FROM sg UNION ALL SELECT 'momentum', symbol, ts, h, alpha, mom * h / 5 FROM sg),
rs AS (SELECT rule, h, quantile_cont(alpha - c, 0.1) AS r1, quantile_cont(alpha - c, 0.5) AS r2, quantile_cont(alpha - c, 0.9) AS r3 FROM rm WHERE ts < DATE '1996-01-01' GROUP BY rule, h),
pd AS (SELECT rm.rule, symbol, ts, rm.h, alpha, c + r1 AS q10, c + r2 AS q50, c + r3 AS q90, scale,
      (greatest(0.1 * (alpha - c - r1), -0.9 * (alpha - c - r1)) + greatest(0.5 * (alpha - c - r2), -0.5 * (alpha - c - r2)) + greatest(0.9 * (alpha - c - r3), -0.1 * (alpha - c - r3))) / 3 AS pin
      FROM rm JOIN rs ON rm.rule = rs.rule AND rm.h = rs.h JOIN sc ON rm.h = sc.h WHERE ts >= DATE '1996-01-01')"""
)

CORR = "CASE WHEN (count(*) * sum({x} * {x}) - sum({x}) * sum({x})) * (count(*) * sum({y} * {y}) - sum({y}) * sum({y})) <= 1e-20 THEN 0 ELSE greatest(least((count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / sqrt((count(*) * sum({x} * {x}) - sum({x}) * sum({x})) * (count(*) * sum({y} * {y}) - sum({y}) * sum({y}))), 1), -1) END"

CROSS = (
    PREDICTIONS
    + """,
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY rule, h, ts ORDER BY alpha, symbol) AS DOUBLE) AS ry, CAST(row_number() OVER (PARTITION BY rule, h, ts ORDER BY q50, symbol) AS DOUBLE) AS rs_, count(*) OVER (PARTITION BY rule, h, ts) AS n FROM pd),
ic AS (SELECT rule, h, ts, count(*) AS n, """
    + CORR.format(x="ry", y="rs_")
    + """ AS ic FROM rk WHERE n >= 3 GROUP BY rule, h, ts HAVING max(q50) > min(q50)),
sd AS (SELECT rule, h, ts, symbol, alpha, CASE WHEN rs_ > n - b THEN 1 WHEN rs_ <= b THEN -1 END AS side, b FROM (SELECT *, greatest(1, n // 5) AS b FROM rk WHERE n >= 3)),
hw AS (SELECT rule, h, ts, symbol, alpha, side, side * 0.5 / b AS weight, dense_rank() OVER (PARTITION BY rule, h ORDER BY ts) AS turn FROM sd WHERE side IS NOT NULL),
ch AS (SELECT coalesce(a.rule, b.rule) AS rule, coalesce(a.h, b.h) AS h, coalesce(a.turn, b.turn + 1) AS turn, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover FROM hw a FULL JOIN hw b ON a.rule = b.rule AND a.h = b.h AND a.turn = b.turn + 1 AND a.symbol = b.symbol GROUP BY 1, 2, 3),
ls AS (SELECT g.rule, g.h, g.ts, gross, turnover, gross - turnover * 10.0 / 10000 AS net FROM (SELECT rule, h, ts, any_value(turn) AS turn, avg(alpha) FILTER (side = 1) - avg(alpha) FILTER (side = -1) AS gross FROM hw GROUP BY rule, h, ts) g JOIN ch ON g.rule = ch.rule AND g.h = ch.h AND g.turn = ch.turn)"""
)


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0 AS {n}" for n in names)


FEATURES = (
    BARS
    + """,
chg AS (SELECT *, l - lag(l) OVER w AS change, coalesce(lag(close) OVER w, close) AS pc, adjusted_close - lag(adjusted_close) OVER w AS step FROM lp WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
ft AS (SELECT symbol, ts, l - coalesce(lag(l, 1) OVER w, first_value(l) OVER w) AS ret_1, l - coalesce(lag(l, 5) OVER w, first_value(l) OVER w) AS ret_5, l - coalesce(lag(l, 20) OVER w, first_value(l) OVER w) AS ret_20, l - coalesce(lag(l, 63) OVER w, first_value(l) OVER w) AS ret_window,
      stddev_pop(change) OVER (w ROWS 19 PRECEDING) * sqrt(252) AS vol, avg(greatest(high - low, abs(high - pc), abs(low - pc))) OVER (w ROWS 13 PRECEDING) / greatest(close, 1e-12) AS atr,
      adjusted_close / avg(adjusted_close) OVER (w ROWS 19 PRECEDING) - 1 AS sma_20, adjusted_close / avg(adjusted_close) OVER (w ROWS 49 PRECEDING) - 1 AS sma_50,
      avg(CASE WHEN step IS NULL THEN 0 ELSE greatest(step, 0) END) OVER (w ROWS 13 PRECEDING) AS up, avg(CASE WHEN step IS NULL THEN 0 ELSE greatest(-step, 0) END) OVER (w ROWS 13 PRECEDING) AS down FROM chg WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
)

RSI = "CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100 ELSE 50 END"

VOLUME = """,
vw AS (SELECT symbol, ts, volume, list(split_adjusted_volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS held, CASE WHEN volume > 0 THEN split_adjusted_volume / volume ELSE 1 END AS rate FROM adj),
vl AS (SELECT symbol, ts, volume, list_transform(held, lambda x: ln(1 + x / rate)) AS logs FROM vw),
vs AS (SELECT symbol, ts, (ln(1 + volume) - list_avg(logs)) / greatest(list_stddev_pop(logs), 1e-6) AS volume_score FROM vl)"""
