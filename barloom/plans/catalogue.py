"""Every query by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import adjust, boosting, features, metrics, models, payloads, store, windows
from ..sources import bars as src
from ..streaming import hourly
from . import market as m
from .oracle import BARS, CORR, CROSS, CUTOFFS, FEATURES, LABELS, MOMENTUM, PREDICTIONS, RSI, SCALES, VOLUME, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int | None = 6):
    """Registers a query; its floating columns are rounded as in its SQL."""

    def add(made):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = made(spark, folder)
            return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" and digits is not None else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])

        QUERIES[made.__name__] = run
        if sql:
            SQL[made.__name__] = sql
        return made

    return add


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return src.table(spark, folder, name)


# sources, payloads


@query(f"WITH {BARS} SELECT symbol, ts, {r('open', 'high', 'low', 'close', 'volume')} FROM bars")
def a1_scan_bars(spark, folder):
    return src.region_bars(spark, folder)


@query("SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, CAST(count(*) AS DOUBLE) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2", digits=None)
def a1_brand_bars(spark, folder):
    return src.brand_bars(spark, folder).select("symbol", "ts", "high", "low", "volume")


@query(f"WITH {BARS} SELECT symbol, ts, {r('open', 'close')} FROM bars")
def a6_envelope_roundtrip(spark, folder):
    made = src.region_bars(spark, folder).select("symbol", "ts", "open", "close")
    return src.from_envelopes(src.to_envelopes(made), made.schema)


@query(
    """
WITH x AS (SELECT 'S' || lpad(CAST(k AS VARCHAR), 4, '0') AS symbol, CAST(DATE '2022-01-03' + CAST(i AS INTEGER) AS DATE) AS ts, i, (50 + 10 * k) * exp(0.0003 * i + 0.01 * sin(i / 13.0::DOUBLE + 50 + 10 * k)) AS c FROM range(0, 511) d(i), range(0, 4) n(k))
SELECT symbol, ts, round(c * 0.998::DOUBLE, 5) + 0 AS open, round(c * 1.006::DOUBLE, 5) + 0 AS high, round(c * 0.994::DOUBLE, 5) + 0 AS low, round(c, 5) + 0 AS close, CAST(1e6 + 100 * i AS DOUBLE) AS volume FROM x WHERE isodow(ts) < 6""",
    digits=5,
)
def a8_synthetic(spark, folder):
    return src.synthetic_bars(spark, 4, 360)


RAW = "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, value AS open, value * 1.01 AS high, CASE WHEN event_id % 50 = 0 THEN value * 1.5 ELSE value * 0.99 END AS low, value AS close, CASE WHEN event_id % 97 = 0 THEN -1::DOUBLE ELSE 10 END AS volume FROM events"
BASE_OK = "NOT (least(open, high, low, close) <= 0) AND NOT (volume < 0) AND NOT (high < greatest(open, close) - 1e-8 OR low > least(open, close) + 1e-8)"


def raw_rows(spark, folder):
    e = t(spark, folder, "events")
    return e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("open"), (F.col("value") * 1.01).alias("high"), F.when(F.col("event_id") % 50 == 0, F.col("value") * 1.5).otherwise(F.col("value") * 0.99).alias("low"), F.col("value").alias("close"), F.when(F.col("event_id") % 97 == 0, -1.0).otherwise(10.0).alias("volume"))


@query(f"WITH raw AS ({RAW}) SELECT symbol, ts, {r('open', 'high', 'low', 'close')}, any_value(volume) AS volume FROM raw WHERE {BASE_OK} GROUP BY symbol, ts, open, high, low, close QUALIFY count(*) OVER (PARTITION BY symbol, ts) = 1 AND sum(count(*)) OVER (PARTITION BY symbol, ts) = 1")
def a13_clean_rows(spark, folder):
    return payloads.clean_rows(raw_rows(spark, folder))


@query(f"WITH raw AS ({RAW}) SELECT * FROM (SELECT 'missing_value' AS reason, count(*) FILTER (value_missing) AS dropped FROM (SELECT ts IS NULL OR open IS NULL AS value_missing FROM raw) UNION ALL SELECT 'non_positive_price', count(*) FILTER (least(open, high, low, close) <= 0) FROM raw UNION ALL SELECT 'negative_volume', count(*) FILTER (volume < 0) FROM raw UNION ALL SELECT 'bad_bounds', count(*) FILTER (high < greatest(open, close) - 1e-8 OR low > least(open, close) + 1e-8) FROM raw)")
def a13_reason_counts(spark, folder):
    return payloads.reason_counts(raw_rows(spark, folder))


INSTRUMENTS = "SELECT c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'etf' ELSE 'stock' END AS asset_type, c_name AS provider_symbol, c_acctbal > 3000 AS is_active FROM customer"


def instruments(spark, folder):
    c = t(spark, folder, "customer")
    return c.select(F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("symbol"), F.when(F.col("c_custkey") % 3 == 0, "etf").otherwise("stock").alias("asset_type"), F.col("c_name").alias("provider_symbol"), (F.col("c_acctbal") > 3000).alias("is_active"))


@query(f"SELECT symbol, asset_type, provider_symbol, is_active FROM ({INSTRUMENTS}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY is_active DESC, asset_type, provider_symbol) = 1")
def a14_dedupe_active_first(spark, folder):
    return payloads.active_first(instruments(spark, folder))


@query(f"WITH u AS (SELECT * FROM ({INSTRUMENTS}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY is_active DESC, asset_type, provider_symbol) = 1) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY asset_type ORDER BY is_active DESC, symbol) <= 7 OR symbol = 'BUILDING-3'")
def a29_limit_per_type(spark, folder):
    return payloads.universe(payloads.active_first(instruments(spark, folder)), 7, "BUILDING-3")


@query("WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN l_quantity || ':' || l_linenumber WHEN 1 THEN l_quantity || '/' || l_linenumber WHEN 2 THEN 'x/' || l_linenumber ELSE '0/' || l_linenumber END AS s, l_quantity, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(n / l_quantity, 6) + 0 AS price_factor, round(l_quantity / n, 6) + 0 AS share_multiplier FROM s WHERE l_orderkey % 4 IN (0, 1)")
def a15_split_ratio(spark, folder):
    k = F.col("l_orderkey") % 4
    text = F.when(k == 0, F.concat_ws(":", "l_quantity", "l_linenumber")).when(k == 1, F.concat_ws("/", "l_quantity", "l_linenumber")).when(k == 2, F.concat(F.lit("x/"), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.lit("0/"), F.col("l_linenumber").cast("string")))
    return t(spark, folder, "lineitem").withColumn("r", fn.split_ratio(text)).where("r is not null").select("l_orderkey", "l_linenumber", "r.price_factor", "r.share_multiplier")


@query(f"WITH {BARS}, ret AS (SELECT ts, arg_max(price, k) AS ac FROM o GROUP BY ts) SELECT b.ts, {r('close')}, round(ac, 6) + 0 AS adjusted_close, 0.0::DOUBLE AS volume FROM bars b JOIN ret ON b.ts = ret.ts WHERE symbol = 'ALL'")
def a21_index_join(spark, folder):
    prices = src.region_bars(spark, folder).where("symbol = 'ALL'").select("ts", "close")
    totals = src.order_trades(spark, folder).select("ts", F.col("price").alias("total_return"), F.col("k").alias("line"))
    return payloads.index_bars(prices, totals)


@query("SELECT CAST(o_orderdate AS DATE) AS ts FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1")
def a31_sessions(spark, folder):
    days = t(spark, folder, "orders").select(F.to_date("o_orderdate").alias("ts")).distinct()
    return days.join(src.sessions(days), "ts")


# checks


@query(f"WITH raw AS ({RAW}) SELECT * FROM (SELECT 'missing_ts' AS rule, count(*) FILTER (ts IS NULL) AS broken FROM raw UNION ALL SELECT 'empty_symbol', count(*) FILTER (symbol IS NULL OR trim(symbol) = '') FROM raw UNION ALL SELECT 'non_finite', count(*) FILTER (open IS NULL OR isnan(open)) FROM raw UNION ALL SELECT 'non_positive_price', count(*) FILTER (least(open, high, low, close) <= 0) FROM raw UNION ALL SELECT 'negative_volume', count(*) FILTER (volume < 0) FROM raw UNION ALL SELECT 'high_below', count(*) FILTER (high < greatest(low, open, close) - 1e-8) FROM raw UNION ALL SELECT 'low_above', count(*) FILTER (low > least(high, open, close) + 1e-8) FROM raw UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM raw GROUP BY symbol, ts))")
def b2_rule_counts(spark, folder):
    return store.rule_counts(raw_rows(spark, folder))


@query(f"WITH {BARS} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS symbols, count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (extreme) AS extremes, count(*) FILTER (gap_days > 10) AS long_gaps, min(ts) AS start_at, max(ts) AS end_at FROM tr")
def b3_quality(spark, folder):
    return store.quality(m.bars(spark, folder), m.THRESHOLD)


CODES = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey AS VARCHAR) || '.TW' WHEN 1 THEN p_brand || '.US' WHEN 2 THEN CAST(1000 + p_partkey % 8999 AS VARCHAR) || '.TWO' WHEN 3 THEN CAST(1000 + p_partkey % 8999 AS VARCHAR) || '.TW' WHEN 4 THEN 'VTI.US' ELSE p_brand END AS symbol, CASE WHEN p_size < 30 THEN 'stock' WHEN p_size < 40 THEN 'etf' WHEN p_size < 45 THEN 'index' ELSE 'option' END AS asset_type, CASE p_partkey % 6 WHEN 0 THEN 'TWSE' WHEN 1 THEN 'US' WHEN 2 THEN 'TPEX' WHEN 3 THEN 'TWSE' WHEN 4 THEN 'US' ELSE 'OTHER' END AS market, CASE WHEN p_partkey % 11 = 0 THEN 'VTI.US' END AS explicit FROM part"
SCOPE = "(asset_type = 'stock' AND CASE market WHEN 'US' THEN symbol LIKE '%.US' AND length(symbol) > 3 WHEN 'TWSE' THEN regexp_matches(symbol, '^(?:[1-9][0-9]{3}|91[0-9]{4})[.]TW$') WHEN 'TPEX' THEN regexp_matches(symbol, '^[1-9][0-9]{3}[.]TWO$') ELSE false END)"


def codes(spark, folder):
    k = F.col("p_partkey") % 6
    number = (1000 + F.col("p_partkey") % 8999).cast("string")
    symbol = F.when(k == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(".TW"))).when(k == 1, F.concat("p_brand", F.lit(".US"))).when(k == 2, F.concat(number, F.lit(".TWO"))).when(k == 3, F.concat(number, F.lit(".TW"))).when(k == 4, "VTI.US").otherwise(F.col("p_brand"))
    kind = F.when(F.col("p_size") < 30, "stock").when(F.col("p_size") < 40, "etf").when(F.col("p_size") < 45, "index").otherwise("option")
    place = F.when(k.isin(0, 3), "TWSE").when(k.isin(1, 4), "US").when(k == 2, "TPEX").otherwise("OTHER")
    return t(spark, folder, "part").select("p_partkey", symbol.alias("symbol"), kind.alias("asset_type"), place.alias("market"), F.when(F.col("p_partkey") % 11 == 0, "VTI.US").alias("explicit"))


@query(f"SELECT p_partkey, symbol, {SCOPE} AS in_scope FROM ({CODES})")
def b5_scope(spark, folder):
    return codes(spark, folder).select("p_partkey", "symbol", fn.training_scope(F.col("symbol"), F.col("asset_type"), F.col("market")).alias("in_scope"))


@query(
    f"WITH c AS ({CODES}), w AS (SELECT *, CASE market WHEN 'US' THEN 'VTI.US' WHEN 'TWSE' THEN 'TAIEX.TW' WHEN 'TPEX' THEN 'TPEX.TWO' END AS mk, {SCOPE} AS ok FROM c), y AS (SELECT *, CASE WHEN asset_type = 'index' THEN 'index' WHEN asset_type NOT IN ('stock', 'etf') THEN 'unsupported_type' WHEN asset_type = 'stock' AND NOT ok THEN 'out_of_scope' WHEN explicit = symbol THEN 'benchmark_self' WHEN explicit IS NOT NULL THEN 'explicit' WHEN mk IS NULL THEN 'unmapped' WHEN mk = symbol THEN 'benchmark_self' ELSE 'market' END AS reason FROM w) SELECT p_partkey, reason, reason IN ('explicit', 'market') AS eligible, CASE WHEN reason IN ('explicit', 'market', 'benchmark_self') THEN coalesce(explicit, mk) END AS benchmark FROM y"
)
def b6_benchmark_case(spark, folder):
    b = fn.benchmark_of(F.col("symbol"), F.col("asset_type"), F.col("market"), F.col("explicit"))
    return codes(spark, folder).withColumn("b", b).select("p_partkey", "b.benchmark", "b.eligible", "b.reason")


@query("WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_orderkey % 1000 AS start_index, l_orderkey % 1000 + l_linenumber AS stop_index, CASE WHEN l_orderkey % 37 = 0 THEN 0 ELSE l_linenumber END AS n, l_orderkey, l_linenumber FROM lineitem), y AS (SELECT *, max(stop_index) OVER (PARTITION BY symbol, start_index, stop_index) AS q FROM x GROUP BY ALL), d AS (SELECT DISTINCT symbol, start_index, stop_index, n AS count FROM x), z AS (SELECT *, lag(stop_index) OVER (PARTITION BY symbol ORDER BY start_index, stop_index, count) AS b FROM d) SELECT symbol, CAST(start_index AS BIGINT) AS start_index, CAST(stop_index AS BIGINT) AS stop_index, CAST(count AS BIGINT) AS count FROM z WHERE start_index < b OR count <> stop_index - start_index")
def b8_range_overlap(spark, folder):
    x = t(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), (F.col("l_orderkey") % 1000).alias("start_index"), (F.col("l_orderkey") % 1000 + F.col("l_linenumber")).alias("stop_index"), F.when(F.col("l_orderkey") % 37 == 0, 0).otherwise(F.col("l_linenumber")).alias("count"))
    return store.overlaps(x.distinct())


# adjustment and labels


@query(f"WITH {BARS} SELECT symbol, ts, price_factor, share_multiplier, source FROM acts")
def c2_action_product(spark, folder):
    return adjust.merge_actions(src.order_actions(spark, folder))


@query(f"WITH {BARS} SELECT symbol, ts, adjusted_close, split_adjusted_volume FROM adj", digits=None)
def c3_back_adjust(spark, folder):
    return m.bars(spark, folder).select("symbol", "ts", "adjusted_close", "split_adjusted_volume")


@query(f"WITH {BARS}, f AS (SELECT symbol, ts, adjusted_close, split_adjusted_volume, adjusted_close / greatest(close, 1e-12) AS p, split_adjusted_volume / volume AS v FROM adj), w AS (SELECT symbol, ts, p, v, list(adjusted_close) OVER y AS a, list(split_adjusted_volume) OVER y AS b FROM f WINDOW y AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)) SELECT symbol, ts, round(list_sum(a) / p, 4) + 0 AS closes, round(list_sum(b) / v, 4) + 0 AS volumes, round(a[1] / p, 4) + 0 AS first_close FROM w WHERE len(a) = 20", digits=4)
def c4_asof_window(spark, folder):
    """Totals of the windows; that of volumes is taken before it is put in the cutoff's shares, as in its SQL."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    shares = total(F.transform("window", lambda x: x["volume"] * F.col("volume_factor")))
    made = {"closes": total(F.col("window.close")), "volumes": fn.ratio(shares, F.col("volume_factor")), "first_close": F.col("window")[0]["close"]}
    return adjust.asof_windows(m.bars(spark, folder), 20).select("symbol", "ts", *[fn.rounded(c, 4).alias(n) for n, c in made.items()])


@query(f"WITH {BARS}, x AS (" + " UNION ALL ".join(f"SELECT symbol, ts, {h} AS h, lead(ts, {h}) OVER w AS end_at, lead(adjusted_close, {h}) OVER w / greatest(lead(open * adjusted_close / greatest(close, 1e-12), 1) OVER w, 1e-12) AS gross, lead(open, 1) OVER w AS e FROM adj WINDOW w AS (PARTITION BY symbol ORDER BY ts)" for h in (1, 5, 14)) + ") SELECT symbol, ts, CAST(h AS BIGINT) AS h, end_at, round(gross, 6) + 0 AS gross FROM x WHERE end_at IS NOT NULL AND e IS NOT NULL")
def c5_exec_return(spark, folder):
    return adjust.execution_returns(m.bars(spark, folder), m.HORIZONS)


@query(f"WITH {LABELS} SELECT symbol, ts, CAST(h AS BIGINT) AS h, end_at, round(alpha, 6) + 0 AS alpha FROM lab")
def c6_alpha(spark, folder):
    return m.labels(spark, folder)


@query(f"WITH {LABELS}{SCALES.format(where='true')} SELECT CAST(h AS BIGINT) AS h, n, round(scale, 6) + 0 AS scale FROM sc")
def c7_robust_scale(spark, folder):
    return adjust.robust_scales(m.labels(spark, folder))


# store


@query(f"WITH {BARS} SELECT symbol, ts, extreme, gap_days FROM tr")
def d4_transitions(spark, folder):
    return store.transitions(m.bars(spark, folder), m.THRESHOLD).select("symbol", "ts", "extreme", "gap_days")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS status FROM lineitem GROUP BY l_orderkey")
def d5_consistent_meta(spark, folder):
    return t(spark, folder, "lineitem").groupBy("l_orderkey").agg(store.consistent("l_returnflag").alias("flag"), store.consistent("l_linestatus").alias("status"))


INDEX = "ix AS (SELECT symbol, count(*) AS row_count, min(ts) AS start_at, max(ts) AS end_at, count(*) FILTER (extreme) AS extreme_count, count(*) FILTER (gap_days > 10) AS long_gap_count, 'ALL' AS benchmark_symbol, CASE WHEN symbol = 'ALL' THEN 'benchmark_self' ELSE 'eligible' END AS reason, symbol <> 'ALL' AS eligible FROM tr GROUP BY symbol)"


@query(f"WITH {BARS}, {INDEX} SELECT * FROM ix")
def d6_symbol_index(spark, folder):
    return store.symbol_index(m.bars(spark, folder), m.BENCHMARK, m.THRESHOLD)


@query(f"WITH {BARS} SELECT symbol, 'missing_benchmark' AS reason, false AS eligible FROM bars GROUP BY symbol")
def d7_missing_benchmark(spark, folder):
    return store.symbol_index(m.bars(spark, folder), "NONE", m.THRESHOLD).select("symbol", "reason", "eligible")


@query(f"WITH {CUTOFFS} SELECT symbol, ts, idx, label_end FROM cand")
def d8_candidates(spark, folder):
    return m.cutoffs(spark, folder)


ISLANDS = "SELECT {keys}, min(idx) AS start_index, max(idx) + 1 AS stop_index, count(*) AS count, min(ts) AS cutoff_start_at, max(ts) AS cutoff_end_at, max(label_end) AS label_end_max_at FROM (SELECT *, idx - row_number() OVER (PARTITION BY {keys} ORDER BY idx) AS run FROM {rows}) GROUP BY {keys}, run"


@query(f"WITH {CUTOFFS} {ISLANDS.format(keys='symbol', rows='cand')}")
def d9_islands(spark, folder):
    return m.candidate_ranges(spark, folder)


@query(f"WITH {CUTOFFS}, {INDEX} SELECT reason, count(*) AS symbols FROM (SELECT reason FROM ix WHERE NOT eligible UNION ALL SELECT 'no_valid_cutoffs' FROM ix WHERE eligible AND symbol NOT IN (SELECT symbol FROM cand)) GROUP BY reason")
def d10_exclusions(spark, folder):
    return store.exclusions(store.symbol_index(m.bars(spark, folder), m.BENCHMARK, m.THRESHOLD), m.cutoffs(spark, folder))


@query(f"WITH {CUTOFFS} SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM cand)")
def d11_calendars(spark, folder):
    return store.calendar(m.cutoffs(spark, folder))


FRACTION = """,
ob AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM bars)),
cd AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM cand)),
bo AS (SELECT max(ts) FILTER (pos = floor(n * 0.70::DOUBLE)) AS te, max(ts) FILTER (pos = floor(n * 0.85::DOUBLE)) AS ve FROM cd),
bp AS (SELECT te, ve, (SELECT pos FROM ob WHERE ts = te) AS a, (SELECT pos FROM ob WHERE ts = ve) AS b FROM bo),
sp AS (SELECT symbol, c.ts, idx, label_end, CASE WHEN pos < a - 20 AND label_end < te THEN 'train' WHEN pos >= a + 14 AND pos < b - 20 AND label_end < ve THEN 'validation' WHEN pos >= b + 14 THEN 'test' WHEN pos < a - 20 OR (pos >= a + 14 AND pos < b - 20) THEN 'label_crosses' ELSE 'purge_or_embargo' END AS split FROM cand c JOIN ob ON c.ts = ob.ts, bp)"""
FIXED = """,
fx AS (SELECT symbol, ts, idx, label_end, CASE WHEN ts < DATE '1996-01-01' THEN CASE WHEN label_end < DATE '1996-01-01' THEN 'train' ELSE 'label_crosses' END WHEN ts < DATE '1997-01-01' THEN CASE WHEN label_end < DATE '1997-01-01' THEN 'validation' ELSE 'label_crosses' END WHEN ts < DATE '1998-01-01' THEN CASE WHEN label_end < DATE '1998-01-01' THEN 'test' ELSE 'label_crosses' END ELSE 'after_test_end' END AS split FROM cand)"""


@query(f"WITH {CUTOFFS}{FRACTION} SELECT symbol, ts, idx, label_end, split FROM sp")
def d13_split_fraction(spark, folder):
    return store.split_by_fraction(m.cutoffs(spark, folder), m.bars(spark, folder), store.FractionPolicy())


def fixed_split(spark, folder):
    return store.split_by_dates(m.cutoffs(spark, folder), m.TRAIN_END, m.VALIDATION_END, m.TEST_END)


@query(f"WITH {CUTOFFS}{FIXED} SELECT * FROM fx")
def d14_split_fixed(spark, folder):
    return fixed_split(spark, folder)


@query(f"WITH {CUTOFFS}{FIXED} {ISLANDS.format(keys='symbol, split', rows='fx')}")
def d15_split_ranges(spark, folder):
    return store.islands(fixed_split(spark, folder), "symbol", "split")


@query(f"WITH {CUTOFFS}{FRACTION} SELECT split, count(*) AS cutoffs, count(DISTINCT symbol) AS symbols, min(ts) AS first_at, max(ts) AS last_at, max(label_end) AS label_end_max_at FROM sp GROUP BY split")
def d16_audit(spark, folder):
    return store.split_audit(store.split_by_fraction(m.cutoffs(spark, folder), m.bars(spark, folder), store.FractionPolicy()))


@query(f"WITH {BARS}, {INDEX} SELECT reason, count(*) AS symbols, CAST(sum(row_count) AS BIGINT) AS n_rows, CAST(sum(extreme_count) AS BIGINT) AS extremes, CAST(sum(long_gap_count) AS BIGINT) AS long_gaps FROM ix GROUP BY reason")
def d17_quality(spark, folder):
    return store.symbol_index(m.bars(spark, folder), m.BENCHMARK, m.THRESHOLD).groupBy("reason").agg(F.count("*").alias("symbols"), F.sum("row_count").alias("n_rows"), F.sum("extreme_count").alias("extremes"), F.sum("long_gap_count").alias("long_gaps"))


# windows and samples

REASON = "CASE WHEN bad > 0 THEN 'extreme_transition' WHEN context_gaps > 0 THEN 'benchmark_context_gap' WHEN label_gaps > 0 THEN 'benchmark_label_gap' ELSE 'valid' END"


def reasons(spark, folder):
    return windows.window_reasons(m.bars(spark, folder), m.BENCHMARK, m.WINDOW, m.HORIZON, m.THRESHOLD, stride=2)


@query(f"WITH {CUTOFFS} SELECT symbol, ts, idx, label_end, {REASON} AS reason FROM cc WHERE idx >= 19 AND label_end IS NOT NULL AND (idx - 19) % 2 = 0")
def e1_windows(spark, folder):
    return reasons(spark, folder)


@query(f"WITH {CUTOFFS} SELECT {REASON} AS reason, count(*) AS windows, count(DISTINCT symbol) AS symbols FROM cc WHERE idx >= 19 AND label_end IS NOT NULL AND (idx - 19) % 2 = 0 GROUP BY 1")
def e2_window_audit(spark, folder):
    return windows.window_audit(reasons(spark, folder))


@query(f"WITH {CUTOFFS} SELECT symbol, ts, idx, label_end, ordinal FROM num")
def e3_ordinals(spark, folder):
    return m.numbered(spark, folder)


@query(f"WITH {BARS}, w AS (SELECT symbol, ts, adjusted_close AS z, list(adjusted_close) OVER y AS c, list(ln(1 + split_adjusted_volume)) OVER y AS n FROM adj WINDOW y AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)) SELECT symbol, ts, round(ln(c[1] / z), 6) + 0 AS first_close, round(list_sum(list_transform(c, lambda x: ln(greatest(x, 1e-12) / z))), 5) + 0 AS closes, round((n[20] - list_avg(n)) / CASE WHEN list_stddev_pop(n) <= 1e-6 THEN 1 ELSE list_stddev_pop(n) END, 5) + 0 AS last_volume FROM w WHERE len(c) = 20", digits=5)
def e6_relative(spark, folder):
    made = features.relative_windows(m.bars(spark, folder), 20)
    return made.select("symbol", "ts", "first_close", F.aggregate("closes", F.lit(0.0), lambda s, x: s + x).alias("closes"), F.element_at("volumes", -1).alias("last_volume"))


SQL["e6_relative"] = SQL["e6_relative"].replace("round(ln(c[1] / z), 6)", "round(ln(c[1] / z), 5)")


@query(f"WITH {BARS} SELECT symbol, ts, CAST(isodow(ts) - 1 AS BIGINT) AS weekday, CAST(day(ts) AS BIGINT) AS day, CAST(month(ts) AS BIGINT) AS month FROM bars")
def e7_time_features(spark, folder):
    return windows.time_features(src.region_bars(spark, folder))


def events_numbered(spark, folder):
    return t(spark, folder, "events").select(F.col("event_id").alias("ordinal"))


def _sample(count: int) -> windows.BlockSample:
    return windows.BlockSample(count, fraction=0.3, block=16)


@query("WITH c AS (SELECT count(*) AS n, CAST(ceil(count(*) / 16.0) AS BIGINT) AS b FROM events), s AS (SELECT n, b, (SELECT min(x) FROM range(1, 100000) t(x) WHERE x >= CASE WHEN 7919 % b = 0 THEN 1 ELSE 7919 % b END AND gcd(x, b) = 1) AS m FROM c), k AS (SELECT row_number() OVER (ORDER BY rank) - 1 AS rank, blk FROM (SELECT i AS rank, (m * i + 13) % b AS blk FROM s, range(0, 1000000) t(i) WHERE i < b)), z AS (SELECT blk, sum(least(16, n - blk * 16)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k, s) SELECT event_id AS ordinal, CAST(coalesce(before, 0) + event_id % 16 AS BIGINT) AS place FROM events JOIN z ON event_id // 16 = blk, s WHERE coalesce(before, 0) + event_id % 16 < greatest(1, CAST(floor(n * 0.3::DOUBLE) AS BIGINT))")
def e9_block_sample(spark, folder):
    rows = events_numbered(spark, folder)
    return windows.block_sample(rows, _sample(rows.count())).select("ordinal", "place")


@query("WITH c AS (SELECT count(*) AS n FROM events), f AS (SELECT event_id AS ordinal, event_id AS pos FROM events UNION ALL SELECT event_id, event_id + n FROM events, c WHERE event_id < (96 - n % 96) % 96) SELECT ordinal, pos // 96 AS batch, pos % 96 AS slot FROM f")
def e10_batches(spark, folder):
    rows = events_numbered(spark, folder)
    return windows.batches(rows, 96, rows.count())


@query(f"WITH {CUTOFFS} SELECT ts, symbol AS market, ordinal, row_number() OVER (PARTITION BY ts ORDER BY symbol, ordinal) AS at FROM num")
def e12_date_market(spark, folder):
    return windows.date_market_order(m.numbered(spark, folder))


# features


@query(f"WITH {FEATURES} SELECT symbol, ts, {r('ret_1', 'ret_5', 'ret_20', 'ret_window')} FROM ft")
def f1_returns(spark, folder):
    return features.returns(m.bars(spark, folder))


@query(f"WITH {FEATURES} SELECT symbol, ts, {r('vol')} FROM ft")
def f2_volatility(spark, folder):
    return features.volatility(m.bars(spark, folder))


@query(f"WITH {FEATURES} SELECT symbol, ts, {r('atr')} FROM ft")
def f3_true_range(spark, folder):
    return features.true_range(m.bars(spark, folder))


@query(f"WITH {BARS}{VOLUME} SELECT symbol, ts, {r('volume_score', digits=5)} FROM vs", digits=5)
def f4_volume_score(spark, folder):
    return features.volume_score(m.bars(spark, folder))


@query(f"WITH {FEATURES} SELECT symbol, ts, {r('sma_20', 'sma_50')} FROM ft")
def f5_averages(spark, folder):
    return features.averages(m.bars(spark, folder))


@query(f"WITH {FEATURES} SELECT symbol, ts, round({RSI}, 5) + 0 AS rsi FROM ft", digits=5)
def f6_strength(spark, folder):
    return features.strength(m.bars(spark, folder))


ROWS = f", fr AS (SELECT f.symbol, f.ts, ret_1, ret_5, ret_20, ret_window, vol, atr, volume_score, sma_20, sma_50, {RSI} AS rsi FROM ft f JOIN vs ON f.symbol = vs.symbol AND f.ts = vs.ts)"
FEATURE_NAMES = ("ret_1", "ret_5", "ret_20", "ret_window", "vol", "atr", "volume_score", "sma_20", "sma_50", "rsi")


@query(f"WITH {FEATURES}{VOLUME}{ROWS} SELECT a.symbol, a.ts, " + ", ".join(f"round(a.{c}, 4) + 0 AS {c}, round(b.{c}, 4) + 0 AS bench_{c}, round(a.{c} - b.{c}, 4) + 0 AS diff_{c}" for c in FEATURE_NAMES) + " FROM fr a JOIN (SELECT * FROM fr WHERE symbol = 'ALL') b ON a.ts = b.ts WHERE a.symbol <> 'ALL'", digits=4)
def f7_feature_rows(spark, folder):
    return features.feature_rows(m.bars(spark, folder), m.BENCHMARK)


EMA = "list_reduce(list_prepend([{x}[1]], list_transform({x}[2:], lambda v: [v])), lambda a, v: list_append(a, a[len(a)] * (1 - {k}) + v[1] * {k}))"


@query(f"WITH {BARS}, w AS (SELECT symbol, ts, list(l) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS x FROM lp), e AS (SELECT symbol, ts, {EMA.format(x='x', k='(2.0 / 13)::DOUBLE')} AS f, {EMA.format(x='x', k='(2.0 / 27)::DOUBLE')} AS s FROM w WHERE len(x) = 20), d AS (SELECT symbol, ts, list_transform(list_zip(f, s), lambda v: v[1] - v[2]) AS y FROM e) SELECT symbol, ts, round(y[20], 6) + 0 AS macd, round(({EMA.format(x='y', k='0.2::DOUBLE')})[20], 6) + 0 AS signal FROM d")
def f13_macd(spark, folder):
    return features.macd(m.bars(spark, folder))


@query(f"WITH {BARS}{MOMENTUM} SELECT symbol, ts, {r('mom')}, round(-mom, 6) + 0 AS reversal FROM mom")
def f10_momentum(spark, folder):
    return features.momentum(m.bars(spark, folder), m.BENCHMARK)


@query(
    f"WITH {BARS}, j AS (SELECT a.symbol, a.ts, a.l AS la, b.l AS lb, b.adjusted_close AS bc FROM lp a JOIN (SELECT * FROM lp WHERE symbol = 'ALL') b ON a.ts = b.ts WHERE a.symbol <> 'ALL'), d AS (SELECT symbol, ts, bc, la - lag(la) OVER w AS a, lb - lag(lb) OVER w AS b, (la - lag(la) OVER w) - (lb - lag(lb) OVER w) AS d FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT * FROM (SELECT symbol, ts, "
    + ", ".join(f"round(stddev_pop({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING), 5) + 0 AS std_{c}_{n}" for n in (20, 60) for c in "abd")
    + ", round(covar_pop(a, b) OVER v / greatest(var_pop(b) OVER v, 1e-8), 5) + 0 AS beta, round(ln(bc / max(bc) OVER v), 5) + 0 AS bench_drawdown FROM d WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING) QUALIFY count(a) OVER v = 60)",
    digits=5,
)
def f15_scale_features(spark, folder):
    return features.scale_features(m.bars(spark, folder), m.BENCHMARK)


STD = "greatest(least((x_{c} - q2_{c}) / greatest(q3_{c} - q1_{c}, 1e-3), 10), -10)"


@query(f"WITH {FEATURES}, s AS (SELECT symbol, ts, asinh(ret_5) AS x_ret_5, asinh(sma_20) AS x_sma_20 FROM ft), q AS (SELECT " + ", ".join(f"quantile_cont(x_{c}, {p}) AS q{i}_{c}" for c in ("ret_5", "sma_20") for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))) + " FROM s) SELECT symbol, ts, " + ", ".join(f"round({STD.format(c=c)}, 5) + 0 AS {c}" for c in ("ret_5", "sma_20")) + " FROM s, q", digits=5)
def f17_standardize(spark, folder):
    b = m.bars(spark, folder)
    rows = features.chosen(b, "ret_5", "sma_20")
    return features.standardised(rows, ["ret_5", "sma_20"])


@query(f"WITH {BARS}, d AS (SELECT symbol, ts, adjusted_close, sum(adjusted_close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25 AS trend FROM adj) SELECT symbol, ts, round(ln(trend), 5) + 0 AS log_trend, round(1 - trend / adjusted_close, 5) + 0 AS seasonal_share FROM d", digits=5)
def f19_decompose(spark, folder):
    made = features.decomposed(m.bars(spark, folder))
    return made.select("symbol", "ts", fn.log(F.col("trend")).alias("log_trend"), fn.rounded(F.col("seasonal_share"), 5).alias("seasonal_share"))


SIGNALS = """,
sj AS (SELECT a.symbol, a.ts, a.l - b.l AS rel FROM lp a JOIN (SELECT * FROM lp WHERE symbol = 'ALL') b ON a.ts = b.ts WHERE a.symbol <> 'ALL'),
s1 AS (SELECT *, rel - lag(rel) OVER w AS step, rel - lag(rel, 5) OVER w AS mom FROM sj WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s2 AS (SELECT *, greatest(stddev_pop(step) OVER (w ROWS 19 PRECEDING), 1e-6) AS relvol, (avg(rel) OVER (w ROWS 19 PRECEDING) - avg(rel) OVER (w ROWS 49 PRECEDING)) / greatest(stddev_pop(rel) OVER (w ROWS 49 PRECEDING), 1e-6) AS cr FROM s1 WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query(f"WITH {FEATURES}{SIGNALS}, rf AS (SELECT symbol, ts, {RSI} AS rsi FROM ft) SELECT s2.symbol, s2.ts, round(relvol, 5) + 0 AS relvol, round(cr * relvol, 5) + 0 AS crossing, round(greatest(least(mom / relvol, 4), -4) * relvol, 5) + 0 AS scaled_momentum, round(greatest(least((b.rsi - a.rsi) / 20, 2.5), -2.5) * relvol, 5) + 0 AS strength_signal FROM s2 JOIN rf a ON a.symbol = s2.symbol AND a.ts = s2.ts JOIN (SELECT * FROM rf WHERE symbol = 'ALL') b ON b.ts = s2.ts WHERE mom IS NOT NULL", digits=5)
def f11_rule_signals(spark, folder):
    return features.rule_signals(m.bars(spark, folder), m.BENCHMARK)


@query(f"WITH {BARS}, w AS (SELECT symbol, ts, list(adjusted_close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS c FROM adj) SELECT symbol, ts, CAST(i // 4 AS BIGINT) AS patch, round(ln(list_sum(c[i + 1 : i + 8])), 6) + 0 AS log_total FROM w, range(0, 13, 4) t(i) WHERE len(c) = 20")
def f20_patches(spark, folder):
    held = m.bars(spark, folder).select("symbol", "ts", F.collect_list("adjusted_close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-19, 0)).alias("c")).where("size(c) = 20")
    cut = held.select("symbol", "ts", F.posexplode(features.patches(F.col("c"), 8, 4)).alias("patch", "x"))
    return cut.select("symbol", "ts", "patch", fn.log(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("log_total"))


@query(f"WITH {BARS}, a AS (SELECT symbol, ts, volume * (open + high + low + close) / 4 AS amount FROM bars) SELECT symbol, ts, round(greatest(least((amount - avg(amount) OVER w) / greatest(stddev_pop(amount) OVER w, 1e-5), 5), -5), 4) + 0 AS amount_score FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)", digits=4)
def f21_amounts(spark, folder):
    return features.amounts(src.region_bars(spark, folder))


# forecasts and metrics


@query(f"WITH {PREDICTIONS} SELECT rule, symbol, ts, CAST(h AS BIGINT) AS h, round(c, 6) + 0 AS q50 FROM rm")
def g1_rules(spark, folder):
    return m.medians(spark, folder).select("rule", "symbol", "ts", "h", "q50")


@query(f"WITH {PREDICTIONS} SELECT rule, symbol, ts, CAST(h AS BIGINT) AS h, {r('alpha', 'q10', 'q50', 'q90', 'scale')} FROM pd")
def g2_quantiles(spark, folder):
    return m.predictions(spark, folder)


@query(f"WITH {PREDICTIONS} SELECT CAST(h AS BIGINT) AS h, rule, round(avg(abs(alpha - q50)), 6) + 0 AS mae, round(sqrt(avg((alpha - q50) * (alpha - q50))), 6) + 0 AS rmse, round(1 - avg((alpha - q50) * (alpha - q50)) / var_pop(alpha), 6) + 0 AS r2 FROM pd GROUP BY h, rule")
def g12_regression(spark, folder):
    return metrics.regression(m.predictions(spark, folder), "alpha", "q50", "h", "rule")


@query(f"WITH {LABELS}{SCALES.format(where='true')}{SIGNALS} SELECT symbol, ts, CAST(h AS BIGINT) AS h, round(least(greatest(relvol * sqrt(h), 0.1 * scale), 10 * scale), 6) + 0 AS anchor FROM s2, sc WHERE mom IS NOT NULL")
def g8_output_scale(spark, folder):
    scales = adjust.robust_scales(m.labels(spark, folder)).select("h", "scale")
    price = features.rule_signals(m.bars(spark, folder), m.BENCHMARK)
    return metrics.output_scales(price, scales)


@query(f"WITH {CUTOFFS} SELECT symbol, ts, dense_rank() OVER (ORDER BY ts) - 1 AS group_code, dense_rank() OVER (ORDER BY symbol) - 1 AS security_code FROM cand")
def g15_codes(spark, folder):
    return metrics.codes(m.cutoffs(spark, folder))


METRICS = "count(*) AS n, avg(pin) AS pinball, avg(pin / scale) AS norm_pinball, avg(abs(alpha - q50)) AS mae, " + CORR.format(x="alpha", y="q50") + " AS corr, avg(CAST(sign(round(alpha, 9)) = sign(round(q50, 9)) AS INT)) AS sign, avg(CAST(alpha BETWEEN q10 AND q90 AS INT)) AS coverage, avg(q90 - q10) AS width, abs(avg(CAST(alpha BETWEEN q10 AND q90 AS INT)) - 0.8) AS coverage_error"
NAMED = ("pinball", "norm_pinball", "mae", "corr", "sign", "coverage", "width", "coverage_error")


@query(f"WITH {PREDICTIONS} SELECT rule, CAST(h AS BIGINT) AS h, n, {r(*NAMED, digits=5)} FROM (SELECT rule, h, {METRICS} FROM pd GROUP BY rule, h)", digits=5)
def h2_metrics(spark, folder):
    return metrics.by_horizon(m.predictions(spark, folder), "rule")


@query(f"WITH {PREDICTIONS} SELECT rule, {', '.join(f'round(avg({c}), 5) + 0 AS {c}' for c in NAMED)}, round(avg(norm_pinball), 5) + 0 AS selection_score FROM (SELECT rule, h, {METRICS} FROM pd GROUP BY rule, h) GROUP BY rule", digits=5)
def h3_multi(spark, folder):
    return metrics.over_horizons(metrics.by_horizon(m.predictions(spark, folder), "rule"), "rule")


@query(f"WITH {CROSS} SELECT rule, CAST(h AS BIGINT) AS h, ts, n, round(ic, 6) + 0 AS ic FROM ic")
def h5_rank_ic(spark, folder):
    return metrics.rank_ic(m.predictions(spark, folder), "rule", "h")


@query(f"WITH {CROSS} SELECT rule, CAST(h AS BIGINT) AS h, ts, {r('gross', 'turnover', 'net')} FROM ls")
def h6_turnover(spark, folder):
    return metrics.long_short(m.predictions(spark, folder), "rule", "h")


@query(
    f"""
WITH {CROSS}, wl AS (SELECT *, exp(sum(net) OVER (PARTITION BY rule, h ORDER BY ts)) AS wealth FROM ls),
fl AS (SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY rule, h ORDER BY ts), 1) - 1 AS fall FROM wl),
ik AS (SELECT rule, h, avg(ic) AS ic_mean, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) ELSE 0 END AS ic_ratio FROM ic GROUP BY rule, h),
fs AS (SELECT rule, h, count(*) AS dates, avg(net) AS mean_return, CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) ELSE 0 END * sqrt(252.0 / h) AS sharpe, least(min(fall), 0) AS max_drawdown, avg(turnover) AS turnover FROM fl GROUP BY rule, h)
SELECT fs.rule, CAST(fs.h AS BIGINT) AS h, dates, {r('mean_return', 'sharpe', 'max_drawdown', 'turnover', 'ic_mean', 'ic_ratio', digits=5)} FROM fs LEFT JOIN ik ON fs.rule = ik.rule AND fs.h = ik.h""",
    digits=5,
)
def h7_portfolio(spark, folder):
    cross = m.predictions(spark, folder)
    return metrics.portfolio(metrics.long_short(cross, "rule", "h"), metrics.rank_ic(cross, "rule", "h"), "rule", "h")


@query(f"WITH {PREDICTIONS} SELECT rule, ts, round(avg(pin / scale), 6) + 0 AS loss, count(*) AS n FROM pd GROUP BY rule, ts")
def h8_daily(spark, folder):
    return metrics.daily(m.predictions(spark, folder), "rule")


LOSSES = ", dl AS (SELECT rule, ts, avg(pin / scale) AS loss FROM pd GROUP BY rule, ts), zl AS (SELECT ts, loss AS b FROM dl WHERE rule = 'zero'), dd AS (SELECT rule, a.ts, loss, b FROM dl a LEFT JOIN zl ON a.ts = zl.ts WHERE rule <> 'zero')"


@query(f"WITH {PREDICTIONS}{LOSSES} SELECT rule, round(avg(loss - b), 6) + 0 AS difference, count(b) AS dates, count(*) + (SELECT count(*) FROM zl) - 2 * count(b) AS unmatched FROM dd GROUP BY rule")
def h9_paired_mean(spark, folder):
    losses = m.losses(spark, folder)
    return metrics.paired(losses.where("rule <> 'zero'"), losses.where("rule = 'zero'"), "rule")


DIGESTS = "ds AS (SELECT month, symbol, sha256(string_agg(CAST(ts AS VARCHAR), ',' ORDER BY ts)) AS d, count(*) AS n, min(ts) AS a, max(ts) AS b FROM p GROUP BY month, symbol)"


@query(f"WITH {LABELS}, p AS (SELECT DISTINCT symbol, ts, strftime(ts, '%Y-%m') AS month FROM lab), {DIGESTS} SELECT month, sha256(string_agg(symbol || ',' || d, ';' ORDER BY symbol)) AS digest, CAST(sum(n) AS BIGINT) AS samples, min(a) AS first_at, max(b) AS last_at FROM ds GROUP BY month")
def h10_membership(spark, folder):
    return metrics.membership(m.labels(spark, folder))


@query(f"WITH {PREDICTIONS} SELECT CAST(h AS BIGINT) AS h, symbol, month, year, count(*) AS n, round(avg(pin / scale), 6) + 0 AS norm_pinball FROM (SELECT *, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') AS year FROM pd) GROUP BY GROUPING SETS ((h), (h, symbol), (h, month), (h, year))")
def h12_grouping_sets(spark, folder):
    return metrics.subgroups(m.predictions(spark, folder))


@query(f"WITH {PREDICTIONS} SELECT CAST(h AS BIGINT) AS h, CAST(CASE WHEN q10 > 0.02 THEN 4 WHEN q50 > 0.02 THEN 3 WHEN q90 < -0.02 THEN 0 WHEN q50 < -0.02 THEN 1 ELSE 2 END AS BIGINT) AS level, count(*) AS n FROM pd GROUP BY 1, 2")
def h13_signals(spark, folder):
    return metrics.signals(m.predictions(spark, folder), 0.02)


@query("SELECT o_orderpriority AS model, count(o_totalprice) AS runs, round(median(o_totalprice), 4) + 0 AS median, min(o_totalprice) AS least, max(o_totalprice) AS most, row_number() OVER (ORDER BY median(o_totalprice) NULLS LAST, o_orderpriority) AS rank FROM orders GROUP BY o_orderpriority", digits=4)
def h18_ranking(spark, folder):
    return metrics.comparison(t(spark, folder, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("score")))


@query("SELECT o_custkey, arg_min(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS state FROM orders GROUP BY o_custkey")
def h20_state_reduce(spark, folder):
    level = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    return t(spark, folder, "orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", level).alias("state"))


#: Symbols of a date that are paired, as a batch has so many at most.
PAIRED = 512


@query(f"WITH {CROSS}, pk AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY rule, h, ts ORDER BY md5(symbol), symbol) <= {PAIRED}), x AS (SELECT a.rule, a.h, a.ts, (a.alpha - b.alpha) / a.scale AS gap, (a.q50 - b.q50) / a.scale AS d FROM pk a JOIN pk b ON a.rule = b.rule AND a.h = b.h AND a.ts = b.ts AND a.symbol < b.symbol) SELECT rule, CAST(h AS BIGINT) AS h, ts, count(*) AS pairs, round(avg(ln(1 + exp(-sign(gap) * d))), 6) + 0 AS loss FROM x WHERE abs(gap) > 0.01 GROUP BY rule, h, ts")
def g16_pairs(spark, folder):
    return metrics.pair_losses(m.predictions(spark, folder), "rule", "h", most=PAIRED)


def probe_rows(spark, folder):
    """Features, the five-day label, and whether a row trains."""
    rows = features.feature_rows(m.bars(spark, folder), m.BENCHMARK).join(m.labels(spark, folder).where("h = 5").select("symbol", "ts", "alpha"), ["symbol", "ts"])
    return rows.withColumn("trains", F.col("ts") < F.lit(m.TRAIN_END).cast("date"))


def ridge_sql(columns: int, penalty: float = 10.0) -> str:
    """From learn (kind, x0, ..., y) to wt (kind, b: the mean of y, and for each column its mean, scale and weight):
    the normal equations of standardised columns, by elimination written out."""
    n = range(columns)
    sums = ", ".join([f"avg(x{i}) AS m{i}, CASE WHEN sqrt(var_pop(x{i})) < 1e-12 THEN 1 ELSE sqrt(var_pop(x{i})) END AS s{i}" for i in n] + [f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i in n for j in n] + [f"covar_pop(x{i}, y) AS d{i}" for i in n])
    table = ", ".join([f"k * c{i}{j} / (s{i} * s{j}) + {penalty if i == j else 0}::DOUBLE AS a{i}{j}" for i in n for j in n] + [f"k * d{i} / s{i} AS r{i}" for i in n])
    kept = ", ".join(["kind, b", *[f"m{i}, s{i}" for i in n]])
    steps = [f"sm AS (SELECT kind, count(*) AS k, avg(y) AS b, {sums} FROM learn GROUP BY kind)", f"e0 AS (SELECT {kept}, {table} FROM sm)"]
    for p in n[:-1]:
        rows = [f"a{i}{j}" if i <= p else f"a{i}{j} - a{i}{p} / a{p}{p} * a{p}{j} AS a{i}{j}" for i in n for j in n] + [f"r{i}" if i <= p else f"r{i} - a{i}{p} / a{p}{p} * r{p} AS r{i}" for i in n]
        steps.append(f"e{p + 1} AS (SELECT {kept}, {', '.join(rows)} FROM e{p})")
    last = f"e{columns - 1}"
    for p in reversed(n):
        known = "".join(f" - a{p}{j} * w{j}" for j in n if j > p)
        steps.append(f"f{p} AS (SELECT *, (r{p}{known}) / a{p}{p} AS w{p} FROM {last})")
        last = f"f{p}"
    return ",\n".join([*steps, f"wt AS (SELECT {kept}, {', '.join(f'w{i}' for i in n)} FROM {last})"])


PROBE = f""",
pb AS (SELECT f.symbol, f.ts, f.ret_5 AS x0, f.sma_20 AS x1, f.ret_5 - b.ret_5 AS x2, {RSI} AS x3, alpha AS y, f.ts < DATE '1996-01-01' AS trains FROM ft f JOIN (SELECT ts, ret_5 FROM ft WHERE symbol = 'ALL') b ON f.ts = b.ts JOIN lab ON lab.symbol = f.symbol AND lab.ts = f.ts AND h = 5 WHERE f.symbol <> 'ALL'),
ct AS (SELECT x0, x1, x2, x3, g.y FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY symbol) AS at FROM pb WHERE trains) p JOIN (SELECT ts, y, row_number() OVER (PARTITION BY ts ORDER BY md5('11:' || symbol), symbol) AS at FROM pb WHERE trains) g ON p.ts = g.ts AND p.at = g.at),
learn AS (SELECT 'ridge' AS kind, x0, x1, x2, x3, y FROM pb WHERE trains UNION ALL SELECT 'control', * FROM ct),
{ridge_sql(4)},
gs AS (SELECT kind, symbol, y, b + {" + ".join(f"(x{i} - m{i}) / s{i} * w{i}" for i in range(4))} AS p FROM pb, wt WHERE NOT trains)"""


@query(f"WITH {FEATURES}{LABELS.replace(BARS, '')}{PROBE} SELECT kind, symbol, round(avg(abs(y - p)), 5) + 0 AS mae, round(sqrt(avg((y - p) * (y - p))), 5) + 0 AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 5) + 0 AS r2 FROM gs GROUP BY kind, symbol", digits=5)
def g11_ridge(spark, folder):
    """Learned from labels, and as a control from labels that changed hands on each training date."""
    columns = ["ret_5", "sma_20", "diff_ret_5", "rsi"]
    rows = probe_rows(spark, folder)
    train = rows.where("trains")
    fits = {"ridge": models.fit_ridge(train, columns, "alpha"), "control": models.fit_ridge(models.shuffled_labels(train, "alpha", 11), columns, "alpha")}
    predicted = [F.when(F.lit(fit is not None), F.struct(F.lit(kind).alias("kind"), (fit.predict() if fit else F.lit(0.0)).alias("predicted"))) for kind, fit in fits.items()]
    each = F.explode(F.array_compact(F.array(*predicted))).alias("x")  # without training rows there is no probe
    made = rows.where("not trains").select("symbol", "alpha", each).select("symbol", "alpha", "x.kind", "x.predicted")
    return metrics.regression(made, "alpha", "predicted", "kind", "symbol")


#: Trees of the query's model. The published setting, 200, is the operator's default.
BOOST_ROUNDS = 3


@query()
def g4_quantile_boost(spark, folder):
    """All thirty features, all horizons and quantiles at once."""
    rows = features.feature_rows(m.bars(spark, folder), m.BENCHMARK).join(m.labels(spark, folder).groupBy("symbol", "ts").agg(*[F.max(F.when(F.col("h") == h, F.col("alpha"))).alias(f"alpha_{h}") for h in m.HORIZONS]), ["symbol", "ts"])
    columns, targets = [c for c in rows.columns if c.split("_")[-1] != "ts" and c != "symbol" and not c.startswith("alpha_")], [f"alpha_{h}" for h in m.HORIZONS]
    fit = boosting.fit(m.training(rows), columns, targets, metrics.QUANTILES, rounds=BOOST_ROUNDS)
    later = rows.where(F.col("ts") >= F.lit(m.TRAIN_END).cast("date"))
    made = fit.predict(later) if fit else later.withColumn("predicted", F.array_repeat(F.lit(0.0), len(targets) * len(metrics.QUANTILES)))
    of = lambda i: F.array_sort(F.slice("predicted", 3 * i + 1, 3))
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"alpha_{h}").alias("alpha"), of(i).alias("q")) for i, h in enumerate(m.HORIZONS)])).alias("x")
    scored = made.select("symbol", each).select("symbol", "x.h", "x.alpha", *[F.col("x.q")[i].alias(n) for i, n in enumerate(metrics.NAMES)]).where("alpha is not null")
    return scored.groupBy("symbol", "h").agg(F.count("*").alias("n"), F.avg(metrics.pinball()).alias("pinball"), F.avg(F.col("alpha").between(F.col("q10"), F.col("q90")).cast("double")).alias("coverage"))


# sorts and sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def i2_topk(spark, folder):
    return windows.top_by(t(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)


@query("SELECT o_custkey, max(o_orderdate) AS at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def i4_latest(spark, folder):
    return t(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query(f"WITH {BARS} SELECT symbol, ts, close FROM bars UNION ALL SELECT p_brand, CAST(l_shipdate AS DATE), arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2", digits=None)
def i9_union(spark, folder):
    return store.union_all([src.region_bars(spark, folder).select("symbol", "ts", "close"), src.brand_bars(spark, folder).select("symbol", "ts", "close")])


@query("SELECT c_custkey FROM customer EXCEPT SELECT l_suppkey FROM lineitem")
def i11_except(spark, folder):
    return t(spark, folder, "customer").select("c_custkey").exceptAll(t(spark, folder, "lineitem").select(F.col("l_suppkey").alias("c_custkey")).distinct())


@query(f"WITH {CUTOFFS}{FIXED} SELECT ts FROM fx WHERE split = 'train' INTERSECT SELECT ts FROM fx WHERE split = 'label_crosses'")
def i12_intersect(spark, folder):
    s = fixed_split(spark, folder)
    return s.where("split = 'train'").select("ts").intersect(s.where("split = 'label_crosses'").select("ts"))


NUMBERS = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN format('{:,.2f}', o_totalprice) WHEN 1 THEN '+' || CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '--' WHEN 3 THEN ' ' ELSE 'x1' END AS s FROM orders"


@query(f"SELECT o_orderkey, TRY_CAST(nullif(nullif(trim(regexp_replace(s, '[,+]', '', 'g')), ''), '--') AS DOUBLE) AS n FROM ({NUMBERS})")
def k3_numbers(spark, folder):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.format_number("o_totalprice", 2)).when(k == 1, F.concat(F.lit("+"), F.col("o_orderkey").cast("string"))).when(k == 2, "--").when(k == 3, " ").otherwise("x1")
    return t(spark, folder, "orders").select("o_orderkey", fn.lenient_number(text).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def k4_roc_dates(spark, folder):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    year = F.year(d) - 1911
    text = (
        F.when(k == 0, F.concat(year.cast("string"), F.date_format(d, "MMdd")))
        .when(k == 1, F.concat(F.lpad(year.cast("string"), 3, "0"), F.date_format(d, "MMdd")))
        .when(k == 2, F.concat(year.cast("string"), F.lit("年"), F.date_format(d, "MM"), F.lit("月"), F.date_format(d, "dd"), F.lit("日")))
        .when(k == 3, F.date_format(d, "yyyyMMdd"))
        .otherwise("not a day")
    )
    return t(spark, folder, "orders").select("o_orderkey", fn.minguo_date(text).alias("day"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, i, CAST(100 + ceil(i * 1000 / 8.0) AS BIGINT) AS step FROM nation, range(1, 9) t(i)")
def p1_schedule(spark, folder):
    return t(spark, folder, "nation").select("n_nationkey", F.posexplode(fn.even_steps(100, 1000, 8)).alias("i", "step")).withColumn("i", F.col("i") + 1)


@query("WITH RECURSIVE v AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), f AS (SELECT o_custkey, i, x AS best, i AS pl, 0 AS stale, -1 AS stopped FROM v WHERE i = 0 UNION ALL SELECT v.o_custkey, v.i, CASE WHEN f.stopped >= 0 OR x >= best - 100 THEN best ELSE x END, CASE WHEN f.stopped >= 0 OR x >= best - 100 THEN pl ELSE v.i END, CASE WHEN f.stopped >= 0 THEN stale WHEN x < best - 100 THEN 0 ELSE stale + 1 END, CASE WHEN f.stopped >= 0 THEN f.stopped WHEN x < best - 100 THEN -1 WHEN stale + 1 >= 3 THEN v.i ELSE -1 END FROM f JOIN v ON v.o_custkey = f.o_custkey AND v.i = f.i + 1) SELECT o_custkey, arg_max(best, i) AS best, CAST(arg_max(pl, i) AS BIGINT) AS best_at, CAST(arg_max(stopped, i) AS BIGINT) AS stopped FROM f GROUP BY o_custkey")
def p3_early_stop(spark, folder):
    held = t(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("v"))
    return held.select("o_custkey", fn.early_stop(F.transform("v", lambda x: x["o_totalprice"]), 3, 100.0).alias("s")).select("o_custkey", "s.best", F.col("s.at").alias("best_at"), "s.stopped")


@query("SELECT event_id, round(CASE WHEN event_id % 200 < 20 THEN (event_id % 200) / 20.0 ELSE 0.5 * (1 + cos(pi() * (event_id % 200 - 20) / 180.0)) END, 6) + 0 AS factor FROM events")
def p5_warm_cosine(spark, folder):
    return t(spark, folder, "events").select("event_id", fn.warm_cosine(F.col("event_id") % 200, 20, 200).alias("factor"))


@query(
    """
WITH v AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY 1),
f AS (SELECT o_custkey, list_reduce(list_prepend({'best': 'Infinity'::DOUBLE, 'stale': 0, 'rate': 1.0::DOUBLE}, list_transform(v, lambda x: {'best': x, 'stale': 0, 'rate': 1.0::DOUBLE})),
      lambda a, b: {'best': least(a.best, b.best), 'stale': CASE WHEN b.best < a.best OR a.stale >= 1 THEN 0 ELSE a.stale + 1 END, 'rate': CASE WHEN b.best < a.best OR a.stale < 1 THEN a.rate ELSE greatest(a.rate * 0.3::DOUBLE, 0.09::DOUBLE) END}) AS s FROM v)
SELECT o_custkey, round(s.rate, 6) + 0 AS rate FROM f"""
)
def p4_plateau(spark, folder):
    held = t(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("v"))
    return held.select("o_custkey", F.element_at(fn.plateau_rate(F.transform("v", lambda x: x["o_totalprice"])), -1).alias("rate"))


PAYLOAD = """'{"h":' || h || ',"q10":' || printf('%.4f', round(q10, 4) + 0) || ',"q50":' || printf('%.4f', round(q50, 4) + 0) || ',"q90":' || printf('%.4f', round(q90, 4) + 0) || '}'"""


@query(f"WITH {PREDICTIONS} SELECT rule, symbol, ts, '[' || string_agg({PAYLOAD}, ',' ORDER BY h) || ']' AS forecast, count(*) AS horizons FROM pd GROUP BY rule, symbol, ts")
def h14_payload(spark, folder):
    return metrics.forecast_payload(m.predictions(spark, folder), "rule", "symbol", "ts")


@query("SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, round(arg_min(value, (ts, event_id)), 6) + 0 AS open, round(max(value), 6) + 0 AS high, round(min(value), 6) + 0 AS low, round(arg_max(value, (ts, event_id)), 6) + 0 AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value > 0 GROUP BY 1, 2")
def l_hourly_bars(spark, folder):
    return hourly(t(spark, folder, "events")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _all() -> None:
    """Registers the queries of the other modules."""
    from . import evaluation_queries, intake_queries, market_queries, sample_queries, store_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
