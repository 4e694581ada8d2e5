"""Queries of vendor names and types, checks, sinks and observations (A, B, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import months
from ..operators import adjust, intake, payloads, store
from ..sources import bars as src
from . import market as m
from .catalogue import FIXED, RAW, fixed_split, query, raw_rows, t
from .oracle import BARS, CUTOFFS, r

BRAND_BARS = """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, CAST(count(*) AS DOUBLE) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""

# names and types


def vendor_rows(spark, folder):
    """Orders as a vendor might send them: other names, all texts, some of them unusable."""
    key = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return t(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.concat(F.lit(" o"), key.cast("string"), F.lit(" ")).alias("Ticker"),
        F.lit(" Stock").alias("Type"),
        price.alias("Open"),
        (price * 1.01).alias("High"),
        (price * 0.99).alias("Low"),
        price.alias("Close"),
        F.when(key % 7 == 0, "x").otherwise("10").alias("Volume"),
        (price * 0.5).alias("Adj Close"),
        F.concat(F.lit(" "), F.col("o_orderstatus")).alias("Provider"),
        F.when(key % 3 == 0, "true").otherwise("unknown").alias("Is-Active"),
        F.lit(1).alias("unused"),
    )


@query(
    """
SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, 'O' || o_orderkey AS symbol, 'stock' AS asset_type, round(o_totalprice, 4) + 0 AS open, round(o_totalprice * 1.01, 4) + 0 AS high,
       round(o_totalprice * 0.99, 4) + 0 AS low, round(o_totalprice, 4) + 0 AS close, CASE WHEN o_orderkey % 7 <> 0 THEN 10::DOUBLE END AS volume, round(o_totalprice * 0.5, 4) + 0 AS adjusted_close,
       o_orderstatus AS provider, CASE WHEN o_orderkey % 3 = 0 THEN true END AS is_active
FROM orders""",
    digits=4,
)
def b1_normalise(spark, folder):
    return intake.normalised(vendor_rows(spark, folder))


@query(f"WITH {BARS} SELECT symbol, ts, {r('open', 'high', 'low', 'close', 'volume')} FROM bars")
def b2_fail_closed(spark, folder):
    return intake.validated(src.region_bars(spark, folder))


@query(
    f"""
WITH raw AS ({RAW})
SELECT symbol, CASE WHEN ts IS NULL THEN 'missing_ts' WHEN symbol IS NULL OR trim(symbol) = '' THEN 'empty_symbol'
            WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR isnan(open) OR isnan(high) OR isnan(low) OR isnan(close) OR isnan(volume) THEN 'non_finite'
            WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price' WHEN volume < 0 THEN 'negative_volume'
            WHEN high + 1e-8 < greatest(open, low, close) THEN 'high_below' WHEN low - 1e-8 > least(open, high, close) THEN 'low_above' ELSE 'none' END AS rule, count(*) AS n
FROM raw GROUP BY 1, 2"""
)
def b2_first_rule(spark, folder):
    rows = raw_rows(spark, folder)
    return rows.select("symbol", F.coalesce(intake.broken_rule(rows.columns), F.lit("none")).alias("rule")).groupBy("symbol", "rule").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN upper(c_mktsegment) IN ('BUILDING', 'MACHINERY') THEN 'etf' ELSE 'stock' END AS asset_type FROM customer")
def b4_asset_types(spark, folder):
    return t(spark, folder, "customer").select("c_custkey", intake.asset_type_of(F.col("c_mktsegment"), ["building", "Machinery"]).alias("asset_type"))


def taiwan_codes(column):
    """Codes of all forms from a number."""
    k, text = column % 8, lambda x: x.cast("string")
    padded = F.lpad(text(column % 97), 2, "0")
    return (
        F.when(k == 0, text(1000 + column % 8999))
        .when(k == 1, F.concat(F.lit("00"), padded))
        .when(k == 2, F.concat(F.lit("91"), padded))
        .when(k == 3, F.concat(F.lit("91"), padded, padded))
        .when(k == 4, F.concat(text(1000 + column % 8999), F.char(65 + F.floor(column / 8) % 26)))
        .when(k == 5, text(200000 + column % 7000))
        .when(k == 6, F.concat(F.lit("03"), padded, padded, F.lit("P")))
        .otherwise(F.concat(F.lit("X"), text(column)))
    )


def taiwan_sql(key: str) -> str:
    padded = f"lpad(CAST({key} % 97 AS VARCHAR), 2, '0')"
    return f"CASE {key} % 8 WHEN 0 THEN CAST(1000 + {key} % 8999 AS VARCHAR) WHEN 1 THEN '00' || {padded} WHEN 2 THEN '91' || {padded} WHEN 3 THEN '91' || {padded} || {padded} WHEN 4 THEN CAST(1000 + {key} % 8999 AS VARCHAR) || chr(CAST(65 + ({key} // 8) % 26 AS INTEGER)) WHEN 5 THEN CAST(200000 + {key} % 7000 AS VARCHAR) WHEN 6 THEN '03' || {padded} || {padded} || 'P' ELSE 'X' || {key} END"


FUNDS = ["0001", "0009", "0017", "0050", "0056"]
ALLOWED = ", ".join(f"'{f}'" for f in FUNDS)
TAIWAN_TYPE = f"CASE WHEN regexp_full_match(code, '91([0-9]{{2}}|[0-9]{{4}})') THEN 'stock' WHEN regexp_full_match(code, '00[0-9A-Z]{{2,6}}') THEN CASE WHEN code IN ({ALLOWED}) THEN 'etf' END WHEN regexp_full_match(code, '[1-9][0-9]{{3}}') THEN 'stock' END"
WHY_NOT = "CASE WHEN regexp_full_match(code, '00[0-9A-Z]{2,6}') THEN 'non_allowlisted_etf_code' WHEN regexp_full_match(code, '[1-9][0-9]{3}[A-E]') THEN 'preferred_stock_code' WHEN regexp_full_match(code, '[1-9][0-9]{3}[L-Z]') THEN 'rights_certificate_code' WHEN regexp_full_match(code, '[0-9]{6}') THEN 'six_digit_numeric_security_code' ELSE 'unsupported_symbol_code' END"


@query(f"WITH c AS (SELECT p_partkey, {taiwan_sql('p_partkey')} AS code FROM part), k AS (SELECT *, {TAIWAN_TYPE} AS asset_type FROM c) SELECT p_partkey, code, asset_type, CASE WHEN asset_type IS NULL THEN {WHY_NOT} END AS why_not FROM k")
def b7_taiwan_types(spark, folder):
    rows = t(spark, folder, "part").select("p_partkey", taiwan_codes(F.col("p_partkey")).alias("code"))
    rows = rows.withColumn("asset_type", intake.taiwan_type(F.col("code"), FUNDS))
    return rows.withColumn("why_not", F.when(F.col("asset_type").isNull(), intake.unsupported_type(F.col("code"))))


@query("SELECT c_custkey, c_nationkey % 5 + 1 AS first, c_nationkey % 5 + 1 <= 3 AND c_custkey % 4 <> 0 AS good FROM customer")
def b14_horizons(spark, folder):
    first, last = F.col("c_nationkey") % 5 + 1, F.when(F.col("c_custkey") % 4 == 0, 13).otherwise(14)
    return t(spark, folder, "customer").select("c_custkey", first.alias("first"), intake.contiguous(F.sequence(first, last)).alias("good"))


@query("SELECT 'props' AS column, count(*) AS n_rows FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'user_token', count(*) FROM events WHERE event_id % 5 = 0")
def b15_secrets(spark, folder):
    e = t(spark, folder, "events")
    url = F.when(F.col("event_id") % 3 == 0, "https://host/eod?API_TOKEN=abc").otherwise(F.lit("https://host/eod"))
    return intake.secrets(e.select("event_id", "event_type", url.alias("props"), F.when(F.col("event_id") % 5 == 0, "x").alias("user_token")))


# sinks and logs


@query(f"WITH {BARS} SELECT symbol, count(*) AS n_rows, count(DISTINCT symbol) AS symbols, count(DISTINCT nation) AS markets, min(ts) AS first_at, max(ts) AS last_at FROM o GROUP BY symbol")
def a3_sink_counts(spark, folder):
    return intake.sink_counts(src.order_trades(spark, folder).withColumnRenamed("nation", "market"), "symbol")


@query("SELECT event_type AS provider, count(*) AS requests, count(*) FILTER (event_id % 3 = 0) AS hits, CAST(sum(event_id % 7) AS BIGINT) AS n_rows FROM events GROUP BY 1")
def a4_request_log(spark, folder):
    log = t(spark, folder, "events").select("event_id", F.col("event_type").alias("provider"), (F.col("event_id") % 3 == 0).alias("cache_hit"), (F.col("event_id") % 7).alias("n_rows"))
    return intake.request_stats(intake.merged_requests([log.where("n_rows < 3").drop("event_id"), log.where("n_rows >= 3")]))


@query("SELECT o_orderkey, round(o_totalprice, 2) + 0 AS price, o_orderstatus AS status FROM orders", digits=2)
def a5_strict_records(spark, folder):
    rows = t(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.struct(F.col("o_orderstatus").alias("status")).alias("nested"))
    back = src.from_envelopes(intake.strict_json(rows), rows.schema)
    return back.select("o_orderkey", "price", "nested.status")


@query(f"SELECT ts, {r('high', 'low', 'volume')} FROM ({BRAND_BARS}) WHERE symbol = 'Brand#11'")
def a11_symbol_read(spark, folder):
    """A point read of one symbol is what this operator is."""
    return intake.one_symbol(src.brand_bars(spark, folder), "Brand#11", "high", "low", "volume")


@query(f"WITH {BARS} SELECT symbol, ts, {r('close')}, 'orders' AS provider, 'R' AS market, 'USD' AS currency FROM bars")
def a16_stamp(spark, folder):
    return intake.stamped(src.region_bars(spark, folder).select("symbol", "ts", "close"), provider="orders", market="R", currency="USD")


def action_texts(spark, folder):
    """Lines as rows of an exchange's table of actions, all texts."""
    k = F.col("l_orderkey") % 5
    free = F.when(k == 0, "--").when(k == 1, "-1").otherwise("50")
    prior = F.when(k == 2, F.lit("0")).otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    reference = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,2)").cast("string")
    day = F.concat((F.year("l_shipdate") - 1911).cast("string"), F.date_format("l_shipdate", "/MM/dd"))
    return t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit(" "), taiwan_codes(F.col("l_partkey"))).alias("code"), day.alias("day"), prior.alias("prior"), reference.alias("reference"), free.alias("free_shares"))


@query(
    f"""
WITH c AS (SELECT *, {taiwan_sql('l_partkey')} AS code FROM lineitem), k AS (SELECT *, {TAIWAN_TYPE} AS asset_type FROM c)
SELECT l_orderkey, l_linenumber, code || '.TWO' AS symbol, CAST(l_shipdate AS DATE) AS ts, round(CAST(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,2)) AS DOUBLE) / CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE), 4) + 0 AS price_factor, 1.05::DOUBLE AS share_multiplier
FROM k WHERE asset_type IS NOT NULL AND l_orderkey % 5 > 2""",
    digits=4,
)
def a20_inline_actions(spark, folder):
    return payloads.inline_actions(action_texts(spark, folder), FUNDS, ".TWO").drop("source")


@query("SELECT event_id, event_id % 6 IN (1, 2, 3, 5) AS empty FROM events")
def a22_no_data(spark, folder):
    said = ['{"stat": "OK", "tables": [{"a": 1}]}', '{"stat": "OK", "tables": []}', '{"status": "No Data found"}', '{"stat": "很抱歉，沒有符合條件的資料!"}', '{"stat": "OK", "data": [[1]]}', '{"data": []}']
    chosen = F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % 6).cast("int") + 1)
    return t(spark, folder, "events").select("event_id", intake.says_no_data(chosen).alias("empty"))


@query(f"WITH {BARS} SELECT symbol, ts, {r('close', 'adjusted_close', 'split_adjusted_volume', digits=5)}, 'exchange' AS provider FROM adj", digits=5)
def a23_adjusted_quotes(spark, folder):
    """All dates at once: quotes with the actions of the whole market, and their source."""
    made = adjust.back_adjust(src.region_bars(spark, folder), src.order_actions(spark, folder))
    return intake.stamped(made.select("symbol", "ts", "close", "adjusted_close", "split_adjusted_volume"), provider="exchange")


@query(f"WITH {BARS}, a AS (SELECT 'lines' AS provider, symbol, ts FROM ({BRAND_BARS}) UNION ALL SELECT 'orders', symbol, ts FROM bars) SELECT provider, count(*) AS n_rows, count(DISTINCT symbol) AS symbols, count(DISTINCT CASE provider WHEN 'lines' THEN 'P' END) AS markets, min(ts) AS first_at, max(ts) AS last_at FROM a GROUP BY provider")
def a30_assembly(spark, folder):
    parts = {"orders": src.region_bars(spark, folder), "lines": src.brand_bars(spark, folder).withColumn("market", F.lit("P"))}
    return intake.sink_counts(intake.assembled(parts), "provider")


@query(f"WITH {BARS} SELECT symbol, ts, round(close, 5) + 0 AS adjusted_close, round(volume, 5) + 0 AS split_adjusted_volume FROM bars", digits=5)
def c1_ensure_anchors(spark, folder):
    return adjust.ensure_anchors(src.region_bars(spark, folder)).select("symbol", "ts", "adjusted_close", "split_adjusted_volume")


@query(f"WITH {BARS} SELECT symbol, ts, have, round(CASE WHEN have IN ('both', 'price') THEN close / 2 ELSE close END, 5) + 0 AS adjusted_close, round(CASE WHEN have IN ('both', 'volume') THEN volume * 2 ELSE volume END, 5) + 0 AS split_adjusted_volume FROM bars, (VALUES ('none'), ('price'), ('volume'), ('both')) k(have)", digits=5)
def c1_some_anchors(spark, folder):
    """Bars that have none of the adjusted columns, one or the other, and both."""
    bars, half, twice = src.region_bars(spark, folder), F.col("close") / 2, F.col("volume") * 2
    cases = {"none": {}, "price": {"adjusted_close": half}, "volume": {"split_adjusted_volume": twice}, "both": {"adjusted_close": half, "split_adjusted_volume": twice}}
    parts = [adjust.ensure_anchors(bars.withColumns(more) if more else bars).select("symbol", "ts", F.lit(have).alias("have"), "adjusted_close", "split_adjusted_volume") for have, more in cases.items()]
    return store.union_all(parts)


# observations and audits


@query(f"WITH {CUTOFFS}{FIXED} SELECT symbol, ts, idx, label_end FROM fx WHERE split = 'validation'")
def b11_split_filter(spark, folder):
    return store.of_split(fixed_split(spark, folder), "validation")


@query(
    f"""
WITH {BARS}, seen AS (SELECT * FROM adj WHERE ts <= DATE '1997-06-30'),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM seen WHERE symbol <> 'ALL'),
w AS (SELECT l.*, b.adjusted_close AS bc FROM l LEFT JOIN (SELECT ts, adjusted_close FROM seen WHERE symbol = 'ALL') b ON l.ts = b.ts WHERE back <= 20),
g AS (SELECT symbol FROM w GROUP BY symbol HAVING count(*) = 20 AND count(bc) = 20)
SELECT w.symbol, w.ts, round(w.adjusted_close / z.adjusted_close * z.close, 4) + 0 AS close, round(w.bc / z.bc, 4) + 0 AS bench_close
FROM w JOIN g ON w.symbol = g.symbol JOIN w z ON z.symbol = w.symbol AND z.back = 1""",
    digits=4,
)
def b12_observations(spark, folder):
    made = intake.observations(m.bars(spark, folder), m.BENCHMARK, m.WINDOW, "1997-06-30")
    return made.select("symbol", F.explode("window").alias("x")).select("symbol", "x.*")


@query(f"WITH {BARS}, l AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars) SELECT symbol, ts, {r('close')} FROM l WHERE back <= 7")
def i6_tail(spark, folder):
    return intake.tail(src.region_bars(spark, folder).select("symbol", "ts", "close"), 7, "symbol")


@query(
    f"""
WITH {CUTOFFS}{FIXED}, b(split, lower, upper) AS (VALUES ('train', DATE '0001-01-01', DATE '1996-01-01'), ('validation', DATE '1996-01-01', DATE '1997-01-01'), ('test', DATE '1997-01-01', DATE '1998-01-01'))
SELECT symbol AS market, fx.split, count(DISTINCT ts) AS dates, min(ts) AS first_at, max(ts) AS last_at, max(label_end) AS label_end_max_at,
       min(ts) >= any_value(lower) AND max(ts) < max(label_end) AND max(label_end) < any_value(upper) AS inside, count(DISTINCT ts) >= 150 AS enough
FROM fx JOIN b ON fx.split = b.split GROUP BY 1, 2"""
)
def b9_split_dates(spark, folder):
    bounds = {"train": ("0001-01-01", m.TRAIN_END), "validation": (m.TRAIN_END, m.VALIDATION_END), "test": (m.VALIDATION_END, m.TEST_END)}
    return store.split_dates(fixed_split(spark, folder).withColumnRenamed("symbol", "market"), bounds, 150)


@query(
    f"""
WITH {CUTOFFS}{FIXED}, s AS (SELECT symbol, CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS turn, min(idx) AS a, max(idx) + 1 AS b, count(*) AS n FROM fx WHERE split IN ('train', 'validation', 'test') GROUP BY 1, 2)
SELECT symbol, CAST(turn AS BIGINT) AS turn, a AS start_index, b AS stop_index, n AS count, coalesce(a >= lag(b) OVER (PARTITION BY symbol ORDER BY turn), true) AS after_before FROM s"""
)
def b10_split_order(spark, folder):
    return store.split_order(fixed_split(spark, folder))


@query("SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, CAST(last_day(o_orderdate) AS DATE) AS last_day FROM orders")
def k6_months(spark, folder):
    days = t(spark, folder, "orders").select(F.to_date("o_orderdate").alias("ts"))
    made = days.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(months(F.col("a"), F.col("b"))).alias("x")).select("x.*")
    return made.join(days.select(F.trunc("ts", "month").alias("first_day")).distinct(), "first_day")


@query("SELECT event_type AS provider, CASE event_id % 3 WHEN 0 THEN 'preferred' WHEN 1 THEN 'rights' ELSE 'other' END AS kind, count(*) AS n_rows FROM events GROUP BY GROUPING SETS ((1, 2), (2), ())".replace("(1, 2), (2), ()", "(provider, kind), (kind), ()"))
def h19_skipped_actions(spark, folder):
    kind = F.element_at(F.array(*map(F.lit, ["preferred", "rights", "other"])), (F.col("event_id") % 3).cast("int") + 1)
    return intake.skipped_actions(t(spark, folder, "events").select(F.col("event_type").alias("provider"), kind.alias("kind")))
