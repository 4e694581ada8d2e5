"""Operators against plain restatements of their rules, on small made-up tables."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom import functions as fn
from barloom.operators import adjust, features, intake, metrics, models, payloads, samples, store, windows
from barloom.plans import market
from barloom.sources import bars as src
from barloom.streaming import append_bars, hourly


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(4)
    rows = []
    for s in ("A", "B", "ALL"):
        price = 100.0
        for i in range(120):
            if s != "ALL" and rng.random() < 0.05 or s == "ALL" and i % 50 == 49:
                continue
            price *= math.exp(rng.gauss(0, 0.02) + (2.0 if s == "B" and i == 60 else 0))
            rows.append((s, date(2024, 1, 1) + timedelta(days=i), price * 0.99, price * 1.02, price * 0.97, price, 1000.0 + i))
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


def held(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["symbol"], []).append(r)
    return {s: sorted(v, key=lambda r: r["ts"]) for s, v in out.items()}


def test_actions_touch_earlier_bars_only(spark, bars):
    acts = spark.createDataFrame([("a ", date(2024, 2, 1), 0.5, 2.0, "x"), ("A", date(2024, 2, 1), 0.1, 10.0, "y"), ("A", date(2024, 3, 3), 0.25, 4.0, "x"), ("B", date(2024, 3, 3), -1.0, 1.0, "bad")], "symbol string, ts date, price_factor double, share_multiplier double, source string")
    merged = {(r.symbol, r.ts): r for r in adjust.merge_actions(acts).collect()}
    assert merged["A", date(2024, 2, 1)].price_factor == pytest.approx(0.05) and merged["A", date(2024, 2, 1)].source == "x+y" and len(merged) == 2
    for s, rows in held(adjust.back_adjust(bars, acts)).items():
        for r in rows:
            factor = math.prod(m.price_factor for m in merged.values() if m.symbol == s and m.ts > r.ts)
            assert r.adjusted_close == pytest.approx(r.close * factor)


def test_cutoffs_and_islands(spark, bars):
    adjusted = adjust.ensure_anchors(bars)
    W, H, tau = 10, 5, 1.0
    got = {(r.symbol, r.idx) for r in store.candidates(adjusted, "ALL", W, H, tau).collect()}
    rows = held(adjusted)
    marks = {r.ts for r in rows["ALL"]}
    want = set()
    for s in "AB":
        own = rows[s]
        jump = [i > 0 and abs(math.log(own[i].close / own[i - 1].close)) > tau for i in range(len(own))]
        want |= {(s, i) for i in range(W - 1, len(own) - H) if not any(jump[i - W + 2 : i + H + 1]) and all(r.ts in marks for r in own[i - W + 1 : i + H + 1])}
    assert got == want and want
    ranges = store.islands(store.candidates(adjusted, "ALL", W, H, tau)).collect()
    assert {(r.symbol, i) for r in ranges for i in range(r.start_index, r.stop_index)} == want
    for r in ranges:
        assert (r.symbol, r.start_index - 1) not in want and (r.symbol, r.stop_index) not in want
    reasons = windows.window_reasons(adjusted, "ALL", W, H, tau)
    assert {(r.symbol, r.idx) for r in reasons.where("reason = 'valid'").collect()} == want


def test_macd_starts_in_its_window(bars):
    made = held(features.macd(adjust.ensure_anchors(bars), 20))

    def ema(x, span):
        out, a = [x[0]], 2 / (span + 1)
        for v in x[1:]:
            out.append(out[-1] * (1 - a) + v * a)
        return out

    closes = [r.close for r in held(bars)["A"]]
    for r, at in zip(made["A"], range(19, len(closes)), strict=True):
        x = [math.log(c) for c in closes[at - 19 : at + 1]]
        line = [f - s for f, s in zip(ema(x, 12), ema(x, 26), strict=True)]
        assert r.macd == pytest.approx(line[-1]) and r.signal == pytest.approx(ema(line, 9)[-1])


@pytest.mark.parametrize("count,fraction,block", [(1, 1.0, 4), (100, 0.3, 16), (1000, 0.5, 128), (257, 1.0, 16)])
def test_block_sample_is_exact(spark, count, fraction, block):
    sample = windows.BlockSample(count, fraction, block=block)
    rows = windows.block_sample(spark.range(count).withColumnRenamed("id", "ordinal"), sample).collect()
    assert sorted(r.place for r in rows) == list(range(sample.target)) and len({r.ordinal for r in rows}) == len(rows)


def test_batches_are_filled(spark):
    rows = windows.batches(spark.range(10).withColumnRenamed("id", "ordinal"), 4, 10).collect()
    assert sorted((r.batch, r.slot) for r in rows) == [(b, s) for b in range(3) for s in range(4)]
    assert sorted(r.ordinal for r in rows if r.batch == 2) == [0, 1, 8, 9]


def test_scalar_functions(spark):
    texts = ["1,234.5", "+7", "--", "nan", "", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.lenient_number(F.col("t"))).collect()]
    assert got == [1234.5, 7.0, None, None, None, None, None]
    days = ["950203", "1130229", "20240229", "113/2/9", "94年01月11日", "1130230", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in days], "t string").select(fn.minguo_date(F.col("t"))).collect()]
    assert got == [date(2006, 2, 3), date(2024, 2, 29), date(2024, 2, 29), date(2024, 2, 9), date(2005, 1, 11), None, None, None]
    got = [r[0] for r in spark.createDataFrame([("7.0/1.0",), ("4:1",), ("0/1",), ("a:1",), ("1",)], "t string").select(fn.split_ratio(F.col("t"))).collect()]
    assert [g and round(g.price_factor, 9) for g in got] == [round(1 / 7, 9), 0.25, None, None, None]


def test_vendor_payloads(spark):
    daily = '[{"date":"2024-01-02","open":1,"high":2,"low":1,"close":2,"adjusted_close":2,"volume":5},{"date":"2024-01-03","open":0,"high":0,"low":0,"close":0,"adjusted_close":0,"volume":0}]'
    rows = payloads.daily_json(spark.createDataFrame([("X", daily), ("Y", "[]"), ("Z", None)], "symbol string, payload string"))
    assert payloads.clean_rows(rows).count() == 1
    assert {r.reason: r.dropped for r in payloads.reason_counts(rows).collect()}["non_positive_price"] == 1
    quote = '{"tables":[{"fields":["a"],"data":[["1"]]},{"fields":["證券 代號","開盤價","最高價","最低價","收盤價","成交股數"],"data":[["2330","1,000.0","1,010","990","1,005","12,345"],["9999","--","--","--","--","0"]]}]}'
    wanted = {"證券代號": "code", "開盤價": "open", "最高價": "high", "最低價": "low", "收盤價": "close", "成交股數": "volume"}
    got = payloads.quotes(payloads.quote_tables(spark.createDataFrame([(date(2024, 1, 2), quote)], "ts date, payload string"), wanted)).collect()
    assert [(r.code, r.open, r.volume) for r in got] == [("2330", 1000.0, 12345.0)]
    acts = spark.createDataFrame([("1", date(2024, 1, 2), "權", 100.0, 90.0), ("2", date(2024, 1, 2), "息", 100.0, 95.0), ("3", date(2024, 1, 2), "權息", 50.0, 40.0)], "code string, ts date, kind string, prior double, reference double")
    more = spark.createDataFrame([("1", date(2024, 1, 2), "100")], "code string, ts date, free_shares string")
    got = {r.code: (round(r.price_factor, 6), r.share_multiplier, r.source) for r in payloads.exchange_actions(acts, more).collect()}
    assert got == {"1": (0.9, 1.1, "exchange"), "2": (0.95, 1.0, "exchange"), "3": (0.8, 1.0, "no_share_detail")}


def test_streamed_bars_equal_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    append_bars(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.symbol, r.ts): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.symbol, r.ts): r for r in hourly(events).collect()}
    assert got and all(want[k] == r for k, r in got.items()) and len(want) - len(got) <= 15


def test_store_round_trip(spark, data, tmp_path):
    paths = market.build_store(spark, data, str(tmp_path))
    made, index = spark.read.parquet(paths["bars"]), spark.read.parquet(paths["index"])
    assert made.count() == index.agg(F.sum("row_count")).first()[0]
    assert store.overlaps(spark.read.parquet(paths["ranges"])).count() == 0
    with pytest.raises(ValueError):
        src.read_bars(spark, "x.txt")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "symbol string, ts date, open double, high double, low double, close double, volume double, adjusted_close double, split_adjusted_volume double")
    assert store.candidates(none, "ALL", 5, 2, 1.0).count() == 0
    assert adjust.alphas(none, "ALL", [1, 2]).count() == 0
    assert features.feature_rows(none, "ALL").count() == 0


def test_bootstrap_interval(spark):
    days = [(k, n) for n in ("a", "b") for k in range(100 if n == "a" else 20)]
    rows = spark.createDataFrame([(n, k, -0.02) for k, n in days] + [("c", k, float(k % 10)) for k in range(60)], "rule string, ts int, difference double")
    got = {r.rule: r for r in metrics.block_intervals(rows, "rule", rounds=100).collect()}
    assert got["a"].low == pytest.approx(-0.02) and got["a"].high == pytest.approx(-0.02) and got["a"].dates == 100
    assert got["b"].low is None and got["b"].dates == 20
    assert 3.5 < got["c"].low < 4.5 < got["c"].high < 5.5


def test_names_and_types_of_vendors(spark):
    rows = spark.createDataFrame([("2024-01-02", " ab ", "1", "2", "0.5", "x", "7", None)], "`Date` string, `TICKER` string, open string, High string, low string, close string, volume string, Extra string")
    made = intake.normalised(rows)
    assert made.columns == ["ts", "symbol", "asset_type", "open", "high", "low", "close", "volume"]
    r = made.first()
    assert (r.symbol, r.asset_type, r.open, r.close) == ("AB", "stock", 1.0, None)
    with pytest.raises(ValueError, match="missing columns: volume"):
        intake.normalised(rows.drop("volume"))
    with pytest.raises(ValueError, match="same meaning: ts"):
        intake.normalised(rows.withColumn("timestamp", F.lit("x")))
    assert intake.normalised(rows.drop("TICKER"), default_symbol="zz").first().symbol == "ZZ"


@pytest.mark.parametrize(
    ("change", "rule"),
    [({"ts": None}, "missing_ts"), ({"symbol": " "}, "empty_symbol"), ({"asset_type": "coin"}, "asset_type"), ({"provider": ""}, "empty_provider"), ({"close": float("nan")}, "non_finite"), ({"volume": float("inf")}, "non_finite"), ({"low": 0.0}, "non_positive_price"), ({"adjusted_close": 0.0}, "non_positive_adjusted_close"), ({"split_adjusted_volume": -1.0}, "negative_split_volume"), ({"volume": -1.0}, "negative_volume"), ({"high": 1.5}, "high_below"), ({"low": 1.7}, "low_above"), ({}, "duplicate_key")],
)
def test_checks_fail_closed(spark, change, rule):
    good = {"ts": 1, "symbol": "A", "asset_type": "stock", "open": 1.6, "high": 2.0, "low": 1.0, "close": 1.7, "volume": 5.0, "adjusted_close": 1.7, "split_adjusted_volume": 5.0, "provider": "p"}
    schema = "ts int, symbol string, asset_type string, open double, high double, low double, close double, volume double, adjusted_close double, split_adjusted_volume double, provider string"
    frame = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert intake.validated(frame(good, good | {"ts": 2})).count() == 2
    with pytest.raises(Exception, match=rule):
        intake.validated(frame(good, good | {"ts": 2 if change else 1} | change)).collect()


def test_observation_of_one_symbol(spark, bars):
    with_type = adjust.ensure_anchors(bars)
    name = with_type.where(F.col("symbol") != "ALL").first().symbol
    last = with_type.where(F.col("symbol") == name).agg(F.max("ts")).first()[0]
    try:
        one = intake.observation(with_type, "ALL", 3, str(last), name).first()
    except ValueError:
        one = None
    if one:
        assert one.symbol == name and len(one.window) == 3 and one.window[-1].bench_close == 1
    with pytest.raises(ValueError, match="is not among"):
        intake.observation(with_type, "ALL", 3, str(last), "nobody")
    with pytest.raises(ValueError, match="bars up to"):
        intake.observation(with_type, "ALL", 10_000, str(last), name)
    with pytest.raises(ValueError, match="1, 2 or 3"):
        intake.horizons_from(4)
    assert intake.horizons_from(2)[-1] == 14
    with pytest.raises(ValueError, match="cache_hit"):
        intake.merged_requests([with_type])
    with pytest.raises(Exception, match="not finite"):
        intake.strict_json(spark.createDataFrame([(float("nan"),)], "x double")).collect()
    with pytest.raises(ValueError, match="same columns"):
        samples.joined_batches([with_type, with_type.drop("ts")])


def test_ridge_model(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 2))
    y = 2 * x[:, 0] - x[:, 1] + rng.standard_normal(600)
    rows = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y, strict=True)], "a double, b double, y double")
    z, centred = (x - x.mean(0)) / x.std(0), y - y.mean()
    want = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ centred)
    assert models.fit_ridge(rows, ["a", "b"], "y").weights == pytest.approx(tuple(want))
    assert models.fit_ridge(rows.where("false"), ["a"], "y") is None


def test_labels_change_hands_within_a_date(spark):
    rows = spark.createDataFrame([(s, t, float(10 * t + s)) for t in range(4) for s in range(9)], "symbol int, ts int, alpha double").withColumn("symbol", F.col("symbol").cast("string"))
    made = models.shuffled_labels(rows, "alpha", 3).collect()
    assert len(made) == 36 and sorted(r.alpha for r in made) == sorted(float(10 * t + s) for t in range(4) for s in range(9))
    assert all(int(r.alpha) // 10 == r.ts for r in made) and sum(int(r.alpha) % 10 != int(r.symbol) for r in made) > 20
