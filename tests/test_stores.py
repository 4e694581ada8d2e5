"""What is stored and read again: stage tables, exact quantiles, bucketed bars, evaluations by chunk, tables in steps."""

import json
import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import evaluation, marks, metrics, quantiles, store
from barloom.plans import market
from barloom.sources import bucketed, sink, stages, tabular


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}"


# stage tables


def test_a_stage_is_made_once(spark, place, tmp_path):
    spark.range(5).write.parquet(f"{place}/in")
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{place}/in").selectExpr("id * 2 AS x")

    for _ in range(2):
        kept = stages.kept(spark, "doubled", {"by": 2}, [f"{place}/in"], make)
        assert sorted(r.x for r in kept.collect()) == [0, 2, 4, 6, 8]
    assert len(made) == 1 and not any(f"{tmp_path}/in" in path for path in kept.inputFiles())
    stages.kept(spark, "doubled", {"by": 3}, [f"{place}/in"], make)
    assert len(made) == 2  # another contract
    spark.range(7).write.mode("overwrite").parquet(f"{place}/in")
    assert stages.kept(spark, "doubled", {"by": 2}, [f"{place}/in"], make).count() == 7 and len(made) == 3  # another input


def test_a_stage_of_something_else_is_refused(spark, place):
    spark.range(3).write.parquet(f"{place}/in")
    kept = stages.kept(spark, "plain", {}, [f"{place}/in"], lambda: spark.read.parquet(f"{place}/in"))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    stages.Files(spark).write(f"{folder}/_identity", "{}")
    with pytest.raises(ValueError, match="was not made of these inputs"):
        stages.kept(spark, "plain", {}, [f"{place}/in"], lambda: spark.range(1))
    with pytest.raises(ValueError):
        stages.digest({"x": float("nan")})
    assert stages.digest({"b": 1, "a": [1, "ü"]}) == stages.digest({"a": [1, "ü"], "b": 1})


def test_forecast_plans_read_stage_tables(spark, data):
    plan = market.predictions(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" not in plan and plan.count("Relation") <= 5


# exact quantiles

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def test_quantiles_equal_sorting(spark):
    rng = random.Random(3)
    draw = lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e300, 5e-324, 0.0, -0.0, -7.5, 2.0**52 + rng.randrange(3), None])
    rows = [(rng.choice("abcd"), draw()) for _ in range(3000)] + [("one", 1.5), ("none", None), ("ends", math.inf), ("ends", -3.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {r.k: r for r in quantiles.exact(df, ["k"], "x", SHARES).collect()}
    for k in {k for k, x in rows if k and x is not None}:
        xs = sorted(x for g, x in rows if g == k and x is not None)
        assert got[k].n == len(xs)
        for share, q in zip(SHARES, got[k].q, strict=True):
            at = (len(xs) - 1) * share
            low, high = xs[math.floor(at)], xs[math.ceil(at)]
            assert q == (low if low == high else pytest.approx((math.ceil(at) - at) * low + (at - math.floor(at)) * high, rel=1e-12))
    assert set(got) == {k for k, x in rows if k and x is not None}
    whole = quantiles.exact(df, [], "x", (0.5,)).collect()
    xs = sorted(x for _, x in rows if x is not None)
    assert len(whole) == 1 and whole[0].n == len(xs) and whole[0].q[0] in xs
    assert quantiles.exact(df.where("false"), ["k"], "x", SHARES).count() == 0 and quantiles.exact(df.where("false"), [], "x", SHARES).count() == 0


def test_codes_keep_the_order(spark):
    xs = [-math.inf, -1e308, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e308, math.inf, math.nan]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", quantiles.code_of(F.col("x")).alias("c")).withColumn("y", quantiles.value_of(F.col("c"))).orderBy("c").collect()
    assert [r.i for r in rows] == list(range(len(xs)))
    assert all(r.y == xs[r.i] or math.isnan(r.y) and math.isnan(xs[r.i]) for r in rows)


# benchmarks of their own


def bars_of(spark, symbols, days=60, seed=1, skip=()):
    rng = random.Random(seed)
    rows = [(s, date(2024, 1, 1) + timedelta(days=i), p := 50 + 50 * rng.random(), p * 1.1, p * 0.9, p * (0.95 + 0.1 * rng.random()), 100.0, "stock" if not s.startswith("IX") else "index", "M") for s in symbols for i in range(days) if (s, i) not in skip and rng.random() > 0.1]
    made = spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double, asset_type string, market string")
    return made.withColumns({"adjusted_close": F.col("close"), "split_adjusted_volume": F.col("volume")})


def test_each_symbol_meets_its_own_benchmark(spark):
    bars = bars_of(spark, ["A", "B", "C", "D", "IX1", "IX2"])
    chosen = spark.createDataFrame([("A", "IX1"), ("B", "IX2"), ("C", "IX1"), ("D", "NONE")], "symbol string, benchmark_symbol string")
    closes = {(r.symbol, r.ts): r.close for r in bars.collect()}
    got = marks.marked(bars, chosen, {"mark": F.col("close")}).collect()
    own = dict(chosen.collect())
    assert sorted((r.symbol, r.ts, r.mark) for r in got if r.mark is not None) == sorted((s, t, closes[own[s], t]) for s, t in closes if s in own and (own[s], t) in closes)
    assert len(got) == sum(s in own for s, _ in closes)
    # one benchmark for all is the same as a table that says so
    same = spark.createDataFrame([(s, "IX1") for s in "ABCD"], "symbol string, benchmark_symbol string")
    rows = [sorted(map(tuple, store.candidates(bars.where("symbol <> 'IX2'"), b, 6, 3, 1.0).collect())) for b in ("IX1", same)]
    assert rows[0] == rows[1] and rows[0]


def test_reasons_against_a_symbol(spark):
    index = spark.createDataFrame([("A", "stock", "M"), ("B", "stock", "N"), ("C", None, "M"), ("IX1", "index", "M"), ("O", "option", "M"), ("F", "etf", "M"), ("G", "etf", "M"), ("E", "stock", "N"), ("S", "stock", "M"), ("Z", "stock", "P")], "symbol string, asset_type string, market string")
    explicit = spark.createDataFrame([("E", "IX1"), ("S", "S")], "symbol string, benchmark_symbol string")
    funds = spark.createDataFrame([("F", "M"), ("G", "N")], "symbol string, market string")
    found = marks.without_missing(marks.decided(index, {"M": "IX1", "P": "IX9"}, explicit, funds))
    assert {r.symbol: (r.reason, r.eligible, r.benchmark_symbol) for r in found.collect()} == {
        "A": ("market", True, "IX1"), "B": ("unmapped", False, None), "C": ("inconsistent_symbol_metadata", False, None), "IX1": ("index", False, None), "O": ("unsupported_type", False, None),
        "F": ("market", True, "IX1"), "G": ("fund_not_listed", False, None), "E": ("explicit", True, "IX1"), "S": ("benchmark_self", False, "S"), "Z": ("missing_benchmark", False, "IX9"),
    }


# bucketed bars

SCHEMA = "symbol string, ts date, close double"


def small_bars(spark, symbols=40, days=30, first=0):
    rows = [(f"S{s:03d}", date(2024, 1, 1) + timedelta(days=first + i), float(s * 100 + first + i)) for s in range(symbols) for i in range(days)]
    return spark.createDataFrame(rows, SCHEMA)


def steps_of(bars):
    """Something of each symbol that needs its bars together and in order."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return bars.withColumn("step", F.col("close") - F.lag("close").over(w)).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


def test_buckets_are_read_without_an_exchange(spark, place):
    results = {}
    for buckets in (4, 64):
        made = bucketed.BarStore(spark, f"{place}/store-{buckets}", buckets, SCHEMA)
        made.append(small_bars(spark))
        made.append(small_bars(spark, first=30))
        assert made.compact() and all(len(paths) == 1 for paths in made.by_bucket().values()) and made.compact() == []
        found = steps_of(made.checked(40 * 60))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        results[buckets] = sorted(map(tuple, found.collect()))
        for bucket, paths in made.by_bucket().items():
            rows = spark.read.parquet(*paths).select("symbol", "ts", made.bucket_of().alias("b")).collect()
            assert {r.b for r in rows} == {bucket} and [(r.symbol, r.ts) for r in rows] == sorted((r.symbol, r.ts) for r in rows)
    assert results[4] == results[64] == sorted(map(tuple, steps_of(small_bars(spark, days=60)).collect()))


def test_one_bucket_is_replaced(spark, place):
    made = bucketed.BarStore(spark, f"{place}/store", 8, SCHEMA)
    made.append(small_bars(spark))
    before = made.by_bucket()
    fixed = made.read().where(made.bucket_of() == 3).withColumn("close", F.lit(1.0))
    fixed.write.parquet(f"{place}/fixed")
    made.replace(spark.read.parquet(f"{place}/fixed"), [3])
    after = made.by_bucket()
    assert {b for b in before if before[b] != after[b]} == {3}
    assert {r.close for r in made.read().where(made.bucket_of() == 3).select("close").distinct().collect()} == {1.0} and made.read().count() == 1200
    with pytest.raises(ValueError, match="other buckets"):
        made.replace(small_bars(spark), [3])
    assert made.by_bucket() == after
    with pytest.raises(ValueError, match="1200 bars of 1199"):
        made.checked(1199)
    made.append(small_bars(spark, symbols=1, days=1))
    with pytest.raises(ValueError, match="2 of a key"):
        made.checked(1201)
    with pytest.raises(ValueError, match="another layout"):
        bucketed.BarStore(spark, f"{place}/store", 9, SCHEMA)


@pytest.mark.parametrize("lost_after", [0, 1, 2, 5])
def test_a_lost_driver_finishes_its_moves(spark, place, monkeypatch, lost_after):
    """The driver dies after so many deletions and renames of a compaction."""
    made = bucketed.BarStore(spark, f"{place}/store", 3, SCHEMA)
    made.append(small_bars(spark))
    made.append(small_bars(spark, first=30))
    real, calls = bucketed.BarStore._finish, []

    def dying(self):
        if stages.Files(spark).read(f"{self.path}/journal") is None:
            return real(self)
        plan = json.loads(self.files.read(f"{self.path}/journal"))
        for act in [*((self.files.delete, [p]) for p in plan["go"]), *((self.files.rename, move) for move in plan["come"])]:
            if len(calls) == lost_after:
                raise KeyboardInterrupt
            calls.append(act[0](*act[1]))

    monkeypatch.setattr(bucketed.BarStore, "_finish", dying)
    with pytest.raises(KeyboardInterrupt):
        made.compact()
    monkeypatch.setattr(bucketed.BarStore, "_finish", real)
    again = bucketed.BarStore(spark, f"{place}/store", 3, SCHEMA)
    assert sorted(map(tuple, steps_of(again.checked(2400)).collect())) == sorted(map(tuple, steps_of(small_bars(spark, days=60)).collect()))
    assert all(len(paths) == 1 for paths in again.by_bucket().values())


# evaluations


def forecasts(spark, n=200, seed=2):
    rng = random.Random(seed)
    rows = [(rule, f"S{i % 7}", date(2024, 1, 1) + timedelta(days=i), h, a := rng.gauss(0, 1), a - 1 + rng.random(), a + rng.gauss(0, 0.3), a + 1, 0.5) for rule in ("x", "y") for i in range(n) for h in (1, 5)]
    return spark.createDataFrame(rows, "rule string, symbol string, ts date, h int, alpha double, q10 double, q50 double, q90 double, scale double")


def test_chunks_merge_and_count_once(spark, place):
    rows = forecasts(spark).withColumn("chunk", F.dayofyear("ts") % 3)
    made = evaluation.EvaluationStore(spark, f"{place}/evaluation", 3)
    sizes = {r.chunk: r.n for r in rows.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    part = lambda c: rows.where(F.col("chunk") == c)
    made.append(0, part(0), sizes[0])
    with pytest.raises(ValueError, match="missing: \\[1, 2\\]"):
        made.metrics()
    for c in (1, 2, 1):
        made.append(c, part(c).repartition(3), sizes[c])
    want = {(r.rule, r.h): r for r in metrics.by_horizon(rows, "rule").collect()}
    for r in made.metrics().collect():
        for name, value in r.asDict().items():
            assert value == (pytest.approx(want[r.rule, r.h][name]) if isinstance(value, float) else want[r.rule, r.h][name])
    with pytest.raises(ValueError, match="and not"):
        made.append(2, part(2).limit(5), sizes[2])
    assert made.metrics().count() == 4  # nothing of the short chunk was stored
    made.append(2, part(2).withColumn("q50", F.col("q50") + 1), sizes[2])
    with pytest.raises(ValueError, match="different predictions: \\[2\\]"):
        made.metrics()
    with pytest.raises(ValueError):
        made.append(3, part(0), sizes[0])


# tables in steps


def test_a_build_goes_on_where_it_stopped(spark, place, monkeypatch):
    rows = spark.range(1000).select(F.col("id").alias("ordinal"), (F.col("id") * 7 % 13).alias("x")).repartition(5)
    whole = tabular.TabularCache(spark, f"{place}/whole", {"of": "x"}, 1000, 300)
    assert whole.build(rows) == 1000
    made = tabular.TabularCache(spark, f"{place}/parts", {"of": "x"}, 1000, 300)
    assert made.build(rows, steps=1) == 300
    with pytest.raises(ValueError, match="300 of 1000"):
        made.read()
    # stops between the part's name and the cursor
    real = stages.Files.write
    monkeypatch.setattr(stages.Files, "write", lambda self, path, text: (_ for _ in ()).throw(KeyboardInterrupt) if path.endswith("cursor") else real(self, path, text))
    with pytest.raises(KeyboardInterrupt):
        made.build(rows, steps=1)
    monkeypatch.setattr(stages.Files, "write", real)
    again = tabular.TabularCache(spark, f"{place}/parts", {"of": "x"}, 1000, 300)
    assert again.cursor == 300 and again.build(rows) == 1000 and again.build(rows) == 1000
    read = sorted(tuple(r) for r in again.read().collect())
    assert read == [(i, i * 7 % 13) for i in range(1000)] == sorted(tuple(r) for r in whole.read().collect())
    with pytest.raises(ValueError, match="another contract"):
        tabular.TabularCache(spark, f"{place}/parts", {"of": "y"}, 1000, 300)
    short = tabular.TabularCache(spark, f"{place}/short", {}, 1000, 600)
    with pytest.raises(ValueError, match="rows"):
        short.build(rows.where("ordinal <> 700"))
    assert short.cursor == 600


# sinks


def test_parts_never_change_and_share_a_schema(spark, place):
    made = sink.ImmutableSink(spark, f"{place}/sink")
    with pytest.raises(ValueError, match="no parts"):
        made.read()
    made.append(spark.createDataFrame([(1, 2.5)], "a int, b double"), "one")
    made.append(spark.createDataFrame([("3.5", "2")], "b string, a string"), "two")
    assert sorted(map(tuple, made.read().collect())) == [(1, 2.5, "one"), (2, 3.5, "two")] and made.parts() == ["one", "two"]
    for rows, name, said in (("a int, b double", "one", "already"), ("a int", "three", "columns"), ("a int, b double, c int", "three", "columns"), ("a int, b double", "a/b", "name")):
        with pytest.raises(ValueError, match=said):
            made.append(spark.createDataFrame([], rows), name)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        made.append(spark.createDataFrame([("x", 1.0)], "a string, b double"), "four")
    assert made.parts() == ["one", "two"] and sink.ImmutableSink(spark, f"{place}/sink").read().count() == 2
