"""Digest trees, slices of long histories, and the vendor data source."""

import hashlib
import json
import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from barloom.operators import adjust, digests, features, slices, store, windows
from barloom.sources import stages, vendor
from barloom.sources.bars import synthetic_bars

# digests


def test_canonical_json_is_that_of_sorted_keys(spark):
    rows = [(1, {"b": 2, "a": None, "ü": 1}, [{"z": 1, "y": "x\"y"}, None], ("t", 1.5), None), (2, None, [], (None, None), "é\n")]
    df = spark.createDataFrame(rows, "k int, m map<string,int>, l array<struct<z: int, y: string>>, s struct<q: string, p: double>, a string")
    want = [
        {"k": 1, "m": {"b": 2, "a": None, "ü": 1}, "l": [{"z": 1, "y": "x\"y"}, None], "s": {"q": "t", "p": 1.5}, "a": None},
        {"k": 2, "m": None, "l": [], "s": {"q": None, "p": None}, "a": "é\n"},
    ]
    got = [r.j for r in df.select("k", digests.canonical(df).alias("j")).orderBy("k").collect()]
    assert got == [json.dumps(w, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for w in want]
    for bad in (math.nan, math.inf):
        odd = spark.createDataFrame([([[1.0, bad]],)], "x array<array<double>>")
        with pytest.raises(Exception, match="not finite"):
            odd.select(digests.canonical(odd)).collect()


def keyed(spark, change=None):
    rng = random.Random(1)
    rows = [(f"S{s}", f"2024-{m:02d}", d, rng.randrange(100)) for s in range(30) for m in range(1, 5) for d in range(1, 8)]
    if change:
        rows = change(rows)
    return spark.createDataFrame(rows, "symbol string, month string, day int, x int")


def tree_of(df):
    return stages.written(digests.tree(df.select("*", *digests.spread("symbol", 1, 1)), ["hash_0", "symbol", "month"], ["day"], ["symbol", "day", "x"]), "tree")


def test_trees_are_the_same_for_all_layouts(spark):
    trees = [sorted(map(str, tree_of(df).collect())) for df in (keyed(spark), keyed(spark).repartition(7, "x"), keyed(spark).orderBy(F.desc("day")))]
    assert trees[0] == trees[1] == trees[2]
    leaf = next(r for r in tree_of(keyed(spark)).collect() if r.level == 3 and r.path[1:] == ["S3", "2024-02"])
    rows = sorted((r.day, r.x) for r in keyed(spark).where("symbol = 'S3' and month = '2024-02'").collect())
    one = lambda d, x: hashlib.sha256(f'{{"day":{d},"symbol":"S3","x":{x}}}'.encode()).hexdigest()
    assert leaf.digest == hashlib.sha256(",".join(one(*r) for r in rows).encode()).hexdigest() and leaf.n == 7
    assert digests.differing(tree_of(keyed(spark)), tree_of(keyed(spark).repartition(3)), 3).count() == 0
    none = tree_of(keyed(spark).where("false"))
    assert none.count() == 0 and digests.differing(none, none, 3).count() == 0


def test_differing_ranges_are_named(spark):
    def change(rows):
        kept = [r for r in rows if not (r[0] == "S4" and r[1] == "2024-03") and r[:3] != ("S5", "2024-01", 2)]
        return [(*r[:3], r[3] + (r[:3] == ("S6", "2024-04", 7))) for r in kept] + [("S99", "2024-01", 1, 5)]

    found = digests.differing(tree_of(keyed(spark)), tree_of(keyed(spark, change)), 3).collect()
    assert sorted((r.path[1], r.path[2], r.n_one, r.n_other) for r in found) == [("S4", "2024-03", 7, None), ("S5", "2024-01", 7, 6), ("S6", "2024-04", 7, 7), ("S99", "2024-01", None, 1)]


# slices


def long_bars(spark):
    bars = synthetic_bars(spark, 3, 260)
    jumps = F.when((F.col("symbol") == "S0001") & (F.dayofmonth("ts") == 13), F.col("close") * 20).otherwise(F.col("close"))
    kept = bars.where("symbol <> 'S0000' or dayofyear(ts) % 41 <> 0").where("symbol <> 'S0002' or ts > '2022-05-01'")
    return adjust.ensure_anchors(kept.withColumn("close", jumps).withColumn("high", F.greatest("high", "close")))


@pytest.mark.parametrize("size", [19, 50, 1000])
def test_slices_give_the_same_rows(spark, size):
    bars = long_bars(spark).persist()
    table = spark.createDataFrame([("S0001", "S0000"), ("S0002", "S0000")], "symbol string, benchmark_symbol string")
    for mark in ("S0000", table):
        for operator, back, ahead in (
            (lambda b, m: store.candidates(b, m, 10, 5, 1.0), 9, 5),
            (lambda b, m: windows.window_reasons(b, m, 10, 5, 1.0), 9, 5),
            (lambda b, m: adjust.alphas(b, m, [1, 5]), 0, 5),
            (lambda b, m: features.momentum(b, m), 5, 0),
            (lambda b, m: adjust.asof_windows(b.join(b.select("symbol").distinct().where("symbol not in ('S0000')"), "symbol"), 10).withColumn("window", F.to_json("window")), 9, 0),
        ):
            whole = operator(bars, mark)
            parts = slices.by_slices(bars, mark, operator, size, back, ahead)
            assert parts.columns == whole.columns and sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) != []
    with pytest.raises(ValueError, match="shorter"):
        slices.by_slices(bars, "S0000", store.candidates, 4, 9, 5)


def test_no_task_holds_more_than_a_slice(spark):
    cut = slices.sliced(long_bars(spark), 50, 9, 5)
    sizes = cut.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("__own").alias("own"), F.max("idx").alias("last")).collect()
    assert max(r.n for r in sizes) <= 50 + 9 + 5 and max(r.own for r in sizes) == 50
    numbers = slices.numbered(long_bars(spark)).groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.max("idx").alias("last")).collect()
    assert all(r.n == r.d == r.last + 1 for r in numbers)


# the vendor source


def lines(spark):
    good = lambda d, p: json.dumps({"date": str(d), "open": p, "high": p + 1, "low": p - 1, "close": p, "volume": 5})
    day = lambda i: date(2024, 1, 1) + timedelta(days=i)
    rows = [(s, day(i), good(day(i), 50.0 + i)) for s in ("A B", "Ü", "C") for i in range(90)]
    bad = ['{"date": "2024-', "[1]", "", '{"date": 5}', good(day(40), 5.0), good(day(1), -5.0), good(day(1), 50.0).replace("51.0", "40"), good(day(1), 50.0).replace("5}", "-1}"), good(day(1), 50.0).replace("50.0", "NaN", 1), good(day(1), 50.0).replace("50.0", "true", 1)]
    rows += [("C", day(1), text) for text in bad]
    return spark.createDataFrame(rows, "symbol string, ts date, value string")


def test_vendor_files(spark, tmp_path):
    place = f"file://{tmp_path}/vendor"
    vendor.write(lines(spark), place)
    bars = vendor.read(spark, place)
    assert bars.count() == 270 and {r.symbol for r in bars.select("symbol").distinct().collect()} == {"A B", "Ü", "C"}
    some = bars.where("symbol = 'A B' and ts >= '2024-02-10' and ts < '2024-03-05'")
    assert sorted(r.ts for r in some.collect()) == [date(2024, 2, 10) + timedelta(days=i) for i in range(24)]
    assert vendor.read(spark, place).where("symbol in ('Ü', 'C') and ts = '2024-01-31'").count() == 2
    told = {r.reason: r.n for r in vendor.rejects(spark, place).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert told == {"not_json": 3, "bad_date": 1, "other_month": 1, "non_positive_price": 1, "bad_bounds": 1, "negative_volume": 1, "missing_value": 2}
    first = vendor.rejects(spark, place).where("symbol = 'C'").orderBy("line").first()
    assert "month=2024-01" in first.file and first.symbol == "C"


def test_files_of_others_stay_closed(spark, tmp_path):
    place = f"file://{tmp_path}/vendor"
    vendor.write(lines(spark), place)
    for root in (tmp_path / "vendor").iterdir():
        if root.is_dir() and root.name != "symbol=C":
            for file in root.rglob("*.txt"):
                file.write_bytes(b"no bar at all")
    reader = vendor.VendorReader(place, "bars", 1 << 20)
    filters = [EqualTo(("symbol",), "C"), GreaterThanOrEqual(("ts",), date(2024, 2, 3)), LessThan(("ts",), date(2024, 3, 1)), EqualTo(("volume",), 5.0)]
    assert list(reader.pushFilters(filters)) == filters[1:]
    assert {(s, m) for part in reader.partitions() for _, s, m in part.files} == {("C", "2024-02"), ("C", "2024-03")}
    assert vendor.read(spark, place).where("symbol = 'C' and ts >= '2024-02-01'").count() == 59 and vendor.rejects(spark, place).where("symbol = 'C' and reason = 'not_json'").count() == 3
    small = vendor.VendorReader(place, "bars", 1)
    assert len(small.partitions()) > len(vendor.VendorReader(place, "bars", 1 << 30).partitions()) >= 1
    none = vendor.VendorReader(place, "bars", 1)
    list(none.pushFilters([EqualTo(("symbol",), "nobody")]))
    assert [f for p in none.partitions() for f in p.files] == []
