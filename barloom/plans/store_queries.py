"""Queries of what is stored and read again: bucketed bars, evaluations by chunk, tables built in steps (A, D, H)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import digests, evaluation, features, intake, slices, store, windows
from ..sources import bars as src
from ..sources import bucketed, sink, stages, tabular, vendor
from . import market as m
from . import market_queries as wide
from .catalogue import METRICS, NAMED, query
from .evaluation_queries import HISTORY
from .oracle import BARS, CUTOFFS, FEATURES, LABELS, PREDICTIONS, r

BAR_SCHEMA = "symbol string, ts date, market string, asset_type string, open double, high double, low double, close double, volume double, adjusted_close double, split_adjusted_volume double"


def _place(spark, name: str) -> str:
    return f"{stages.root(spark)}/stages/{name}.{uuid.uuid4().hex}"


@query(f"WITH {wide.MARKETS} SELECT symbol, count(*) AS n_rows, min(ts) AS start_at, max(ts) AS end_at, count(*) FILTER (extreme) AS extremes, count(*) FILTER (gap_days > 10) AS long_gaps FROM mr GROUP BY symbol")
def d18_bucketed_store(spark, folder):
    """Bars appended in two parts, compacted, checked, and read by symbol without an exchange."""
    bars = wide.bars(spark, folder)
    made = bucketed.BarStore(spark, _place(spark, "store"), 16, BAR_SCHEMA)
    first = F.col("ts") < F.lit(m.VALIDATION_END).cast("date")
    made.append(bars.where(first))
    made.append(bars.where(~first))
    made.compact()
    found = store.transitions(made.checked(bars.count()), wide.THRESHOLD)
    return found.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count_if("extreme").alias("extremes"), F.count_if(F.col("gap_days") > 10).alias("long_gaps"))


CHUNKS = 5


@query(f"WITH {PREDICTIONS} SELECT rule, CAST(h AS BIGINT) AS h, n, {r(*NAMED, digits=5)} FROM (SELECT rule, h, {METRICS} FROM pd GROUP BY rule, h)", digits=5)
def h4_evaluation_store(spark, folder):
    """Five chunks of the predictions, one of which comes twice."""
    rows = m.predictions(spark, folder).withColumn("chunk", F.pmod(F.xxhash64("symbol", "ts"), F.lit(CHUNKS)))
    sizes = {row["chunk"]: row["n"] for row in rows.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    made = evaluation.EvaluationStore(spark, _place(spark, "evaluation"), CHUNKS)
    for chunk in (0, 1, 2, 3, 2, 4):
        made.append(chunk, rows.where(F.col("chunk") == chunk), sizes.get(chunk, 0))
    return made.metrics()


TABULAR = ("ret_5", "sma_20", "bench_ret_5", "diff_ret_5")


def numbered_rows(spark, folder):
    """A stage table of all cutoffs by ordinal with features, and labels of all horizons; null where there is none."""
    bars = m.bars(spark, folder)
    labels = m.labels(spark, folder).groupBy("symbol", "ts").agg(*[F.max(F.when(F.col("h") == h, F.col("alpha"))).alias(f"alpha_{h}") for h in m.HORIZONS])
    rows = features.feature_rows(bars, m.BENCHMARK).select("symbol", "ts", *TABULAR)
    made = lambda: windows.ordinals(m.cutoffs(spark, folder)).select("ordinal", "symbol", "ts").join(rows, ["symbol", "ts"], "left").join(labels, ["symbol", "ts"], "left").repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    return m.stage(spark, folder, "numbered", {"features": TABULAR, "horizons": m.HORIZONS}, made)


@query(
    f"WITH {FEATURES}{CUTOFFS.replace(BARS, '')}{LABELS.replace(BARS, '')}, tb AS (SELECT symbol, ts, "
    + ", ".join(f"max(alpha) FILTER (h = {h}) AS alpha_{h}" for h in m.HORIZONS)
    + " FROM lab GROUP BY symbol, ts) SELECT n.ordinal, n.symbol, n.ts, round(f.ret_5, 5) + 0 AS ret_5, round(f.sma_20, 5) + 0 AS sma_20, round(b.ret_5, 5) + 0 AS bench_ret_5, round(f.ret_5 - b.ret_5, 5) + 0 AS diff_ret_5, "
    + r(*[f"alpha_{h}" for h in m.HORIZONS], digits=5)
    + " FROM num n LEFT JOIN ft f ON f.symbol = n.symbol AND f.ts = n.ts LEFT JOIN (SELECT * FROM ft WHERE symbol = 'ALL') b ON b.ts = n.ts LEFT JOIN tb ON tb.symbol = n.symbol AND tb.ts = n.ts",
    digits=5,
)
def a34_tabular_cache(spark, folder):
    """A build that stops after two steps, and one that goes on."""
    rows = numbered_rows(spark, folder)
    total = rows.count()
    place, contract = _place(spark, "tabular"), {"features": list(TABULAR), "horizons": m.HORIZONS}
    step = max(1, -(-total // 5))
    tabular.TabularCache(spark, place, contract, total, step).build(rows, steps=2)
    whole = tabular.TabularCache(spark, place, contract, total, step)
    whole.build(rows)
    return whole.read() if total else rows


def vendor_lines(spark, folder):
    """Orders as a vendor's lines: some are cut off, some have no date or one of another month, no price, or wrong bounds."""
    k, price = F.col("k"), F.col("price")
    day = F.when(k % 83 == 0, "soon").when(k % 79 == 0, "1901-01-01").otherwise(F.col("ts").cast("string"))
    low = F.when(k % 73 == 0, price * 1.5).when(k % 71 == 0, -price).otherwise(price)
    close = F.when(k % 67 != 0, price)
    text = F.to_json(F.struct(day.alias("date"), price.alias("open"), price.alias("high"), low.alias("low"), close.alias("close"), F.when(k % 61 == 0, -1.0).otherwise(k.cast("double")).alias("volume")))
    return src.order_trades(spark, folder).select("symbol", "ts", F.when(k % 89 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


VENDOR = "vl AS (SELECT r_name AS symbol, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS price, CASE WHEN o_orderkey % 89 = 0 THEN 'not_json' WHEN o_orderkey % 83 = 0 THEN 'bad_date' WHEN o_orderkey % 79 = 0 THEN 'other_month' WHEN o_orderkey % 67 = 0 THEN 'missing_value' WHEN o_orderkey % 73 <> 0 AND o_orderkey % 71 = 0 THEN 'non_positive_price' WHEN o_orderkey % 61 = 0 THEN 'negative_volume' WHEN o_orderkey % 73 = 0 THEN 'bad_bounds' END AS reason FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def vendor_place(spark, folder) -> str:
    place = _place(spark, "vendor")
    vendor.write(vendor_lines(spark, folder), place)
    return place


@query(f"WITH {VENDOR} SELECT symbol, ts, count(*) AS n, round(max(price), 6) + 0 AS high FROM vl WHERE reason IS NULL AND symbol IN ('ASIA', 'EUROPE') AND ts >= DATE '1996-03-15' GROUP BY symbol, ts")
def a25_vendor_bars(spark, folder):
    """Two markets from a day on; files of other markets and months stay closed."""
    rows = vendor.read(spark, vendor_place(spark, folder))
    return rows.where("symbol in ('ASIA', 'EUROPE') and ts >= date'1996-03-15'").groupBy("symbol", "ts").agg(F.count("*").alias("n"), F.max("high").alias("high"))


@query(f"WITH {VENDOR} SELECT symbol, reason, count(*) AS n FROM vl WHERE reason IS NOT NULL GROUP BY symbol, reason")
def a25_vendor_rejects(spark, folder):
    return vendor.rejects(spark, vendor_place(spark, folder)).groupBy("symbol", "reason").agg(F.count("*").alias("n"))


# digests and slices

TREE = (
    wide.MARKETS
    + """,
dr AS (SELECT symbol, strftime(ts, '%Y-%m') AS month, ts, CAST(volume AS BIGINT) AS volume FROM mb),
dl AS (SELECT symbol, month, sha256(string_agg(sha256('{"asset":"' || symbol || '","ts":"' || ts || '","volume":' || volume || '}'), ',' ORDER BY ts)) AS d, count(*) AS n FROM dr GROUP BY 1, 2),
dy AS (SELECT symbol, sha256(string_agg(d, ',' ORDER BY month)) AS d, CAST(sum(n) AS BIGINT) AS n FROM dl GROUP BY 1),
dh AS (SELECT substr(sha256(symbol), 1, 2) AS h, sha256(string_agg(d, ',' ORDER BY symbol)) AS d, CAST(sum(n) AS BIGINT) AS n FROM dy GROUP BY 1)"""
)


def digest_rows(spark, folder):
    rows = wide.bars(spark, folder).select(F.col("symbol").alias("asset"), "ts", F.col("volume").cast("long").alias("volume"), F.date_format("ts", "yyyy-MM").alias("month"))
    return rows.select("*", *digests.spread("asset", levels=1))


def bar_tree(rows):
    return stages.written(digests.tree(rows, ["hash_0", "asset", "month"], ["ts"], ["asset", "ts", "volume"]), "tree")


@query(f"WITH {TREE} SELECT 3 AS level, substr(sha256(symbol), 1, 2) || '/' || symbol || '|' || month AS path, d AS digest, n FROM dl UNION ALL SELECT 2, substr(sha256(symbol), 1, 2) || '/' || symbol, d, n FROM dy UNION ALL SELECT 1, h, d, n FROM dh UNION ALL SELECT 0, '', sha256(string_agg(d, ',' ORDER BY h)), CAST(sum(n) AS BIGINT) FROM dh")
def n1_digest_tree(spark, folder):
    """The bars of all symbols by range of hash, symbol and month."""
    p = lambda i: F.get("path", F.lit(i))
    return bar_tree(digest_rows(spark, folder)).select("level", F.concat(F.coalesce(p(0), F.lit("")), F.coalesce(F.concat(F.lit("/"), p(1)), F.lit("")), F.coalesce(F.concat(F.lit("|"), p(2)), F.lit(""))).alias("path"), "digest", "n")


@query(f"WITH {TREE}, ch AS (SELECT symbol, month, count(*) AS a, count(*) FILTER (NOT (symbol LIKE 'BRAND#3/%' AND day(ts) = 17)) AS b, max(CASE WHEN symbol LIKE 'BRAND#4/%' AND ts = DATE '1996-05-05' THEN 1 ELSE 0 END) AS changed FROM dr GROUP BY 1, 2) SELECT symbol AS asset, month, a AS n_one, nullif(b, 0) AS n_other FROM ch WHERE a <> b OR changed = 1")
def h11_differing_ranges(spark, folder):
    """A store against one that lacks some bars and has others changed."""
    rows = digest_rows(spark, folder)
    changed = F.col("asset").like("BRAND#4/%") & (F.col("ts") == F.lit("1996-05-05").cast("date"))
    other = rows.where(~(F.col("asset").like("BRAND#3/%") & (F.dayofmonth("ts") == 17))).withColumn("volume", F.when(changed, F.col("volume") + 1).otherwise(F.col("volume")))
    found = digests.differing(bar_tree(rows), bar_tree(other), 3)
    return found.select(F.get("path", F.lit(1)).alias("asset"), F.get("path", F.lit(2)).alias("month"), "n_one", "n_other")


@query(f"WITH {CUTOFFS} SELECT symbol, ts, idx, label_end FROM cand")
def d8_sliced_candidates(spark, folder):
    """The cutoffs of d8, by slices of 64 bars."""
    found = lambda bars, mark: store.candidates(bars, mark, m.WINDOW, m.HORIZON, m.THRESHOLD)
    return slices.by_slices(m.bars(spark, folder), m.BENCHMARK, found, 64, m.WINDOW - 1, m.HORIZON)


@query(f"WITH {HISTORY} SELECT symbol, ts, {r(*features.SCALE_NAMES, digits=4)} FROM hs", digits=4)
def f16_sliced_scales(spark, folder):
    """The scales of f16, by slices of 200 bars. Dates that the benchmark lacks do not count there, so more bars are borrowed than windows have."""
    return slices.by_slices(m.bars(spark, folder), m.BENCHMARK, features.historical_scales, 200, 100, 0)


# files and sinks


@query(f"WITH {BARS} SELECT kind, symbol, ts, {r('open', 'high', 'low', 'close', 'volume')} FROM bars, (VALUES ('csv'), ('parquet')) k(kind)")
def a1_read_files(spark, folder):
    """The bars written as CSV with a vendor's names, and as checked Parquet (A2), read and normalised."""
    bars, place = src.region_bars(spark, folder), _place(spark, "files")
    named = bars.select(F.col("symbol").alias("Ticker"), F.col("ts").alias("Date"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    named.write.option("header", True).csv(f"{place}/all.csv")
    src.write_bars(bars, f"{place}/all.parquet")
    parts = [intake.normalised(src.read_bars(spark, f"{place}/all.{kind}")).select(F.lit(kind).alias("kind"), "symbol", F.col("ts").cast("date").alias("ts"), "open", "high", "low", "close", "volume") for kind in ("csv", "parquet")]
    return store.union_all(parts)


@query(f"WITH {BARS} SELECT CAST(year(ts) AS VARCHAR) AS part, symbol, count(*) AS n, round(sum(close), 4) + 0 AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2", digits=4)
def a3_immutable_sink(spark, folder):
    """A part a year; later ones come with other types and another order of columns."""
    bars, made = src.region_bars(spark, folder), sink.ImmutableSink(spark, _place(spark, "sink"))
    for year in [row["y"] for row in bars.select(F.year("ts").alias("y")).distinct().orderBy("y").collect()]:  # a row a year
        own = bars.where(F.year("ts") == year)
        odd = own.select(F.col("volume").cast("long").alias("volume"), F.col("close").cast("string").alias("close"), "ts", "symbol", "open", "high", "low")
        made.append(own if year % 2 else odd, str(year))
    return made.read().groupBy("part", "symbol").agg(F.count("*").alias("n"), F.sum("close").alias("close"), F.sum("volume").alias("volume"))
