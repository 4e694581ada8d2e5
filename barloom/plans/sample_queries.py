"""Queries of samples, batches, windows and sets (D, E, G, I, N, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import intake, samples, store, windows
from ..sources import bars as src
from . import market as m
from .catalogue import FRACTION, INDEX, ISLANDS, events_numbered, query, t
from .oracle import BARS, CUTOFFS, LABELS, r

# stores and splits

CONTEXT = FRACTION.replace("(SELECT DISTINCT ts FROM bars)", "(SELECT DISTINCT l.ts FROM lp l JOIN cand c ON l.symbol = c.symbol AND l.idx BETWEEN c.idx - 19 AND c.idx)")


@query(f"WITH {CUTOFFS}{CONTEXT} SELECT symbol, ts, idx, label_end, split FROM sp")
def d19_context_split(spark, folder):
    return store.split_by_context(m.cutoffs(spark, folder), m.bars(spark, folder), m.WINDOW, store.FractionPolicy())


@query(f"WITH {CUTOFFS}, rg AS ({ISLANDS.format(keys='symbol', rows='cand')}) SELECT symbol, CAST(sum(stop_index - start_index) AS BIGINT) AS expected, CAST(sum(count) AS BIGINT) AS stored, CAST(sum(count) AS BIGINT) AS both FROM rg GROUP BY symbol")
def d20_second_audit(spark, folder):
    """Cutoffs counted a second way against the stored ranges."""
    expected = store.second_candidates(m.bars(spark, folder), m.BENCHMARK, m.WINDOW, m.HORIZON, m.THRESHOLD)
    return store.audit_ranges(expected, m.candidate_ranges(spark, folder))


@query(
    f"WITH {CUTOFFS}, rg AS ({ISLANDS.format(keys='symbol', rows='cand')}), st AS (SELECT symbol, unnest(generate_series(start_index + count % 3, stop_index - 1 + count % 2)) AS idx FROM rg WHERE count > 3) "
    "SELECT symbol, count(c) AS expected, count(s) AS stored, count(c) FILTER (s IS NOT NULL) AS both FROM (SELECT coalesce(cand.symbol, st.symbol) AS symbol, cand.idx AS c, st.idx AS s FROM cand FULL JOIN st ON cand.symbol = st.symbol AND cand.idx = st.idx) GROUP BY symbol"
)
def d20_wrong_ranges(spark, folder):
    """Stored ranges that lack cutoffs or have some too many."""
    n = F.col("count")
    held = m.candidate_ranges(spark, folder).where(n > 3).withColumns({"start_index": F.col("start_index") + n % 3, "stop_index": F.col("stop_index") + n % 2})
    return store.audit_ranges(store.second_candidates(m.bars(spark, folder), m.BENCHMARK, m.WINDOW, m.HORIZON, m.THRESHOLD), held)


@query(f"WITH {CUTOFFS} SELECT symbol, ts, idx FROM cand")
def d20_second_candidates(spark, folder):
    return store.second_candidates(m.bars(spark, folder), m.BENCHMARK, m.WINDOW, m.HORIZON, m.THRESHOLD)


@query(f"WITH {BARS}, {INDEX}, f AS (SELECT symbol, count(*) AS found FROM bars WHERE symbol <> 'ASIA' GROUP BY 1) SELECT coalesce(ix.symbol, f.symbol) AS symbol, coalesce(row_count, 0) AS named, coalesce(found, 0) AS found, coalesce(row_count, 0) = coalesce(found, 0) AS same FROM ix FULL JOIN f ON ix.symbol = f.symbol")
def n4_index_audit(spark, folder):
    """The index against a store that lacks a symbol's file."""
    index = store.symbol_index(m.bars(spark, folder), m.BENCHMARK, m.THRESHOLD)
    return store.index_audit(index, src.region_bars(spark, folder).where("symbol <> 'ASIA'"))


# windows and samples

WINDOWS = """,
wj AS (SELECT a.*, b.adjusted_close AS ba, b.close AS br FROM lp a LEFT JOIN (SELECT ts, adjusted_close, close FROM adj WHERE symbol = 'ALL') b ON a.ts = b.ts WHERE a.symbol <> 'ALL'),
wl AS (SELECT symbol, ts, idx, adjusted_close AS za, close AS zr, ba AS zb, br AS zbr, CASE WHEN volume > 0 THEN split_adjusted_volume / volume ELSE 1 END AS rate, count(ba) OVER w AS n, list(adjusted_close) OVER w AS c, list(split_adjusted_volume) OVER w AS v, list(ba) OVER w AS b
       FROM wj WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
wa AS (SELECT symbol, ts, idx, list_transform(c, lambda x: x / za * zr) AS closes, list_transform(v, lambda x: x / rate) AS volumes, list_transform(b, lambda x: x / zb * zbr) AS bench FROM wl WHERE n = 20)"""


@query(f"WITH {BARS}{WINDOWS} SELECT symbol, ts, idx, round(ln(list_sum(closes)), 5) + 0 AS closes, round(ln(1 + list_sum(volumes)), 5) + 0 AS volumes, round(ln(list_sum(bench)), 5) + 0 AS bench_closes, round(ln(closes[1] / closes[20]), 5) + 0 AS first_close FROM wa", digits=5)
def e5_window_arrays(spark, folder):
    made = samples.window_arrays(m.bars(spark, folder), m.BENCHMARK, m.WINDOW)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    first = fn.log(F.col("closes")[0] / F.element_at("closes", -1))
    return made.select("symbol", "ts", "idx", F.ln(total("closes")).alias("closes"), F.log1p(total("volumes")).alias("volumes"), F.ln(total("bench_closes")).alias("bench_closes"), first.alias("first_close"))


TRAINING = ", ".join(f"round(max(alpha) FILTER (h = {h}), 6) + 0 AS alpha_{h}, max(end_at) FILTER (h = {h}) AS end_{h}" for h in m.HORIZONS)


@query(
    f"""
WITH {LABELS}{WINDOWS}, wd AS (SELECT symbol, ts, list(ts) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS d FROM wj), tg AS (SELECT symbol, ts, count(*) AS valid, {TRAINING} FROM lab GROUP BY symbol, ts)
SELECT wa.symbol, wa.ts, idx, round(ln(list_sum(closes)), 5) + 0 AS closes, CAST(list_sum(list_transform(d, lambda x: isodow(x) - 1)) AS BIGINT) AS weekdays, CAST(list_sum(list_transform(d, lambda x: day(x) * month(x))) AS BIGINT) AS days, coalesce(valid, 0) AS valid, {", ".join(f"alpha_{h}, end_{h}" for h in m.HORIZONS)}
FROM wa JOIN wd ON wd.symbol = wa.symbol AND wd.ts = wa.ts LEFT JOIN tg ON tg.symbol = wa.symbol AND tg.ts = wa.ts"""
)
def e5_training_rows(spark, folder):
    rows = samples.training_rows(m.bars(spark, folder), m.BENCHMARK, m.WINDOW, m.HORIZONS)
    total = lambda c, f, zero: F.aggregate(c, zero, lambda s, x: s + f(x))
    of = [c for i, h in enumerate(m.HORIZONS) for c in (F.col("targets")[i].alias(f"alpha_{h}"), F.when(F.col("valid")[i], F.col("end_at")[i]).alias(f"end_{h}"))]
    return rows.select("symbol", "ts", "idx", F.round(F.ln(total("closes", lambda x: x, F.lit(0.0))), 5).alias("closes"), total("times", lambda x: x["weekday"], F.lit(0)).alias("weekdays"), total("times", lambda x: x["day"] * x["month"], F.lit(0)).alias("days"), F.size(F.filter("valid", lambda v: v)).alias("valid"), *of)


def block_sample(spark, folder):
    numbered = m.numbered(spark, folder)
    return windows.block_sample(numbered, windows.BlockSample(numbered.count(), fraction=0.4, most=1500, block=16))


SAMPLED = """,
bc AS (SELECT count(*) AS n, CAST(ceil(count(*) / 16.0) AS BIGINT) AS b FROM num),
bs AS (SELECT n, b, least(1500, greatest(1, CAST(floor(n * 0.4::DOUBLE) AS BIGINT))) AS target, (SELECT min(x) FROM range(1, 100000) t(x) WHERE x >= CASE WHEN 7919 % b = 0 THEN 1 ELSE 7919 % b END AND gcd(x, b) = 1) AS m FROM bc),
bk AS (SELECT i AS rank, (m * i + 13) % b AS blk FROM bs, range(0, 100000) t(i) WHERE i < b),
bz AS (SELECT blk, coalesce(sum(least(16, n - blk * 16)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bk, bs),
smp AS (SELECT symbol, ts, idx, ordinal, CAST(before + ordinal % 16 AS BIGINT) AS place FROM num JOIN bz ON ordinal // 16 = blk, bs WHERE before + ordinal % 16 < target)"""


@query(f"WITH {CUTOFFS}{SAMPLED}{WINDOWS} SELECT s.ordinal, s.place, w.symbol, w.ts, round(ln(list_sum(closes)), 5) + 0 AS closes FROM smp s JOIN wa w ON s.symbol = w.symbol AND s.idx = w.idx", digits=5)
def e5_sampled_arrays(spark, folder):
    """The windows of a block sample, as the vectorised reader gathers them."""
    arrays = samples.window_arrays(m.bars(spark, folder), m.BENCHMARK, m.WINDOW)
    made = samples.gather(block_sample(spark, folder).select("symbol", "idx", "ordinal", "place"), arrays)
    return made.select("ordinal", "place", "symbol", "ts", F.ln(F.aggregate("closes", F.lit(0.0), lambda s, x: s + x)).alias("closes"))


@query(f"WITH {CUTOFFS}{LABELS.replace(BARS, '')}, tg AS (SELECT n.symbol, n.ts, n.ordinal, l.h, l.alpha FROM num n JOIN lab l ON n.symbol = l.symbol AND n.ts = l.ts) SELECT symbol, ts, ordinal, CAST(h AS BIGINT) AS h, round(alpha, 6) + 0 AS alpha FROM tg")
def e8_targets(spark, folder):
    return samples.targets_of(m.numbered(spark, folder), m.labels(spark, folder))


@query("WITH c AS (SELECT count(*) AS n FROM events), f AS (SELECT event_id AS ordinal, event_id AS pos FROM events UNION ALL SELECT event_id, event_id + n FROM events, c WHERE event_id < (96 - n % 96) % 96) SELECT ordinal, pos // 96 AS batch, pos % 96 AS slot FROM f WHERE pos // 96 >= 3")
def e11_resume(spark, folder):
    rows = events_numbered(spark, folder)
    return samples.resumed(windows.batches(rows, 96, rows.count()), 3)


@query(
    """
WITH c AS (SELECT count(*) AS n FROM events), b AS (SELECT DISTINCT CAST(ceil(n * i / 4.0) AS BIGINT) AS s FROM c, range(1, 5) t(i) UNION SELECT 37 FROM c),
x AS (SELECT event_id AS place, (SELECT max(s) FROM b WHERE s <= event_id) AS section FROM events WHERE event_id >= 37)
SELECT place, section, (place - section) // 64 AS batch_in_section FROM x"""
)
def e11_cursor(spark, folder):
    rows = events_numbered(spark, folder).withColumnRenamed("ordinal", "place")
    return samples.cursor_batches(rows, rows.count(), 64, 4, 37)


@query("SELECT event_id AS ordinal FROM events ORDER BY md5('11:' || event_id), event_id LIMIT 200")
def e14_uniform_sample(spark, folder):
    """A sample of a set size is what this operator is."""
    return samples.uniform_sample(events_numbered(spark, folder), 200, 11)


@query(
    """
WITH a AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY 1), l AS (SELECT max(len(v)) AS longest FROM a)
SELECT o_custkey, len(v) AS length, longest AS padded, round(list_sum(v), 2) + 0 AS total, len(v) AS valid, CASE WHEN len(v) < longest THEN 0::DOUBLE ELSE round(v[longest], 2) END AS last FROM a, l""",
    digits=2,
)
def e15_padded(spark, folder):
    held = t(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    made = samples.padded(held.select("o_custkey", F.transform("x", lambda x: x["o_totalprice"]).alias("v")), "v")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return made.select("o_custkey", "length", F.size("v").alias("padded"), total.alias("total"), F.size(F.filter("mask", lambda x: x)).alias("valid"), F.element_at("v", -1).alias("last"))


@query(f"WITH {LABELS} SELECT symbol, ts, CAST(h AS BIGINT) AS h, round(alpha, 6) + 0 AS alpha FROM lab")
def e17_joined_batches(spark, folder):
    labels = m.labels(spark, folder).select("symbol", "ts", "h", "alpha")
    return samples.joined_batches([labels.where("h = 1"), labels.where("h > 1")])


@query(f"WITH {CUTOFFS}{SAMPLED} SELECT symbol, ts, idx, ordinal, place FROM smp")
def e18_capped_sample(spark, folder):
    """A share of the cutoffs by whole blocks, with a cap."""
    return block_sample(spark, folder).select("symbol", "ts", "idx", "ordinal", "place")


@query(f"WITH {BARS} SELECT symbol, ts, idx FROM lp WHERE idx >= 60 AND symbol <> 'ALL'")
def e20_past_only(spark, folder):
    return samples.past_only(src.indexed(m.bars(spark, folder)).where(F.col("symbol") != m.BENCHMARK))


@query("SELECT user_id, round(avg(value) FILTER (event_id % 3 <> 0), 5) + 0 AS mean, round(arg_max(value, event_id) FILTER (event_id % 3 <> 0), 5) + 0 AS last FROM events GROUP BY user_id", digits=5)
def g13_pooled(spark, folder):
    e = t(spark, folder, "events").withColumn("valid", F.col("event_id") % 3 != 0)
    return samples.pooled(e, "user_id", "event_id", "value", "valid")


@query(f"WITH {LABELS} SELECT ts < DATE '1996-01-01' AS trains, CAST(h AS BIGINT) AS h, count(*) AS n, count(DISTINCT symbol) AS symbols, count(DISTINCT ts) AS dates, min(ts) AS first_at, max(ts) AS last_at FROM lab GROUP BY 1, 2")
def g14_set_summary(spark, folder):
    return samples.set_summary(m.labels(spark, folder).withColumn("trains", F.col("ts") < F.lit(m.TRAIN_END).cast("date")), "trains", "h")


# sorts, sets, schedules


@query(f"WITH {BARS} SELECT symbol, ts, {r('close')} FROM bars ORDER BY symbol, ts")
def i1_ordered(spark, folder):
    return intake.ordered(src.region_bars(spark, folder).select("symbol", "ts", "close"), "symbol", "ts")


@query("SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus <> 'F') AS step, arg_max(round(o_totalprice, 4) + 0, o_orderkey) FILTER (o_orderstatus <> 'F') AS price FROM orders GROUP BY o_custkey", digits=4)
def i3_latest_open(spark, folder):
    step = F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))
    return t(spark, folder, "orders").groupBy("o_custkey").agg(F.max(step).alias("step"), F.max_by("o_totalprice", step).alias("price"))


@query("SELECT p_partkey, CAST(2 ** i AS BIGINT) AS size FROM part, range(0, 20) t(i) WHERE 2 ** i <= p_size")
def i7_powers(spark, folder):
    return t(spark, folder, "part").select("p_partkey", F.explode(fn.powers_of_two(F.col("p_size"))).alias("size"))


@query("WITH b AS (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS best FROM part) SELECT p_brand, CAST(min(p_size) AS BIGINT) AS size, round(max(best), 4) + 0 AS best FROM b WHERE p_retailprice >= 0.97::DOUBLE * best GROUP BY p_brand", digits=4)
def i8_near_best(spark, folder):
    return samples.near_best(t(spark, folder, "part"), "p_brand", "p_size", "p_retailprice")


@query("SELECT CAST(o_orderdate AS DATE) AS ts FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def i10_union_distinct(spark, folder):
    return t(spark, folder, "orders").select(F.to_date("o_orderdate").alias("ts")).union(t(spark, folder, "lineitem").select(F.to_date("l_shipdate"))).distinct()


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(100 + ceil(i * 1000 / 8.0) AS BIGINT) AS canonical, CAST(40 + ceil(i * 300 / 8.0) AS BIGINT) AS runtime FROM nation, range(1, 9) t(i)")
def p2_alignment(spark, folder):
    pairs = F.explode(samples.aligned_steps(fn.even_steps(100, 1000, 8), fn.even_steps(40, 300, 8))).alias("x")
    return t(spark, folder, "nation").select("n_nationkey", pairs).select("n_nationkey", "x.canonical", "x.runtime")
