"""Bar checks, the symbol index, forecast cutoffs and chronological splits (B, D)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSET_TYPES = ("stock", "etf", "future", "option", "index", "other")
TOLERANCE = 1e-8

#: B2: rule name and the condition that breaks it.
RULES = {
    "missing_ts": "ts is null",
    "empty_symbol": "symbol is null or trim(symbol) = ''",
    "non_finite": "coalesce(isnan(open) or isnan(high) or isnan(low) or isnan(close) or isnan(volume), true)",
    "non_positive_price": "least(open, high, low, close) <= 0",
    "negative_volume": "volume < 0",
    "high_below": f"high < greatest(low, open, close) - {TOLERANCE}D",
    "low_above": f"low > least(high, open, close) + {TOLERANCE}D",
}


def rule_counts(bars: DataFrame) -> DataFrame:
    """B2: broken rules by name, in one pass, with duplicate keys counted apart."""
    broken = bars.agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()])
    twice = bars.groupBy("symbol", "ts").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_key"))
    both = broken.crossJoin(twice)  # one row each
    return both.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in both.columns]), F.array(*[F.col(c).cast("long") for c in both.columns]))).alias("rule", "broken"))


def transitions(bars: DataFrame, threshold: float) -> DataFrame:
    """Extreme (log change of the adjusted close over the threshold) and gap_days to the bar before."""
    w = Window.partitionBy("symbol").orderBy("ts")
    price = F.greatest("adjusted_close", F.lit(1e-12))
    jump = F.abs(F.ln(price) - F.ln(F.lag(price).over(w)))
    return bars.withColumn("extreme", F.coalesce(jump > threshold, F.lit(False))).withColumn("gap_days", F.greatest(F.coalesce(F.datediff("ts", F.lag("ts").over(w)), F.lit(0)), F.lit(0)))


def quality(bars: DataFrame, threshold: float) -> DataFrame:
    """One row of totals."""
    return transitions(bars, threshold).agg(F.count("*").alias("n_rows"), F.count_distinct("symbol").alias("symbols"), F.count_if(F.col("volume") == 0).alias("zero_volume"), F.count_if("extreme").alias("extremes"), F.count_if(F.col("gap_days") > 10).alias("long_gaps"), F.min("ts").alias("start_at"), F.max("ts").alias("end_at"))


def consistent(column: str) -> F.Column:
    """The value if there is exactly one, nulls apart, else null."""
    return F.when(F.min(column) == F.max(column), F.max(column))


def symbol_index(bars: DataFrame, benchmark: str, threshold: float) -> DataFrame:
    """A row for each symbol; eligible unless it is the benchmark or its benchmark is missing."""
    marks = bars.where(F.col("symbol") == benchmark).select(F.col("symbol").alias("benchmark_symbol")).distinct()
    made = transitions(bars, threshold).groupBy("symbol").agg(F.count("*").alias("row_count"), F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count_if("extreme").alias("extreme_count"), F.count_if(F.col("gap_days") > 10).alias("long_gap_count"))
    joined = made.withColumn("wanted", F.lit(benchmark)).join(F.broadcast(marks), F.col("wanted") == F.col("benchmark_symbol"), "left")
    reason = F.when(F.col("symbol") == benchmark, "benchmark_self").when(F.col("benchmark_symbol").isNull(), "missing_benchmark").otherwise("eligible")
    return joined.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible").drop("wanted")


def candidates(bars: DataFrame, benchmark: str | DataFrame, window: int, horizon: int, threshold: float) -> DataFrame:
    """Cutoffs with a whole context and label, no extreme change in them and every date in the symbol's benchmark."""
    from .marks import marked

    own = transitions(marked(bars, benchmark, {"missing": F.lit(0)}), threshold)
    w = Window.partitionBy("symbol").orderBy("ts")
    span = lambda first, last: w.rowsBetween(first, last)
    marked = own.withColumn("bad", F.sum(F.col("extreme").cast("int")).over(span(2 - window, horizon))).withColumn("absent", F.sum(F.coalesce("missing", F.lit(1))).over(span(1 - window, horizon)))
    marked = marked.withColumn("idx", F.row_number().over(w) - 1).withColumn("label_end", F.lead("ts", horizon).over(w))
    return marked.where((F.col("idx") >= window - 1) & F.col("label_end").isNotNull() & (F.col("bad") == 0) & (F.col("absent") == 0)).select("symbol", "ts", "idx", "label_end")


def islands(cutoffs: DataFrame, *keys: str) -> DataFrame:
    """Maximal runs of consecutive idx within the keys, as half-open ranges."""
    keys = keys or ("symbol",)
    run = F.col("idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))
    ends = [F.min("ts").alias("cutoff_start_at"), F.max("ts").alias("cutoff_end_at"), F.max("label_end").alias("label_end_max_at")]
    return cutoffs.withColumn("run", run).groupBy(*keys, "run").agg(F.min("idx").alias("start_index"), (F.max("idx") + 1).alias("stop_index"), F.count("*").alias("count"), *ends).drop("run")


def exclusions(index: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """How many symbols are left out, by reason; eligible ones without a cutoff have no_valid_cutoffs."""
    without = index.where("eligible").join(cutoffs.select("symbol").distinct(), "symbol", "left_anti").withColumn("reason", F.lit("no_valid_cutoffs"))
    return index.where("not eligible").select("reason").union(without.select("reason")).groupBy("reason").agg(F.count("*").alias("symbols"))


def calendar(rows: DataFrame) -> DataFrame:
    """The distinct dates with their numbers from 0. A date a row: small for any number of symbols."""
    return rows.select("ts").distinct().withColumn("pos", F.row_number().over(Window.orderBy("ts")) - 1)


@dataclass(frozen=True)
class FractionPolicy:
    train: float = 0.70
    validation: float = 0.15
    purge: int = 20
    embargo: int = 14


def split_by_fraction(cutoffs: DataFrame, bars: DataFrame, policy: FractionPolicy) -> DataFrame:
    """Boundaries count candidate dates, then purge and embargo count observed dates.

    Training and validation labels must end before the next boundary; the last part has no such guard.
    """
    observed, dates = calendar(bars), calendar(cutoffs)
    n = dates.agg(F.count("*").alias("n"))
    at = dates.crossJoin(n).agg(  # one row
        F.max(F.when(F.col("pos") == F.floor(F.col("n") * F.lit(policy.train)), F.col("ts"))).alias("train_end"), F.max(F.when(F.col("pos") == F.floor(F.col("n") * F.lit(policy.train + policy.validation)), F.col("ts"))).alias("validation_end")
    )
    bounds = at.join(observed.select(F.col("ts").alias("train_end"), F.col("pos").alias("a")), "train_end").join(observed.select(F.col("ts").alias("validation_end"), F.col("pos").alias("b")), "validation_end")
    placed = cutoffs.join(observed, "ts").crossJoin(F.broadcast(bounds))
    split = (
        F.when((F.col("pos") < F.col("a") - policy.purge) & (F.col("label_end") < F.col("train_end")), "train")
        .when((F.col("pos") >= F.col("a") + policy.embargo) & (F.col("pos") < F.col("b") - policy.purge) & (F.col("label_end") < F.col("validation_end")), "validation")
        .when(F.col("pos") >= F.col("b") + policy.embargo, "test")
        .when((F.col("pos") < F.col("a") - policy.purge) | ((F.col("pos") >= F.col("a") + policy.embargo) & (F.col("pos") < F.col("b") - policy.purge)), "label_crosses")
        .otherwise("purge_or_embargo")
    )
    return placed.select("symbol", "ts", "idx", "label_end", split.alias("split"))


def split_by_dates(cutoffs: DataFrame, train_end: str, validation_end: str, test_end: str) -> DataFrame:
    """Half-open regions of dates; a cutoff counts if its label ends inside its region."""
    one, two, three = (F.lit(d).cast("date") for d in (train_end, validation_end, test_end))
    region = F.when(F.col("ts") < one, "train").when(F.col("ts") < two, "validation").when(F.col("ts") < three, "test").otherwise("after_test_end")
    end = F.when(F.col("ts") < one, one).when(F.col("ts") < two, two).otherwise(three)
    return cutoffs.withColumn("split", F.when((region != "after_test_end") & (F.col("label_end") >= end), "label_crosses").otherwise(region))


def split_audit(assigned: DataFrame) -> DataFrame:
    """By split the cutoffs, symbols, first and last cutoff and last label end."""
    return assigned.groupBy("split").agg(F.count("*").alias("cutoffs"), F.count_distinct("symbol").alias("symbols"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max("label_end").alias("label_end_max_at"))


def overlaps(ranges: DataFrame) -> DataFrame:
    """Ranges that start before the one before them has ended, or whose count is not their length."""
    w = Window.partitionBy("symbol").orderBy("start_index", "stop_index", "count")
    checked = ranges.withColumn("before", F.lag("stop_index").over(w))
    return checked.where((F.col("start_index") < F.col("before")) | (F.col("count") != F.col("stop_index") - F.col("start_index"))).drop("before")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def of_split(assigned: DataFrame, split: str) -> DataFrame:
    """B11."""
    return assigned.where(F.col("split") == split).drop("split")


def split_dates(assigned: DataFrame, bounds: dict[str, tuple[str, str]], least: int) -> DataFrame:
    """By market and split the dates, whether cutoffs and labels keep inside the split's half-open bounds, and whether there are enough."""
    made = assigned.where(F.col("split").isin(*bounds)).groupBy("market", "split").agg(F.count_distinct("ts").alias("dates"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max("label_end").alias("label_end_max_at"))
    bound = lambda i: F.element_at(F.create_map(*[F.lit(x) for split, pair in bounds.items() for x in (split, pair[i])]), F.col("split")).cast("date")
    inside = (F.col("first_at") >= bound(0)) & (F.col("last_at") < F.col("label_end_max_at")) & (F.col("label_end_max_at") < bound(1))
    return made.withColumn("inside", inside).withColumn("enough", F.col("dates") >= least)


def split_order(assigned: DataFrame, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """By symbol and split the range of its cutoffs, and whether it starts where the one before has ended or later."""
    turn = F.array_position(F.array(*map(F.lit, splits)), F.col("split"))
    made = assigned.where(F.col("split").isin(*splits)).groupBy("symbol", turn.alias("turn")).agg(F.min("idx").alias("start_index"), (F.max("idx") + 1).alias("stop_index"), F.count("*").alias("count"))
    before = F.lag("stop_index").over(Window.partitionBy("symbol").orderBy("turn"))
    return made.withColumn("after_before", F.coalesce(F.col("start_index") >= before, F.lit(True)))


def split_by_context(cutoffs: DataFrame, bars: DataFrame, window: int, policy: FractionPolicy) -> DataFrame:
    """split_by_fraction by the calendar of the dates that are in some cutoff's context."""
    own = bars.join(cutoffs.select("symbol", "ts", F.lit(1).alias("cut")), ["symbol", "ts"], "left")
    ahead = Window.partitionBy("symbol").orderBy("ts").rowsBetween(0, window - 1)
    return split_by_fraction(cutoffs, own.withColumn("used", F.max("cut").over(ahead)).where("used = 1"), policy)


def second_candidates(bars: DataFrame, benchmark: str | DataFrame, window: int, horizon: int, threshold: float) -> DataFrame:
    """Cutoffs by differences of running totals, independently of `candidates`."""
    from .marks import marked

    w = Window.partitionBy("symbol").orderBy("ts")
    own = transitions(marked(bars, benchmark, {"missing": F.lit(0)}), threshold)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("idx", F.row_number().over(w) - 1).withColumn("gaps", F.sum(F.coalesce("missing", F.lit(1))).over(run)).withColumn("jumps", F.sum(F.col("extreme").cast("int")).over(run))
    gaps = F.lead("gaps", horizon).over(w) - F.coalesce(F.lag("gaps", window).over(w), F.lit(0))
    jumps = F.lead("jumps", horizon).over(w) - F.lag("jumps", window - 1).over(w)
    return own.withColumn("open", (gaps == 0) & (jumps == 0)).where((F.col("idx") >= window - 1) & F.col("open")).select("symbol", "ts", "idx")


def audit_ranges(expected: DataFrame, ranges: DataFrame) -> DataFrame:
    """By symbol how many cutoffs are expected, stored in ranges, and both.

    Expected ones become ranges too, and a walk over the ends of both counts what is in both: a row a
    range end, and never one a stored cutoff.
    """
    run = F.col("idx") - F.row_number().over(Window.partitionBy("symbol").orderBy("idx"))
    own = expected.withColumn("run", run).groupBy("symbol", "run").agg(F.min("idx").alias("a"), (F.max("idx") + 1).alias("b")).drop("run")
    held = ranges.select("symbol", F.col("start_index").alias("a"), F.col("stop_index").alias("b"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    end = lambda at, e, s: F.struct(F.col(at).cast("long").alias("at"), e.alias("expected"), s.alias("stored"))
    ends = own.select("symbol", F.explode(F.array(end("a", one, zero), end("b", -one, zero))).alias("x")).union(held.select("symbol", F.explode(F.array(end("a", zero, one), end("b", zero, -one))).alias("x")))
    at = ends.groupBy("symbol", "x.at").agg(F.sum("x.expected").alias("expected"), F.sum("x.stored").alias("stored"))
    w = Window.partitionBy("symbol").orderBy("at")
    length = F.coalesce(F.lead("at").over(w) - F.col("at"), F.lit(0))
    run_of = lambda c: F.sum(c).over(w)
    walked = at.select("symbol", length.alias("n"), run_of("expected").alias("e"), run_of("stored").alias("s"))
    return walked.groupBy("symbol").agg(F.sum(F.col("n") * F.col("e")).alias("expected"), F.sum(F.col("n") * F.col("s")).alias("stored"), F.sum(F.when((F.col("e") > 0) & (F.col("s") > 0), F.col("n")).otherwise(0)).alias("both"))


def index_audit(index: DataFrame, bars: DataFrame) -> DataFrame:
    """By symbol the rows that the index names and those that there are; symbols of one side alone count."""
    there = bars.groupBy("symbol").agg(F.count("*").alias("found"))
    both = index.select("symbol", F.col("row_count").alias("named")).join(there, "symbol", "full_outer").select("symbol", F.coalesce("named", F.lit(0)).alias("named"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.withColumn("same", F.col("named") == F.col("found"))
