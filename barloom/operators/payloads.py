"""Vendor payloads to bars, and the union of providers (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lenient_number, minguo_date, split_ratio

#: Reasons against a vendor row; several may hold for one row.
REASONS = {
    "missing_value": "ts is null or coalesce(isnan(open) or isnan(high) or isnan(low) or isnan(close) or isnan(volume), true)",
    "non_positive_price": "least(open, high, low, close) <= 0",
    "negative_volume": "volume < 0",
    "bad_bounds": "high < greatest(open, close) - 1e-8D or low > least(open, close) + 1e-8D",
}


def clean_rows(rows: DataFrame) -> DataFrame:
    """Rows that no reason speaks against; of otherwise valid rows with one key, none stays."""
    bad = F.lit(False)
    for rule in REASONS.values():
        bad = bad | F.coalesce(F.expr(rule), F.lit(False))
    kept = rows.where(~bad)
    return kept.withColumn("copies", F.count("*").over(Window.partitionBy("symbol", "ts"))).where("copies = 1").drop("copies")


def reason_counts(rows: DataFrame) -> DataFrame:
    counted = rows.agg(*[F.count_if(F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in REASONS.items()])
    return counted.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in REASONS]), F.array(*[F.col(c) for c in REASONS]))).alias("reason", "dropped"))


def daily_json(lines: DataFrame) -> DataFrame:
    """(symbol, payload) with a JSON array of days to typed rows."""
    schema = "array<struct<date: string, open: double, high: double, low: double, close: double, adjusted_close: double, volume: double>>"
    return lines.select("symbol", F.explode(F.from_json("payload", schema)).alias("d")).select("symbol", F.try_to_date("d.date", "yyyy-MM-dd").alias("ts"), "d.open", "d.high", "d.low", "d.close", "d.adjusted_close", "d.volume")


def quote_tables(lines: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The first table whose headers hold all of `wanted` (header to name), its rows as columns."""
    schema = "struct<tables: array<struct<fields: array<string>, data: array<array<string>>>>>"
    clean = lambda a: F.transform(a, lambda h: F.regexp_replace(h, r"[\s　]", ""))
    tables = F.transform(F.col("j.tables"), lambda t: F.struct(clean(t["fields"]).alias("fields"), t["data"].alias("data")))
    fits = F.filter(tables, lambda t: F.array_size(F.array_except(F.array(*[F.lit(h) for h in wanted]), t["fields"])) == 0)
    found = lines.withColumn("j", F.from_json("payload", schema)).withColumn("t", F.get(fits, F.lit(0)))
    rows = found.where("t is not null").select(*[c for c in lines.columns if c != "payload"], "t.fields", F.explode("t.data").alias("row"))
    return rows.select(*[c for c in lines.columns if c != "payload"], *[F.get("row", F.array_position("fields", F.lit(h)).cast("int") - 1).alias(n) for h, n in wanted.items()])


def quotes(rows: DataFrame) -> DataFrame:
    """Code and texts to numbers; rows without positive prices and a volume are left out."""
    typed = rows.select("code", "ts", *[lenient_number(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])
    return typed.where("open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0")


def split_events(rows: DataFrame) -> DataFrame:
    """(symbol, ts, split) to actions; malformed ones go."""
    return rows.withColumn("r", split_ratio(F.col("split"))).where("r is not null").select("symbol", "ts", "r.price_factor", "r.share_multiplier")


def exchange_actions(actions: DataFrame, details: DataFrame) -> DataFrame:
    """Reference by prior close; free shares a thousand from the detail, where the kind has them."""
    joined = actions.join(details.select("code", "ts", lenient_number(F.col("free_shares")).alias("free")), ["code", "ts"], "left")
    free = F.when(F.col("kind").contains("權"), F.coalesce(1 + F.col("free") / 1000, F.lit(1.0))).otherwise(1.0)
    source = F.when(F.col("kind").contains("權") & F.col("free").isNull(), "no_share_detail").otherwise("exchange")
    return joined.where("prior > 0 and reference > 0").select("code", "ts", (F.col("reference") / F.col("prior")).alias("price_factor"), free.alias("share_multiplier"), source.alias("source"))


def index_bars(prices: DataFrame, returns: DataFrame) -> DataFrame:
    """Index prices with the total return of their date as adjusted close; the last of two returns holds."""
    last = returns.where("total_return is not null").groupBy("ts").agg(F.max_by("total_return", "line").alias("adjusted_close"))
    return prices.join(last, "ts").withColumn("volume", F.lit(0.0))


def active_first(instruments: DataFrame) -> DataFrame:
    """One row a symbol: an active one before others, then by asset type and provider symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("is_active"), "asset_type", "provider_symbol")
    return instruments.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def universe(instruments: DataFrame, each: int, benchmark: str) -> DataFrame:
    """So many of each asset type, active ones first; and the benchmark, if it is known."""
    w = Window.partitionBy("asset_type").orderBy(F.desc("is_active"), "symbol")
    return instruments.withColumn("n", F.row_number().over(w)).where((F.col("n") <= each) | (F.col("symbol") == benchmark)).drop("n")


def roc_dates(rows: DataFrame) -> DataFrame:
    return rows.select("text", minguo_date(F.col("text")).alias("day"))


def inline_actions(rows: DataFrame, allowed_funds: list[str], suffix: str) -> DataFrame:
    """Actions whose free shares a thousand stand in the same row; rows with anything missing go."""
    from .intake import taiwan_type

    code = F.upper(F.trim("code"))
    number = {c: lenient_number(F.col(c)) for c in ("prior", "reference", "free_shares")}
    typed = rows.withColumns({**number, "code": code, "ts": minguo_date(F.col("day"))})
    good = typed.where(taiwan_type(F.col("code"), allowed_funds).isNotNull() & (F.col("prior") > 0) & (F.col("reference") > 0) & (F.col("free_shares") >= 0) & F.col("ts").isNotNull())
    named = good.withColumns({"symbol": F.concat("code", F.lit(suffix)), "price_factor": F.try_divide("reference", "prior"), "share_multiplier": 1 + F.col("free_shares") / 1000, "source": F.lit("exchange")})
    return named.drop("code", "day", "prior", "reference", "free_shares")
