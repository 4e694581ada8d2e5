"""The tables that the queries share, and whole plans from orders to evaluated forecasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import adjust, metrics, store, windows
from ..sources import bars as src
from ..sources import stages

BENCHMARK, WINDOW, HORIZON, THRESHOLD = src.BENCHMARK, 20, 14, 4.0
HORIZONS = [1, 5, 14]
TRAIN_END, VALIDATION_END, TEST_END = "1996-01-01", "1997-01-01", "1998-01-01"


#: The tables that bars are made of.
TABLES = ("orders", "customer", "nation", "region")


def stage(spark: SparkSession, folder: str, name: str, contract: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage table of these order tables: made once, and read by all plans that need it."""
    return stages.kept(spark, name, {"made": 1} | contract, [f"{folder}/{t}.parquet" for t in TABLES], make)


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Adjusted daily bars of the regions and the benchmark."""
    return stage(spark, folder, "bars", {}, lambda: adjust.back_adjust(src.region_bars(spark, folder), src.order_actions(spark, folder)))


def cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return store.candidates(bars(spark, folder), BENCHMARK, WINDOW, HORIZON, THRESHOLD)


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return adjust.alphas(bars(spark, folder), BENCHMARK, HORIZONS)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with the momentum of their cutoff, null where there is none: one join and one chain of windows."""
    w = Window.partitionBy("symbol").orderBy("ts")
    price = lambda c: F.when(F.col(c).isNotNull(), F.ln(F.greatest(c, F.lit(1e-12))))  # noqa: E731  # greatest passes nulls over
    ahead = price("adjusted_close") - price("b_close")
    return adjust.alphas(bars(spark, folder), BENCHMARK, HORIZONS, {"mom": ahead - F.lag(ahead, 5).over(w)})


def training(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("ts") < F.lit(TRAIN_END).cast("date"))


def scales(spark: SparkSession, folder: str) -> DataFrame:
    """(h, n, scale) of the training labels, a stage table."""
    return stage(spark, folder, "scales", {"train_end": TRAIN_END, "horizons": HORIZONS}, lambda: adjust.robust_scales(training(labels(spark, folder))))


def always(spark: SparkSession, folder: str) -> DataFrame:
    """(h, m) of always_buy, a stage table."""
    return stage(spark, folder, "always", {"train_end": TRAIN_END, "horizons": HORIZONS}, lambda: metrics.bought(training(labels(spark, folder)), scales(spark, folder)))


def medians(spark: SparkSession, folder: str) -> DataFrame:
    """The rules' central forecasts for every label with a momentum."""
    return metrics.rule_medians(labelled(spark, folder).where("mom is not null"), always(spark, folder))


def residuals(spark: SparkSession, folder: str) -> DataFrame:
    """(rule, h, n, r) of the training residuals, a stage table."""
    return stage(spark, folder, "residuals", {"train_end": TRAIN_END, "horizons": HORIZONS}, lambda: metrics.offsets(training(medians(spark, folder))))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Rule forecasts with calibrated quantiles for all labels after the training dates."""
    later = medians(spark, folder).where(F.col("ts") >= F.lit(TRAIN_END).cast("date"))
    made = metrics.calibrated(later, residuals(spark, folder))
    return made.join(F.broadcast(scales(spark, folder).select("h", "scale")), "h")  # a row a horizon


def losses(spark: SparkSession, folder: str) -> DataFrame:
    """H8 of all predictions, a stage table: a row a rule and date."""
    return stage(spark, folder, "losses", {"train_end": TRAIN_END, "horizons": HORIZONS}, lambda: metrics.daily(predictions(spark, folder), "rule"))


def candidate_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: orders to bars, actions, extreme changes, benchmark calendar, cutoffs, ranges."""
    return store.islands(cutoffs(spark, folder)).orderBy("symbol", "start_index")


def build_store(spark: SparkSession, folder: str, out: str) -> dict[str, str]:
    """Bars clustered by symbol, the symbol index and the split ranges as three tables; their paths."""
    made = bars(spark, folder)
    paths = {name: f"{out}/{name}" for name in ("bars", "index", "ranges")}
    src.write_bars(made, paths["bars"], replace=True)
    kept = spark.read.parquet(paths["bars"])
    store.symbol_index(kept, BENCHMARK, THRESHOLD).write.mode("overwrite").parquet(paths["index"])
    valid = store.candidates(kept, BENCHMARK, WINDOW, HORIZON, THRESHOLD)
    split = store.split_by_dates(valid, TRAIN_END, VALIDATION_END, TEST_END).where("split in ('train', 'validation', 'test')")
    store.islands(split, "symbol", "split").write.mode("overwrite").parquet(paths["ranges"])
    return paths


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    return windows.ordinals(cutoffs(spark, folder))
