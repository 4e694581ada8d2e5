"""A data source of vendors' daily files (A13, A25): format "barloom_vendor", or `read` and `rejects` here.

Files are lines of JSON, one day a line, under `symbol=.../month=yyyy-MM/`. Filters on symbol and ts are
pushed down: files of other symbols and months are never opened. Files are put together to read partitions
of about `bytes` (32 MB), so many small ones make few tasks. A line that is no bar is a row of the rejects,
with its file, number, reason and text, and not of the bars; nothing is repaired.

Any store that pyarrow opens by its URI can be read; there is no network access of its own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import date, datetime
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FORMAT = "barloom_vendor"
PRICES = ("open", "high", "low", "close")
BARS = "symbol string, ts date, open double, high double, low double, close double, volume double"
REJECTS = "symbol string, file string, line long, reason string, payload string"
FIRST, LAST = "0000-00", "9999-99"


def _day(value) -> date | None:
    try:
        return datetime.strptime(value, "%Y-%m-%d").date()
    except (TypeError, ValueError):
        return None


def parsed(text: str, month: str) -> tuple[str, tuple]:
    """A line's reason against it, or "" and its values."""
    try:
        held = json.loads(text)
    except ValueError:
        return "not_json", ()
    if not isinstance(held, dict):
        return "not_json", ()
    if (day := _day(held.get("date"))) is None:
        return "bad_date", ()
    if day.isoformat()[:7] != month:
        return "other_month", ()
    values = [held.get(c) for c in (*PRICES, "volume")]
    if any(isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v) for v in values):
        return "missing_value", ()
    first, high, low, last, volume = map(float, values)
    if min(first, high, low, last) <= 0:
        return "non_positive_price", ()
    if volume < 0:
        return "negative_volume", ()
    if high < max(first, low, last) or low > min(first, last):
        return "bad_bounds", ()
    return "", (day, first, high, low, last, volume)


class Files(InputPartition):
    """(path, symbol, month) of some files."""

    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files


class VendorReader(DataSourceReader):
    def __init__(self, path: str, kind: str, size: int):
        self.path, self.kind, self.size = path, kind, size
        self.symbols: set[str] | None = None
        self.first, self.last = FIRST, LAST

    def pushFilters(self, filters):
        """Symbols are filtered here; of ts the months are, and Spark filters the days."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == "symbol" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = wanted if self.symbols is None else self.symbols & wanted
                continue
            if name == "ts" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                month = f.value.isoformat()[:7]
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.first = max(self.first, month)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.last = min(self.last, month)
            yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        chosen: list[tuple[int, tuple[str, str, str]]] = []
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            said = dict(part.split("=", 1) for part in info.path.split("/")[:-1] if "=" in part)
            if not info.is_file or info.base_name.startswith(("_", ".")) or not {"symbol", "month"} <= set(said):
                continue
            symbol, month = unquote(said["symbol"]), said["month"]
            if (self.symbols is None or symbol in self.symbols) and self.first <= month <= self.last:
                chosen.append((info.size, (info.path, symbol, month)))
        out, held, size = [], [], 0
        for n, file in sorted(chosen, key=lambda x: x[1]):
            if held and size + n > self.size:
                out.append(Files(held))
                held, size = [], 0
            held.append(file)
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        names, types = zip(*((c.split()[0], {"string": pa.string(), "date": pa.date32(), "double": pa.float64(), "long": pa.int64()}[c.split()[1]]) for c in (BARS if self.kind == "bars" else REJECTS).split(", ")))
        for path, symbol, month in partition.files:
            rows = []
            with fs.open_input_stream(path) as stream:
                for number, line in enumerate(stream.read().decode("utf-8", "replace").splitlines(), 1):
                    reason, values = parsed(line, month)
                    if self.kind == "bars" and not reason:
                        rows.append((symbol, *values))
                    elif self.kind == "rejects" and reason:
                        rows.append((symbol, path, number, reason, line))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], list(names))


class VendorSource(DataSource):
    """Options: path (a URI), kind (bars or rejects), bytes (of a read partition)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return REJECTS if self.options.get("kind", "bars") == "rejects" else BARS

    def reader(self, schema) -> VendorReader:
        if not (path := self.options.get("path")):
            raise ValueError("the source has no path")
        return VendorReader(path, self.options.get("kind", "bars"), int(self.options.get("bytes", 32 << 20)))


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorSource)
    return spark.read.format(FORMAT).option("kind", kind).load(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The bars."""
    return _read(spark, path, "bars")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are none."""
    return _read(spark, path, "rejects")


def write(lines: DataFrame, path: str) -> None:
    """(symbol, ts, value), value being a line, laid out for this source; for what comes as a table."""
    from pyspark.sql import functions as F

    placed = lines.select("symbol", F.date_format("ts", "yyyy-MM").alias("month"), "value")
    placed.repartition("symbol", "month").write.partitionBy("symbol", "month").text(path)
