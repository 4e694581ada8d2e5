"""A bar store in fixed buckets of symbols.

Bars are dealt out by Spark's own hash of the symbol, as a bucketed table: windows, groupings and joins
by symbol of the store need no exchange. An append adds a file to each bucket it touches. `compact` makes
one sorted file of a bucket that has several, and `replace` gives some buckets new rows; both leave the
files of other buckets alone. They write what is new beside the store, note in a journal which files come
and which go, and only then move them; a store that is opened with a journal finishes it first, so a
driver that is lost between two moves loses nothing. A reader that began before the moves may fail and
is to be run again. Row groups are bounded by `row_group_bytes`.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import Files

BUCKET = re.compile(r"_(\d{5})(?:\.c\d+)?\.[^/]*parquet$")


class BarStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int, schema: str, row_group_bytes: int = 32 << 20):
        """Opens the store at a path, or makes an empty one; schema is DDL with symbol and ts in it."""
        self.spark, self.path, self.buckets, self.files = spark, path.rstrip("/"), buckets, Files(spark)
        self.row_group_bytes = row_group_bytes
        self.name = f"bars_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        self.files.make(f"{self.path}/bars")
        known = self.files.read(f"{self.path}/layout")
        layout = json.dumps({"buckets": buckets, "schema": schema}, sort_keys=True)
        if known is None:
            self.files.write(f"{self.path}/layout", layout)
        elif known != layout:
            raise ValueError(f"{path} has another layout: {known}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, ts) INTO {buckets} BUCKETS LOCATION '{self.path}/bars'")
        self._finish()

    @property
    def columns(self) -> list[str]:
        return self.spark.table(self.name).columns

    def bucket_of(self, symbol: str = "symbol"):
        return F.pmod(F.hash(symbol), F.lit(self.buckets))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def by_bucket(self) -> dict[int, list[str]]:
        """The files of each bucket: names alone."""
        found: dict[int, list[str]] = {}
        for path, _, _ in self.files.listed(f"{self.path}/bars"):
            if place := BUCKET.search(path):
                found.setdefault(int(place[1]), []).append(path)
        return found

    def _laid(self, bars: DataFrame) -> DataFrame:
        """One task a bucket, so one file a bucket."""
        return bars.select(*self.columns).repartition(self.buckets, "symbol").sortWithinPartitions("symbol", "ts")

    def append(self, bars: DataFrame) -> None:
        self._laid(bars).write.option("parquet.block.size", self.row_group_bytes).insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def _swap(self, bars: DataFrame, buckets: list[int], old: list[str]) -> None:
        """Files of `buckets` become those of `bars`; nothing of another bucket may be in it."""
        turn = uuid.uuid4().hex
        fresh = f"{self.path}/_fresh/{turn}"
        writer = self._laid(bars).write.bucketBy(self.buckets, "symbol").sortBy("symbol", "ts")
        writer.option("path", fresh).option("parquet.block.size", self.row_group_bytes).saveAsTable(f"{self.name}_{turn}")
        self.spark.sql(f"DROP TABLE {self.name}_{turn}")  # the files stay
        new = [path for path, _, _ in self.files.listed(fresh) if BUCKET.search(path)]
        if astray := {int(BUCKET.search(path)[1]) for path in new} - set(buckets):
            raise ValueError(f"rows of other buckets: {sorted(astray)}")
        moves = [[path, f"{self.path}/bars/{path.rsplit('/', 1)[1]}"] for path in new]
        self.files.write(f"{self.path}/journal", json.dumps({"come": moves, "go": old}))
        self._finish()
        self.files.delete(fresh)

    def _finish(self) -> None:
        """Does what the journal says, in part or whole done before or not."""
        text = self.files.read(f"{self.path}/journal")
        if text is None:
            return
        plan = json.loads(text)
        for path in plan["go"]:
            self.files.delete(path)
        for old, new in plan["come"]:
            if not self.files.exists(new) and not self.files.rename(old, new):
                raise OSError(f"{old} could not be moved")
        self.files.delete(f"{self.path}/journal")
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> list[int]:
        """The buckets that had several files, each of which has one sorted file now."""
        many = {b: paths for b, paths in self.by_bucket().items() if len(paths) > 1}
        if many:
            old = [path for paths in many.values() for path in paths]
            self._swap(self.spark.read.schema(self.read().schema).parquet(*old), list(many), old)
        return sorted(many)

    def replace(self, bars: DataFrame, buckets: list[int]) -> None:
        """These buckets hold the given rows and no others; a row of another bucket is an error, and nothing changes."""
        held = self.by_bucket()
        self._swap(bars, buckets, [path for b in buckets for path in held.get(b, [])])

    def checked(self, rows: int) -> DataFrame:
        """The store's bars, after a check that they are so many and that no key occurs twice."""
        twice = self.read().groupBy("symbol", "ts").agg(F.count("*").alias("n"))
        n, most = twice.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if n != rows or most > 1:
            raise ValueError(f"the store has {n} bars of {rows}, and {most} of a key at most")
        return self.read()
