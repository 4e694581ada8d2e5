"""A table that is built in steps and goes on where it stopped.

Rows have ordinals from 0, and a step is a range of them. A step is written under a name of its own and
renamed to its first ordinal when it is whole, and then the cursor, a small file, moves behind it. A
build that stops between the two has a part that the cursor does not name: it is made anew. What the
table is made of is its contract, which a later build must share. Parts are sorted; the ordinal says the order of all rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import Files, canonical_json


class TabularCache:
    def __init__(self, spark: SparkSession, path: str, contract: dict, total: int, step: int):
        self.spark, self.path, self.total, self.step, self.files = spark, path.rstrip("/"), total, step, Files(spark)
        self.contract = canonical_json({"contract": contract, "total": total, "step": step})
        known = self.files.read(f"{self.path}/contract")
        if known is None:
            self.files.write(f"{self.path}/contract", self.contract)
        elif known != self.contract:
            raise ValueError(f"{path} is a table of another contract")

    @property
    def cursor(self) -> int:
        """How many rows are there for good."""
        return json.loads(self.files.read(f"{self.path}/cursor") or "0")

    def _part(self, first: int) -> str:
        return f"{self.path}/parts/{first:015d}"

    def build(self, numbered: DataFrame, steps: int | None = None) -> int:
        """Goes on with the rows (ordinal and others) for so many steps, or to the end; the cursor then.

        The range of a step reaches the scan, so rows that are laid out by ordinal are read once in all.
        """
        while (first := self.cursor) < self.total and steps != 0:
            last = min(first + self.step, self.total)
            fresh = f"{self.path}/_fresh/{uuid.uuid4().hex}"
            rows = numbered.where(F.col("ordinal").between(first, last - 1))
            rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.parquet(fresh)
            found = self.spark.read.schema(numbered.schema).parquet(fresh).agg(F.count("*"), F.count_distinct("ordinal")).first()
            if tuple(found) != (last - first, last - first):
                self.files.delete(fresh)
                raise ValueError(f"{found[0]} rows, {found[1]} of them different, for ordinals {first} to {last - 1}")
            self.files.delete(self._part(first))  # of a build that stopped before its cursor moved
            self.files.make(f"{self.path}/parts")
            if not self.files.rename(fresh, self._part(first)):
                raise OSError(f"{self._part(first)} could not be written")
            self.files.write(f"{self.path}/cursor", json.dumps(last))
            steps = None if steps is None else steps - 1
        return self.cursor

    def read(self) -> DataFrame:
        if self.cursor < self.total:
            raise ValueError(f"{self.path} has {self.cursor} of {self.total} rows")
        return self.spark.read.parquet(*[self._part(first) for first in range(0, self.total, self.step)])
