"""A sink whose parts never change and share the first one's schema (A3)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stages import Files


class ImmutableSink:
    """Parts by name. The first part's columns and types hold for all: later rows are put in their order and cast,
    a value that does not fit fails when the part is written, and a column more or less is an error at once. A part
    appears whole under its name, and a name that is taken is an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    @property
    def schema(self) -> StructType | None:
        text = self.files.read(f"{self.path}/schema")
        return StructType.fromJson(json.loads(text)) if text else None

    def append(self, rows: DataFrame, name: str) -> None:
        place = f"{self.path}/parts/{name}"
        if not name or "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"not a name of a part: {name!r}")
        if self.files.exists(place):
            raise ValueError(f"part {name} is there already")
        first = self.schema
        if first is None:
            self.files.write(f"{self.path}/schema", rows.schema.json())
            first = rows.schema
        if sorted(rows.columns) != sorted(first.names):
            raise ValueError(f"columns {sorted(rows.columns)}, and not {sorted(first.names)}")
        fresh = f"{self.path}/_fresh/{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in first.fields]).write.option("compression", "zstd").parquet(fresh)
        self.files.make(f"{self.path}/parts")
        if self.files.exists(place) or not self.files.rename(fresh, place):
            self.files.delete(fresh)
            raise ValueError(f"part {name} is there already")

    def parts(self) -> list[str]:
        head = f"{self.path}/parts/".split(":", 1)[-1].lstrip("/")
        found = {path.split(head, 1)[1].split("/", 1)[0] for path, _, _ in self.files.listed(f"{self.path}/parts") if head in path}
        return sorted(found)

    def read(self) -> DataFrame:
        """All rows with their part's name, by the first schema; an empty sink is an error."""
        first = self.schema
        if first is None or not (names := self.parts()):
            raise ValueError(f"{self.path} has no parts")
        rows = self.spark.read.schema(first).parquet(*[f"{self.path}/parts/{n}" for n in names])
        return rows.withColumn("part", F.element_at(F.split("_metadata.file_path", "/"), -2))
