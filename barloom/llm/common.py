"""Helpers shared by the corpus operators: written intermediates, text columns, input checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written once and read again, in the folder the cluster shares.

    The place is `spark.checkpoint.dir`; where that is unset, a temporary folder is used if Spark runs
    in one process (as in tests), and on a cluster it is an error. Written tables cut the lineage, so
    a lost executor costs a reread and no recomputation. They stay while a result may read them;
    `release` frees what is left of all operators once their results are written.
    """

    made: ClassVar[list["Scratch"]] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.names = spark, set()
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="barloom-")
        self.root = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
        Scratch.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it; the shuffle files of the writing go as soon as it is done."""
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Frees a table that nothing reads any more."""
        self._delete(self.path(name))
        self.names.discard(name)

    def only(self, *names: str) -> None:
        """Frees all tables but these."""
        for name in self.names - set(names):
            self.drop(name)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    @classmethod
    def release(cls, since: int = 0) -> None:
        """Frees the tables of all that have been made since then (a length of `made`); results that read them must have been written."""
        for one in cls.made[since:]:
            one._delete(one.root)
        del cls.made[since:]


def text_of(column: str = "text") -> F.Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
