"""A store of evaluations that merge (A35, H4): partial sums by chunk of predictions, and metrics of all.

A chunk is a part of the population with a number and a stated count of rows. Its sums are a few rows,
written under the chunk and a digest of its predictions, and renamed when they are whole. A chunk that
comes again with the same predictions is the same file and counts once; with others it is an error when
the store is read, as is a chunk that is missing or that has not its count. Predictions are not kept.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import Files
from .metrics import metrics_of, partial_sums

PREDICTION = ("symbol", "ts", "h", "alpha", "q10", "q50", "q90", "scale")


class EvaluationStore:
    def __init__(self, spark: SparkSession, path: str, chunks: int, keys: tuple[str, ...] = ("rule",)):
        self.spark, self.path, self.chunks, self.keys, self.files = spark, path.rstrip("/"), chunks, keys, Files(spark)

    def append(self, chunk: int, predictions: DataFrame, rows: int) -> None:
        """Stores the sums of a chunk that has so many predictions; another number is an error, and nothing is stored."""
        if not 0 <= chunk < self.chunks:
            raise ValueError(f"there are {self.chunks} chunks, and no {chunk}")
        told = F.xxhash64(*self.keys, *PREDICTION)
        # the digest is a sum of hashes, so the order of the rows plays no part
        sums = predictions.groupBy(*self.keys, "h").agg(*[s.alias(n) for n, s in partial_sums().items()], F.sum(told.cast("decimal(38,0)")).alias("told"))
        fresh = f"{self.path}/_fresh/{uuid.uuid4().hex}"
        sums.write.parquet(fresh)
        kept = self.spark.read.schema(sums.schema).parquet(fresh)
        n, told = kept.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("told"), F.lit(0).cast("decimal(38,0)")).cast("string")).first()
        if n != rows:
            self.files.delete(fresh)
            raise ValueError(f"chunk {chunk} has {n} predictions, and not {rows}")
        place = f"{self.path}/chunk={chunk}/told={told}"
        self.files.make(f"{self.path}/chunk={chunk}")
        if self.files.exists(place) or not self.files.rename(fresh, place):
            self.files.delete(fresh)  # it came before

    def stored(self) -> dict[int, set[str]]:
        """The digests by chunk: a name a chunk, and no data."""
        found: dict[int, set[str]] = {}
        for path, _, _ in self.files.listed(self.path):
            if place := re.search(r"/chunk=(\d+)/told=([^/]+)/", path):
                found.setdefault(int(place[1]), set()).add(place[2])
        return found

    def sums(self) -> DataFrame:
        """The merged sums by keys and horizon."""
        found = self.stored()
        if twice := sorted(c for c, digests in found.items() if len(digests) > 1):
            raise ValueError(f"chunks with different predictions: {twice}")
        if missing := sorted(set(range(self.chunks)) - set(found)):
            raise ValueError(f"chunks that are missing: {missing}")
        parts = self.spark.read.parquet(*[f"{self.path}/chunk={c}/told={d}" for c, digests in sorted(found.items()) for d in digests])
        return parts.groupBy(*self.keys, "h").agg(*[F.sum(n).alias(n) for n in partial_sums()])

    def metrics(self) -> DataFrame:
        """H2 of the whole population."""
        return self.sums().select(*self.keys, "h", *[c.alias(n) for n, c in metrics_of().items()])
