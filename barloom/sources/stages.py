"""Tables kept under the digest of what they are made of (N8), and the folder that they are in.

A stage table is made once: its identity is its name, a contract (what it is made by) and its input
files with their lengths and times. A second call with an equal identity reads the table and scans no
input; a changed file or contract is another identity, and so another table. The identity is stored with
the table and compared on reading, so a table that was made of something else is refused. A table is
written under a name of its own and renamed when it is whole, so that a build that stops leaves nothing
that could be read, and of two builds at once one counts.

The folder is `spark.checkpoint.dir`, which driver and executors share; where that is unset, a temporary
folder is used if Spark runs in one process, and on a cluster it is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="barloom-")
    return _LOCAL[app]


class Files:
    """Small files and names in the shared folder, by Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def make(self, path: str) -> None:
        fs, where = self._at(path)
        fs.mkdirs(where)

    def rename(self, old: str, new: str) -> bool:
        fs, where = self._at(old)
        return bool(fs.rename(where, self.spark._jvm.org.apache.hadoop.fs.Path(new)))

    def listed(self, path: str) -> list[tuple[str, int, int]]:
        """(path, length, time) of the files under a path, sorted; none if it does not exist."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return []
        found, out = fs.listFiles(where, True), []
        while found.hasNext():
            one = found.next()
            out.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
        return sorted(out)

    def read(self, path: str) -> str | None:
        fs, where = self._at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new small file; the name appears when the text is whole."""
        fs, where = self._at(f"{path}.{uuid.uuid4().hex[:8]}")
        stream = fs.create(where, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.delete(self._at(path)[1], False)
        if not fs.rename(where, self._at(path)[1]):
            raise OSError(f"{path} could not be written")


def canonical_json(value) -> str:
    """Sorted keys, no blanks, and an error for numbers that are not finite."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def identity(spark: SparkSession, name: str, contract: dict, inputs: list[str]) -> str:
    files = Files(spark)
    return canonical_json({"name": name, "contract": contract, "inputs": [files.listed(path) for path in inputs]})


def kept(spark: SparkSession, name: str, contract: dict, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The stage table of this identity, made if there is none; a table that holds another identity is refused."""
    files, wanted = Files(spark), identity(spark, name, contract, inputs)
    path = f"{root(spark)}/stages/{name}-{hashlib.sha256(wanted.encode()).hexdigest()[:32]}"
    if not files.exists(path):
        fresh = f"{path}.{uuid.uuid4().hex[:8]}"
        make().write.parquet(fresh)
        files.write(f"{fresh}/_identity", wanted)
        if files.exists(path) or not files.rename(fresh, path):
            files.delete(fresh)  # another build came first
    if files.read(f"{path}/_identity") != wanted:
        raise ValueError(f"{path} was not made of these inputs by this contract")
    return spark.read.parquet(path)


def written(df: DataFrame, name: str = "pass") -> DataFrame:
    """A table that is written once and read again several times, as counting in several passes asks for."""
    path = f"{root(df.sparkSession)}/stages/{name}.{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Frees all stage tables of this folder."""
    Files(spark).delete(f"{root(spark)}/stages")
