"""Products of earlier runs: tables that are used again as long as what they were made from is the same.

A product's folder is named by a digest of its inputs, its options and the products that it was made from, so that a change of
any of these makes a new folder and whatever depends on it follows. A manifest is written behind the last table: a run that was
interrupted leaves none, and the product is made again.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"
#: The temporary folder of each local application that has no shared one.
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local master gets a temporary one if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="corvane-")
        _local[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: for rows that a plan reads more than once."""
    at = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def content_digest(df: DataFrame) -> str:
    """A digest of the rows of ``df``, whatever their order: their number and the sum of their hashes, in one pass."""
    hashed = df.select(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in df.dtypes]).cast("decimal(38,0)").alias("h"))
    n, total = hashed.agg(F.count(F.lit(1)), F.sum("h")).first()
    return hashlib.sha256(json.dumps([df.dtypes, n, str(total)]).encode()).hexdigest()


def files_digest(spark: SparkSession, path: str) -> str:
    """A digest of the files below ``path`` by their names, lengths and times; none is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    n, total = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([path, n, str(total)]).encode()).hexdigest()


class Products:
    """Products below ``root``. ``force`` makes each anew, once for this object; ``made`` lists the names that it made."""

    def __init__(self, spark: SparkSession, root: str, force: bool = False) -> None:
        self.spark, self.root, self.force = spark, root.rstrip("/"), force
        self.made: list[str] = []
        self._done: set[str] = set()

    def get(self, name: str, parts: dict, make: Callable[[str], None]) -> str:
        """The folder of the product ``name`` of ``parts`` (inputs, options, folders of other products), made if it is not
        there whole: ``make`` writes its tables below the folder, replacing what an interrupted run has left."""
        key = hashlib.sha256(json.dumps([name, parts], sort_keys=True).encode()).hexdigest()[:32]
        at = f"{self.root}/{name}-{key}"
        if at not in self._done and (self.force or not self._whole(at)):
            make(at)
            text = json.dumps({"name": name, "parts": parts}, sort_keys=True, ensure_ascii=False)
            self.spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(f"{at}/{MANIFEST}")
            self.made.append(name)
        self._done.add(at)
        return at

    def manifest(self, at: str) -> dict:
        """Name and parts of the product in folder ``at``."""
        return json.loads(self.spark.read.text(f"{at}/{MANIFEST}").first()["value"])

    def clean(self, keep: list[str]) -> list[str]:
        """Removes the folders of products below the root but those of ``keep``; their names. Only for roots of one's own."""
        fs, top = self._fs(self.root)
        gone = []
        for status in fs.listStatus(top) if fs.exists(top) else []:
            name = status.getPath().getName()
            if f"{self.root}/{name}" not in keep and fs.exists(self._path(f"{self.root}/{name}/{MANIFEST}")):
                fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        at = self._path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _whole(self, at: str) -> bool:
        fs, path = self._fs(f"{at}/{MANIFEST}/_SUCCESS")
        return fs.exists(path)
