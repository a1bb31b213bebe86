"""Tables written in the shared checkpoint folder, which cut the lineage of iterative plans.

A lost executor costs a re-read of files, never a recomputation of the loop. Each cut computes its
input once (an RDD checkpoint computes it twice), and takes the row count along with the write.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset, one of our own, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="pedlake-")
    return f"file://{shared_folder.own}"


class Scratch:
    """Written tables of one operator run.

    ``cut`` writes a DataFrame and reads it back; ``rows`` has the row count of the last cut. Tables
    that the returned plan no longer reads are dropped with ``drop``; the rest go when Python exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.rows, self.n = 0, 0
        self.paths: dict[int, str] = {}
        atexit.register(self.close)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path, seen = f"{self.root}/{self.n}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.rows = seen.get["n"]
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = self  # keeps the id in use
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass
