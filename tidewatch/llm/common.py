"""Helpers of the training-data operators: tables, shared scratch space, held-out rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; a word is a run of anything else.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; set here only where the cluster names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        path = context.getCheckpointDir()
        if not path:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
            path = context.getCheckpointDir()
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        return self.read(self.write(df), df)

    def write(self, df: DataFrame) -> str:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.mode("overwrite").parquet(path)
        return path

    def read(self, path: str, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove the files behind a table from keep() that nothing needs any more."""
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tidewatch/" in name:
                self.drop_path(name)

    def drop_path(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def released(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], *caches: dict) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run for mapInPandas; when a task ends, its memory goes back to the system, as the worker process goes on to serve other operators."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
