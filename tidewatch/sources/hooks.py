"""Readers of one's own as table functions: a Python function from a page to rows, for SQL and DataFrames.

``register_reader(spark, "name", read, "column type, ...")`` makes ``name(TABLE(pages))`` a table: for every row of pages all its columns except the
text, ``ord`` from 0, the reader's columns, and ``error``. The result's shape follows the table that it is called with. A page that the
reader fails on is one row with an error, and costs no other page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def reader_class(read: Callable[[str], Iterable[tuple]], columns: StructType, text: str) -> type:
    """The class behind a table function; the text column is named ``text``."""
    fields = list(columns.fields)
    nothing = (None,) * len(fields)

    class Reader:
        @staticmethod
        def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable or text not in pages.dataType.names:
                raise ValueError(f"the argument must be a table with a column {text}")
            passed = [f for f in pages.dataType.fields if f.name != text]
            clash = {f.name for f in passed} & {"ord", "error", *(f.name for f in fields)}
            if clash:
                raise ValueError(f"the table has columns that the reader makes: {', '.join(sorted(clash))}")
            return AnalyzeResult(schema=StructType([*passed, StructField("ord", IntegerType()), *fields, StructField("error", StringType())]))

        def eval(self, row):
            given = tuple(row[name] for name in row.__fields__ if name != text)
            try:
                found = list(read(row[text])) if row[text] is not None else []
            except Exception as failed:  # what a reader raises is about its page
                yield (*given, None, *nothing, f"{type(failed).__name__}: {failed}")
                return
            for k, r in enumerate(found):
                yield (*given, k, *r, None)

    return Reader


def register_reader(spark: SparkSession, name: str, read: Callable[[str], Iterable[tuple]], columns: str, text: str = "html") -> None:
    """Make a reader a table function of this session."""
    spark.udtf.register(name, udtf(reader_class(read, StructType.fromDDL(columns), text)))


def read_with(spark: SparkSession, name: str, pages: DataFrame) -> DataFrame:
    """A registered reader's rows of pages."""
    return spark.sql(f"SELECT * FROM {name}(TABLE({{pages}}))", pages=pages)
