"""Delimited text files: CSV with header, header-less CSV/TSV, and the prediction file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def escaped(value: Column) -> Column:
    """Line breaks as ``\\n`` and ``\\r``, backslashes doubled, so that a row is a line and a large file splits."""
    doubled = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescaped(value: Column) -> Column:
    """The inverse of ``escaped``."""
    plain = lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(F.split(value, r"\\\\"), plain), "\\")


def _read(spark: SparkSession, path: str, quoted_breaks: bool, **options) -> DataFrame:
    rows = spark.read.csv(path, inferSchema=False, multiLine=quoted_breaks, escape='"', **options).fillna("")
    return rows if quoted_breaks else rows.select(*[unescaped(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def read_csv(spark: SparkSession, path: str, limit: int | None = None, quoted_breaks: bool = False) -> DataFrame:
    """CSV with a header, every column a string; exactly ``limit`` rows if given.

    Line breaks are expected in the escaped form that ``write_csv`` gives them, so that large files are read in splits.
    ``quoted_breaks`` reads files of others, with line breaks inside quotes and backslashes as they are; such a file is one task.
    """
    rows = _read(spark, path, quoted_breaks, header=True)
    return rows if limit is None else rows.limit(limit)


def delimiter_of(path: str) -> str:
    return "\t" if path.rstrip("/").endswith(".tsv") else ","


def read_rows(spark: SparkSession, path: str, quoted_breaks: bool = False) -> DataFrame:
    """Header-less rows with columns _c0, _c1, ...; the delimiter follows the extension.  Line breaks as in ``read_csv``."""
    return _read(spark, path, quoted_breaks, sep=delimiter_of(path))


def _strings(df: DataFrame) -> DataFrame:
    return df.select(*[escaped(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def write_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows, without a header, to a delimited folder (``predictions.tsv`` or ``.csv``)."""
    _strings(df).write.mode(mode).csv(path, sep=delimiter_of(path), escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    _strings(df).write.mode("error").csv(path, header=True, escape='"')
