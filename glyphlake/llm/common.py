"""Helpers that several training-data operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.session import scratch_path

#: Letters and digits of ASCII and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is.

    For pure ASCII ``lower`` does just that and is much faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(lowered: Column) -> Column:
    """The words of a lower-cased text; null has none."""
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def literal_list(values) -> str:
    """SQL text of an array of strings."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return f"cast(array({quoted}) as array<string>)"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has. Spark tells names apart without their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
