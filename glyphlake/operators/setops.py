"""Set operations, deletes by label and comparisons of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prune(tables: Mapping[str, DataFrame], label: str) -> dict[str, DataFrame]:
    """Every table without the rows of one dictionary."""
    return {name: df.where(~F.col("source" if "source" in df.columns else "dict").eqNullSafe(label))
            for name, df in tables.items()}


def sweep_orphans(glosses: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) glossaries by whether any term points at them."""
    used = terms.select("gloss_key").distinct()
    return glosses.join(used, "gloss_key", "left_semi"), glosses.join(used, "gloss_key", "left_anti")


def tables_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in only one of two tables, counting repeats, with the side they are on."""
    b = b.select(*a.columns)
    both = (a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
            .groupBy(*a.columns).agg(F.sum("_n").alias("extra")).where("extra <> 0"))
    return both.withColumn("side", F.when(F.col("extra") > 0, "left").otherwise("right")).withColumn(
        "extra", F.abs("extra"))


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    return tables_differ(a, b).limit(1).count() == 0


def golden_diff(base: DataFrame, current: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, status): identical, changed, missing or added."""
    b = base.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    c = current.select(*keys, F.col(value).alias("_c"), F.lit(True).alias("_in_c"))
    status = (F.when(F.col("_in_c").isNull(), "missing").when(F.col("_in_b").isNull(), "added")
              .when(F.col("_b").eqNullSafe(F.col("_c")), "identical").otherwise("changed"))
    return b.join(c, list(keys), "full").select(*keys, status.alias("status"))


def shared_ratio(lines: DataFrame, group: Sequence[str], prev: Sequence[str], text: str = "text") -> DataFrame:
    """Similarity of each page to another page named by the ``prev`` columns.

    ``lines``: (group columns, prev columns, text), one row per line. The result
    is lines whose text the other page also has, over the larger of this page's
    lines and the other page's distinct lines; zero when either has none.
    """
    other = lines.select(*[F.col(g).alias(p) for g, p in zip(group, prev)], text).distinct()
    sizes = other.groupBy(*prev).agg(F.count("*").alias("n_prev"))
    hits = (lines.join(other.withColumn("_hit", F.lit(1)), [*prev, text], "left")
            .groupBy(*group, *prev).agg(F.count("*").alias("n"), F.count("_hit").alias("shared")))
    return (hits.join(sizes, list(prev), "left")
            .select(*group, "n", F.coalesce("n_prev", F.lit(0)).alias("n_prev"), "shared")
            .withColumn("ratio", F.when(F.col("n_prev") == 0, 0.0).otherwise(
                F.col("shared") / F.greatest("n", "n_prev"))))


def first_nonempty(keys: Sequence[str], *sources: DataFrame) -> DataFrame:
    """Per key, the rows of the first source that has any."""
    tagged = [df.withColumn("_src", F.lit(i)) for i, df in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    best = rows.groupBy(*keys).agg(F.min("_src").alias("_src"))
    return rows.join(best, [*keys, "_src"]).drop("_src")


def split_import(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, failed): archives of a known kind go in, the rest are named with a reason."""
    added = archives.where(F.col("kind").isNotNull())
    failed = archives.where(F.col("kind").isNull()).withColumn(
        "error", F.coalesce(F.col("error") if "error" in archives.columns else F.lit(None).cast("string"),
                            F.lit("no recognisable banks")))
    return added, failed
