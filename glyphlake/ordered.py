"""Ordered scans (row number, lag, lead, running aggregates) that survive hot keys.

A window over a key that holds a third of the table is one task. So the rows are
range-partitioned by (key, order), every range becomes a chunk of its key, the
window runs inside chunks, and one small row per chunk carries the values over the
chunk border. Groups that are bounded by what they are (the entries of one
dictionary key, say) take the plain window; the caller says so, not the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.session import cut

_CHUNK = "_chunk"


def _struct(names: Sequence[str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', `{n}`" for n in names) + ")"


class Ordered:
    """Rows ordered by ``order`` (ascending, unique inside ``keys``)."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], bounded: bool = False,
                 *, _chunked: bool | None = None):
        self.keys = list(keys)
        self.order = list(order)
        if _chunked is None and not bounded:
            df = cut(df.repartitionByRange(*self.keys, *self.order).withColumn(_CHUNK, F.spark_partition_id()))
        self.chunked = (not bounded) if _chunked is None else _chunked
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_CHUNK)

    def _next(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.keys, self.order, _chunked=self.chunked)

    def with_columns(self, columns: Mapping[str, Column]) -> "Ordered":
        return self._next(self._df.withColumns(dict(columns)))

    def scan(self, number: str | None = None, lag: Mapping[str, str] | None = None,
             lead: Mapping[str, str] | None = None,
             run: Mapping[str, tuple[str, str]] | None = None) -> "Ordered":
        """Add columns computed along the order.

        ``number``: name of a 1-based row number. ``lag``/``lead``: new name to
        the column to fetch from the neighbour. ``run``: new name to
        (``sum`` | ``max`` | ``min`` | ``last``, column), over all rows up to
        and including this one; ``last`` skips nulls.
        """
        lag, lead, run = dict(lag or {}), dict(lead or {}), dict(run or {})
        groups = self.keys + ([_CHUNK] if self.chunked else [])
        w = Window.partitionBy(*groups).orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        one = {"sum": F.sum, "max": F.max, "min": F.min,
               "last": lambda c: F.last(c, ignorenulls=True)}
        cols: dict[str, Column] = {}
        if number:
            cols[number] = F.row_number().over(w).cast("bigint")
        for out, col in lag.items():
            cols[out] = F.lag(col).over(w)
        for out, col in lead.items():
            cols[out] = F.lead(col).over(w)
        for out, (kind, col) in run.items():
            cols[out] = one[kind](F.col(col)).over(upto)
        if not self.chunked:
            return self._next(self._df.withColumns(cols))
        cols["_at"] = F.row_number().over(w)
        cols["_left"] = F.count(F.lit(1)).over(Window.partitionBy(*groups)) - F.col("_at")
        return self._next(self._carry(
            self._df.withColumns({k: v for k, v in cols.items() if k != "_left"})
            .withColumn("_left", cols["_left"]), groups, number, lag, lead, run))

    def _carry(self, local, groups, number, lag, lead, run):
        order = _struct(self.order)
        totals = [F.count(F.lit(1)).alias("_n")]
        if lag:
            totals.append(F.expr(f"max_by({_struct(sorted(set(lag.values())))}, {order})").alias("_end"))
        if lead:
            totals.append(F.expr(f"min_by({_struct(sorted(set(lead.values())))}, {order})").alias("_start"))
        for out, (kind, col) in run.items():
            text = (f"max_by(`{col}`, {order}) filter (where `{col}` is not null)"
                    if kind == "last" else f"{kind}(`{col}`)")
            totals.append(F.expr(text).alias(f"_t_{out}"))
        ends = self._df.groupBy(*groups).agg(*totals)
        w = Window.partitionBy(*self.keys).orderBy(_CHUNK)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        carried = {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0))}
        if lag:
            carried["_end"] = F.lag("_end").over(w)
        if lead:
            carried["_start"] = F.lead("_start").over(w)
        for out, (kind, _) in run.items():
            total = F.col(f"_t_{out}")
            fold = {"sum": F.sum, "max": F.max, "min": F.min,
                    "last": lambda c: F.last(c, ignorenulls=True)}[kind]
            carried[f"_t_{out}"] = fold(total).over(before)
        ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in groups],
                           *[c.alias(n) for n, c in carried.items()])
        cond = F.lit(True)
        for k in groups:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        out = local.join(ends, cond)
        fixed: dict[str, Column] = {}
        if number:
            fixed[number] = F.col(number) + F.col("_before")
        for name, col in lag.items():
            fixed[name] = F.when(F.col("_at") == 1, F.col("_end").getField(col)).otherwise(F.col(name))
        for name, col in lead.items():
            fixed[name] = F.when(F.col("_left") == 0, F.col("_start").getField(col)).otherwise(F.col(name))
        for name, (kind, _) in run.items():
            here, prior = F.col(name), F.col(f"_t_{name}")
            fixed[name] = {
                "sum": F.when(prior.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + prior),
                "max": F.greatest(here, prior),
                "min": F.least(here, prior),
                "last": F.coalesce(here, prior),
            }[kind]
        drop = ["_at", "_left", "_before", "_end", "_start"]
        drop += [f"_k_{k}" for k in groups] + [f"_t_{n}" for n in run]
        return out.withColumns(fixed).drop(*drop)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
            number: str = "rn") -> DataFrame:
    """The first ``n`` rows of each key.

    Spark limits each key before the shuffle (the group-limit rewrite), so a hot
    key sends at most ``n`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).where(F.col(number) <= n)
