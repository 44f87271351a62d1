"""Where a chain of forward pointers leads: scans that are no associative fold, for keys of any size.

Rows of a key are numbered from 1 and each points to a later one. The rows of a key are cut
into blocks. In a block every row learns where its chain leaves the block. Rows where chains
enter blocks are few; among those alone, pointers are doubled until the chain from row 1 is
known from block to block. Then every block walks its own part.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.session import cut

BLOCK = 4_096


def _blocks(rows: DataFrame, keys: Sequence[str], number: str, down: bool, block: int) -> DataFrame:
    rows = rows.withColumn("_block", F.floor((F.col(number) - 1) / block).cast("bigint"))
    by = [F.col(c) for c in (*keys, "_block")]
    return rows.repartition(*by).sortWithinPartitions(*by, F.col(number).desc() if down else F.col(number).asc())


def exits(pointers: DataFrame, keys: Sequence[str], number: str, following: str, block: int = BLOCK) -> DataFrame:
    """(keys, number, out): the first row outside its block that each row's chain meets; it may not exist."""
    place = [*keys, "_block"]

    def run(batches):
        current, known = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*place, number, following)]
            found = []
            for *group, n, to in zip(*columns):
                if group != current:
                    current, known = group, {}
                known[n] = out = known.get(to, to)
                found.append(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, number)), pa.array(found, pa.int64())], [*keys, number, "_out"])

    kinds = {f.name: f.dataType.simpleString() for f in pointers.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, number)) + ", _out bigint"
    return _blocks(pointers, keys, number, True, block).mapInArrow(run, schema)


def chain(pointers: DataFrame, keys: Sequence[str], number: str, following: str, block: int = BLOCK) -> DataFrame:
    """(keys, number): the rows of each key on the chain that begins at row 1.

    ``pointers`` has (keys, number, following) with ``following`` > ``number``; a chain ends where it points to no row.
    Keys are not null.
    """
    keys = list(keys)
    pointers = cut(pointers.select(*keys, F.col(number).cast("bigint").alias(number), F.col(following).cast("bigint").alias(following)))
    left = cut(exits(pointers, keys, number, following, block))
    targets = left.select(*keys, F.col("_out").alias(number)).distinct()
    first = left.where(F.col(number) == 1)
    jumps = cut(left.join(targets, [*keys, number], "left_semi").unionByName(first).distinct())
    met, n = first.select(*keys, number), 0
    while True:
        step = met.join(jumps, [*keys, number]).select(*keys, F.col("_out").alias(number))
        met = cut(met.unionByName(step.join(jumps, [*keys, number], "left_semi")).distinct())
        before, n = n, met.count()
        if n == before:
            break
        on = jumps.select(*keys, F.col(number).alias("_out"), F.col("_out").alias("_far"))
        jumps = cut(jumps.join(on, [*keys, "_out"], "left").select(*keys, number, F.coalesce("_far", "_out").alias("_out")))
    place = [*keys, "_block"]

    def run(batches):
        current, goal = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*place, number, following, "_entry")]
            taken = []
            for *group, n, to, entry in zip(*columns):
                if group != current:
                    current, goal = group, None
                taken.append(bool(entry) or n == goal)
                if taken[-1]:
                    goal = to
            yield batch.select([*keys, number]).filter(pa.array(taken))

    walked = pointers.join(met.withColumn("_entry", F.lit(True)), [*keys, number], "left")
    return _blocks(walked, keys, number, False, block).mapInArrow(run, pointers.select(*keys, number).schema)
