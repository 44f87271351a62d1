"""State machines over event streams: the events of each key in order, in bounded memory.

A micro-batch is dealt by key and sorted inside its partitions by Spark, which spills; the
state machine then runs over the sorted rows an Arrow batch at a time and never holds the
events of a key. What a key remembers is one small row, written per micro-batch next to the
stream's checkpoint and read by the next one, so a batch that is run again gives the same
rows. One key's events pass through one task, since each step depends on the one before it;
``maxFilesPerTrigger`` and ``maxBytesPerTrigger`` of the source bound a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: About how many bytes of a batch become Python objects at a time.
_PART = 4 << 20
Fold = Callable[[dict, dict], tuple[dict, dict | None]]


def _kind(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)


def _values(column: pa.Array) -> list:
    """What ``column.to_pylist()`` gives; the elements of all its lists are converted together, which is much faster."""
    kind = column.type
    if pa.types.is_list(kind):
        ends = column.offsets.to_pylist()
        flat = _values(column.values.slice(ends[0], ends[-1] - ends[0]))
        found = [flat[a - ends[0]:b - ends[0]] for a, b in zip(ends, ends[1:])]
    elif pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        found = [dict(zip(names, row)) for row in zip(*(_values(column.field(i)) for i in range(kind.num_fields)))]
    elif pa.types.is_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    if column.null_count:
        found = [x if there else None for x, there in zip(found, column.is_valid().to_pylist())]
    return found


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        size = max(1, batch.num_rows * _PART // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, size):
            yield from _values(batch.slice(at, size).to_struct_array())


def stepped(events: DataFrame, before: DataFrame | None, key: str, order: list[str], fold: Fold, start: dict,
            out: str, state: str) -> DataFrame:
    """(key, out, state): what ``fold(memory, event) -> (memory, told)`` tells, and one row with each key's last memory.

    ``before`` has (key, state) of earlier batches. Rows have one of both structs, the other is null. A memory of
    None is forgotten; the key's next event meets ``start`` again.
    """
    told, kept = _kind(out), _kind(state)
    columns = [c for c in events.columns if c != key]
    rows = events.select(key, F.struct(*columns).alias("e"), F.lit(None).cast(kept).alias("s"))
    if before is not None:
        rows = rows.unionByName(before.select(key, F.lit(None).cast(rows.schema["e"].dataType).alias("e"), F.col("state").alias("s")))
    rows = rows.repartition(F.col(key)).sortWithinPartitions(
        F.col(key), F.col("e").isNotNull(), *[F.col("e").getField(c) for c in order])
    schema = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("out", told), T.StructField("state", kept)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        found, nobody = [], object()
        current, memory = nobody, start
        for row in _records(batches):
            if current is nobody or row[key] != current:
                if current is not nobody and memory is not None:
                    found.append({key: current, "state": memory})
                current, memory = row[key], start
            if row["e"] is None:
                memory = row["s"]
                continue
            memory, one = fold(start if memory is None else memory, row["e"])
            if one is not None:
                found.append({key: current, "out": one})
            if len(found) >= 5_000:
                yield pa.RecordBatch.from_pylist(found, arrow)
                found = []
        if current is not nobody and memory is not None:
            found.append({key: current, "state": memory})
        if found:
            yield pa.RecordBatch.from_pylist(found, arrow)

    return rows.mapInArrow(run, schema)


class Batch:
    """One micro-batch of a stream: reads what the batch before kept, writes what this one keeps."""

    def __init__(self, spark: SparkSession, root: str, number: int):
        self.spark, self.root, self.number = spark, root, number

    def _path(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/{number}"

    def before(self, name: str, schema: T.StructType | str) -> DataFrame:
        """The table of this name that the batch before kept; empty in the first."""
        if not self.number:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name, self.number - 1))

    def keep(self, name: str, table: DataFrame) -> DataFrame:
        """``table``, written for this batch and the next."""
        table.write.mode("overwrite").parquet(self._path(name, self.number))
        return self.spark.read.schema(table.schema).parquet(self._path(name, self.number))

    def states(self, name: str, key: T.StructField, state: str) -> DataFrame:
        """(key, state) as the batch before left it."""
        schema = T.StructType([key, T.StructField("state", _kind(state))])
        return self.before(name, schema).where("state is not null")

    def after(self) -> "Batch":
        """The batch that follows, which finds what this one kept."""
        return Batch(self.spark, self.root, self.number + 1)

    def step(self, name: str, events: DataFrame, key: str, order: list[str], fold: Fold, start: dict, out: str, state: str,
             before: DataFrame | None = None) -> DataFrame:
        """(key, out): what the steps of this batch tell. Their memory is kept under ``name``.

        ``before`` takes the place of what the batch before kept.
        """
        if before is None and self.number:
            before = self.states(name, events.schema[key], state)
        return self.keep(name, stepped(events, before, key, order, fold, start, out, state)).where("out is not null").select(key, "out.*")


@dataclass
class Steps:
    """A stream and what is done with each of its micro-batches."""

    stream: DataFrame
    plan: Callable[[DataFrame, Batch], DataFrame]

    def fed(self, stream: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> "Steps":
        """The same steps over another stream, of which ``rows`` makes what they take, a micro-batch at a time and by many tasks."""
        return Steps(stream, lambda some, batch: self.plan(rows(some), batch))

    def run(self, path: str, checkpoint: str) -> DataFrame:
        """All rows that the plan gives for what is there now, by way of ``path``. May be called again for what comes later."""
        spark, schema = self.stream.sparkSession, []

        def each(rows: DataFrame, number: int) -> None:
            found = self.plan(rows, Batch(spark, f"{checkpoint}/steps", number))
            schema[:] = [found.schema]
            found.write.mode("overwrite").parquet(f"{path}/batch={number}")

        query = (self.stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        if not schema:
            raise ValueError("the stream has no files")
        return spark.read.schema(schema[0]).parquet(f"{path}/batch=*")
