"""Nearest neighbours by inverted lists and an adaptive scan of rotated dimensions.

Directions are clustered into lists on a bounded sample; every vector is indexed.
A query probes the lists nearest to it. Inside a list vectors are randomly rotated
and kept in blocks of dimensions, so a partial distance over the first t of d
dimensions, scaled by d / t, estimates the whole one. After each block a
hypothesis test drops the candidates whose estimate lies clearly beyond the k-th
best distance so far; what survives all blocks gets its exact cosine on the
original vector.

Equal vectors are one candidate with their k + 1 smallest ids, which are all that
any answer can hold. Long lists and lists with many queries are cut into parts of
bounded size, and every part of the one meets every part of the other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import written

#: Vectors that the lists are fitted to at most.
SAMPLE = 16_384
#: Vectors in a list, about, until there are MOST_LISTS lists.
LIST_ROWS, MOST_LISTS = 512, 4_096
#: Share of true neighbours that the probed lists shall hold, measured on the sample.
TARGET = 0.97
#: Candidates and queries that meet in one task at most, about.
PART = 4_096
#: Dimensions in a block; looseness of the test: larger drops fewer.
BLOCK, EPSILON = 16, 2.1
SEED = 7


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a finite, non-zero vector of the usual dimension, each once, v in double precision.

    The usual dimension is the most frequent one among them, the smaller in a tie.
    """
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).distinct()
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (usual[0]["d"] if usual else 0))


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, each divided by a power of two that brings its largest component near one.

    Cosines stay as they are to the last bit, and no square overflows or vanishes.
    """
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=1.0 if not x.shape[1] else 0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of ``lists`` clusters of directions."""
    x = _unit(sample)
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """Lists to probe so that they hold ``target`` of the k nearest of 256 sample vectors within the sample.

    In the whole table neighbours are nearer than in the sample, so fewer lists would do.
    """
    x = _unit(sample)
    asked = x[:256]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    own = (x @ centres.T).argmax(axis=1)[np.argsort(-near, axis=1)[:, :min(k, max(1, len(x) - 1))]]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(place, own, axis=1), target)) + 1


def scan_part(x, ids, q, query_ids, k: int, rotation: np.ndarray):
    """(query_id, vec_id, score) of the k nearest of each query among one part of a list."""
    unit, d = _unit(x), x.shape[1]
    rotated = unit @ rotation
    columns = [np.ascontiguousarray(rotated[:, at:at + BLOCK]) for at in range(0, d, BLOCK)]
    norms, out = np.sqrt((x * x).sum(axis=1)), []
    for query, own in zip(q, query_ids):
        target = _unit(query[None, :])[0] @ rotation
        # The first few, scanned in full, set the bound; the query's own vector must not tighten it.
        few = min(len(x), 8 * (k + 1))
        start = np.sort(((rotated[:few] - target) ** 2).sum(axis=1))
        bound = start[k] if few > k else np.inf
        alive, partial = np.arange(len(x)), np.zeros(len(x))
        for b, block in enumerate(columns):
            partial += ((block[alive] - target[b * BLOCK:b * BLOCK + BLOCK]) ** 2).sum(axis=1)
            t = min(d, (b + 1) * BLOCK)
            reach = bound * (1 + EPSILON / math.sqrt(t)) ** 2 if t < d else bound * (1 + 1e-9) + 1e-12
            keep = partial * (d / t) <= reach
            alive, partial = alive[keep], partial[keep]
        score = (x[alive] @ query) / (norms[alive] * np.sqrt((query * query).sum()))
        best = sorted((-s, i) for a, s in zip(alive, score) for i in ids[a] if i != own)[:k]
        out += [(own, i, -s) for s, i in best]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, target: float = TARGET, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest by cosine, ties to the smaller id.

    A query is not its own neighbour. Rows without id, and vectors that are
    null, zero, of an unusual dimension or hold null or non-finite components,
    take no part on either side. Repeated rows count once; of rows that share an
    id but not a vector each is a row. With fewer than k other vectors all are
    returned; without any, nothing. Other columns are not carried.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = written(few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    n = distinct.count()
    sample = _rows(distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toArrow().column("v"))
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    centres = fit_lists(sample, max(1, min(MOST_LISTS, round(n / LIST_ROWS))))
    probes = probes_for(sample, centres, k, target)
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((sample.shape[1],) * 2))[0]
    shared = spark.sparkContext.broadcast((centres, rotation))

    def assign(batches):
        for batch in batches:
            near = (_unit(_rows(batch.column("v"))) @ shared.value[0].T).argmax(axis=1) if batch.num_rows else []
            yield batch.append_column("list", pa.array(near, pa.int32()))

    index = written(distinct.mapInArrow(assign, "v array<double>, ids array<bigint>, list int"), "lists")
    sizes = dict(index.groupBy("list").count().collect())
    filled = np.array(sorted(sizes))

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                near = _unit(_rows(batch.column("v"))) @ shared.value[0][filled].T
                lists = filled[np.argsort(-near, axis=1, kind="stable")[:, :max(probes, k + 1)]]
                yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), lists.shape[1]))).append_column(
                    "list", pa.array(lists.ravel(), pa.int32()))

    asked = usable(queries, vec_id, embedding).where(F.size("v") == sample.shape[1])
    probed = written(asked.mapInArrow(probe, "id bigint, v array<double>, list int"), "probes")
    loads = dict(probed.groupBy("list").count().collect())
    parts = F.broadcast(spark.createDataFrame(  # a row per list, at most MOST_LISTS
        [(int(i), math.ceil(c / PART), math.ceil(loads[i] / PART)) for i, c in sizes.items() if i in loads],
        "list int, index_parts int, query_parts int"))

    def dealt(df, by, own, other):
        part, across = F.pmod(F.xxhash64(by), F.col(f"{own}_parts")).cast("int"), F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)
        return (df.join(parts, "list").withColumn(f"{own}_part", part).withColumn(f"{other}_part", F.explode(across))
                .drop("index_parts", "query_parts"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = scan_part(_rows(left.column("v")), left.column("ids").to_pylist(), _rows(right.column("v")),
                              right.column("id").to_pylist(), k, shared.value[1])
        columns = list(zip(*found)) if found else [()] * 3
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["list", "index_part", "query_part"]
    met = dealt(index, "v", "index", "query").groupBy(*keys).cogroup(
        dealt(probed, "id", "query", "index").groupBy(*keys)).applyInArrow(scan, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
