"""Ranked lexical search: the best documents of each item, by groups of documents that hold the same of its terms.

1. One scan of the texts keeps, per document, its length and the occurrences of terms
   that any item has. It is written: corpus counts come from it, and the search reads it.
2. A task takes its documents a chunk at a time. For an item every document gets a
   presence mask, one bit for each of the item's terms, by OR-ing the bits of a term into
   its documents. Documents of one mask are one group. No document of a group can score
   more than the sum of the chunk's best contributions of the mask's terms.
3. Groups are scored from the highest such bound down, until the bound falls below the
   worst score kept so far. Only then is the rest safely out. Scores kept in one chunk
   are the bar of the next.
4. Every task tells its best few for each item; a window ranks those.

Items are a query set: they are taken in blocks of at most ``BLOCK_TERMS`` different
terms, and only a block travels to the tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import written

#: Most different terms of a block of items.
BLOCK_TERMS = 200_000
#: Documents of a chunk.
CHUNK = 16_384
TOP = 10
TERM = rb"[0-9a-z\x80-\xff]+"


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text; ``bytes.lower`` changes A-Z only."""
    return re.findall(TERM, text.lower())


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, Counter]]]:
    """(id, its terms and how often they occur), in blocks that hold few enough different terms."""
    block, seen = [], set()
    for key, value in items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).toLocalIterator():
        counts = Counter(terms((value or "").encode()))
        if block and len(seen) + len(counts) > BLOCK_TERMS:
            yield block
            block, seen = [], set()
        block.append((key, counts))
        seen.update(counts)
    if block:
        yield block


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every row with a term: its length and which terms of the vocabulary it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = shared.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                sizes, held, counts = [], [], []
                for value in part.column("text"):
                    found = terms(value.as_buffer().to_pybytes()) if value.is_valid else []
                    here = Counter(map(number, found))
                    here.pop(None, None)
                    sizes.append(len(found))
                    held.append(list(here))
                    counts.append(list(here.values()))
                out = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())),
                     pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(np.array(sizes) > 0))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<bigint>")


def presence_groups(postings: list[np.ndarray], unit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, bounds), highest bound first: each document that holds a term, and the most its presence mask can score.

    ``postings`` has each term's documents among ``size``, ``unit`` the most one of them scores by it.
    """
    words = -(-len(postings) // 64)
    masks = np.zeros((size, words), np.uint64)
    for k, docs in enumerate(postings):
        masks[docs, k // 64] |= np.uint64(1) << np.uint64(k % 64)
    docs = np.nonzero(masks.any(axis=1))[0]
    if words == 1:
        distinct, group = np.unique(masks[docs, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, group = np.unique(masks[docs], axis=0, return_inverse=True)
    bounds = np.zeros(len(distinct), np.int64)
    for k, most in enumerate(unit):
        bounds += most * ((distinct[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64)
    bounds = bounds[group.reshape(-1)]
    order = np.argsort(-bounds, kind="stable")
    return docs[order], bounds[order]


class _Search:
    """The best documents of each item of a block over the chunks of one task."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, documents: int, length: int, top: int):
        self.items, self.n_terms, self.documents, self.length, self.top = items, n_terms, documents, length, top
        self.best: list[list[tuple[int, bool, object]]] = [[] for _ in items]

    def add(self, ids: list, n: np.ndarray, held: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        """A chunk: ids and lengths of documents, and the terms of all of them, ``sizes`` of each."""
        m = 25 + 75 * n * self.documents // self.length
        doc = np.repeat(np.arange(len(ids)), sizes)
        gain = 1_000_000_000 * counts // (1_000 * counts + 8 * m[doc])
        order = np.argsort(held, kind="stable")
        doc, gain = doc[order], gain[order]
        ends = np.searchsorted(held[order], np.arange(self.n_terms + 1))
        most = np.zeros(self.n_terms, np.int64)
        present = np.nonzero(ends[1:] > ends[:-1])[0]
        if len(present):
            most[present] = np.maximum.reduceat(gain, ends[present])
        for item, (numbers, weights) in enumerate(self.items):
            here = ends[numbers + 1] > ends[numbers]
            numbers, weights = numbers[here], weights[here]
            if len(numbers):
                spans = [slice(ends[t], ends[t + 1]) for t in numbers]
                self._take(item, ids, [doc[s] for s in spans], [gain[s] for s in spans], weights, weights * most[numbers])

    def _take(self, item, ids, postings, gains, weights, unit) -> None:
        best = self.best[item]
        docs, bounds = presence_groups(postings, unit, len(ids))
        at, step = 0, 64
        while at < len(docs):
            bar = best[-1][0] * -1 if len(best) == self.top else 1
            stop = min(at + step, int(np.searchsorted(-bounds, -bar, side="right")))
            if stop <= at:
                break
            some = np.sort(docs[at:stop])
            score = np.zeros(len(some), np.int64)
            for where, gain, weight in zip(postings, gains, weights):
                i = np.minimum(np.searchsorted(where, some), len(where) - 1)
                score += np.where(where[i] == some, weight * gain[i], 0)
            for k in np.nonzero(score >= max(bar, 1))[0]:
                key = ids[some[k]]
                best.append((-int(score[k]), key is None, key if key is not None else 0))
            best.sort()
            del best[self.top:]
            at, step = stop, step * 4


def _search(rows: DataFrame, block: list[tuple[object, np.ndarray, np.ndarray]], n_terms: int, documents: int, length: int,
            top: int, id_kind: str, doc_kind: str) -> DataFrame:
    """(item, item_id, doc_id, score): what every task keeps for each item of the block."""
    shared = rows.sparkSession.sparkContext.broadcast([(numbers, weights) for _, numbers, weights in block])
    keys = [key for key, _, _ in block]

    def chunks(batches):
        waiting, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                waiting.append(batch.slice(at, CHUNK))
                n += waiting[-1].num_rows
                if n >= CHUNK:
                    yield pa.Table.from_batches(waiting)
                    waiting, n = [], 0
        if waiting:
            yield pa.Table.from_batches(waiting)

    def run(batches):
        search = _Search(shared.value, n_terms, documents, length, top)
        doc_type = None
        for chunk in chunks(batches):
            doc_type = chunk.schema.field("doc_id").type
            held = chunk.column("terms").combine_chunks()
            search.add(chunk.column("doc_id").to_pylist(), chunk.column("n").to_numpy(), held.flatten().to_numpy(),
                       chunk.column("counts").combine_chunks().flatten().to_numpy(), held.value_lengths().to_numpy())
        found = [(i, keys[i], None if none else key, -score) for i, best in enumerate(search.best) for score, none, key in best]
        if found:
            item, item_id, doc, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(item_id), pa.array(doc, doc_type),
                                              pa.array(score, pa.int64())], ["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, f"item int, item_id {id_kind}, doc_id {doc_kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each row of ``items`` with a score above 0.

    Equal scores go by ascending id, nulls last; rows of equal id and score in any order. Rows
    are documents, also when they repeat. Null and empty texts have no terms: such a document is
    not counted, such an item finds nothing. Empty tables give no rows. Other columns are not read.
    """
    id_kind = items.schema[item_id].dataType.simpleString()
    doc_kind = docs.schema[doc_id].dataType.simpleString()
    found = []
    for block in item_blocks(items, item_id, item_text):
        vocabulary = {term: i for i, term in enumerate(sorted({t for _, counts in block for t in counts}))}
        rows = written(occurrences(docs, vocabulary, doc_id, text), "occurrences")
        documents, length = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        queries = []
        for key, counts in block:
            numbers = np.array([vocabulary[t] for t in counts], np.int64)
            queries.append((key, numbers, weight[numbers] * np.array(list(counts.values()), np.int64) if len(numbers) else numbers))
        kept = _search(rows, queries, len(vocabulary), documents, length, top, id_kind, doc_kind)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found.append(kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
                     .select("item_id", "rank", "doc_id", "score"))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {id_kind}, rank int, doc_id {doc_kind}, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
