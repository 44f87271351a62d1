"""Removal of byte strings that stand in an earlier document too, by a partitioned array of sampled suffixes.

Every window of ``WINDOW`` bytes has an anchor: the leftmost of its ``GRAM``-byte grams
with the least hash. Equal windows have their anchor at the same place, so it is enough
to compare suffixes that begin at anchors, about one byte in sixteen, together with what
stands to their left. The windows of one anchor are one extent, at most
``2 * WINDOW - GRAM`` bytes long.

1. Texts are written as compressed chunks. A chunk sends the hashes of its grams to hash
   buckets, which answer with one bit for each: another chunk has it too. Texts that equal
   a whole earlier one are told by their hash and take no further part.
2. For grams that several documents have, each different extent of a chunk becomes one
   suffix row, with the least id of the chunk's documents that hold it. Copies inside a
   chunk thus never reach the shuffle.
3. Spark samples splitters and range-partitions the suffixes by their leading bytes. A
   bucket sorts its suffixes, and their left contexts read backwards, by multikey
   quicksort. Neighbours with a common prefix that is long enough share windows; the
   least id of each window decides which rows come later.
4. A window that no row of the bucket precedes may have partners beyond the boundary, if the
   bucket's first or last suffix begins like it from the anchor on. Rows with such windows
   are range-partitioned once more, by their left contexts read backwards, and compared in
   those buckets. Windows that stay open there too are compared across all buckets by
   grouping, so a string of a hot passage is sent about once a bucket.
5. The marks go back to the chunks, which cut the marked windows out.

Texts are compared byte by byte, or by MD5 as a whole; other hashes only choose what is compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import written

WINDOW = 50
GRAM = 20
#: Bytes of text and documents of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_DOCS = 4 << 20, 20_000
#: Grams that one hash bucket, and suffixes that one range bucket should hold.
BUCKET_GRAMS, BUCKET_SUFFIXES = 1 << 21, 1 << 16
#: Positions hashed at a time.
_SLICE = 1 << 17
_LAST = np.iinfo(np.int64).max
_CHUNK = "chunk bigint, ids array<bigint>, sizes array<bigint>, hashes array<binary>, data binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def text_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, ids, sizes, hashes, data): texts laid end to end and compressed, null as empty."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        ids, parts, total = [], [], 0

        def chunk():
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                 pa.array([[hashlib.md5(p).digest() for p in parts]], pa.list_(pa.binary())),
                 pa.array([pack.compress(b"".join(parts))], pa.binary())], ["chunk", "ids", "sizes", "hashes", "data"])

        for batch in batches:
            for key, value in zip(batch.column("doc_id"), batch.column("text")):
                data = value.as_buffer().to_pybytes()
                if ids and (total + len(data) > CHUNK_BYTES or len(ids) >= CHUNK_DOCS):
                    yield chunk()
                    ids, parts, total, number = [], [], 0, number + 1
                ids.append(key.as_py())
                parts.append(data)
                total += len(data)
        if ids:
            yield chunk()

    return rows.mapInArrow(run, _CHUNK)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position on, by doubling."""
    h, step, out, done = _mix(data.astype(np.uint64) + np.uint64(1)), 1, None, 0
    while True:
        if size & step:
            if out is None:
                out = h
            else:
                n = len(h) - done
                out = _mix(out[:n] * np.uint64(3) + h[done:]) if n > 0 else out[:0]
            done += step
        if done == size:
            return out[:max(0, len(data) - size + 1)]
        n = max(0, len(h) - step)
        h, step = _mix(h[:n] * np.uint64(3) + h[step:step + n]), step * 2


def window_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each position on."""
    step = 1
    while step * 2 <= width:
        key, step = np.minimum(key[:len(key) - step], key[step:]), step * 2
    rest = width - step
    return np.minimum(key[:len(key) - rest], key[rest:]) if rest else key


class Extents:
    """The extents of a chunk: first window, number of windows, anchor, document and gram hash of each."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        ends = np.cumsum(sizes)
        starts, anchors, hashes = [], [], []
        for low in range(0, max(0, len(data) - window + 1), _SLICE):
            part = data[low:low + _SLICE + window - 1]
            h = gram_hashes(part, gram)
            key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            anchor = (window_least(key, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.nonzero(np.append(True, anchor[1:] != anchor[:-1]))[0]
            starts.append(new + low)
            anchors.append(anchor[new] + low)
            hashes.append(h[anchor[new]])
        start, anchor, h = (np.concatenate(x) if x else np.zeros(0, k) for x, k in
                            ((starts, np.int64), (anchors, np.int64), (hashes, np.uint64)))
        if len(start):  # an extent that a slice cut in two
            whole = np.append(True, anchor[1:] != anchor[:-1])
            start, anchor, h = start[whole], anchor[whole], h[whole]
        # Windows across the border of two texts are none: an extent may begin behind such windows.
        doc = np.searchsorted(ends, start, side="right")
        stop = np.append(start[1:], max(0, len(data) - window + 1))[:len(start)]
        pieces = [(start, np.minimum(stop, ends[doc] - window + 1), anchor, doc, h)] if len(start) else []
        more = np.nonzero(stop > ends[doc])[0] if len(start) else []
        for i in more:  # the anchor serves windows of the next texts
            d = doc[i] + 1
            while d < len(ends) and ends[d] - sizes[d] < stop[i]:
                a, b = ends[d] - sizes[d], min(stop[i], ends[d] - window + 1)
                pieces.append(tuple(np.array([v]) for v in (a, b, anchor[i], d, h[i])))
                d += 1
        start, stop, anchor, doc, h = (np.concatenate(x) for x in zip(*pieces)) if pieces else (start, start, anchor, doc, h)
        real = stop > start
        order = np.argsort(start[real], kind="stable")
        self.start, self.anchor, self.doc, self.hash = (x[real][order] for x in (start, anchor, doc, h))
        self.count = (stop - start)[real][order]


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of 64-bit words: three-way partition by one word, equal rows go on with the next."""
    order, stack = np.arange(len(words)), [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        part = order[low:high]
        if high - low <= 512:
            order[low:high] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        key = words[part, depth]
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        less, same = key < pivot, key == pivot
        order[low:high] = np.concatenate([part[less], part[same], part[~(less | same)]])
        a, b = low + int(less.sum()), low + int(less.sum()) + int(same.sum())
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def sorted_strings(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings of at most ``width`` bytes, padded with zeros, and the common prefix of each with the one before."""
    wide = -(-width // 8) * 8
    table = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), np.uint8).reshape(len(strings), wide)
    order = multikey_quicksort(table.view(">u8").astype(np.uint64))
    ranked = table[order]
    differs = ranked[1:] != ranked[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    return order, np.append(0, common)


def later_windows(suffixes: list[bytes], backs: list[bytes], docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per row a bit for each of its windows that a row with a smaller id has too, counted from the row's first window.

    A row's text is ``backs`` read backwards and then ``suffixes``; windows begin in the former or with the latter.
    """
    n = len(suffixes)
    sizes, befores = np.array([len(s) for s in suffixes]), np.array([len(s) for s in backs])
    order, common = sorted_strings(suffixes, window)
    back, back_common = sorted_strings(backs, window)
    marks, run, side = np.zeros(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    for left in range(int(befores.max(initial=-1)) + 1):
        rows = np.nonzero((befores >= left) & (sizes >= window - left))[0]
        if len(rows) < 2:
            continue
        run[order] = np.cumsum(common < window - left)
        side[back] = np.cumsum(back_common < left)
        key = run[rows] * (n + 1) + side[rows]
        by = np.argsort(key, kind="stable")
        first = np.append(True, key[by][1:] != key[by][:-1])
        least = np.minimum.reduceat(docs[rows][by], np.nonzero(first)[0])[np.cumsum(first) - 1]
        later = rows[by][least < docs[rows][by]]
        marks[later] |= np.int64(1) << (befores[later] - left)
    return marks


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, sizes and ids of a chunk; a missing id is larger than all others."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"].as_py()), np.uint8)
    ids = np.array([_LAST if i is None else i for i in row["ids"].as_py()], np.int64)
    return data, np.array(row["sizes"].as_py(), np.int64), ids


def _codes(extents: Extents, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each extent's gram hash."""
    h = extents.hash
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def gram_buckets(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, grams): 32 bits of each different gram of a chunk, ascending, by bucket."""
    def run(batches):
        for row in _rows(batches):
            data, sizes, _ = _unpacked(row)
            codes = np.unique(_codes(Extents(data, sizes), buckets))
            bucket = (codes >> np.uint64(32)).astype(np.int64)
            first = np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0] if len(codes) else np.zeros(0, int)
            low = codes.astype(np.uint32)
            grams = [x.tobytes() for x in np.split(low, first[1:])] if len(codes) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[first], pa.int32()), pa.array([row["chunk"].as_py()] * len(grams), pa.int64()), pa.array(grams, pa.binary())],
                ["bucket", "chunk", "grams"])

    return chunks.select("chunk", "ids", "sizes", "data").mapInArrow(run, "bucket int, chunk bigint, grams binary")


def shared_grams(grams: DataFrame) -> DataFrame:
    """(chunk, bucket, bits): for each gram of a chunk's bucket, in order, whether another chunk has it."""
    def run(table):
        parts = [np.frombuffer(g.as_buffer(), np.uint32) for g in table.column("grams")]
        _, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = (n > 1)[at]
        bits = [np.packbits(s).tobytes() for s in np.split(shared, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return grams.groupBy("bucket").applyInArrow(run, "chunk bigint, bucket int, bits binary")


def later_copies(chunks: DataFrame) -> DataFrame:
    """(chunk, copies): places of texts of at least a window that a document with a smaller id has as they are."""
    id_ = F.coalesce(F.col("t.ids"), F.lit(_LAST))
    texts = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "sizes", "hashes")).alias("place", "t")).where(
        F.col("t.sizes") >= WINDOW).select("chunk", "place", id_.alias("id"), F.col("t.hashes").alias("hash"))
    least = texts.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    return texts.join(least, "hash").where("id > least").groupBy("chunk").agg(F.collect_list("place").alias("copies"))


class _Candidates:
    """Extents of a chunk whose gram several documents have, each different one once; without those of later copies.

    ``which`` are their indexes among ``extents``, ``kind`` the number of the different
    extent, ``sample`` one index of each, ``least`` the least id of the documents that hold it.
    """

    def __init__(self, row, buckets: int):
        self.data, self.sizes, self.ids = _unpacked(row)
        self.extents = e = Extents(self.data, self.sizes)
        codes, at = np.unique(_codes(e, buckets), return_inverse=True)
        n = len(codes)
        bucket = (codes >> np.uint64(32)).astype(np.int64)
        shared = np.zeros(n, bool)
        for flag in row["flags"].as_py() or ():
            low, high = np.searchsorted(bucket, [flag["bucket"], flag["bucket"] + 1])
            shared[low:high] = np.unpackbits(np.frombuffer(flag["bits"], np.uint8), count=high - low).astype(bool)
        doc = self.ids[e.doc] if len(e.doc) else np.zeros(0, np.int64)
        self.copied = np.zeros(len(self.ids), bool)
        self.copied[row["copies"].as_py() or []] = True
        first = ~self.copied[e.doc] if len(e.doc) else np.zeros(0, bool)
        least, most = np.full(n, _LAST), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, at[first], doc[first])
        np.maximum.at(most, at[first], doc[first])
        self.which = np.nonzero((shared | (least < most))[at] & first)[0]
        start, size = e.start[self.which], e.count[self.which] + WINDOW - 1
        width = 2 * WINDOW - GRAM
        body = np.zeros((len(start), width + 4), np.uint8)
        for k in range(width):
            inside = size > k
            body[inside, k] = self.data[start[inside] + k]
        body[:, width:] = size.astype(">u4").view(np.uint8).reshape(-1, 4)
        _, self.sample, self.kind = np.unique(body.view(f"V{width + 4}").reshape(-1), return_index=True, return_inverse=True)
        self.sample, self.kind = self.which[self.sample], self.kind.reshape(-1)
        self.least = np.full(len(self.sample), _LAST)
        np.minimum.at(self.least, self.kind, doc[self.which])


def suffix_rows(chunks: DataFrame, buckets: int) -> DataFrame:
    """(suffix, back, doc, chunk, kind): from the anchor on, and backwards from it, of each different extent of a chunk with ``flags``."""
    def run(batches):
        for row in _rows(batches):
            found = _Candidates(row, buckets)
            e, raw = found.extents, found.data.tobytes()
            for at in range(0, len(found.sample), 50_000):
                some = found.sample[at:at + 50_000]
                spans = list(zip(e.start[some].tolist(), e.anchor[some].tolist(), (e.start[some] + e.count[some] + WINDOW - 1).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw[p:b] for _, p, b in spans], pa.binary()), pa.array([raw[a:p][::-1] for a, p, _ in spans], pa.binary()),
                     pa.array(found.least[at:at + 50_000]), pa.array([row["chunk"].as_py()] * len(some), pa.int64()),
                     pa.array(np.arange(at, at + len(some)), pa.int64())], ["suffix", "back", "doc", "chunk", "kind"])

    return chunks.mapInArrow(run, "suffix binary, back binary, doc bigint, chunk bigint, kind bigint")


def _whole(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def prefix_lengths(strings: list[bytes], other: bytes) -> np.ndarray:
    """Length of the common prefix of each string with ``other``."""
    sizes = np.array([len(s) for s in strings])
    wide = int(sizes.max(initial=1))
    table = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), np.uint8).reshape(len(strings), wide)
    differs = table != np.frombuffer(other[:wide].ljust(wide, b"\0"), np.uint8)
    return np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), wide), np.minimum(sizes, len(other)))


def bucket_marks(suffixes: DataFrame, buckets: int) -> DataFrame:
    """(suffix, back, doc, chunk, kind, marks, open) of range buckets; without suffix where the bucket alone decides.

    ``open`` has a bit for each unmarked window that other buckets may have too.
    """
    ranged = suffixes.repartitionByRange(buckets, "suffix", "back", "doc", "chunk")

    def run(batches):
        table = _whole(batches)
        if table is None:
            return
        suffix, back = table.column("suffix").to_pylist(), table.column("back").to_pylist()
        marks = later_windows(suffix, back, table.column("doc").to_numpy())
        near = np.maximum(prefix_lengths(suffix, min(suffix)), prefix_lengths(suffix, max(suffix)))
        # Bits of the windows that reach no further to the right of the anchor than ``near``.
        reach = np.array([len(b) for b in back]) - np.maximum(WINDOW - near, 0) + 1
        open_ = ((np.int64(1) << np.maximum(reach, 0)) - 1) & ~marks
        for rows in np.array_split(np.nonzero(open_)[0], np.count_nonzero(open_) // 10_000 + 1):
            part = table.take(pa.array(rows)).append_column("marks", pa.array(marks[rows])).append_column("open", pa.array(open_[rows]))
            yield from part.combine_chunks().to_batches()
        inner = np.nonzero((open_ == 0) & (marks != 0))[0]
        for rows in np.array_split(inner, len(inner) // 100_000 + 1):
            none = pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.nulls(len(rows), pa.int64()), table.column("chunk").take(rows).combine_chunks(),
                 table.column("kind").take(rows).combine_chunks(), pa.array(marks[rows]), pa.nulls(len(rows), pa.int64())],
                ["suffix", "back", "doc", "chunk", "kind", "marks", "open"])

    return ranged.mapInArrow(run, "suffix binary, back binary, doc bigint, chunk bigint, kind bigint, marks bigint, open bigint")


def edge_marks(rows: DataFrame, buckets: int) -> DataFrame:
    """(window, doc, chunk, kind, marks): marks of ``bucket_marks`` rows by their left contexts, and with ``window`` those that stay open."""
    ranged = rows.repartitionByRange(buckets, "back", "suffix", "doc", "chunk")

    def run(batches):
        table = _whole(batches)
        if table is None:
            return
        suffix, back = table.column("suffix").to_pylist(), table.column("back").to_pylist()
        doc, chunk, kind, old, open_ = (table.column(c).to_numpy() for c in ("doc", "chunk", "kind", "marks", "open"))
        marks = later_windows(suffix, back, doc) | old
        near = np.maximum(prefix_lengths(back, min(back)), prefix_lengths(back, max(back)))
        open_ = open_ & ~marks
        windows, at, bits = [], [], []
        for row in np.nonzero(open_)[0].tolist():
            b, s = back[row], suffix[row]
            for left in range(max(0, WINDOW - len(s)), int(near[row]) + 1):
                bit = 1 << (len(b) - left)
                if int(open_[row]) & bit:
                    windows.append(b[:left][::-1] + s[:WINDOW - left])
                    at.append(row)
                    bits.append(bit)
        names = ["window", "doc", "chunk", "kind", "marks"]
        some = np.nonzero(marks)[0]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), *map(pa.array, (doc[some], chunk[some], kind[some], marks[some]))], names)
        if at:
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows, pa.binary()), *map(pa.array, (doc[at], chunk[at], kind[at])), pa.array(bits, pa.int64())], names)

    return ranged.mapInArrow(run, "window binary, doc bigint, chunk bigint, kind bigint, marks bigint")


def boundary_marks(windows: DataFrame) -> DataFrame:
    """(chunk, kind, marks): those rows of ``edge_marks`` whose window a row with a smaller id has too."""
    least = windows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    return windows.join(least, "window").where("least < doc").select("chunk", "kind", "marks")


def cut_chunks(chunks: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): chunks with ``flags`` and ``marks``, each text without its marked windows."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for row in _rows(batches):
            found = _Candidates(row, buckets)
            e, raw, which = found.extents, found.data.tobytes(), found.which
            marks = np.zeros(len(found.sample), np.int64)
            for mark in row["marks"].as_py() or ():
                marks[mark["kind"]] |= mark["marks"]
            marks = marks[found.kind]
            start, count = e.start[which], e.count[which]
            whole = marks == (np.int64(1) << count) - 1
            if len(which):
                whole |= found.ids[e.doc[which]] > found.least[found.kind]
            # Runs of marked windows: of a whole extent, or single ones.
            begins, stops = [start[whole]], [start[whole] + count[whole] - 1 + WINDOW]
            part = np.nonzero(~whole & (marks != 0))[0]
            for k in range(WINDOW - GRAM + 1):
                hit = part[(marks[part] >> np.int64(k)) & 1 == 1]
                begins.append(start[hit] + k)
                stops.append(start[hit] + k + WINDOW)
            ends = np.cumsum(found.sizes)
            copied = np.nonzero(found.copied)[0]
            begins, stops = np.concatenate([*begins, ends[copied] - found.sizes[copied]]), np.concatenate([*stops, ends[copied]])
            order = np.argsort(begins, kind="stable")
            begins, stops = begins[order], stops[order]
            doc = np.searchsorted(ends, begins, side="right")
            fresh = np.append(True, (begins[1:] > stops[:-1]) | (doc[1:] != doc[:-1]))[:len(begins)]
            first = np.nonzero(fresh)[0]
            last = np.append(first[1:], len(begins))[:len(first)] - 1
            spans: dict[int, list[tuple[int, int]]] = {}
            for d, a, b in zip(doc[first].tolist(), begins[first].tolist(), stops[last].tolist()):
                spans.setdefault(d, []).append((a, b))
            keys = row["ids"].as_py()
            for at in range(0, len(keys), 1_000):
                cuts, kept = [], []
                for d in range(at, min(at + 1_000, len(keys))):
                    here, begin, end = [], int(ends[d] - found.sizes[d]), int(ends[d])
                    parts, place = [], begin
                    for a, b in spans.get(d, ()):
                        here.append({"start": a - begin, "stop": b - begin})
                        parts.append(raw[place:a])
                        place = b
                    parts.append(raw[place:end])
                    cuts.append(here)
                    kept.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at:at + 1_000], pa.int64()), pa.array(found.sizes[at:at + 1_000]), pa.array(cuts, span),
                     pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return chunks.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each row's text without the bytes that an earlier document has too.

    A byte goes if it lies in a ``WINDOW``-byte string of the UTF-8 text that also starts in a row
    with a smaller id; ``spans`` are the maximal runs of such bytes, ``kept`` the rest, which may
    end inside a character. A null text is empty, a null id is larger than all others; rows of
    one id take nothing from each other. Repeated rows stay rows, an empty table gives none.
    Other columns are not carried.
    """
    chunks = written(text_chunks(docs, doc_id, text), "chunks")
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = int(total * 2 // (WINDOW - GRAM + 2) // BUCKET_GRAMS) + 1
    flags = written(shared_grams(gram_buckets(chunks, buckets)), "shared")
    flags = flags.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags"))
    copies = written(later_copies(chunks), "copies")
    flagged = chunks.drop("hashes").join(flags.join(copies, "chunk", "full"), "chunk", "left")
    suffixes = written(suffix_rows(flagged, buckets), "suffixes", compression="zstd")
    least = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = written(bucket_marks(suffixes, max(least, suffixes.count() // BUCKET_SUFFIXES + 1)), "marks",
                      compression="zstd")
    edges = sorted_.where("suffix is not null")
    edges = written(edge_marks(edges, max(least, edges.count() // BUCKET_SUFFIXES + 1)), "edges")
    marks = sorted_.where("suffix is null").select("chunk", "kind", "marks").unionByName(
        edges.where("window is null").select("chunk", "kind", "marks")).unionByName(boundary_marks(edges.where("window is not null")))
    marks = marks.groupBy("chunk", "kind").agg(F.bit_or("marks").alias("marks")).groupBy("chunk").agg(
        F.collect_list(F.struct("kind", "marks")).alias("marks"))
    return cut_chunks(flagged.join(marks, "chunk", "left"), buckets)
