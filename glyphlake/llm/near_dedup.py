"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Every text becomes a weighted set: hashes of its five-word shingles with their
   counts. Exact copies are one text from here on.
2. Document frequencies of shingles are counted over all documents in a table of
   fixed size, resolved down to a fixed share of the documents at any size. A
   shingle weighs count * (1 + log(1 + documents / frequency) / DAMPING).
3. Consistent weighted samples of each set (the sample and its weight level agree
   for two sets with a probability equal to their weighted Jaccard similarity) are
   joined to bands. Texts of one band value are candidates.
4. In a bucket every text is paired with two of its texts, the smallest key and
   one drawn by the band, so the pairs are linear in the bucket's size. Pairs are
   verified exactly: their weighted Jaccard similarity must reach the threshold,
   by these weights or by counts alone. The second is for large families, whose
   common text is so frequent that its weight no longer binds them. Pairs whose
   sketches (sizes and parities of counts) already rule both out are left out before.
5. Texts that verified pairs connect are one class, found by alternating star
   contraction over tables in the shared folder. In buckets that still hold several
   classes, the texts outside the core class (the largest but by rare chance) meet
   two texts drawn from that class and one from the bucket, for a few turns; each turn
   is linear in those texts. A bucket whose classes joined nothing in a turn draws no more.
6. Where a bucket still holds several classes, its texts meet once more by an exact
   join: two similar texts share one of the rarest shingles of both (prefix
   filter), and what stands behind it must be enough on both sides (positional
   filter). What is verified joins the classes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import WORD, free_name, written

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**3)**12 = 0.9998.
ROWS, BANDS = 3, 12
#: The larger, the less a shingle's rarity counts.
DAMPING = 8
#: Most turns in which open buckets draw texts; the exact join takes what they leave.
TURNS = 3
#: Counters of document frequency; a power of two.
COUNTERS = 1 << 18
#: Bits of the filter that keeps vectors of texts without a candidate at home; a power of two.
FILTER_BITS = 1 << 23
#: Texts of a bucket's core class that are drawn from, on average.
CORE_DRAWS = 8
#: Words of 64 bits in a sketch; a power of two.
SKETCH = 8
#: Shingles sampled together; larger chunks take more memory for the same samples.
CHUNK = 1 << 12
#: Hashes of words that a task remembers.
REMEMBERED = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_vectors(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, shingles, counts): the weighted set of each row's text, empty without words.

    ``key`` is the MD5 of the text, ``shingles`` sorted 32-bit hashes, ``counts``
    32-bit numbers or null if all are one. A text of fewer words is one shingle.
    """
    import xxhash

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    word = WORD

    class Hashes(dict):
        def __missing__(self, w):
            self[w] = h = xxhash.xxh3_64_intdigest(w)
            return h

    def run(batches):
        find, hashes = re.compile(word).findall, Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                keys, sets, counts = [], [], []
                if len(hashes) > REMEMBERED:
                    hashes.clear()
                for value in part.column("text"):
                    t = value.as_py()
                    keys.append(hashlib.md5(t.encode()).digest())
                    h = np.fromiter(map(hashes.__getitem__, find(t.lower())), np.uint64)
                    n = max(1, len(h) - size + 1) if len(h) else 0
                    s = np.zeros(n, np.uint64)
                    for i in range(min(size, len(h))):
                        s = _mix(s + h[i:i + n])
                    s, c = np.unique((s >> np.uint64(32)).astype(np.uint32), return_counts=True)
                    sets.append(s.tobytes())
                    counts.append(None if not n or c.max() == 1 else c.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sets, pa.binary()),
                     pa.array(counts, pa.binary())], ["doc_id", "key", "shingles", "counts"])

    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, shingles binary, counts binary")


def inverse_frequencies(vectors: DataFrame) -> np.ndarray:
    """Weight of one occurrence for each counter; the table has a fixed size."""
    def run(batches):
        counts, n = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for s in batch.column("shingles"):
                h = np.frombuffer(s.as_buffer(), np.uint32) & np.uint32(COUNTERS - 1)
                counts += np.bincount(h, minlength=COUNTERS) if len(h) > COUNTERS else 0
                if len(h) <= COUNTERS:
                    np.add.at(counts, h, 1)
                n += 1
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *counts[at]], pa.int64())],
                                         ["counter", "n"])

    rows = (vectors.select("shingles").mapInArrow(run, "counter int, n bigint")
            .groupBy("counter").agg(F.sum("n").alias("n")).toArrow())
    at, n = rows.column("counter").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(COUNTERS)
    counts[at[at >= 0]] = n[at >= 0]
    return (1 + np.log1p(max(1, n[at < 0].sum()) / np.maximum(counts, 1)) / DAMPING).astype(np.float32)


def _weights(shingles, counts, idf):
    h = np.frombuffer(shingles, np.uint32)
    w = idf[h & np.uint32(COUNTERS - 1)]
    return h, w if counts is None else w * np.frombuffer(counts, np.uint32)


def consistent_samples(h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """``n`` improved consistent weighted samples of a set, each as one number.

    For sample k and element x, r and c are Gamma(2, 1) and b is uniform, all
    drawn from (k, x). With t = floor(log w / r + b), the element with the least
    c * exp(-r * (t - b + 1)) is the sample (x, t).
    """
    salts = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[:, None] | np.uint64(1)
    best, found = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64)
    unit, rows = np.float32(2.0 ** -32), np.arange(n)
    for at in range(0, len(h), CHUNK):
        x = h[at:at + CHUNK].astype(np.uint64) + np.uint64(1)
        log_w = np.log(w[at:at + CHUNK])
        one = _mix(x * salts)
        two = _mix(one + np.uint64(0xA0761D6478BD642F))
        three = (_mix(two + np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
        low = np.uint64(0xFFFFFFFF)

        def gamma(z):
            a = ((z >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * unit
            b = ((z & low).astype(np.float32) + np.float32(0.5)) * unit
            return -np.log(a * b)

        r, c = gamma(one), gamma(two)
        t = np.floor(log_w / r + three)
        value = np.log(c) - r * (t - three + np.float32(1))
        least = value.argmin(axis=1)
        better = value[rows, least] < best
        best = np.where(better, value[rows, least], best)
        level = t[rows, least].astype(np.int64).astype(np.uint64)
        found = np.where(better, _mix(x[least] + (level << np.uint64(33))), found)
    return found


_SKETCH_NAMES = ["n", "w", *(f"b{i}" for i in range(SKETCH))]
_SKETCH_KIND = f"struct<n: double, w: double, {', '.join(f'b{i}: bigint' for i in range(SKETCH))}>"


def sketch(h: np.ndarray, counts) -> np.ndarray:
    """Bits of the shingles with an odd count, those of one place added without carry.

    Two sets differ in no more bits than their counts differ in sum.
    """
    odd = h if counts is None else h[np.frombuffer(counts, np.uint32) & 1 == 1]
    bits = np.bincount(odd & np.uint32(64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def band_values(vectors: DataFrame, idf: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(key, doc_id, bands, sketch): a number per band, null for an empty set; sums of counts and weights, and the bits of ``sketch``."""
    idf = vectors.sparkSession.sparkContext.broadcast(idf)
    names = _SKETCH_NAMES

    def run(batches):
        for batch in batches:
            out, sums, bits = [], np.zeros((2, batch.num_rows)), np.zeros((SKETCH, batch.num_rows), np.int64)
            for row, (s, c) in enumerate(zip(batch.column("shingles"), batch.column("counts"))):
                counts = c.as_py()
                h, w = _weights(s.as_buffer(), counts, idf.value)
                if not len(h):
                    out.append(None)
                    continue
                sums[:, row] = len(h) if counts is None else np.frombuffer(counts, np.uint32).sum(), w.sum(dtype=np.float64)
                bits[:, row] = sketch(h, counts)
                samples = consistent_samples(h, w, rows * bands).reshape(bands, rows)
                value = np.zeros(bands, np.uint64)
                for i in range(rows):
                    value = _mix(value + samples[:, i])
                out.append(value.astype(np.int64))
            sketches = pa.StructArray.from_arrays([pa.array(x) for x in (*sums, *bits)], names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(out, pa.list_(pa.int64())), sketches], ["key", "doc_id", "bands", "sketch"])

    kind = vectors.select("doc_id").schema[0].dataType.simpleString()
    return vectors.mapInArrow(run, f"key binary, doc_id {kind}, bands array<bigint>, sketch {_SKETCH_KIND}")


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): every text of a bucket with the bucket's smallest key and with one drawn by the band."""
    members = texts.select("key", F.posexplode("bands").alias("band", "value"))
    drawn = F.min_by("key", F.xxhash64("key", "band"))
    buckets = members.groupBy("band", "value").agg(
        F.min("key").alias("least"), F.max("key").alias("most"), drawn.alias("drawn")).where("least <> most").drop("most")
    met = members.join(buckets, ["band", "value"]).select(
        "key", F.explode(F.array_distinct(F.array("least", "drawn"))).alias("other")).where("key <> other")
    return met.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def _held(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``vectors`` whose key may be in ``keys``, by a bit filter of fixed size."""
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).cast("int")
    bits = keys.select(place.alias("p")).select(
        (F.col("p") / 32).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p") % 32).alias("bit"))
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    shared = vectors.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            p = batch.column("place").to_numpy()
            keep = (shared.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1
            yield batch.drop_columns(["place"]).filter(pa.array(keep.astype(bool)))

    return vectors.withColumn("place", place).mapInArrow(run, vectors.schema)


def may_reach(a: Column, b: Column, idf: np.ndarray, threshold: float = THRESHOLD) -> Column:
    """Do the sketches of two texts leave a similarity of ``threshold`` possible.

    A pair that reaches it by counts differs by (1 - threshold) / (1 + threshold) of both sums at most, and so do
    its bits and sums; by weights likewise, where a bit stands for the least weight. No similar pair is lost.
    """
    most = (1 - threshold) / (1 + threshold) + 1e-6
    bits = sum(F.bit_count(a[f"b{i}"].bitwiseXOR(b[f"b{i}"])) for i in range(SKETCH))
    by_count, by_weight = (F.greatest(bits * F.lit(least), F.abs(a[x] - b[x])) <= most * (a[x] + b[x])
                           for x, least in (("n", 1.0), ("w", float(idf.min()))))
    return by_count | by_weight


def possible_pairs(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``pairs`` (a, b, ..) that may reach ``threshold`` by the sketches of ``texts`` (key, sketch)."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(texts.select(F.col("key").alias(side), F.col("sketch").alias(f"_{side}")), side)
    return both.where(may_reach(F.col("_a"), F.col("_b"), idf, threshold)).select(*pairs.columns)


def verified_pairs(pairs: DataFrame, vectors: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): the pairs whose weighted Jaccard similarity, by weights or by counts, is ``threshold`` or more."""
    idf = pairs.sparkSession.sparkContext.broadcast(idf)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    held = _held(vectors.select("key", "shingles", "counts"), keys).groupBy("key").agg(
        F.first(F.struct("shingles", "counts")).alias("v"))
    both = (pairs.join(held.select(F.col("key").alias("a"), F.col("v").alias("va")), "a")
            .join(held.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b"))
    flat = both.select("a", "b", F.col("va.shingles").alias("sa"), F.col("va.counts").alias("ca"),
                       F.col("vb.shingles").alias("sb"), F.col("vb.counts").alias("cb"))

    def run(batches):
        for batch in batches:
            found = []
            for sa, ca, sb, cb in zip(*(batch.column(n) for n in ("sa", "ca", "sb", "cb"))):
                ha, wa = _weights(sa.as_buffer(), ca.as_py(), idf.value)
                hb, wb = _weights(sb.as_buffer(), cb.as_py(), idf.value)
                _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                na, nb = (np.ones(len(h)) if c.as_py() is None else np.frombuffer(c.as_py(), np.uint32).astype(float)
                          for h, c in ((ha, ca), (hb, cb)))
                best = 0.0
                for x, y in ((wa, wb), (na, nb)):
                    shared = float(np.minimum(x[i], y[j]).sum(dtype=np.float64))
                    total = float(x.sum(dtype=np.float64) + y.sum(dtype=np.float64)) - shared
                    best = max(best, shared / total)
                found.append(best)
            similarity = pa.array(found, pa.float64())
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), similarity], ["a", "b", "similarity"])
            yield out.filter(pa.array(np.array(found) >= threshold))

    return flat.mapInArrow(run, "a binary, b binary, similarity double")


def components(pairs: DataFrame) -> DataFrame:
    """(key, root): every key of a pair with the least key it is connected to."""
    edges = written(pairs.select("a", "b").distinct(), "edges")
    before = None
    while True:
        # Large star: neighbours above a key move to the least of its neighbourhood.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a key, and the key, move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small.select(F.col("v").alias("a"), F.col("u").alias("b")), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("b").alias("key"), F.col("a").alias("root"))
        before = now


def open_rows(members: DataFrame) -> DataFrame:
    """(key, root, band, value, core): what (key, root, band, value) hold of buckets of three or more texts and several classes.

    ``core`` is the bucket's least root. A large class has the least key of many, so that is the largest class but by
    rare chance. The texts outside it are all here, of its own only a few draws (``CORE_DRAWS`` a bucket on average):
    a family that is one class but for some strangers costs as much as the strangers.
    """
    mixed = members.groupBy("band", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("core"), F.max("root").alias("most")).where("n > 2 and core <> most")
    few = F.pmod(F.xxhash64("key", "band", F.lit(-1)), F.col("n")) < CORE_DRAWS
    return members.join(mixed.drop("most"), ["band", "value"]).where((F.col("root") != F.col("core")) | few).select(
        "key", "root", "band", "value", "core")


def drawn_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b, root_a, root_b): pairs of different classes that the buckets of ``open_rows`` draw.

    A text outside its bucket's core class meets two texts of that class and one of the bucket.
    """
    def draw(kind):
        return F.xxhash64("key", "band", F.lit(3 * turn + kind))

    at_home = F.col("root") == F.col("core")
    buckets = rows.groupBy("band", "value").agg(
        *[F.min_by(F.struct("key", "root"), F.when(at_home, draw(i))).alias(f"home{i}") for i in range(2)],
        F.min_by(F.struct("key", "root"), draw(2)).alias("hub"))
    outside = rows.where(~at_home).join(buckets, ["band", "value"])
    met = outside.select("key", "root", F.explode(F.array("home0", "home1", "hub")).alias("other")).where("root <> other.root")
    turned = F.col("key") > F.col("other.key")
    return met.select(F.least("key", "other.key").alias("a"), F.greatest("key", "other.key").alias("b"),
                      F.when(turned, F.col("other.root")).otherwise(F.col("root")).alias("root_a"),
                      F.when(turned, F.col("root")).otherwise(F.col("other.root")).alias("root_b")).distinct()


def open_texts(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, root): the texts that may still be similar to one of another class in a bucket of ``open_rows``.

    ``roots`` (key, root) are the classes as they are now. A bucket's text outside its core class was outside before;
    of the core class, all texts are taken, in whatever bucket they are.
    """
    now = rows.select("key", "core").join(roots, "key").join(
        roots.select(F.col("key").alias("core"), F.col("root").alias("home")), "core").where("root <> home")
    return roots.join(now.select("key").distinct(), "key", "left_semi").unionByName(
        roots.join(now.select(F.col("home").alias("root")).distinct(), "root", "left_semi").select("key", "root")).distinct()


def _tops(links: DataFrame) -> DataFrame:
    """(root, top): the classes that ``links`` (root_a, root_b) join."""
    merged = components(links.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")))
    return written(merged.select(F.col("key").alias("root"), F.col("root").alias("top")), "tops")


def _moved(rows: DataFrame, tops: DataFrame, label: str = "root") -> DataFrame:
    """``rows`` with the classes that theirs became."""
    tops = tops.withColumnRenamed("root", label)
    return rows.join(tops, label, "left").withColumn(label, F.coalesce("top", label)).drop("top").select(*rows.columns)


def prefixes(texts: DataFrame, vectors: DataFrame, n_rows: int, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(key, root, shingle, short, by_count, by_weight, sketch): the rarest shingles of the texts (key, root).

    ``vectors`` has the rows of at least these texts, ``n_rows`` is the number of all rows.

    In the order of weights, rarest first, the shingles from the first common one of
    a similar pair on hold ``threshold`` of both texts and, as a pair's similarity s
    is an overlap of s / (1 + s) of their sum, 2 * threshold / (1 + threshold) of the
    smaller one: ``short``. Frequent shingles weigh less, so these shares by weights
    are never above those by counts, and one list serves both. ``by_count`` and
    ``by_weight`` are (all, rest): of the text, and from the shingle on. Shingles of
    only one row are left out.
    """
    n = max(1, n_rows)
    once = 1 + (np.log1p(n) + np.log1p(n / 2)) / 2 / DAMPING  # between the weights of frequency 1 and 2
    shared = vectors.sparkSession.sparkContext.broadcast(idf)
    held = _held(vectors.select("key", "shingles", "counts"), texts.select("key")).groupBy("key").agg(
        F.first(F.struct("shingles", "counts")).alias("v"))
    rows = texts.join(held, "key").select("key", "root", "v.shingles", "v.counts")
    names = _SKETCH_NAMES
    part = 2 * threshold / (1 + threshold)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                taken, out = [], {k: [] for k in ("e", "short", "n", "n_rest", "w", "w_rest")}
                bits = np.zeros((SKETCH, some.num_rows), np.int64)
                for row, (s, c) in enumerate(zip(some.column("shingles"), some.column("counts"))):
                    counts = c.as_py()
                    h, w = _weights(s.as_buffer(), counts, shared.value)
                    bits[:, row] = sketch(h, counts)
                    one = shared.value[h & np.uint32(COUNTERS - 1)]
                    order = np.lexsort((h, -one))
                    h, w, one = h[order], w[order].astype(float), one[order]
                    m = np.ones(len(h)) if counts is None else np.frombuffer(counts, np.uint32)[order].astype(float)
                    n_rest, w_rest = m[::-1].cumsum()[::-1], w[::-1].cumsum()[::-1]
                    keep = np.nonzero((n_rest >= (threshold - 1e-6) * n_rest[:1]) & (one < once))[0]
                    taken.append(np.full(len(keep), row))
                    for name, values in (("e", h), ("short", n_rest >= (part - 1e-6) * n_rest[:1]), ("n", np.full(len(h), n_rest[:1])),
                                         ("n_rest", n_rest), ("w", np.full(len(h), w_rest[:1])), ("w_rest", w_rest)):
                        out[name].append(values[keep])
                taken = pa.array(np.concatenate(taken))
                out = {name: np.concatenate(values) for name, values in out.items()}
                yield pa.RecordBatch.from_arrays(
                    [some.column("key").take(taken), some.column("root").take(taken), pa.array(out["e"].astype(np.int64)),
                     pa.array(out["short"].astype(bool)), *(pa.array(out[x]) for x in ("n", "n_rest", "w", "w_rest")), pa.StructArray.from_arrays(
                         [pa.array(out["n"]), pa.array(out["w"]), *(pa.array(x).take(taken) for x in bits)], names)],
                    ["key", "root", "shingle", "short", "n", "n_rest", "w", "w_rest", "sketch"])

    flat = rows.mapInArrow(run, "key binary, root binary, shingle bigint, short boolean, n double, n_rest double, w double, w_rest double, "
                           f"sketch {_SKETCH_KIND}")
    return flat.select("key", "root", "shingle", "short", F.struct(F.col("n").alias("all"), F.col("n_rest").alias("rest")).alias("by_count"),
                       F.struct(F.col("w").alias("all"), F.col("w_rest").alias("rest")).alias("by_weight"), "sketch")


def remaining_pairs(entries: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, root_a, root_b): the pairs of different classes that the rows of ``prefixes`` leave possible.

    A shingle's largest class meets the others but not itself, so a family that is
    one class costs no more than its size.
    """
    classes = entries.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"), F.bool_or("short").alias("short"))
    useful = classes.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("k"), F.max_by("root", F.struct("n", "root")).alias("largest"), F.bool_or("short").alias("short"))
    rows = entries.join(useful.where("k > 1 and short").select("shingle", "largest"), "shingle")
    mine = rows.where("root <> largest").drop("largest")
    other = rows.drop("largest").select("shingle", *(F.col(c).alias(f"{c}_") for c in ("key", "root", "short", "by_count", "by_weight", "sketch")))
    met = mine.where("short").join(other, "shingle").unionByName(mine.where("not short").join(other.where("short_"), "shingle"))
    part = threshold / (1 + threshold) - 1e-6
    enough = [F.least(f"{c}.rest", f"{c}_.rest") >= part * (F.col(f"{c}.all") + F.col(f"{c}_.all")) for c in ("by_count", "by_weight")]
    turned = F.col("key") > F.col("key_")
    return met.where("root <> root_").where(enough[0] | enough[1]).where(may_reach(F.col("sketch"), F.col("sketch_"), idf, threshold)).select(
        F.least("key", "key_").alias("a"), F.greatest("key", "key_").alias("b"),
        F.when(turned, F.col("root_")).otherwise(F.col("root")).alias("root_a"),
        F.when(turned, F.col("root")).otherwise(F.col("root_")).alias("root_b")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, rows: int = ROWS,
                    bands: int = BANDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, class_id, n_links, kept): one row per row of ``docs``.

    ``class_id`` is the least id of the rows whose texts are equal or connected
    by verified pairs, ``n_links`` the number of different texts its text was
    compared with and found similar to (not all similar texts of a large family),
    ``kept`` marks the rows with the class's least id
    and, if several texts have that id, its least text. Null and empty texts are
    one text; texts without words have no near-duplicates but their copies. Null
    ids are larger than all others. Other columns are not carried.
    """
    vectors = written(shingle_vectors(docs, size, doc_id, text), "shingles")
    idf = inverse_frequencies(vectors)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))
    texts = written(band_values(vectors, idf, rows, bands).groupBy("key").agg(
        F.min(order)["doc_id"].alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "texts")

    def possible(some):
        return written(possible_pairs(some, texts, idf, threshold), "possible")

    pairs = written(candidate_pairs(texts), "pairs")
    links = written(verified_pairs(possible(pairs), vectors, idf, threshold), "links")
    roots = texts.select("key").join(components(links), "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    links = links.select("a", "b")
    first = open_ = written(open_rows(texts.join(roots, "key").select("key", "root", F.posexplode("bands").alias("band", "value"))), "open")

    def once(keys):
        return written(_held(vectors.select("key", "shingles", "counts"), keys).groupBy("key").agg(
            F.first(F.struct("shingles", "counts")).alias("v")).select("key", "v.*"), "held")

    held = once(first.select("key"))
    for turn in range(TURNS):
        drawn = written(drawn_pairs(open_, turn).join(pairs, ["a", "b"], "left_anti"), "drawn")
        maybe = possible(drawn)
        more = written(verified_pairs(maybe.select("a", "b"), held, idf, threshold).join(maybe, ["a", "b"]), "more")
        pairs = pairs.unionByName(drawn.select("a", "b"))
        if more.isEmpty():
            break
        links = links.unionByName(more.select("a", "b"))
        tops = _tops(more)
        roots = _moved(roots, tops)
        joined = open_.join(tops, "root", "left_semi").select("band", "value").distinct()
        moved = written(_moved(_moved(open_.join(joined, ["band", "value"], "left_semi"), tops), tops, "core"), "moved")
        open_ = moved.join(moved.where("root <> core").select("band", "value").distinct(), ["band", "value"], "left_semi")
    roots = written(roots, "roots")
    left = written(open_texts(first, roots), "open-texts")
    held = once(left.select("key"))
    entries = written(prefixes(left, held, vectors.count(), idf, threshold), "prefixes")
    rest = written(remaining_pairs(entries, idf, threshold).join(pairs, ["a", "b"], "left_anti"), "rest")
    more = written(verified_pairs(rest.select("a", "b"), held, idf, threshold).join(rest, ["a", "b"]), "more")
    roots, links = _moved(roots, _tops(more)), links.unionByName(more.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = texts.select("key", "doc_id").join(roots, "key").join(degree, "key", "left")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key")))
    heads = rooted.groupBy("root").agg(least.alias("head"))
    classes = rooted.join(heads, "root").select("key", F.col("head.doc_id").alias("class_id"),
                                                F.col("head.key").alias("head_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return vectors.select("doc_id", "key").join(classes, "key").select(
        "doc_id", "key", "class_id", "n_links",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("head_key"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, with all its columns; of rows that repeat it, any one.

    Null and empty texts are one class. An empty table stays empty.
    """
    own, id_, key = (free_name(docs, n) for n in ("own", "kept_id", "kept_key"))
    kept = near_duplicates(docs, doc_id=doc_id, text=text, **options).where("kept").select(
        F.col("doc_id").alias(id_), F.col("key").alias(key)).distinct()
    rows = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = rows.join(kept, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left_semi")
    return rows.dropDuplicates([doc_id, own]).drop(own)
