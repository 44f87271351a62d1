"""Benchmark decontamination: word windows of test items looked up in every training text.

The hashes of the test windows form the broadcast set, a table of bits whose size is
the same for every benchmark. Every window of a text is hashed where the text lies;
only windows whose bit is set leave the row, with their words, and an exact join on
the words decides. A larger benchmark lets more windows through to that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import ascii_lower, free_name, words, written

WINDOW = 10
#: Bits of the broadcast set; a power of two.
SET_BITS = 1 << 22
#: Windows of the benchmark up to which the exact join may broadcast them.
BROADCAST_BOUND = 200_000


def _spans(n_words: Column, size: int) -> Column:
    """Start of every window of ``size`` words."""
    return F.when(n_words >= size, F.sequence(F.lit(0), n_words - size)).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(words, size, hash, items): each distinct window once, with the ids of its items as strings."""
    w = F.col("w")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                             words(ascii_lower(F.col(text))).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(window)))
    rows = items.select("item", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("at"))
    part = F.slice(w, F.col("at") + 1, F.col("size"))
    return rows.select("item", "size", F.array_join(part, " ").alias("words"), F.xxhash64(part).alias("hash")).groupBy(
        "words", "size", "hash").agg(F.collect_set("item").alias("items"))


def _place(hashed: Column) -> tuple[Column, Column]:
    """Word and bit of a hash in the set."""
    at = F.pmod(hashed, F.lit(SET_BITS))
    return F.call_function("shiftright", at, F.lit(6)).cast("int"), at.bitwiseAND(63).cast("int")


def hash_set(windows: DataFrame) -> Column:
    """The bits of all hashes in ``windows``: a literal array of ``SET_BITS`` / 64 numbers."""
    word, bit = _place(F.col("hash"))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")))
    table = [0] * (SET_BITS // 64)
    for r in windows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(bits.alias("bits")).collect():
        table[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _hits(windows: DataFrame) -> Column:
    """Array of (at, size, words) for the windows of ``w`` that may occur."""
    known = hash_set(windows)

    def possible(hashed):
        word, bit = _place(hashed)
        return F.call_function("shiftright", F.get(known, word), bit).bitwiseAND(1) == 1

    def of_size(size):
        def part(i):
            return F.slice("w", i + 1, size)
        hashed = F.transform(_spans(F.size("w"), size), lambda i: F.struct(i.alias("at"), F.xxhash64(part(i)).alias("hash")))
        return F.transform(F.filter(hashed, lambda x: possible(x["hash"])), lambda x: F.struct(
            x["at"].alias("at"), F.lit(size).alias("size"), F.array_join(part(x["at"]), " ").alias("words")))

    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    return F.concat(F.array().cast("array<struct<at:int,size:int,words:string>>"), *map(of_size, sizes))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
               text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans): one row per row of ``docs``.

    ``spans`` are the (at, size) of all windows of the benchmark in the text, in
    order. Null and empty texts have no words and are clean; an item without
    words leaks nowhere; repeated items and rows count each on their own. A null
    item id is the string ``null``. Other columns are not carried.
    """
    windows = written(item_windows(benchmark, window, item_id, item_text), "windows")
    small = windows.count() <= BROADCAST_BOUND
    rows = (docs.select(F.col(doc_id).alias("doc_id"), words(ascii_lower(F.col(text))).alias("w"))
            .select(F.monotonically_increasing_id().alias("row"), "doc_id",
                    F.size("w").cast("bigint").alias("n_words"), _hits(windows).alias("hits")))
    table = windows.select("words", "items")
    found = (rows.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("h"))
             .select("row", "doc_id", "n_words", "h.at", "h.size",
                     # Rows without a hit get a key that is no words, each its own.
                     F.coalesce("h.words", F.concat(F.lit(" "), F.col("row").cast("string"))).alias("words"))
             .join(F.broadcast(table) if small else table, "words", "left"))
    place = F.when(F.col("items").isNotNull(), F.struct("at", "size"))
    by_row = found.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(place)).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    items = F.array_sort(F.array_distinct("items"))
    return by_row.select(
        "doc_id", "n_words", F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no leak, with all their columns.

    A row is known by its id and the MD5 of its text, so rows that share an id, or
    have none, are judged each by their own text. Null and empty texts have no leak; an empty table stays empty.
    """
    own, id_, key = (free_name(docs, n) for n in ("own", "leaky_id", "leaky_key"))
    named = docs.withColumn(own, F.struct(F.col(doc_id).alias("id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("key")))
    leaks = find_leaks(named, benchmark, window, own, text, item_id, item_text)
    bad = leaks.where("contaminated").select(F.col("doc_id.id").alias(id_), F.col("doc_id.key").alias(key)).distinct()
    return named.join(bad, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(own).getField("key") == F.col(key)), "left_anti").drop(own)
