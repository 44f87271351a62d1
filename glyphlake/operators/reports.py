"""Reports over whole tables: totals, rates, manifests, samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.places import has_page, told_by_page, values
from glyphlake.functions.text import edit_distance, strip_edges
from glyphlake.ordered import Ordered


def classify_archives(members: DataFrame, archive: str, tag: str, place: str) -> DataFrame:
    """(archive, kind): kanji before term before the kind of the first meta tag, else null."""
    meta = F.expr(f"min_by({tag}, {place}) filter (where {tag} in ('pitch', 'freq'))")
    kind = (F.when(F.bool_or(F.col(tag) == "kanji"), "kanji").when(F.bool_or(F.col(tag) == "term"), "term").otherwise(meta))
    return members.groupBy(archive).agg(kind.alias("kind"))


def index_stats(terms: DataFrame) -> DataFrame:
    """(dict, n, n_keys, n_glosses), and one row for all with a null dict."""
    return terms.rollup("dict").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"),
                                    F.count_distinct("gloss_key").alias("n_glosses"))


def manifest(terms: DataFrame, *others: DataFrame, order: str = "pos") -> DataFrame:
    """(dict, source, first): labels by first appearance among the terms, then those of other tables not listed before."""
    rows = terms.groupBy("dict").agg(F.min(order).alias("first")).withColumn("source", F.lit(0))
    for i, other in enumerate(others, 1):
        rows = rows.unionByName(other.groupBy("dict").agg(F.min(order).alias("first")).withColumn("source", F.lit(i)))
    return rows.groupBy("dict").agg(F.min(F.struct("source", "first")).alias("at")).select("dict", "at.source", "at.first")


def dedup_glosses(rows: DataFrame, gloss: str, place: str) -> tuple[DataFrame, DataFrame]:
    """Distinct glosses by hash, with their first place, and the rows that point at them."""
    keyed = rows.withColumn("gloss_key", F.sha1(F.coalesce(F.col(gloss), F.lit(""))))
    return keyed.groupBy("gloss_key", gloss).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), keyed.drop(gloss)


def cer_report(scored: DataFrame, category: str = "category", truth: str = "truth", hyp: str = "hyp") -> DataFrame:
    """(category, n, dist, micro, mean): per category and, under ``ALL``, over everything without a mean. Empty truths do not count."""
    rows = scored.where(F.length(truth) > 0).select(
        F.col(category).alias("category"), edit_distance(truth, hyp).alias("d"), F.length(truth).alias("n_chars"))
    totals = rows.rollup("category").agg(
        F.grouping("category").alias("_all"), F.count(F.lit(1)).alias("n"), F.sum("d").alias("dist"),
        (F.sum("d") / F.sum("n_chars")).alias("micro"), F.avg(F.col("d") / F.col("n_chars")).alias("mean"))
    every = F.col("_all") == 1
    return totals.select(F.when(every, "ALL").otherwise(F.col("category")).alias("category"), "n", "dist",
                         "micro", F.when(~every, F.col("mean")).alias("mean"))


def agreement_report(pairs: DataFrame, bucket: Column, a: str = "truth", b: str = "hyp") -> DataFrame:
    """(bucket, n, equal, equal_bare): share of equal pairs as they are and without edge punctuation."""
    bare = strip_edges(a).eqNullSafe(strip_edges(b))
    return pairs.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((edit_distance(a, b) == 0).cast("double")).alias("equal"),
        F.avg(bare.cast("double")).alias("equal_bare"))


def agreement_histogram(pairs: DataFrame, bucket: Column, a: str = "truth", b: str = "hyp") -> DataFrame:
    """(bucket, distance, n, n_bare): how many pairs are so far apart, as they are and without edge punctuation."""
    rows = pairs.select(bucket.alias("bucket"), F.array(
        F.struct(edit_distance(a, b).alias("d"), F.lit(1).alias("n"), F.lit(0).alias("bare")),
        F.struct(edit_distance(strip_edges(a), strip_edges(b)).alias("d"), F.lit(0).alias("n"), F.lit(1).alias("bare"))).alias("_d"))
    return rows.select("bucket", F.explode("_d").alias("_d")).groupBy("bucket", F.col("_d.d").alias("distance")).agg(
        F.sum("_d.n").alias("n"), F.sum("_d.bare").alias("n_bare"))


def unique_probes(probes: DataFrame, probe_id: str, text: str, n: int = 6, within: Sequence[str] = ()) -> DataFrame:
    """(within, probe, needle): probes whose needle (the first ``n`` characters, or all) stands in at most one probe's text.

    Probes are compared with those of equal ``within``, which fit one task. Without it, needles of one length are looked up among the windows of that
    length of all texts, so the work is linear in their length; a shorter text's needle has its own length.
    """
    rows = probes.select(*within, F.col(probe_id).alias("id"), F.col(text).alias("t"), F.left(F.col(text), F.lit(n)).alias("needle"))
    if within:
        held = first_places(rows.select(*within, "id", "t"), rows.select(*within, "needle"), within, "id", "t").groupBy(
            *within, "needle").agg(F.count(F.lit(1)).alias("n"))
        return rows.join(held, [*within, "needle"], "left").where(F.coalesce("n", F.lit(0)) <= 1).select(*within, F.col("id").alias(probe_id), "needle")
    # The characters are split once: a substring is sought from the text's start, a slice is not.
    texts = rows.where(F.length("t") > 0).select(F.filter(F.split("t", ""), lambda c: c != "").alias("_c"))
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.least(k, F.size("_c"))))
    spans = F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(
        F.sequence(F.lit(1), F.size("_c") - k + 1), lambda i: F.array_join(F.slice("_c", i, k), "")))))
    held = texts.select(F.explode(spans).alias("needle")).join(
        rows.select("needle").distinct(), "needle", "left_semi").groupBy("needle").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(held, "needle", "left").where(F.coalesce("n", F.lit(0)) <= 1).select(F.col("id").alias(probe_id), "needle")


def first_places(texts: DataFrame, needles: DataFrame, within: Sequence[str], text_id: str, text: str) -> DataFrame:
    """(within, text_id, needle, at): the first place, from 0, of each needle in each row of ``texts`` that holds it.

    Needles are compared with texts of equal ``within``, which fit one task. All windows of a needle's length are hashed at
    once and those of equal hash are compared, so the work is linear in the texts.
    """
    kind = texts.schema[text_id].dataType.simpleString()
    rows = texts.where(has_page(within) & (F.length(text) > 0)).select(*within, F.lit(True).alias("_text"), F.col(text_id).alias("_id"), F.col(text).alias("_t"))
    asked = needles.where(has_page(within) & (F.length("needle") > 0)).select(*within, F.lit(False).alias("_text"), F.lit(None).cast(kind).alias("_id"), F.col("needle").alias("_t"))
    return told_by_page(rows.unionByName(asked), within, _places, ["_text", "_id", "_t"], {text_id: kind, "needle": "string", "at": "int"}, text_id)


def _hashed(chars: np.ndarray, k: int) -> np.ndarray:
    """A number of each window of ``k`` characters."""
    found = np.zeros(max(0, len(chars) - k + 1), np.uint64)
    for i in range(k):
        found = found * np.uint64(0x9E3779B97F4A7C15) + chars[i:i + len(found)]
    return found ^ (found >> np.uint64(29))


def _places(name: str, is_text: pa.Array, ids: pa.Array, words: pa.Array) -> dict:
    """``first_places`` of one group."""
    is_text = is_text.to_numpy(zero_copy_only=False)
    own = np.flatnonzero(is_text)
    texts, needles = words.take(pa.array(own)).to_pylist(), set(words.take(pa.array(np.flatnonzero(~is_text))).to_pylist())
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    rows, found, places = [], [], []
    for k in sorted({len(n) for n in needles}):
        some = sorted(n for n in needles if len(n) == k)
        sought = _hashed(np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.uint64), k)[::k]
        if len(set(sought.tolist())) < len(some):  # needles of equal hash
            for t, n in ((t, n) for t, held in enumerate(texts) for n in some if n in held):
                rows.append(own[t])
                found.append(n)
                places.append(texts[t].find(n))
            continue
        order = np.argsort(sought)
        seen, mask = _hashed(chars, k), np.uint64(0xFFFF)
        maybe = np.zeros(1 << 16, bool)
        maybe[(sought & mask).astype(np.int64)] = True
        at = np.flatnonzero(maybe[(seen & mask).astype(np.int64)])
        spot = np.minimum(np.searchsorted(sought[order], seen[at]), len(some) - 1)
        text = np.searchsorted(ends, at, "right")
        ok = (sought[order][spot] == seen[at]) & (at + k <= ends[text])
        at, text, needle = at[ok], text[ok], order[spot[ok]]
        first = np.unique(text * len(some) + needle, return_index=True)[1]
        for i, t, n in zip(at[first].tolist(), text[first].tolist(), needle[first].tolist()):
            begin = i - (int(ends[t - 1]) if t else 0)
            if texts[t][begin:begin + k] != some[n]:
                begin = texts[t].find(some[n])  # another window of equal hash came first
            if begin >= 0:
                rows.append(own[t])
                found.append(some[n])
                places.append(begin)
    return {name: values(ids.take(pa.array(rows, pa.int64()))), "needle": found, "at": np.array(places, np.int32)}


def corpus_totals(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("passages"), F.sum(F.size(F.split(text, "\n"))).alias("paragraphs"),
                    F.sum(F.length(text)).alias("characters"))


def choose_front(rects: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """(key, rect_id): the front-most rectangle larger than 200 by 200 of which at least half can be seen.

    ``visible`` has (key, rect_id, visible), as ``pages.visible_fraction`` gives it. Keys without one have no row.
    """
    large = rects.where((F.col("w") > 200) & (F.col("h") > 200)).select(key, "rect_id", "z")
    seen = visible.where(F.col("visible") >= 0.5).select(key, "rect_id")
    return large.join(seen, [key, "rect_id"]).groupBy(key).agg(F.min_by("rect_id", "z").alias("rect_id"))


def by_owner(windows: DataFrame, owner: str) -> DataFrame:
    """(owner, n, on_screen, largest): windows of at least 300 by 200; ties to the smaller id."""
    ok = windows.where((F.col("w") >= 300) & (F.col("h") >= 200) & F.col(owner).isNotNull())
    return ok.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("layer") == 0).alias("on_screen"),
        F.max_by("rect_id", F.struct((F.col("w") * F.col("h")).alias("a"), (-F.col("rect_id")).alias("b"))).alias("largest"))


def latency(deltas: DataFrame, keys: list[str], value: str, shares: tuple[tuple[str, float], ...] = (("p50", 0.5), ("p95", 0.95))) -> DataFrame:
    """(keys, p50, p95): exact percentiles, interpolated between the two nearest ranks. Nulls do not count.

    Rows are numbered over ranges of (keys, value) and only those at the wanted ranks are kept, so a key of any size
    needs no buffer of its values.
    """
    rows = deltas.where(F.col(value).isNotNull()).select(*keys, value)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = sizes.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(share)).alias("at"))
                                                 for name, share in shares])).alias("_p")).select(*keys, "_p.name", "_p.at")
    wanted = at.select(*keys, "name", (F.col("at") - F.floor("at")).alias("_part"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), (F.floor("at") + 1).alias("i")), F.struct(F.lit(1).alias("side"), (F.ceil("at") + 1).alias("i")))).alias("_r"))
    ranked = Ordered(rows, keys, [value]).scan(number="_i").df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_i", F.col(value).cast("double").alias("_v"))
    same = F.col("_i") == F.col("_r.i")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = wanted.join(ranked, same).groupBy(*keys, "name").agg(
        F.max(F.when(F.col("_r.side") == 0, F.col("_v"))).alias("low"), F.max(F.when(F.col("_r.side") == 1, F.col("_v"))).alias("high"), F.max("_part").alias("part"))
    mixed = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, mixed)).alias(name) for name, _ in shares])


def missing_reports(crops: DataFrame, truth: DataFrame, hyps: DataFrame, key: str, empty: Column) -> DataFrame:
    """(key, reason): rows without a truth, with an empty one (``empty``, over ``truth``), or with a truth but no hypothesis."""
    keys = crops.select(key)
    told = truth.select(key, F.coalesce(empty, F.lit(True)).alias("_empty")).groupBy(key).agg(F.bool_or("_empty").alias("_empty"))
    rows = keys.join(told, key, "left").join(hyps.select(key).distinct().withColumn("_read", F.lit(True)), key, "left")
    reason = F.when(F.col("_empty").isNull(), "no truth").when(F.col("_empty"), "empty truth").when(F.col("_read").isNull(), "no hypothesis")
    return rows.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


def sample_per_category(df: DataFrame, category: str, key: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows of each category, the same every time."""
    w = Window.partitionBy(category).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
