"""Jobs over whole corpora: passages, segmentation, evaluation, dictionary tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import fixed, folds, text
from glyphlake.operators import filters, reports, sequence
from glyphlake.sources import html, records


def pack_passages(texts: DataFrame, key: str, sentences, targets: tuple[int, ...] = fixed.PASSAGE_TARGETS,
                  min_tail: int = fixed.PASSAGE_MIN_TAIL, length: Callable[[Column], Column] = F.length) -> DataFrame:
    """(key, passage, n, text): sentences of a text put together until they reach the next target in turn.

    ``sentences`` is the text's array of sentences, ``length`` says how long one is. A tail shorter than ``min_tail``
    is left out.
    """
    rows = texts.select(key, sentences.alias("_s")).withColumn(
        "_p", folds.pack(F.transform("_s", length), targets, min_tail))
    rows = rows.select(key, F.posexplode(F.arrays_zip("_s", "_p")).alias("_i", "_z"))
    return rows.where("_z._p >= 0").groupBy(key, F.col("_z._p").alias("passage")).agg(
        F.count(F.lit(1)).alias("n"), F.expr("listagg(_z._s, '') within group (order by _i)").alias("text"))


def wrap_groups(segments, k: int) -> Column:
    """Array of (line, text, ruby) for segments (text, ruby) set in lines of ``k`` cells.

    A word with a reading stays on one line; one longer than a line loses its reading.
    """
    short = F.transform(segments, lambda s: F.struct(
        s["text"].alias("text"), F.when(F.length(s["text"]) <= k, s["ruby"]).alias("ruby")))
    whole = lambda s: F.coalesce(s["ruby"], F.lit("")) != ""
    # Only segments go through Python; the line of a plain character follows from where its segment begins.
    places = folds.wrap(F.transform(short, lambda s: F.length(s["text"])), F.transform(short, whole), k)

    def units(seg, place):
        chars = F.when(seg["text"] == "", F.array().cast("array<string>")).otherwise(F.split(seg["text"], ""))
        plain = F.transform(chars, lambda c, i: F.struct(
            (place["line"] + F.call_function("div", place["used"] + i, F.lit(k)).cast("int")).alias("line"), c.alias("text"), F.lit(None).cast("string").alias("ruby")))
        return F.when(whole(seg), F.array(F.struct(place["line"].alias("line"), seg["text"].alias("text"), seg["ruby"].alias("ruby")))).otherwise(plain)

    return F.flatten(F.zip_with(short, places, units))


def segment(hits: DataFrame, keys: list[str], pos: str, length: str) -> DataFrame:
    """(keys, pos, length): the matches that a reader takes from left to right, the longest at each place.

    The matches of one text travel together; they are no more than its characters.
    """
    longest = hits.groupBy(*keys, pos).agg(F.max(length).alias(length))
    rows = longest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, length))).alias("_h"))
    return rows.select(*keys, F.inline(folds.greedy(F.col("_h").getField(pos), F.col("_h").getField(length))).alias(pos, length))


def cells_from_runs(runs: DataFrame, keys: list[str], em: float) -> DataFrame:
    """(keys, cell, top, height): character cells from the strokes (start, end) of a page column."""
    rows = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_r"))
    found = folds.cells(F.col("_r").getField("start"), F.col("_r").getField("end"), em)
    return rows.select(*keys, F.posexplode(found).alias("cell", "_c")).select(*keys, "cell", "_c.top", "_c.height")


def evaluate(pairs: DataFrame, least: int) -> DataFrame:
    """The error report of (category, truth, hyp) after both are brought into one form; fails below ``least`` rows."""
    same = pairs.withColumns({c: text.normalize_eval(c) for c in ("truth", "hyp")})
    report = reports.cer_report(same)
    floor = F.when((F.col("category") == "ALL") & (F.col("n") < least), F.raise_error(F.lit(f"fewer than {least} rows")).cast("bigint"))
    return report.withColumn("n", F.coalesce(floor, F.col("n")))


def evaluate_sample(crops: DataFrame, truth: DataFrame, hyps: DataFrame, n: int, seed: str, least: int) -> tuple[DataFrame, DataFrame]:
    """The error report of a sample of ``n`` crops of each category, and (name, reason) of those that could not be judged.

    ``crops`` has (category, name), ``truth`` (name, truth), ``hyps`` (name, hyp). What is missing does not count as an error.
    """
    drawn = reports.sample_per_category(crops.select("category", "name"), "category", "name", n, seed)
    judged = truth.select("name", "truth", text.normalize_eval("truth").alias("_t"))
    lacking = reports.missing_reports(drawn, judged, hyps, "name", F.coalesce(F.length("_t"), F.lit(0)) == 0)
    pairs = drawn.join(lacking.select("name"), "name", "left_anti").join(judged.drop("_t"), "name").join(hyps.select("name", "hyp"), "name")
    return evaluate(pairs, least), lacking


def second_opinion(asked: DataFrame, told: DataFrame, key: str, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """Agreement, as report and as histogram, of the second reading of each request with the first, in compatible forms.

    ``asked`` has (key, asked, truth, ..), ``told`` (key, told, ok, hyp). A request counts by its first reply that is
    not older; failed ones and those without a reply do not.
    """
    met = sequence.correlate(asked.select(key, "asked"), told, [key]).where("told is not null")
    answer = told.where("ok").groupBy(key, "told").agg(F.min("hyp").alias("hyp"))
    pairs = asked.join(met.select(key, "asked", "told"), [key, "asked"]).join(answer, [key, "told"]).withColumns(
        {c: text.nfkc(c) for c in ("truth", "hyp")})
    return reports.agreement_report(pairs, bucket), reports.agreement_histogram(pairs, bucket)


def lossless(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, sense, kept): do all characters of an old sense stand in the new text, in order. Blanks do not count.

    Senses of fewer than two characters are not judged, nor keys without a new text.
    """
    def bare(c):
        return F.regexp_replace(c, "(?U)\\s+", "")

    rows = old.select(key, "sense", bare("sense").alias("_s")).where(F.length("_s") >= 2).join(
        new.select(key, bare("text").alias("_t")), key)
    # Position behind the last character found; null once one is missing.
    behind = F.expr("aggregate(filter(split(_s, ''), c -> c <> ''), 1, (at, c) -> nullif(locate(c, _t, at), 0) + 1)")
    return rows.select(key, "sense", behind.isNotNull().alias("kept"))


def alignment(probes: DataFrame, lines: DataFrame, glyphs: DataFrame, page: list[str], size: int = 6) -> DataFrame:
    """(page, probe, dx, dy, aligned, gross): how far the nearest reading of a probe's first characters is from it.

    Only probes of three characters or more count whose needle (the first ``size`` characters, or all) stands in no
    other probe of their page. ``probes`` has (page, probe, text, x, y, h), ``lines`` (page, li, text), ``glyphs``
    (page, li, ci, x, y). A line counts by the first place of the needle in it.
    """
    asked = probes.where(F.length("text") >= 3)
    alone = reports.unique_probes(asked.select(*page, "probe", "text"), "probe", "text", size, page)
    asked = asked.join(alone, [*page, "probe"]).select(
        *page, "probe", "needle", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("h").alias("_h"))
    first = reports.first_places(lines.select(*page, "li", "text"), asked.select(*page, "needle"), page, "li", "text").groupBy(
        *page, "li", "needle").agg(F.min("at").alias("ci"))
    # The glyphs pass by the few places that are asked for; they are not sorted.
    met = asked.join(first, [*page, "needle"]).hint("shuffle_hash").join(glyphs.select(*page, "li", "ci", "x", "y"), [*page, "li", "ci"])
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    best = met.groupBy(*page, "probe", "_h").agg(F.min_by(F.struct(dx.alias("dx"), dy.alias("dy")), F.struct(F.abs(dx) + F.abs(dy), "li")).alias("b"))
    fits = (F.abs("b.dx") <= 12) & (F.abs("b.dy") <= F.greatest(F.lit(10), F.col("_h") * 0.45))
    far = ~fits & ((F.abs("b.dx") > 30) | (F.abs("b.dy") > 30))
    return best.select(*page, "probe", "b.dx", "b.dy", fits.alias("aligned"), far.alias("gross"))


def build_tables(banks: DataFrame, payload: str, label: Column, place: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms that point at glosses, the distinct glosses, and the statistics of both, from the banks of archives."""
    terms = records.load_terms(records.bank_records(banks, payload, 6), label)
    glosses, terms = reports.dedup_glosses(terms, "gloss_json", place)
    return terms, glosses, reports.index_stats(terms)


#: Around a word with a reading in running text: before it, before and behind its reading. HTML texts have no control characters.
_WORD, _READING, _END = "\u0001", "\u0002", "\u0003"


def _marked(segments: Column) -> Column:
    word = lambda s: F.concat(F.lit(_WORD), s["text"], F.lit(_READING), s["ruby"], F.lit(_END))
    return F.array_join(F.transform(segments, lambda s: F.when(s["ruby"].isNull(), s["text"]).otherwise(word(s))), "")


def _bare(marked: Column) -> Column:
    return F.regexp_replace(marked, f"{_READING}[^{_END}]*{_END}|{_WORD}", "")


def _parts(marked: Column) -> Column:
    """Array of (text, ruby) of marked text."""
    found = [F.regexp_extract_all(marked, F.lit(f"{_WORD}([^{_READING}]*){_READING}([^{_END}]*){_END}|([^{_WORD}]+)"), F.lit(i)) for i in (1, 2, 3)]
    return F.zip_with(found[2], F.arrays_zip(found[0].alias("w"), found[1].alias("r")), lambda plain, word: F.struct(
        F.concat(word["w"], plain).alias("text"), F.nullif(word["r"], F.lit("")).alias("ruby")))


def truth_corpus(pages: DataFrame, key: str, page: str, script: str, ends: str, continues: str, variants: int, per: int, k: int) -> DataFrame:
    """(key, passage, repeat, variant, body, ruby): the passages of HTML pages, set in lines of ``k`` cells, in ``per`` renderings.

    Only paragraphs with at least ten characters of ``script`` count; passages run on over their borders. ``ruby`` lists
    the readings of a passage in order; they are not in the body and do not count for its length.
    """
    paras = html.html_paragraphs(pages, key, page).select(key, "para_no", _marked(F.col("segments")).alias("t"))
    cut = F.split(F.regexp_replace("t", f"([{ends}])(?![{continues}{_READING}])(?![^{_WORD}{_READING}]*[{_READING}{_END}])", "$1\u0000"), "\u0000")
    paras = paras.where(filters.has_script(_bare(F.col("t")), script)).withColumn("s", F.filter(cut, lambda s: s != ""))
    whole = paras.groupBy(key).agg(F.flatten(F.sort_array(F.collect_list(F.struct("para_no", "s"))).getField("s")).alias("s"))
    passages = pack_passages(whole, key, F.col("s"), length=lambda s: F.length(_bare(s)))
    # A passage is set once for all its renderings.
    units = passages.withColumn("_s", _parts(F.col("text"))).withColumn("_u", wrap_groups(F.col("_s"), k))
    lead = F.concat(F.array(F.lit(0)), F.slice(F.col("_u.line"), F.lit(1), F.greatest(F.size("_u") - 1, F.lit(0))))
    body = F.array_join(F.zip_with("_u", lead, lambda u, before: F.concat(F.when(u["line"] > before, "\n").otherwise(""), u["text"])), "")
    ruby = F.regexp_extract_all("text", F.lit(f"{_READING}([^{_END}]*){_END}"), F.lit(1))
    rows = sequence.assign_variants(units.select(key, "passage", body.alias("body"), ruby.alias("ruby")), "passage", variants, per)
    return rows.select(key, "passage", "repeat", "variant", "body", "ruby")


def write_truth(rows: DataFrame, key: str, path: str) -> None:
    """The rows of ``truth_corpus`` as text files, one folder a variant: a note, the body's lines, and a ``#ruby:`` line a reading.

    The note tells key, passage, repeat and the number of body lines. A blank line ends a passage; bodies have none.
    """
    note = F.concat_ws(" ", F.lit("#"), key, "passage", "repeat", F.size(F.split("body", "\n")))
    lines = F.concat(F.array(note, F.col("body")), F.transform("ruby", lambda r: F.concat(F.lit("#ruby:"), r)))
    rows.select("variant", F.array_join(lines, "\n").alias("value")).write.partitionBy("variant").option("lineSep", "\n\n").text(path)


def read_truth(spark: SparkSession, key: str, kind: str, path: str) -> DataFrame:
    """What ``write_truth`` wrote; ``kind`` is the key's type."""
    lines = F.split("value", "\n")
    note = F.split(lines[0], " ")
    n = note[4].cast("int")
    return spark.read.option("lineSep", "\n\n").text(path).select(
        note[1].cast(kind).alias(key), note[2].cast("int").alias("passage"), note[3].cast("int").alias("repeat"), F.col("variant").cast("int").alias("variant"),
        F.array_join(F.slice(lines, 2, n), "\n").alias("body"),
        F.transform(F.slice(lines, n + 2, F.size(lines)), lambda r: F.substr(r, F.lit(7))).alias("ruby"))
