"""Derived tables shared by the queries, as DataFrames and as SQL for the check.

The base tables hold no Japanese text, so stand-ins with the same shape are
derived from them: a dictionary from ``benchmark`` words, glyph boxes from the
characters of ``documents``, rectangles from ``orders``, points from
``lineitem``. Every view covers its whole table.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.session import by_key

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()
WORD_BREAK = "[^a-zà-öø-ÿ]+"
#: What stands between two breaks.
LETTERS = "[a-zà-öø-ÿ]+"
#: Characters of a text that are looked through together for the positions of ``v_query``.
QUERY_BLOCK = 64


def words_of(text):
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def micros(ts):
    """Microseconds since 1970 of a zone-less timestamp, as a column name."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


class Tables:
    """The base tables of one directory and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def over(self, documents: DataFrame) -> "Tables":
        """The same views over other documents."""
        other = type(self).__new__(type(self))
        other.spark, other.sf_dir, other.documents = self.spark, self.sf_dir, documents
        return other

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def v_events(self):
        return self.events.select("event_id", micros("ts").alias("us"), "user_id", "event_type",
                                  "value", "props")

    @cached_property
    def v_lines(self):
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))

    @cached_property
    def v_turn_lines(self):
        return self.conversations.select("conv_id", "turn", "role",
                                         F.posexplode(F.split("text", "\n")).alias("line_no", "line"))

    @cached_property
    def v_tokens(self):
        # A file may be one group of rows, which is one task however many words it holds, so texts are dealt out first.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.documents.select("doc_id", "lang", "text").repartition(parts, "doc_id").select(
            "doc_id", "lang", F.posexplode(words_of("text")).alias("pos", "word"))

    @cached_property
    def v_word(self):
        return (self.benchmark.select("item_id", F.explode(words_of("text")).alias("word"))
                .groupBy("word").agg(F.count("*").alias("score"), F.min("item_id").alias("pos")))

    @cached_property
    def v_dict(self):
        word = self.v_word.withColumns({
            "reading": F.substring("word", 1, 3),
            "dict": F.concat(F.lit("d"), (F.length("word") % 3).cast("string"))})
        keys = F.when(F.length("word") > 3, F.array("word", "reading")).otherwise(F.array("word"))
        return word.select(F.explode(keys).alias("key"), "reading", F.col("word").alias("gloss_key"),
                           "score", "dict", "pos")

    @cached_property
    def v_gloss(self):
        return self.v_word.select(
            F.col("word").alias("gloss_key"),
            F.concat(F.lit('["'), "word", F.lit('","'), F.expr("substring(word, 2)"), F.lit('"]'))
            .alias("gloss_json"))

    @cached_property
    def v_entries(self):
        return self.v_dict.join(self.v_gloss, "gloss_key").select(
            "key", "pos", "reading", "dict", "score", "gloss_key", "gloss_json")

    @cached_property
    def v_query(self):
        """Every position of every turn with the twelve characters from there on."""
        # Every character becomes a row of up to twelve, and most queries multiply that by twelve
        # again, so turns are dealt out first: the shuffle is small against what follows it.
        # A text is cut into blocks with the characters behind them, so a substring is sought from its
        # block's start and a text costs time in proportion to its length.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        turns = self.conversations.where(F.length("text") > 0).select(
            "conv_id", "turn", F.lower("text").alias("text")).repartition(parts, "conv_id", "turn")
        block = f"(?s)(.{{1,{QUERY_BLOCK}}})(?=(.{{0,11}}))"
        blocks = [F.regexp_extract_all("text", F.lit(block), F.lit(i)).alias(n) for i, n in ((1, "own"), (2, "behind"))]
        rows = turns.select("conv_id", "turn", F.posexplode(F.arrays_zip(*blocks)).alias("_k", "_b")).select(
            "conv_id", "turn", "_k", F.concat("_b.own", "_b.behind").alias("_t"), F.explode(
                F.sequence(F.lit(1), F.length("_b.own"))).alias("_i"))
        return rows.select("conv_id", "turn", (F.col("_k") * QUERY_BLOCK + F.col("_i") - 1).alias("pos"),
                           F.expr("substring(_t, _i, 12)").alias("q"))

    @cached_property
    def v_freq_raw(self):
        return self.v_tokens.select(
            F.col("word").alias("term"), F.col("lang").alias("source"), F.col("doc_id").alias("value"))

    @cached_property
    def v_freq(self):
        return self.v_freq_raw.groupBy("term", "source").agg(F.min("value").alias("value"))

    @cached_property
    def v_pitch(self):
        return self.v_dict.select(F.col("key").alias("term"), "reading",
                                  (F.length("key") % 4).alias("position")).distinct()

    @cached_property
    def v_char(self):
        return self.v_word.select(
            F.substring("word", 1, 1).alias("char"),
            F.concat(F.lit("on"), (F.length("word") % 2).cast("string")).alias("on_yomi"),
            F.lit("").alias("kun_yomi"), F.array(F.substring("word", 1, 2)).alias("meanings"),
            F.concat(F.lit("d"), (F.length("word") % 3).cast("string")).alias("dict")).distinct()

    @cached_property
    def v_prefs(self):
        return self.spark.createDataFrame([("d0", True, 0), ("d1", False, 1)],
                                          "name string, enabled boolean, ord int")

    @cached_property
    def v_manifest(self):
        return self.spark.createDataFrame([("d2", 0), ("d0", 1), ("d1", 2), ("d3", 3)],
                                          "label string, ord int")

    @cached_property
    def v_glyph(self):
        """One box per character; even lines are small and sit close above the next."""
        li, ci = F.col("li"), F.col("ci")
        return (self.v_lines
                .select(F.col("doc_id").alias("page_id"), F.col("line_no").alias("li"),
                        F.posexplode(F.split("line", "")).alias("ci", "ch"))
                .where(F.col("ch") != "")
                .select("page_id", "li", "ci", "ch",
                        (ci * 10 + F.col("page_id") % 3).alias("x"),
                        (li * 24 + F.when(li % 2 == 0, 12).otherwise(0)).alias("y"),
                        F.lit(10).alias("w"),
                        F.when(li % 2 == 0, 9).otherwise(20).alias("h")))

    def passes(self, number):
        """Noisy reads of every page; ``number`` tells of each glyph in which passes it is."""
        g = self.v_glyph.withColumn("pass", number)
        noisy = (F.col("page_id") + F.col("li") * 7 + F.col("ci") * 3 + F.col("pass") * 5) % 11 == 0
        return g.select("page_id", "pass", "li", "ci",
                        F.when(noisy, "#").otherwise(F.col("ch")).alias("ch"),
                        (F.col("x") + F.col("pass")).alias("x"), "y", "w", "h")

    @cached_property
    def v_pass(self):
        """Three noisy reads of every page."""
        return self.passes(F.explode(F.sequence(F.lit(0), F.lit(2))))

    @cached_property
    def v_read(self):
        """The three reads with characters left out, put in between, and lines that moved."""
        ci, n = F.col("ci"), F.col("pass")
        r = self.v_pass.where((n == 0) | ((F.col("page_id") + F.col("li") * 3 + ci * 5 + n * 7) % 13 != 0))
        moved = r.select("page_id", "pass", "li", F.when((n == 1) & (ci > 4), ci + 1).otherwise(ci).alias("ci"), "ch", "x",
                         F.when((n == 2) & (F.col("li") % 7 == 3), F.col("y") + 40).otherwise(F.col("y")).alias("y"), "w", "h")
        # The pass that is added to is spelled out alone.
        return moved.unionByName(self.passes(F.lit(1)).where((ci == 4) & ((F.col("page_id") + F.col("li") * 3 + ci * 5 + n * 7) % 13 != 0)).select(
            "page_id", "pass", "li", F.lit(5).alias("ci"), F.lit("+").alias("ch"), (F.col("x") + 5).alias("x"), "y", "w", "h"))

    @cached_property
    def v_line_geom(self):
        return self.v_glyph.groupBy("page_id", "li").agg(
            F.count("*").alias("n"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"),
            F.min("y").alias("y0"), F.max(F.col("y") + F.col("h")).alias("y1"), F.max("h").alias("hh"))

    @cached_property
    def v_rect(self):
        k = F.col("o_orderkey")
        return self.orders.select(
            F.col("o_custkey").alias("snap"), k.alias("rect_id"), k.alias("z"),
            F.when(k % 5 == 0, 1).otherwise(0).alias("layer"),
            ((k % 20) / F.lit(20.0)).alias("alpha"),
            (k * 37 % 1400).alias("x"), (k * 53 % 800).alias("y"),
            (k * 17 % 500 + 100).alias("w"), (k * 29 % 400 + 100).alias("h"))

    @cached_property
    def v_points(self):
        """One point per (order, line number), in its order's snapshot."""
        ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
        lines = self.lineitem.select("l_orderkey", "l_linenumber").repartition("l_orderkey").distinct()  # one shuffle for both steps
        return (lines.join(self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
                .select(F.col("o_custkey").alias("snap"), (ok * 10 + ln).alias("pt_id"),
                        ((ok * 13 + ln * 101) % 1600).alias("px"), ((ok * 7 + ln * 59) % 1000).alias("py")))

    @cached_property
    def v_cer(self):
        """Every line of every turn as truth, with a damaged copy of every third."""
        ascii_line = F.regexp_replace("line", "[^ -~]", "?")
        t = self.v_turn_lines.select(
            F.col("role").alias("category"),
            F.concat_ws("-", "conv_id", "turn", "line_no").alias("name"),
            ((F.col("conv_id") + F.col("turn") + F.col("line_no")) % 3).alias("k"),
            ascii_line.alias("truth"))
        damaged = F.expr("concat(substring(truth, 1, 20), '#', substring(truth, 24))")
        return t.select("category", "name", "truth",
                        F.when(F.col("k") == 0, damaged).otherwise(F.col("truth")).alias("hyp"))

    @cached_property
    def v_profile(self):
        minute = F.floor(F.col("us") / 60_000_000) % 1440
        return (self.v_events.groupBy(F.col("event_type").alias("page"), minute.cast("bigint").alias("pos"))
                .agg(F.count("*").alias("n")))


class PagedTables(Tables):
    """The same views with documents dealt by page before their text is spelled out.

    A page is one input cell, so all its lines and glyphs fit one task, and what joins or groups them by page and more needs no
    further shuffle. A character becomes a row of some hundred bytes, often one per pass: only the text travels, in small parts.
    """

    #: Parts per shuffle partition; each is sorted in memory as glyphs.
    PARTS = 4

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(by_key(spark), sf_dir)

    def deal(self, df: DataFrame, key: str) -> DataFrame:
        return df.repartition(self.PARTS * int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)

    @cached_property
    def v_tokens(self):
        return self.deal(self.documents.select("doc_id", "lang", "text"), "doc_id").select(
            "doc_id", "lang", F.posexplode(words_of("text")).alias("pos", "word"))

    @cached_property
    def v_lines(self):
        return self.deal(self.documents.select("doc_id", "text"), "doc_id").select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


VIEWS = {
    "v_events": "select event_id, epoch_us(ts) as us, user_id, event_type, value, props from events",
    "v_lines": "select doc_id, unnest(range(len(l)))::int as line_no, unnest(l) as line from "
               "(select doc_id, string_split(text, chr(10)) l from documents)",
    "v_turn_lines": "select conv_id, turn, role, unnest(range(len(l)))::int as line_no, unnest(l) as line from "
                    "(select conv_id, turn, role, string_split(text, chr(10)) l from conversations)",
    "v_tokens": "select doc_id, lang, unnest(range(len(l)))::int as pos, unnest(l) as word from (select doc_id, lang, "
                f"list_filter(string_split_regex(lower(text), '{WORD_BREAK}'), lambda w: w <> '') l from documents)",
    "v_word": "select word, count(*) as score, min(item_id) as pos from (select item_id, unnest(list_filter("
              f"string_split_regex(lower(text), '{WORD_BREAK}'), lambda w: w <> '')) as word "
              "from benchmark) group by word",
    "v_dict": "select word as key, substring(word,1,3) as reading, word as gloss_key, score, "
              "concat('d', length(word) % 3) as dict, pos from v_word union all "
              "select substring(word,1,3), substring(word,1,3), word, score, concat('d', length(word) % 3), pos "
              "from v_word where length(word) > 3",
    "v_gloss": """select word as gloss_key, concat('["', word, '","', substring(word,2), '"]') as gloss_json from v_word""",
    "v_entries": "select d.key, d.pos, d.reading, d.dict, d.score, d.gloss_key, g.gloss_json "
                 "from v_dict d join v_gloss g on d.gloss_key = g.gloss_key",
    "v_query": "select conv_id, turn, i::int as pos, substring(text, i+1, 12) as q from (select conv_id, turn, text, "
               "unnest(range(length(text))) as i from (select conv_id, turn, lower(text) as text from conversations))",
    "v_prefix": "select conv_id, turn, pos, n::int as len, substring(q,1,n) as surface from (select conv_id, turn, pos, q, "
                "unnest(range(1, least(12, length(q))+1)) as n from v_query)",
    "v_freq_raw": "select word as term, lang as source, doc_id as value from v_tokens",
    "v_freq": "select term, source, min(value) as value from v_freq_raw group by term, source",
    "v_pitch": "select distinct key as term, reading, (length(key) % 4)::int as position from v_dict",
    "v_char": "select distinct substring(word,1,1) as char, concat('on', length(word) % 2) as on_yomi, "
              "'' as kun_yomi, [substring(word,1,2)] as meanings, concat('d', length(word) % 3) as dict from v_word",
    "v_prefs": "select * from (values ('d0', true, 0), ('d1', false, 1)) t(name, enabled, ord)",
    "v_manifest": "select * from (values ('d2', 0), ('d0', 1), ('d1', 2), ('d3', 3)) t(label, ord)",
    "v_glyph": "select doc_id as page_id, line_no as li, ci::int as ci, ch, ci*10 + doc_id % 3 as x, "
               "(line_no*24 + case when line_no % 2 = 0 then 12 else 0 end)::int as y, 10 as w, "
               "case when line_no % 2 = 0 then 9 else 20 end as h from (select doc_id, line_no, "
               "unnest(range(len(l))) as ci, unnest(l) as ch from (select doc_id, line_no, "
               "string_split(line, '') l from v_lines where line <> ''))",
    "v_pass": "select g.page_id, p.pass::int as pass, g.li, g.ci, case when (g.page_id + g.li*7 + g.ci*3 + p.pass*5) % 11 = 0 "
              "then '#' else g.ch end as ch, g.x + p.pass as x, g.y, g.w, g.h from v_glyph g "
              "cross join (select range as pass from range(3)) p",
    "v_read": "with r as (select * from v_pass where pass = 0 or (page_id + li*3 + ci*5 + pass*7) % 13 <> 0) "
              "select page_id, pass, li, case when pass = 1 and ci > 4 then ci + 1 else ci end as ci, ch, x, "
              "case when pass = 2 and li % 7 = 3 then y + 40 else y end as y, w, h from r union all "
              "select page_id, pass, li, 5, '+', x + 5, y, w, h from r where pass = 1 and ci = 4",
    "v_line_geom": "select page_id, li, count(*) as n, min(x) as x0, max(x+w) as x1, min(y) as y0, max(y+h) as y1, "
                   "max(h) as hh from v_glyph group by page_id, li",
    "v_rect": "select o_custkey as snap, o_orderkey as rect_id, o_orderkey as z, "
              "case when o_orderkey % 5 = 0 then 1 else 0 end as layer, (o_orderkey % 20) / 20.0::DOUBLE as alpha, "
              "(o_orderkey*37) % 1400 as x, (o_orderkey*53) % 800 as y, 100 + (o_orderkey*17) % 500 as w, "
              "100 + (o_orderkey*29) % 400 as h from orders",
    "v_points": "select o_custkey as snap, l_orderkey * 10 + l_linenumber as pt_id, "
                "(l_orderkey*13 + l_linenumber*101) % 1600 as px, (l_orderkey*7 + l_linenumber*59) % 1000 as py "
                "from (select distinct l_orderkey, l_linenumber from lineitem) join orders on o_orderkey = l_orderkey",
    "v_cer": "select category, name, truth, case when k = 0 then concat(substring(truth,1,20), '#', "
             "substring(truth,24)) else truth end as hyp from (select role as category, "
             "concat_ws('-', conv_id, turn, line_no) as name, (conv_id + turn + line_no) % 3 as k, "
             "regexp_replace(line, '[^ -~]', '?', 'g') as truth from v_turn_lines)",
    "v_profile": "select event_type as page, (us // 60000000) % 1440 as pos, count(*) as n from v_events group by 1, 2",
}


def _needed(text: str, found: list[str]) -> None:
    for name in VIEWS:
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)


def with_views(sql: str, recursive: bool = False) -> str:
    """``sql`` with the views it names in front as CTEs."""
    used: list[str] = []
    _needed(sql, used)
    ctes = [f"{name} as ({VIEWS[name]})" for name in used]
    body = sql.strip()
    lead = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    if lead:
        recursive = recursive or bool(lead.group(1))
        if not ctes:
            return body
        body = body[lead.end():]
        sep = ",\n"
    else:
        sep = "\n"
    if not ctes:
        return body
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(ctes) + sep + body
