"""Every query of the catalog next to its SQL, and Japanese text where the given tables have none."""

import time

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from glyphlake import catalog
from glyphlake.catalog import views
from glyphlake.functions import gloss, text
from glyphlake.functions.inflection import Rule, base_forms, inflected, japanese_rules
from glyphlake.operators import lookup
from glyphlake.operators.reports import unique_probes
from glyphlake.ordered import Ordered

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    rows, bad = compare(spark, duck, SF, catalog.queries()[name], SQL.get(name))
    assert not bad and rows


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_fold(spark):
    assert one(spark, text.nfkc("x"), "ｶﾞ①Ａ　㍻") == "ガ1A 平成"


def test_kana_fraction(spark):
    assert one(spark, text.kana_fraction("x"), "漢字かな") == 0.5
    assert one(spark, text.kana_fraction("x"), "abc") == 0.0


def test_morae(spark):
    assert one(spark, text.morae("x"), "きょうしゃ") == ["きょ", "う", "しゃ"]


@pytest.mark.parametrize("line,kind", [
    ("［意味］", "head"), ("　［意味］", "head"), ("「例文です。」", "ex"), ("a｜b｜c", "row"), ("①意味", "numbered"),
    ("読み方：ようき", "label"), ("　読み方：ようき", "label"), ("ただの文", "")])
def test_lines(spark, line, kind):
    assert one(spark, text.classify_line("x"), line) == kind


def test_nodes(spark):
    tree = '{"type":"structured-content","content":{"tag":"ruby","content":["漢",{"tag":"rt","content":"かん"}]}}'
    rows = spark.createDataFrame([("a", tree), ("b", None), ("c", "not json"), ("d", '["x","y"]')], "gloss_key string, gloss_json string")
    got = {r.gloss_key: r.text for r in gloss.gloss_text(rows).collect()}
    assert got["a"] == "漢" and got["c"] == "not json" and got["d"] == "xy" and not got["b"]
    deep = "[" * 400 + '"x"' + "]" * 400
    assert gloss.gloss_text(spark.createDataFrame([("e", deep)], "gloss_key string, gloss_json string")).first().text == "x"


@pytest.mark.parametrize("word,base", [
    ("食べられなかった", "食べる"), ("行った", "行く"), ("しろ", "する"), ("しよう", "する"), ("来い", "来る"), ("書きなさい", "書く"),
    ("よかった", "いい"), ("飲んじゃった", "飲む"), ("書かなければ", "書く"), ("高くない", "高い"), ("読んでいました", "読む"), ("話せます", "話す")])
def test_base_forms(spark, word, base):
    got = base_forms(spark.createDataFrame([(word,)], "surface string"), japanese_rules())
    assert base in {r.form for r in got.collect()}


def test_inflected_is_the_other_side(spark):
    """What a dictionary is inflected to is what undoing the rules finds in the surfaces."""
    rules = [Rule("た", "る", "", "v1", "past"), Rule("た", "い", "past", "adj", "past"), Rule("くな", "い", "adj", "adj", ""),
             Rule("よ", "いい", "adj", "adj", ""), Rule("られる", "る", "v1", "v1", "passive"), Rule("ない", "る", "adj", "v1", "negative"),
             Rule("て", "る", "te", "v1", "te"), Rule("ちゃう", "て", "", "te", "contraction")]
    words = ["食べる", "いい", "高い", "る", ""]
    found = inflected(spark.createDataFrame([(w,) for w in words], "form string"), rules, 6, {"te"}).collect()
    undone = base_forms(spark.createDataFrame([(r.surface,) for r in found] + [("食べて",), ("x",)], "surface string"), rules, {"te"})
    want = undone.where(F.col("form").isin(*words)).groupBy("surface", "form").agg(F.min("steps").alias("steps")).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in want} and len(found) > 10
    assert {("食べられた", "食べる", 2), ("食べちゃう", "食べる", 2), ("よ", "いい", 0)} <= {tuple(r) for r in found}


def test_silent_steps_do_not_count(spark):
    got = base_forms(spark.createDataFrame([("書かなければ",)], "surface string"), japanese_rules())
    assert got.where("form = '書く'").agg(F.min("steps")).first()[0] == 2


@pytest.mark.parametrize("bounded", [True, False])
def test_ordered(spark, bounded):
    rows = [(i % 3 if i % 7 else 0, i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(5)
    got = Ordered(df, ["k"], ["o"], bounded=bounded).scan(number="n", lag={"before": "v"}, lead={"after": "v"},
                                                          run={"total": ("sum", "v"), "top": ("max", "v")}).df.collect()
    want = {}
    for k in range(3):
        own, total, top = sorted(r for r in rows if r[0] == k), 0, -1
        for n, (_, o, v) in enumerate(own):
            total, top = total + v, max(top, v)
            want[k, o] = (n + 1, own[n - 1][2] if n else None, own[n + 1][2] if n + 1 < len(own) else None, total, top)
    assert {(r.k, r.o): (r.n, r.before, r.after, r.total, r.top) for r in got} == want


@pytest.mark.parametrize("name", ["a08_line_geometry", "a09_word_boxes", "a11_picket_fence", "a18_placement_report", "c03_vote",
                                  "j17_map_strip", "j20_match_glyphs", "s10_assemble_payload", "w17_layout_shift"])
def test_glyphs_stay_with_their_page(spark, name):
    """Only the text of documents is shuffled, never the glyphs it is spelled out into."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Word boxes are gathered by match once more: a row per line.
    assert "REPARTITION_BY_NUM" in plan and plan.count("ENSURE_REQUIREMENTS") == (name == "a09_word_boxes") and "ExistingRDD" not in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_not_sent_out(spark):
    """spans of a small text are never the side that is broadcast, the dictionary is as long as it is small."""
    text_ = spark.createDataFrame([("abc" * 50,)], "t string").select(F.explode(F.split("t", "")).alias("surface"))
    known = spark.createDataFrame([("a", 1), ("a", 2), ("x", 3)], "surface string, n int")
    assert lookup.probe_spans(text_, known, "surface").count() == 100
    plan = plan_of(lookup.probe_spans(text_, known, "surface"))
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert "BuildLeft" not in plan_of(catalog.queries()["c02_annotate"](spark, SF))


def test_prefix_counts(spark):
    """the prefixes of a key are counted from its sorted queries."""
    words = [("a", w) for w in ("ab", "abc", "abd", "b", "ab", "é", "漢字かな")] + [("b", "x")]
    got = {(r.k, r.len): (r.n, r.n_distinct, r.last) for r in lookup.prefix_counts(
        spark.createDataFrame(words, "k string, q string"), ["k"], "q", 3).collect()}
    want = {}
    for k, n in [(k, n) for k in "ab" for n in (1, 2, 3)]:
        own = [w[:n] for x, w in words if x == k and len(w) >= n]
        if own:
            want[k, n] = (len(own), len(set(own)), max(own))
    assert got == want
    plan = plan_of(catalog.queries()["f04_prefixes"](spark, SF))
    assert "surface" not in plan  # a query's position is a row, its prefixes are not


def test_positions_of_long_texts(spark, tmp_path):
    """blocks of a text meet at their borders, also with line ends and characters of two code units."""
    texts = ["".join(chr(0x61 + i % 26) if i % 9 else "\n" if i % 2 else "😀" for i in range(n)) for n in (1, 63, 64, 65, 76, 200)]
    spark.createDataFrame([(i, 0, "user", s) for i, s in enumerate([*texts, "", None])], "conv_id bigint, turn int, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    t = views.Tables(spark, str(tmp_path))
    got = {(r.conv_id, r.pos): r.q for r in t.v_query.collect()}
    assert got == {(i, p): s[p:p + 12] for i, s in enumerate(texts) for p in range(len(s))}
    assert "transform" not in plan_of(t.v_query.select(F.inline(text.prefixes("q"))))


def test_fallback_joins_no_positions(spark):
    """queries without a match are found by the table of words; positions are not shuffled."""
    plan = plan_of(catalog.queries()["j05_char_fallback"](spark, SF))
    assert not [x for x in plan.splitlines() if "ENSURE_REQUIREMENTS" in x and "pos#" in x]


def test_marks_stay_with_their_screen(spark):
    """marks are dealt by screen once; cells, distinct marks and what is left are found in place."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.queries()["j13_unexplained_cells"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not [x for x in plan.splitlines() if "ENSURE_REQUIREMENTS" in x and ("pt_id" in x or "_c0" in x)]


@pytest.mark.parametrize("name", ["k07_order_candidates", "w13_attach_labels"])
def test_words_and_lines_stay_with_their_text(spark, name):
    """only texts are shuffled, not their words or lines, and nothing is written on the way."""
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan and "ExistingRDD" not in plan


def test_edit_distance_of_equal_near_and_far_texts(spark):
    """the exact distance, in linear time for long texts that are equal."""
    long = "".join(chr(0x61 + i * i % 23) for i in range(60_000))
    pairs = [("", ""), ("", "x" * 40), ("abc", "acb"), ("a" * 30, "b" * 17), ("a" * 16, "b" * 16), ("é漢", "e漢"), (None, "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate([*pairs, (long, long), (long[:900], long[:20] + "#" + long[24:900])])], "i int, a string, b string")
    began = time.monotonic()
    got = [r.d for r in df.select("i", text.edit_distance("a", "b").alias("d")).orderBy("i").collect()]
    assert got == [0, 40, 2, 30, 16, 1, None, 0, 4]
    assert time.monotonic() - began < 20


def test_probes_in_a_long_text(spark):
    """Windows of a text are cut in time proportional to its length."""
    text = "".join(chr(0xe0 + i * i % 31) for i in range(60_000))
    rows = spark.createDataFrame([(1, 0, "xyzxyz"), (1, 1, "a" + text)], "page int, id int, t string")
    began = time.monotonic()
    assert {r.id for r in unique_probes(rows, "id", "t", 6, ["page"]).collect()} == {0, 1}
    assert time.monotonic() - began < 20


def test_words_are_dealt(spark):
    """A file of one group of rows is no bound on the tasks that split its texts."""
    assert spark.read.parquet(f"{SF}/documents.parquet").rdd.getNumPartitions() < 7
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert views.Tables(spark, SF).v_tokens.rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_words_of(spark):
    rows = spark.createDataFrame([(None,), ("",), (" 1-Été,\nÀ b_c ",), ("..",), ("one",)], "t string")
    assert [r.w for r in rows.select(views.words_of("t").alias("w")).collect()] == [None, [], ["été", "à", "b", "c"], [], ["one"]]


def test_fallback_sends_characters(spark):
    """the table of characters is sent to the positions, never the positions by way of the driver."""
    assert "BuildLeft" not in plan_of(catalog.queries()["j05_char_fallback"](spark, SF))
