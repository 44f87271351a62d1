"""Operators that SQL does not say, next to plain Python, and odd inputs of the others."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake import catalog
from glyphlake.chains import chain
from glyphlake.functions import places
from glyphlake.functions.text import class_fraction
from glyphlake.operators import anchors, corpus, pages, preferences, reports, settings, votes
from glyphlake.session import scratch_path
from glyphlake.sources import html, messages, records
from glyphlake.spatial import overlap_join


def test_match_glyphs(spark):
    truth = [(i % 2, "ab"[i % 3 % 2], i, float(i * 13 % 170), float(i * 29 % 150), 10, 9 + i % 20) for i in range(120)]
    got = [(p, c, i, x + (i % 5) * 6 - 9, y + (i % 4) * 7 - 8, w, h) for p, c, i, x, y, w, h in truth if i % 6]
    got = [g for g in got if (g[0], g[1]) != (1, "b")]
    cols = "page int, ch string, id int, x double, y double, w int, h int"
    rows = pages.match_glyphs(spark.createDataFrame(truth, cols), spark.createDataFrame(got, cols), ["page"], "ch", ["id"]).collect()
    want = {}
    for p, c, i, x, y, w, h in truth:
        tol = max(12, w * 0.7, h * 0.7)
        near = [(abs(g[3] - x) + abs(g[4] - y), not (abs(g[3] - x) <= tol and abs(g[4] - y) <= tol)) for g in got if g[:2] == (p, c)]
        want[i] = (bool(near), bool(near) and not min(near)[1])
    assert {r.id: (r.matched, r.placed) for r in rows} == want
    assert {m for m, _ in want.values()} == {p for _, p in want.values()} == {True, False}


def test_overlap_join(spark):
    a = [(i % 3, i, i * 37 % 400, i * 37 % 400 + i * 11 % 90) for i in range(80)] + [(0, 99, 0, 5000)]
    b = [(i % 3, i, i * 53 % 400, i * 53 % 400 + i * 7 % 300) for i in range(60)]
    met = overlap_join(spark.createDataFrame(a, "k int, i int, a0 int, a1 int"), spark.createDataFrame(b, "k int, j int, b0 int, b1 int"),
                       ["k"], [("a0", "a1", "b0", "b1")]).select("i", "j").collect()
    want = sorted((x[1], y[1]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r.i, r.j) for r in met) == want


def test_segment_takes_matches_with_their_length(spark):
    """the taken matches keep their lengths and are not joined with all matches again."""
    hits = spark.createDataFrame([(1, 0, 2), (1, 0, 3), (1, 1, 9), (1, 3, 1), (1, 4, 2), (2, 5, 1)], "k int, pos int, len int")
    got = corpus.segment(hits, ["k"], "pos", "len")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3), (1, 3, 1), (1, 4, 2), (2, 5, 1)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_visible_fraction_counts_sample_points(spark):
    """Hidden points are bits of one row a window, equal to counting the points."""
    rects = [(i % 4, i, i, 0 if i % 5 else 1, (i % 7) / 6, i * 137 % 900 - 50, i * 211 % 700, 60 + i * 53 % 500, 40 + i * 29 % 450) for i in range(60)]
    displays = [(0, 0, 800, 500), (700, 100, 400, 600)]
    df = spark.createDataFrame(rects, "snap int, rect_id int, z int, layer int, alpha double, x int, y int, w int, h int")
    found = pages.visible_fraction(df, ["snap"], "rect_id", "z", displays)
    plan = found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for s, r, z, _, _, x, y, w, h in rects:
        front = [o for o in rects if o[0] == s and o[2] < z and o[3] == 0 and o[4] > 0.05
                 and min(x + w, o[5] + o[7]) - max(x, o[5]) > 1 and min(y + h, o[6] + o[8]) - max(y, o[6]) > 1]
        points = [(x + (i + 0.5) * w / 20, y + (j + 0.5) * h / 20) for i in range(20) for j in range(20)]
        want[r] = sum(any(a <= px < a + c and b <= py < b + d for a, b, c, d in displays)
                      and not any(o[5] <= px < o[5] + o[7] and o[6] <= py < o[6] + o[8] for o in front) for px, py in points) / 400
    assert {r.rect_id: r.visible for r in found.collect()} == want and 0 < sum(want.values()) < 60
    # Only the cells of the grid are spelled out.
    assert all("_c" in line for line in plan.splitlines() if "Generate explode" in line)


def test_html_paragraphs(spark):
    page = ("<style>p{}</style><script>'<p>no'</script>out<p>甲<ruby>漢<rp>(</rp><rt>かん</rt><rp>)</rp>字</ruby>乙<br>二&amp;<b>三</b></p>"
            "between<P class=x>四<img src=a></P><p></p><p><ruby>五</ruby>六")
    rows = html.html_paragraphs(spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, h string"), "id", "h").collect()
    got = {(r.id, r.para_no): [(s.text, s.ruby) for s in r.segments] for r in rows}
    assert got == {(1, 0): [("甲", None), ("漢", "かん"), ("字", None), ("乙", None)], (1, 1): [("二&三", None)], (1, 4): [("五六", None)]}


def test_wrap_groups(spark):
    parts = [("あいう", None), ("漢字", "かんじ"), ("え", None), ("一二三四五六", "x"), ("お", None)]
    df = spark.createDataFrame([(parts,), (None,)], "s array<struct<text string, ruby string>>")
    units = df.where("s is not null").select(corpus.wrap_groups("s", 4).alias("u")).first().u
    lines = ["".join(u.text for u in group) for _, group in itertools.groupby(units, lambda u: u.line)]
    assert lines == ["あいう", "漢字え一", "二三四五", "六お"]
    assert [u.ruby for u in units if u.ruby] == ["かんじ"]


def test_wrap_takes_segments(spark):
    """Python sees a row's segments, not its characters, and units stand where they stood one by one."""
    rng = random.Random(5)
    rows = [([("x" * rng.randint(0, 11), rng.choice([None, "", "r"])) for _ in range(rng.randint(0, 6))],) for _ in range(60)]
    df = spark.createDataFrame(rows, "s array<struct<text string, ruby string>>")
    places = corpus.folds.wrap(F.expr("transform(s, x -> length(x.text))"), F.expr("transform(s, x -> length(x.text) <= 4 and coalesce(x.ruby, '') <> '')"), 4)
    for segments, units, starts in df.select("s", corpus.wrap_groups("s", 4), places).collect():
        sizes = [n for t, r in segments for n in ([len(t)] if r and len(t) <= 4 else [1] * len(t))]
        line, used, want = 0, 0, []
        for n in sizes:
            if used + n > 4 and used:
                line, used = line + 1, 0
            want.append(line)
            used += n
        assert [u.line for u in units] == want and len(starts) == len(segments)


def test_truth_is_set_once_for_all_renderings(spark):
    page = "<p>" + "Some words of a page that go on for quite a while. " * 8 + "</p>"
    pages = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    truth = corpus.truth_corpus(pages, "page_id", "html", "a-z", ".!?", '")', 8, 3, 20)
    plan = truth._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(") < plan.index(" AS _u#")  # set below the renderings
    rows = truth.collect()
    assert {r.repeat for r in rows} == {0, 1, 2} and all(max(map(len, r.body.split("\n"))) <= 20 for r in rows)
    assert len({r.body for r in rows}) * 3 == len(rows)


def test_cells_from_runs(spark):
    runs = [("a", 0, 2), ("a", 5, 9), ("a", 12, 31), ("a", 40, 43), ("b", 3, 3)]
    rows = corpus.cells_from_runs(spark.createDataFrame(runs, "k string, start int, end int"), ["k"], 10.0).collect()
    got = {(r.k, r.cell): (r.top, r.height) for r in rows}
    # Two strokes of one glyph, a run of two glyphs, and small ones that grow.
    assert got == {("a", 0): (0.0, 10.0), ("a", 1): (12.0, 10.0), ("a", 2): (22.0, 10.0),
                   ("a", 3): (37.5, 9.0), ("b", 0): (-1.0, 9.0)}


def test_truth_corpus(spark):
    page = "<p>" + "</p><p>".join(["日本語の文章です。これは二つ目の文です！" * 3, "short", "かな。" * 20]) + "</p>"
    rows = corpus.truth_corpus(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h", "ぁ-んァ-ヶ一-龠", "。！？", "」。！？", 8, 2, 20).collect()
    text = "日本語の文章です。これは二つ目の文です！" * 3 + "かな。" * 20
    want, cur, targets = [], "", itertools.cycle((60, 90, 120, 160, 200))
    goal = next(targets)
    for s in [p + "。" if not p.endswith("！") else p for p in text.replace("！", "！。").split("。") if p]:
        cur += s
        if len(cur) >= goal:
            want, cur, goal = [*want, cur], "", next(targets)
    want += [cur] if len(cur) >= 40 else []
    bodies = {r.passage: r.body for r in rows}
    assert len(rows) == 2 * len(want)
    assert [bodies[p].replace("\n", "") for p in sorted(bodies)] == want
    assert all(len(line) <= 20 for b in bodies.values() for line in b.split("\n"))


def test_truth_files(spark):
    """Readings stay with their words: whole on a line, outside the body, and back from the files."""
    ruby = "<ruby>漢字<rt>かん。じ</rt></ruby>"
    page = f"<p>{'日本語の文章' * 3}の{ruby}です。{ruby}だ！</p><p>{'これは二つ目の文' * 4}です。「{ruby}」。</p><p>{'#ruby:' + 'かな' * 30}。</p>"
    rows = corpus.truth_corpus(spark.createDataFrame([(7, page), (8, None), (9, "<p>短い</p>")], "id int, h string"), "id", "h",
                               "ぁ-んァ-ヶ一-龠", "。！？", "」。！？", 8, 3, 20)
    path = scratch_path(spark, "truth")
    corpus.write_truth(rows, "id", path)
    back = corpus.read_truth(spark, "id", "int", path)
    assert back.columns == rows.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    first = {r.passage: r for r in back.where("repeat = 0").collect()}
    assert sum(len(r.ruby) for r in first.values()) == 3 and {x for r in first.values() for x in r.ruby} == {"かん。じ"}
    text = "".join(first[p].body.replace("\n", "") for p in sorted(first))
    assert text == "日本語の文章" * 3 + "の漢字です。漢字だ！" + "これは二つ目の文" * 4 + "です。「漢字」。" + "#ruby:" + "かな" * 30 + "。"
    assert first[0].body.split("\n")[0] == "日本語の文章" * 3 + "の" and all(len(x) <= 20 for r in first.values() for x in r.body.split("\n"))


def test_sample_and_what_it_lacks(spark):
    names = [(c, f"{c}{i}") for c in "ab" for i in range(6)]
    truth = [(n, "" if i % 5 == 4 else "abcd") for i, (_, n) in enumerate(names) if i % 5 != 3]
    hyps = [(n, "abcx") for i, (_, n) in enumerate(names) if i % 5 != 1]
    df = spark.createDataFrame
    report, lacking = corpus.evaluate_sample(df(names, "category string, name string"), df(truth, "name string, truth string"),
                                             df(hyps, "name string, hyp string"), 6, "s", 1)
    reasons = {3: "no truth", 4: "empty truth", 1: "no hypothesis"}
    assert {r.name: r.reason for r in lacking.collect()} == {n: reasons[i % 5] for i, (_, n) in enumerate(names) if i % 5 in reasons}
    assert {r.category: (r.n, r.dist, r.micro) for r in report.collect()} == {"ALL": (5, 5, 0.25), "a": (3, 3, 0.25), "b": (2, 2, 0.25)}
    assert corpus.evaluate_sample(df(names, "category string, name string"), df(truth, "name string, truth string"),
                                  df(hyps, "name string, hyp string"), 2, "s", 1)[0].where("category = 'ALL'").first().n <= 4


def test_records_of_odd_archives(spark):
    bank = '[["食べる","たべる","","",5,["eat"]],["x"],"no",null,["","","","",null,null],["か","か","","",null,"g"]]'
    rows = spark.createDataFrame([(bank,), ("{}",), (None,), ("broken [",)], "payload string")
    terms = records.load_terms(records.bank_records(rows, "payload", 6), F.lit("L")).collect()
    assert sorted((r.key, r.reading, r.score, r.gloss_json) for r in terms) == [
        ("か", "か", 0, "g"), ("たべる", "たべる", 5, '["eat"]'), ("食べる", "たべる", 5, '["eat"]')]


def test_settings(spark):
    current = {"modifier": "option", "mode": "hold", "hoverDelayMs": 300, "engine": "vision", "interval": 2, "passes": 3, "everyN": 5}
    texts = ['{"target":{"bundle":123,"windowId":"abc"}}', '{"target":{"bundle":"a.b","windowId":42,"label":"K"},"new":{"x":[1]}}',
             '{"trigger":{"modifier":"evil","mode":"nonsense","hoverDelayMs":99999}}', '{"trigger":{"modifier":"shift","mode":"hover","hoverDelayMs":50}}',
             '{"engine":"rm","interval":-5,"voting":{"passes":"a","everyN":0}}', '{"engine":"auto","interval":0.1,"voting":{"passes":9,"everyN":60.0}}',
             '{"dictionaries":[{"name":"J","enabled":"yes"},{"name":"","enabled":true},null,{"enabled":true},{"name":5},"x"]}', '{"dictionaries":7,"images":""}',
             "[1]", "no json", None, "{}"]
    rows = preferences.sanitize_settings(spark.createDataFrame([(t,) for t in texts], "j string"), "j", current).collect()
    s = [r.settings for r in rows]
    assert tuple(s[0].target) == (None, None, "not set") and tuple(s[1].target) == ("a.b", 42, "K") and rows[1].rest == {"new": '{"x":[1]}'}
    assert tuple(s[2].trigger) == ("option", "hold", 300) and tuple(s[3].trigger) == ("shift", "hover", 50)
    assert (s[4].engine, s[4].interval, *s[4].voting) == ("vision", 2, 3, 5) and (s[5].engine, s[5].interval, *s[5].voting) == ("auto", 0.1, 9, 60)
    assert [tuple(d) for d in s[6].dictionaries] == [("J", True)] and s[7].dictionaries is None and rows[7].rest == {"dictionaries": "7"} and s[7].images is False
    assert s[8:11] == [None] * 3 and s[11].target is None and s[11].images is None and rows[11].rest == {}


def test_settings_are_parsed_once(spark):
    current = {"modifier": "option", "mode": "hold", "hoverDelayMs": 300, "engine": "vision", "interval": 2, "passes": 3, "everyN": 5}
    rows = spark.createDataFrame([("{}",)], "j string").where("j is not null")
    plan = preferences.sanitize_settings(rows, "j", current)._jdf.queryExecution().optimizedPlan().toString()
    # One type a path, two of a dictionary's name and switch, and that of the whole for both columns.
    assert plan.count("parseJson") == 1 and plan.count("schemaOfVariant(") <= len(preferences._PATHS) + 4


def test_ndjson(spark):
    lines = spark.createDataFrame([('{"a":1}',), ("",), ("  ",), ('{"a":',), (None,), ('{"a":null}',)], "line string")
    assert {r.a for r in messages.parse_ndjson(lines, "line", "a int").collect()} == {1, None}


def test_gate(spark):
    totals = spark.createDataFrame([(5,)], "n int")
    assert settings.assert_min(totals, n=5).first().n == 5
    with pytest.raises(Exception, match="n is below 6"):
        settings.assert_min(totals, n=6).collect()


def test_repair():
    cells = [(0.0, float(y), 20.0, float(y + 20)) for y in range(0, 120, 24)]
    assert anchors.repair(cells, 5, 20) == cells
    halves = [*cells[:1], (0.0, 24.0, 20.0, 34.0), (0.0, 34.0, 20.0, 44.0), *cells[2:]]
    assert anchors.repair(halves, 5, 20) == cells
    assert anchors.repair(halves, 4, 20) is None  # a second merge would join two glyphs
    long = [*cells[:1], (0.0, 24.0, 20.0, 68.0), *cells[3:]]
    assert anchors.repair(long, 5, 20) == [*cells[:1], (0.0, 24.0, 20.0, 46.0), (0.0, 46.0, 20.0, 68.0), *cells[3:]]
    assert anchors.repair(cells, 6, 20) is None  # the tallest is one glyph
    assert anchors.repair([(0.0, 0.0, 20.0, 200.0)], 5, 20) is None  # three halvings give four
    assert anchors.repair([], 1, 20) is None


def test_reanchor(spark):
    """Two lines share a column; one column is repaired, one keeps its boxes, one line is outside."""
    cells = [(0, 0, 100, y, 20, 20) for y in range(0, 120, 24)]
    cells += [(0, 1, 50, 0, 20, 20), (0, 1, 50, 24, 20, 9), (0, 1, 50, 34, 20, 10), (0, 1, 50, 48, 20, 20)]
    cells += [(0, 2, 0, 0, 20, 20), (0, 2, 0, 24, 20, 20)]
    glyphs = [(0, 0, i, 105, 50 + i * 24, 10, 20) for i in range(3)] + [(0, 1, i, 106, 3 + i * 24, 10, 20) for i in range(2)]
    glyphs += [(0, 2, i, 54, 2 + i * 24, 10, 20) for i in range(3)] + [(0, 3, i, 4, i * 24, 10, 20) for i in range(4)]
    glyphs += [(0, 4, 0, 300, 0, 10, 20), (1, 0, 0, 105, 0, 10, 20)]
    rows = anchors.reanchor(spark.createDataFrame(glyphs, "p int, li int, ci int, x int, y int, w int, h int"),
                            spark.createDataFrame(cells, "p int, col int, x int, y int, w int, h int"), ["p"]).collect()
    got = {(r.p, r.li, r.ci): (r.anchored, r.x, r.y, r.w, r.h) for r in rows}
    assert len(got) == len(glyphs)
    assert [got[0, 1, i] for i in range(2)] + [got[0, 0, i] for i in range(3)] == [("index", 100.0, y, 20.0, 20.0) for y in range(0, 120, 24)]
    assert [got[0, 2, i] for i in range(3)] == [("repair", 50.0, 0.0, 20.0, 20.0), ("repair", 50.0, 24.0, 20.0, 20.0), ("repair", 50.0, 48.0, 20.0, 20.0)]
    for p, li, ci, x, y, w, h in glyphs:
        if (p, li) in ((0, 3), (0, 4), (1, 0)):
            assert got[p, li, ci] == ("kept", x, y, w, h)


def test_vote(spark):
    """By place, not by index: an inserted glyph shifts nothing, a tie keeps the base, what is far does not count."""
    def line(p, text, dx=0, y=0, li=0):
        return [(1, p, li, i, c, 10.0 * i + dx, float(y), 10.0, 10.0) for i, c in enumerate(text) if c != " "]

    reads = line(0, "日木語の本") + line(1, "日本語の本", 2) + line(2, "日本語の本", -2)
    reads += line(0, "今日", li=1, y=40) + line(1, "今目", li=1, y=40) + line(2, "会日", li=1, y=40)
    reads += line(0, "犬", li=2, y=80) + line(1, "太", li=2, y=87) + line(2, "太", li=2, y=86)
    reads += line(0, "上", li=3, y=120) + line(2, "下 ", 60, li=3, y=120) + line(1, "余", 90, li=9, y=200)
    reads = [r for r in reads if r[:4] != (1, 1, 0, 3)] + [(1, 1, 0, 9, "x", 15.0, 0.0, 10.0, 10.0)]
    cols = "page int, pass int, li int, ci int, ch string, x double, y double, w double, h double"
    rows = votes.vote(spark.createDataFrame(reads, cols), ["page"]).collect()
    got = {(r.li, r.ci): (r.ch, r.votes, r.passes) for r in rows}
    assert "".join(got[0, i][0] for i in range(5)) == "日本語の本"
    assert got[0, 1] == ("本", 2, 3) and got[0, 3] == ("の", 2, 3)
    assert got[1, 0] == ("今", 2, 3) and got[1, 1] == ("日", 2, 3)
    assert got[2, 0] == ("犬", 1, 3) and got[3, 0] == ("上", 1, 3)
    assert set(got) == {(0, i) for i in range(5)} | {(1, 0), (1, 1), (2, 0), (3, 0)}
    tie = line(0, "ab") + line(1, "xb") + line(2, "yb") + line(3, "xb") + line(4, "yb")
    rows = votes.voted_lines(votes.vote(spark.createDataFrame(tie, cols), ["page"]), ["page"]).collect()
    assert [(r.text, r.votes, r.conf) for r in rows] == [("xb", 7, 0.7)]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_chain(spark, block):
    rows, want = [], set()
    for key, n in (("a", 1), ("b", 40), ("c", 25), ("d", 7)):
        to = {i: i + 1 + (i * 7 + len(key)) % (n if key == "d" else 5) for i in range(1, n + 1)}
        rows += [(key, i, t) for i, t in to.items()]
        at = 1
        while at in to:
            want.add((key, at))
            at = to[at]
    got = chain(spark.createDataFrame(rows, "k string, n int, t int").repartition(3), ["k"], "n", "t", block).collect()
    assert len(got) == len(want) and {(r.k, r.n) for r in got} == want


def test_groups_of_the_first_band(spark):
    """A and B share rows, B and C do, A and C do not: C opens a group."""
    bands = [(1, 0, 0, 10, "か"), (1, 1, 5, 10, "な"), (1, 2, 12, 10, "漢字"), (1, 3, 13, 2, "か"), (1, 4, 40, 0, ""), (1, 5, 40, 5, "")]
    df = spark.createDataFrame(bands, "k int, id int, y int, h int, text string")
    rows = pages.group_bands(df, ["k"], "id", "text", class_fraction("text", "[ぁ-ん]", "."), 0.7).collect()
    assert sorted((r.grp, r.n, r.text, r.keep) for r in rows) == [(1, 2, "かな", True), (2, 2, "漢字か", False), (3, 1, "", True), (4, 1, "", True)]


def test_latency(spark):
    rows = [("a", v) for v in [5, 1, 9, 9, 2, 100, None]] + [("b", 7), ("c", None)] + [(None, 1), (None, 2)]
    got = {r.k: (r.p50, r.p95) for r in reports.latency(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()}
    assert got["a"][0] == 7.0 and got["a"][1] == pytest.approx(9 + 91 * 0.75)
    assert got["b"] == (7.0, 7.0) and got[None] == (1.5, 1.95) and "c" not in got


def test_near():
    """pairs by bands are those of all with all, also on dense, far and broken places."""
    rng = np.random.default_rng(3)
    x, y = rng.uniform(-50, 900, 700).round(1), rng.uniform(-300, 40, 700).round(1)
    x[:4], y[:4] = [np.nan, 1e9, -1e9, 5], [5, 5, -1e9, np.nan]
    x[10:60], y[10:60] = 7, 7
    group, own = rng.integers(0, 3, 700), rng.integers(0, 4, 200)
    x0, y0 = rng.uniform(-80, 900, 200).round(1), rng.uniform(-320, 50, 200).round(1)
    x0[:2], y0[:2] = [7, np.nan], [7, 0]
    x1, y1 = x0 + rng.choice([-1, 0, 20, 1e10], 200), y0 + rng.choice([0, 20, 300], 200)
    got = sorted((int(a), int(b)) for part in places.near(group, x, y, own, x0, x1, y0, y1, 16.0) for a, b in zip(*part))
    want = [(i, j) for i in range(200) for j in range(700) if own[i] == group[j] and x0[i] <= x[j] <= x1[i] and y0[i] <= y[j] <= y1[i]]
    assert got == want and len(want) > 500
    none = np.zeros(0)
    assert not list(places.near(none.astype(int), none, none, own, x0, x1, y0, y1, 16.0))


def test_matches_of_odd_rows(spark):
    """Rows without a page, a label or a place are not matched but told; equal ids are one glyph."""
    truth = [(1, "a", 0, 0.0, 0.0, 10, 10), (1, "a", 0, 900.0, 0.0, 10, 10), (1, "b", 1, 0.0, 0.0, 10, 10), (1, None, 2, 0.0, 0.0, 10, 10),
             (None, "a", 3, 0.0, 0.0, 10, 10), (1, "a", 4, None, 0.0, 10, 10), (1, "a", None, 0.0, 0.0, 10, 10), (1, "a", 5, 0.0, 0.0, None, None), (2, "a", 6, 0.0, 0.0, 10, 10)]
    got = [(1, "a", 9, 3.0, 0.0, 10, 10), (1, None, 9, 0.0, 0.0, 10, 10), (None, "a", 9, 0.0, 0.0, 10, 10), (1, "b", 9, None, 0.0, 10, 10)]
    cols = "page int, ch string, id int, x double, y double, w int, h int"
    found = pages.match_glyphs(spark.createDataFrame(truth, cols), spark.createDataFrame(got, cols), ["page"], "ch", ["id"])
    assert found.dtypes == [("page", "int"), ("id", "int"), ("matched", "boolean"), ("placed", "boolean")]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [
        (1, 0, True, True), (1, 0, True, True), (1, 1, True, False), (1, 2, False, False), (None, 3, False, False), (1, 4, True, False),
        (1, None, True, False), (1, 5, True, True), (2, 6, False, False)]))


@pytest.mark.parametrize("name", ["a18_placement_report", "j20_match_glyphs"])
def test_matches_are_not_joined(spark, name):
    """a glyph is one row from its page's text on, never one for each cell and level that it may be met in."""
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "sequence" not in plan


def test_vote_over_first_passes(spark):
    """the votes over 1, 2, .. passes of a page are those of these passes alone; a pass without glyphs may come first."""
    rng, cols = random.Random(5), "page int, pass int, li int, ci int, ch string, x double, y double, w double, h double"
    reads = [(p, k, i // 9, i % 9, rng.choice("abc"), 11.0 * (i % 9) + rng.randint(-6, 6), 25.0 * (i // 9) + rng.randint(-3, 3), 10.0, 20.0)
             for p in (1, 2) for k in (p - 1, p, p + 1) for i in range(40) if rng.random() > 0.2]
    reads += [(2, 1, 0, 0, None, 0.0, 0.0, 10.0, 20.0), (2, 2, 0, 0, "a", None, 0.0, 10.0, 20.0), (None, 0, 0, 0, "a", 0.0, 0.0, 1.0, 1.0)]
    names = ["page", "li", "ci", "ch", "votes", "passes", "conf"]
    grown = votes.vote(spark.createDataFrame(reads, cols), ["page"], grown=True).collect()
    for n in range(1, 5):
        alone = votes.vote(spark.createDataFrame([r for r in reads if r[1] < n <= (r[0] or 0) + 2], cols), ["page"]).select(*names).collect()
        assert sorted(map(repr, (tuple(r[c] for c in names) for r in grown if r.vote == n))) == sorted(map(repr, map(tuple, alone)))
    assert {(r.page, r.vote) for r in grown} == {(1, n) for n in (1, 2, 3)} | {(2, n) for n in (2, 3, 4)}


def test_votes_are_not_joined(spark):
    """the readings of a page are met where they are, not joined by cell."""
    plan = catalog.queries()["c03_vote"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_reanchor_of_odd_rows(spark):
    """other columns travel along, glyphs that come twice take each other's boxes too, and what has no place keeps its box."""
    cells = [(0, 0, 100, y, 20, 20) for y in (0, 24, 48)] + [(0, None, 300, 0, 20, 20), (None, 0, 100, 0, 20, 20), (0, 5, 900, 0, 20, 20)]
    glyphs = [(0, 0, 0, 105, 0, 10, 20, "a"), (0, 0, 0, 105, 0, 10, 20, "b"), (0, 0, 1, 105, 24, 10, 20, None), (0, 1, 0, 305, 0, 10, 20, "c"),
              (None, 0, 0, 105, 0, 10, 20, "d"), (0, None, 0, 105, 0, 10, 20, "e"), (0, 2, 0, None, 0, 10, 20, "f"), (3, 0, 0, 1, 2, 3, 4, "g")]
    found = anchors.reanchor(spark.createDataFrame(glyphs, "p int, li int, ci bigint, x int, y int, w int, h int, mark string"),
                             spark.createDataFrame(cells, "p int, col int, x int, y int, w int, h int"), ["p"])
    assert found.dtypes == [("p", "int"), ("li", "int"), ("ci", "bigint"), ("x", "double"), ("y", "double"), ("w", "double"), ("h", "double"),
                            ("mark", "string"), ("anchored", "string")]
    want = [(0, 0, 0, 100.0, y, 20.0, 20.0, m, "index") for m in "ab" for y in (0.0, 24.0)] + [(0, 0, 1, 100.0, 48.0, 20.0, 20.0, None, "index")]
    want += [(*g[:3], *[None if v is None else float(v) for v in g[3:7]], g[7], "kept") for g in glyphs[3:]]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    plan = catalog.queries()["m04_reanchor"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_first_places(spark, monkeypatch):
    """needles of several lengths are found in texts of their page, at the first place, also where hashes are equal."""
    rng = random.Random(2)
    texts = [(p, i, "".join(rng.choice("aaab\n漢😀") for _ in range(n))) for p in (1, 2) for i, n in enumerate((0, 1, 2, 5, 40, 200, 200))]
    needles = [(p, t[a:a + k]) for p, _, t in texts for k in (1, 2, 3, 6) for a in range(0, max(0, len(t) - k), 17)] + [(1, "zzz"), (2, "")]
    texts += [(1, 7, None), (None, 8, "aaab"), (1, 3, texts[3][2])]
    want = sorted((p, i, n, t.find(n)) for p, i, t in texts if p and t for n in {n for q, n in needles if q == p and n} if n in t)
    for weak in (None, lambda chars, k: np.zeros(max(0, len(chars) - k + 1), np.uint64), lambda chars, k: chars[:max(0, len(chars) - k + 1)] % 2):
        if weak:
            monkeypatch.setattr(reports, "_hashed", weak)
        got = reports.first_places(spark.createDataFrame(texts, "p int, id int, t string"), spark.createDataFrame([*needles, (None, "a")], "p int, needle string"),
                                   ["p"], "id", "t").collect()
        assert sorted(map(tuple, got)) == want


def test_alignment_spells_out_no_windows(spark):
    """the windows of all lines are no rows, and the glyphs they are met with are not sorted."""
    plan = catalog.queries()["c09_alignment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "slice(" not in plan and "ShuffledHashJoin" in plan


def test_messages_are_parsed_once(spark):
    """a message is not parsed below the shuffle that deals it and again above, and its hundredths are made without decimals."""
    pages_ = spark.range(3).select("id", F.lit('{"lines":[{"li":0,"chars":[{"c":"a","x":1},{"c":"b"}]},{"li":1,"chars":[]},{"chars":[{"c":"z"}]}]}').alias("payload"))
    pages_ = pages_.unionByName(spark.createDataFrame([(7, " "), (8, None), (9, "{broken"), (10, "{}"), (11, '{"lines":[{"li":"x"}]}')], "id bigint, payload string"))
    found = messages.flatten_payload(pages_.repartition(4, "id"), ["id"])
    assert sorted((r.id, r.li, r.ci, r.ch, r.x) for r in found.where("id = 1").collect() if r.li is not None) == [(1, 0, 0, "a", 1), (1, 0, 1, "b", None)]
    assert {r.id for r in found.collect()} == {0, 1, 2} and found.count() == 9
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    shares = [i / 1000 for i in range(1001)] + [0.285, 0.005, 1.0049999999999999 - 1, 0.995]
    rows = spark.createDataFrame([(v,) for v in shares], "v double").select(messages._hundredths(F.col("v")).alias("a"), F.round("v", 2).alias("b"))
    assert not rows.where("a <> b").collect()
