"""Streams over several micro-batches, next to plain Python or to their batch forms."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphlake import catalog
from glyphlake.catalog import streams
from glyphlake.operators import votes
from glyphlake.session import scratch_path
from glyphlake.streaming import events as stream
from glyphlake.streaming import pages as reads
from glyphlake.streaming import state, steps

PASS = "k int, us bigint, event_id bigint"


def streamed(spark, batches, schema, op):
    """``op`` over one file a micro-batch, in order."""
    path = scratch_path(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.run_through(op(source), scratch_path(spark, "out"), scratch_path(spark, "state")).collect()


def test_throttle_over_batches(spark):
    got = streamed(spark, [[(1, 0, 1), (1, 300, 2), (None, 7, 9)], [(1, 399, 3), (1, 400, 4), (2, 5, 5)], [(1, 900, 6), (None, 300, 10)]],
                   PASS, lambda s: state.throttle(s, "k", 400))
    assert sorted(r.event_id for r in got) == [1, 4, 5, 6, 9]


def test_a_hot_key_passes_in_parts(spark, monkeypatch):
    """Events of one key reach the steps a few at a time, sorted over all of them."""
    monkeypatch.setattr(steps, "_PART", 4_000)
    order = list(range(30_000))
    random.Random(3).shuffle(order)
    rows = [(1, i, i) for i in order] + [(k, k, k) for k in range(2, 40)]
    got = streamed(spark, [rows], PASS, lambda s: state.throttle(s, "k", 1_000))
    assert sorted(r.event_id for r in got if r.k == 1) == list(range(0, 30_000, 1_000)) and len(got) == 68


def test_a_run_goes_on_where_it_ended(spark):
    path, out, kept = (scratch_path(spark, n) for n in ("batches", "out", "state"))
    for rows in ([(1, 0, 1)], [(1, 100, 2), (1, 450, 3)]):
        spark.createDataFrame(rows, PASS).coalesce(1).write.mode("append").parquet(path)
        found = stream.run_through(state.throttle(spark.readStream.schema(PASS).parquet(path), "k", 400), out, kept)
    assert sorted(r.event_id for r in found.collect()) == [1, 3]


def test_classified(spark):
    got = streamed(spark, [[(1, 0, 1, "a"), (1, 1, 2, "a")], [(1, 2, 3, None), (1, 3, 4, "a"), (1, 4, 5, "b")], [(1, 5, 6, "b")]],
                   PASS + ", content string", lambda s: state.classify_passes(s, "k"))
    assert [r.kind for r in sorted(got, key=lambda r: r.event_id)] == ["payload", "heartbeat", "idle", "heartbeat", "payload", "heartbeat"]


def test_page_turns(spark):
    a, b, c = ["1", "2", "3"], ["4", "5", "6"], ["7", "8", "9"]
    rows = [(1, i, i, page) for i, page in enumerate([a, a, b, a, b, b, c, b, c, c])]
    got = streamed(spark, [rows[:3], rows[3:]], PASS + ", lines array<string>", lambda s: state.page_turns(s, "k"))
    assert sorted(r.event_id for r in got) == [5, 9]


def test_rebuild_gate(spark):
    base = [f"line {i}" for i in range(10)]
    near, voted, other = [*base[:9], "other line"], [*base[:9], "line X"], ["new"]
    seen = [(base, 0, 1), (base, 0, 1), (near, 0, 1), (near, 0, 1), (near, 0, 1), (base, 9, 1), (voted, 9, 2), (other, 9, 1), ([], 9, 1)]
    rows = [(1, i, i, p, [0.0] * len(p), [float(y)] * len(p), "f", v) for i, (p, y, v) in enumerate(seen)]
    got = streamed(spark, [rows[:4], rows[4:]], PASS + ", lines array<string>, xs array<double>, ys array<double>, frame string, vote int",
                   lambda s: state.rebuild_gate(s, "k"))
    verdicts = [r.verdict for r in sorted(got, key=lambda r: r.event_id)]
    assert verdicts == ["rebuilt", "identical", "kept", "kept", "rebuilt", "rebuilt", "patched", "rebuilt", "rebuilt"]


def test_stalls(spark):
    """A silence is told once: by the event after it, or by the clock; never by both."""
    s = 1_000_000
    batches = [[(1, 0, 0), (1, 5 * s, 0), (2, 0, 0)], [(3, 30 * s, 0)], [(1, 31 * s, 0), (2, 33 * s, 0), (3, 34 * s, 0)], [(3, 90 * s, 0)]]
    got = streamed(spark, batches, PASS, lambda x: state.stall_alerts(x.withColumn("ts", F.timestamp_micros("us")), "k", "ts", 10 * s, 2 * s))
    assert sorted((r.k, r.us) for r in got) == [(1, 5 * s), (1, 31 * s), (2, 0), (2, 33 * s), (3, 34 * s)]


GLYPHS = "glyphs array<struct<li int, ci int, ch string, x double, y double, w double, h double>>"


def test_votes_grow(spark):
    """Each admitted pass gives the vote over all passes of its page so far; a new page begins anew."""
    def read(text, dx):
        return [(i // 4, i % 4, c, 12.0 * (i % 4) + dx, 30.0 * (i // 4), 10.0, 10.0) for i, c in enumerate(text)]

    seen = [("p", "abcdefgh", 0), ("p", "abXdefYh", 2), ("p", "ab", 0), ("p", "abXdZfgh", 1), ("p", "QQQQQQQQ", 0),
            ("q", "abXdefgh", 0), ("q", "abcdefgh", 0), ("p", "zzzz", 0), ("p", "zyzz", 1), ("p", "zyzz", 2)]
    rows = [(1, i, i, page, read(text, dx)) for i, (page, text, dx) in enumerate(seen)]
    rows += [(2, 0, 100, "p", read("lone", 0)), (2, 1, 101, "p", []), (2, 2, 102, None, None)]
    got = streamed(spark, [rows[:2] + rows[10:11], rows[2:4], rows[4:8] + rows[11:], rows[8:10]], f"{PASS}, page string, {GLYPHS}",
                   lambda s: reads.vote_stream(s, "k", 3, 1))
    pages, want = {0: [0], 1: [0, 1], 3: [0, 1, 3], 5: [5], 6: [5, 6], 7: [7], 8: [7, 8], 9: [7, 8, 9], 100: [10]}, {}
    box = "page int, pass int, li int, ci int, ch string, x double, y double, w double, h double"
    for event, passes in pages.items():
        flat = [(1, n, *g) for n, p in enumerate(passes) for g in rows[p][4]]
        for r in votes.voted_lines(votes.vote(spark.createDataFrame(flat, box), ["page"]), ["page"]).collect():
            want[event, r.li] = (len(passes), r.text, r.votes, r.conf)
    assert {(r.event_id, r.li): (r.vote, r.text, r.votes, r.conf) for r in got} == want
    assert want[3, 0][1] == "abXd" and want[9, 0][1] == "zyzz"


def evidence(**kw):
    return {"across": 50, "mostly_down": False, "native_down": False, "fence": False, "turned": 0} | kw


@pytest.mark.parametrize("before, row, after", [
    ("unknown", evidence(), ("horizontal", False, True)),
    ("unknown", evidence(across=4), ("unknown", False, True)),
    ("unknown", evidence(native_down=True), ("vertical_native", True, True)),
    ("unknown", evidence(native_down=True, across=4), ("unknown", False, True)),
    ("unknown", evidence(turned=101), ("vertical", True, True)),
    ("unknown", evidence(turned=100), ("horizontal", False, True)),
    ("unknown", evidence(fence=True, turned=6), ("vertical", True, True)),
    ("unknown", evidence(fence=True, turned=4), ("unknown", False, True)),
    ("horizontal", evidence(), ("horizontal", False, False)),
    ("horizontal", evidence(native_down=True), ("vertical_native", True, False)),
    ("horizontal", evidence(across=4, turned=5), ("horizontal", False, True)),
    ("horizontal", evidence(across=4, turned=9), ("vertical", True, True)),
    ("horizontal", evidence(mostly_down=True), ("horizontal", False, True)),
    ("horizontal", evidence(mostly_down=True, turned=200), ("vertical", True, True)),
    ("horizontal", evidence(fence=True, turned=80), ("vertical", True, True)),
    ("vertical", evidence(turned=5), ("vertical", True, False)),
    ("vertical", evidence(turned=4), ("horizontal", False, True)),
    ("vertical", evidence(turned=4, across=2), ("unknown", False, True)),
    ("vertical", evidence(turned=3, native_down=True), ("vertical_native", True, True)),
    ("vertical_native", evidence(native_down=True), ("vertical_native", True, False)),
    ("vertical_native", evidence(), ("horizontal", False, True)),
    ("vertical_native", evidence(native_down=True, across=3, turned=60), ("vertical", True, True))])
def test_turn(before, row, after):
    assert reads.turn(before, row) == after


def test_orientation_sticks_over_batches(spark):
    across = [(12, 120, 20, False, True)] * 3
    native = [(12, 20, 120, True, True)] * 3
    spread = [(li, ci, 40.0 * ci, 10.0, 10.0) for li in range(4) for ci in range(4)]
    seen = [(across, [], 0), (across, [], 500), (native, [], 0), (native, [], 0), ([], [], 40), (across, [], 30), (across, spread, 3), (None, None, 90)]
    rows = [(1, i, i, turned, lines, glyphs) for i, (lines, glyphs, turned) in enumerate(seen)]
    schema = PASS + (", turned int, lines array<struct<n int, w int, h int, down boolean, cjk boolean>>, "
                     "glyphs array<struct<li int, ci int, x double, w double, h double>>")
    got = streamed(spark, [rows[:3], rows[3:5], rows[5:]], schema, lambda s: reads.orientation(s, "k"))
    told = [(r.state, r.upright, r.probed) for r in sorted(got, key=lambda r: r.event_id)]
    assert told == [("horizontal", False, True), ("horizontal", False, False), ("vertical_native", True, False), ("vertical_native", True, False),
                    ("vertical", True, True), ("vertical", True, False), ("unknown", False, True), ("vertical", True, True)]


def test_triggers_by_the_latest_layer(spark):
    """A stream in three batches tells what the batch operator tells of all events."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        layer = rng.random() < 0.15
        rows.append((rng.randint(1, 4), i * 10 + rng.randint(0, 9), i, None if layer else rng.randint(0, 60), None if layer else rng.randint(0, 60),
                     rng.randint(0, 2) if layer else None))
    boxes = spark.createDataFrame([(p, b, b % 3 * 20, b // 3 * 20, 18, 18) for p in range(3) for b in range(9) if (p + b) % 4], "page int, box int, x int, y int, w int, h int")
    covers = spark.createDataFrame([(0, 40, 40, 30, 30), (1, 0, 0, 10, 10)], "page int, x int, y int, w int, h int")
    schema = PASS + ", px int, py int, page int"
    got = streamed(spark, [rows[:150], rows[150:170], rows[170:]], schema, lambda s: stream.trigger_stream(s, boxes, covers, "k"))
    df = spark.createDataFrame(rows, schema)
    want = stream.enrich_triggers(df.where("page is null").drop("page"), df.where("page is not null").select("k", "us", "page"), boxes, covers, ["k"]).collect()
    assert {(r.event_id, r.box) for r in got} == {(r.event_id, r.box) for r in want} and len(got) == len(want) > 50


def test_replies_and_expiry(spark):
    def ask(i, us):
        return (i, us, "request", None)

    def tell(i, us, ok=True):
        return (i, us, "reply", ok)

    batches = [[ask(1, 0), ask(2, 0), ask(3, 5), tell(1, 7), tell(9, 8)], [tell(1, 9), tell(2, 10, False), ask(4, 12), ask(5, 100)],
               [tell(3, 101), tell(4, 108), ask(6, 110), tell(6, 110)], [ask(7, 150), tell(7, 260, None), tell(5, 300)], [ask(8, 301)]]
    got = streamed(spark, batches, "id int, us bigint, kind string, ok boolean", lambda s: stream.correlate(s, "id", 100))
    told = sorted((r.id, r.asked, r.told, r.latency, r.expired) for r in got)
    assert told == [(1, 0, 7, 7, False), (3, 5, 101, 96, False), (4, 12, 108, 96, False), (5, 100, None, None, True), (6, 110, 110, 0, False),
                    (7, 150, None, None, True)]


@pytest.mark.parametrize("name", ["t02_rebuild_gate", "t03_page_turns"])
def test_slices_hold_texts(spark, monkeypatch, name):
    """What one task writes is each turn once as it is, not its four passes spelled out."""
    sliced, write = [], streams._slices
    monkeypatch.setattr(streams, "_slices", lambda t, rows, *more: sliced.append(rows) or write(t, rows, *more))
    sf = "/root/testdata/sf0.001"
    assert not catalog.queries()[name](spark, sf).isEmpty()
    assert [r.columns for r in sliced] == [["conv_id", "turn", "text", "first"]]
    assert sliced[0].count() == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_records():
    """Rows become the same Python values as by ``to_pylist``, in less time where they hold long lists."""
    words = [None if i % 7 == 0 else [None if j == 3 and i % 3 == 0 else f"w{i % 5}{j}é" for j in range(i % 4)] for i in range(40)]
    items = [None if i % 5 == 0 else [None if i % 2 else {"a": j, "b": [float(j), None]} for j in range(i % 3)] for i in range(40)]
    columns = {"k": pa.array([None, *range(39)]), "lines": pa.array(words), "items": pa.array(items), "x": pa.array([float("inf"), 0.5] * 20),
               "none": pa.nulls(40), "m": pa.array([[("a", 1)]] * 40, pa.map_(pa.string(), pa.int64())), "yes": pa.array([True, None] * 20),
               "e": pa.array([None if i % 4 == 0 else {"lines": words[i], "n": i, "t": None} for i in range(40)])}
    batch = pa.RecordBatch.from_pydict(columns)
    for part in (batch, batch.slice(5, 20), batch.slice(7, 0), batch.slice(21)):
        assert list(steps._records([part])) == part.to_pylist()
    long = pa.RecordBatch.from_pydict({"lines": [[f"w{i}{j}" for j in range(90)] for i in range(2_000)], "xs": [[0.5] * 90] * 2_000})
    began = time.process_time()
    want = long.to_pylist()
    middle = time.process_time()
    assert list(steps._records([long])) == want
    assert time.process_time() - middle < (middle - began) / 2


@pytest.mark.parametrize("name", ["t07_vote_stream", "t08_orientation_state"])
def test_slices_hold_documents(spark, monkeypatch, name):
    """What one task writes is each document as it is, not the passes and glyphs it is spelled out into."""
    sliced, write = [], streams._slices
    monkeypatch.setattr(streams, "_slices", lambda t, rows, *more: sliced.append(rows) or write(t, rows, *more))
    sf = "/root/testdata/sf0.001"
    assert not catalog.queries()[name](spark, sf).isEmpty()
    assert [r.columns for r in sliced] == [["source", "doc_id", "text"]]
    assert sliced[0].count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_votes_of_events_that_come_twice(spark):
    """an event that is there twice counts as two passes and is told once for each; its text is that of both."""
    glyphs = [(0, i, c, 12.0 * i, 0.0, 10.0, 10.0) for i, c in enumerate("abc")]
    other = [(0, i, c, 12.0 * i + 1, 0.0, 10.0, 10.0) for i, c in enumerate("xbc")]
    rows = [(1, 0, 10, "p", glyphs), (1, 0, 10, "p", glyphs), (1, 1, 11, "p", other)]
    for batches in ([rows], [rows[:2], rows[2:]]):
        got = streamed(spark, batches, f"{PASS}, page string, {GLYPHS}", lambda s: reads.vote_stream(s, "k", 3, 1))
        assert sorted((r.event_id, r.vote, r.li, r.text, r.votes, r.conf) for r in got) == [
            (10, 1, 0, "abc", 6, 1.0), (10, 2, 0, "abc", 6, 1.0), (11, 3, 0, "abc", 8, 8 / 9)]
