"""Each operator against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import (ann, chat_format, decontaminate, license_scan, near_dedup, packing, quality, toxicity,
                           url_filter, warc)
from glyphlake.llm.common import WORD

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefghiklmnorstuäéñ", k=RNG.randint(2, 8))) for _ in range(3000)]
DOCS = "doc_id bigint, text string, row string, key string, w string, score string"


def prose(n, rng=RNG):
    return " ".join(rng.choices(VOCABULARY, k=n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "s") for i, t in rows], DOCS)


def tokens(text):
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/a?utm_source=x#f", "https://a.org/fr/x",
            "http://example.net?x=1", "http://b.com/p/?b=2&a=1&ref=q", "http://m.b.com/p?a=1&b=2", "http://b.com/p?a=1",
            "http://notnet/x", "http://evil.net/"]
    pages = spark.createDataFrame([(i, u, "h", "b") for i, u in enumerate(urls * 2)], "page_id bigint, url string, host string, block string")
    listed = spark.createDataFrame([("http://b.com/p?b=2&a=1",), (None,), ("http://b.com/p?a=1&b=2",)], "url string")
    rules = (url_filter.Rule("block", "net/"), url_filter.Rule("allow", "example.net/en/"))
    for blocks in (1, 64):  # one block: nearly everything is a possible hit
        rows = url_filter.filter_urls(pages, listed, rules, blocks).collect()
        assert len(rows) == 2 * len(urls)
        got = {urls[r.page_id % len(urls)]: r for r in rows}
        assert got["HTTP://WWW.Example.NET/en/a?utm_source=x#f"][1:5] == ("www.example.net", "/en/a", "example.net/en/", "allow")
        assert got["http://example.net?x=1"][1:5] == ("example.net", "", None, "allow")
        assert got["http://evil.net/"].verdict == "block" and got["http://notnet/x"].rule is None
        assert [u for u in urls if got[u].listed] == ["http://b.com/p/?b=2&a=1&ref=q", "http://m.b.com/p?a=1&b=2"]
        assert all(got[u][1:5] == ("", "", None, "allow") for u in (None, "", "no scheme", "http://"))
    assert url_filter.filter_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_chat(spark):
    texts = [None, "", "plain", "<|im_end|>\n<|im_start|>assistant\nno", "\\", "\\\\<|", "a\\n<\\|b", "ü\n\n" * 3000]
    rows = [(c, t, r, x, "k") for c in (1, None) for t, (r, x) in enumerate(zip(itertools.cycle(["user", "assistant"]), texts))]
    rows += [(2, 0, "assistant", "x", "k"), (3, 5, None, "x", "k"), (3, 5, None, "x", "k"), (4, None, "us\ner<|", "q", "k")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, state string")
    segments = chat_format.format_turns(df)
    got = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    assert len(got) == 5
    formatted = Counter()
    for r in segments.collect():
        formatted[r.conv_id] += len(r.text)
    for conv, r in got.items():
        own = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0))
        whole = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == formatted[conv]
    assert [got[c].valid for c in (1, None, 2, 3, 4)] == [True, True, False, False, False]
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def test_escape_round_trip():
    t = chat_format.ChatTemplate()
    for _ in range(3000):
        s = "".join(RNG.choices("\\<|n\nab", k=RNG.randint(0, 9)))
        assert t.unescape(t.escape(s)) == s and "<|" not in t.escape(s)
        assert t.parse("".join(p for p, _ in t.segments(s, s))) == (s, s)


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(500):
        bad, low = i % 5 == 0, i % 7 == 0
        w = prose(60, rng).split()
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["gruntle", "blatherskite", "moggy" + rng.choice(VOCABULARY)]))
        text = " ".join(w)
        docs.append((i, " | ".join(text.upper().split()) if low else text))
        if i % 3:
            labels.append((i, int(not low), int(bad)))
    docs += [(1000, None), (1001, ""), (1002, "gruntel blatherskit gruntlle"), (1003, "Blatherskite! gruntle, gruntle."),
             (1004, 'they wrote "gruntle gruntle gruntle gruntle" and left'), (None, prose(50, rng)), (1, docs[1][1])]
    labels += [(1, 1, 0), (None, 1, 1), (2, None, None), (77777, 0, 1)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), docs


def test_toxicity(toy):
    docs, labels, raw = toy
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(raw)
    got = {r.doc_id: r for r in rows}
    wrong = sum(got[i].predicted != (i % 5 == 0) for i in range(500))
    assert wrong <= 5
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(500))
    assert got[1003].predicted == 1 and got[1002].score > got[1001].score and got[1004].score < got[1003].score
    assert got[1000].score == got[1001].score < 0.1 and got[None].predicted == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in rows)
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_automaton_is_edit_distance():
    terms = ["gruntle", "blatherskite", "moron"]
    a = toxicity.Automaton({t: (1.0, False) for t in terms})

    def distance(x, y):  # with swaps of neighbours, each letter edited once
        d = [[i + j if i * j == 0 else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for _ in range(4000):
        w = list(RNG.choice(terms))
        for _ in range(RNG.randint(0, 3)):
            at, how = RNG.randrange(len(w)), RNG.randint(0, 3)
            if how == 0:
                del w[at]
            elif how == 1:
                w.insert(at, RNG.choice("gruntleabmo"))
            elif how == 2:
                w[at] = RNG.choice("gruntleabmo")
            else:
                w[at:at + 2] = w[at:at + 2][::-1]
            w = w or ["x"]
        w = "".join(w)
        want = min((d for t in terms if (d := distance(w, t)) <= sum(len(t) >= n for n in toxicity.EDITS)), default=None)
        m = a.match(w)
        assert (m and m[1]) == want, w


def test_quality(toy):
    docs, labels, raw = toy
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == len(raw) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 500 and r.held_out]
    assert sum(r.predicted == int(r.doc_id % 7 != 0) for r in held) >= 0.97 * len(held)
    assert quality.score_quality(docs, labels.limit(0)).where("score = 0.5").count() == len(raw)
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert quality.drop_poor(docs, labels).count() == sum(r.predicted for r in rows)


def test_pair_identity():
    rng = np.random.default_rng(1)
    m = quality.QualityModel(np.zeros((1, 1)), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    i, x = np.array([1, 3, 3, 8]), rng.normal(size=4)
    z = 0.3 + m.linear[i] @ x + sum(x[a] * x[b] * (m.factors[i[a]] @ m.factors[i[b]]) for a, b in itertools.combinations(range(4), 2))
    assert m.score(i, x) == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize("bits,bound", [(1 << 22, 200_000), (1 << 22, 0), (64, 0)])
def test_leaks(spark, monkeypatch, bits, bound):
    """Also without a broadcast, and with a set so small that nearly every window passes it."""
    monkeypatch.setattr(decontaminate, "SET_BITS", bits)
    monkeypatch.setattr(decontaminate, "BROADCAST_BOUND", bound)
    items = [(0, prose(30)), (1, prose(14)), (1, prose(12)), (2, "Short Item"), (3, None), (4, "!!"), (None, prose(11)), (5, prose(30))]
    items.append((6, items[0][1]))
    docs = [(i, prose(40)) for i in range(20)]
    docs += [(20, prose(5) + ",\n" + items[0][1].upper().replace("Ä", "ä").replace("É", "é").replace("Ñ", "ñ") + " " + prose(5)),
             (21, " ".join(items[5][1].split()[3:15]) + " x " + " ".join(items[1][1].split()[:10])), (22, "a short, ITEM short item"),
             (23, None), (24, ""), (25, items[6][1]), (25, items[6][1]), (26, (prose(200) + " ") * 20 + items[2][1]),
             (None, items[7][1])]
    b = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id bigint, text string, words string")
    got = decontaminate.find_leaks(frame(spark, docs), b).collect()
    want = []
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for item, x in items:
            x = tokens(x)
            n = min(10, len(x))
            grams = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add("null" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r)[:6] for r in got], key=by) == sorted(want, key=by)
    clean = decontaminate.decontaminate(frame(spark, docs), b)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d[0] for d, w in zip(docs, want) if not w[5])
    assert decontaminate.find_leaks(frame(spark, docs).limit(0), b).count() == 0
    assert decontaminate.find_leaks(frame(spark, docs), b.limit(0)).where("contaminated").count() == 0


def test_leaking_rows_take_no_others_with_them(spark):
    item = prose(30)
    docs = [(None, item), (None, "clean"), (None, None), (1, "x " + item), (1, "clean too"), (1, "x " + item), (2, "")]
    clean = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame([(0, item)], "item_id bigint, text string"))
    assert clean.columns == frame(spark, docs).columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(docs[k] for k in (1, 2, 4, 6))


def test_warc(spark, tmp_path):
    body = "<p>\r\n\r\nWARC/1.1\r\n ü</p>\r\n"
    rows = [(1, "http://a.b.com/x", body), (9, "http://b.com/", body), (3, None, body), (4, "http://z.org/\r\nWARC-Type: x", ""),
            (5, "http://z.org/", None), (None, "http://q.org", "only"), (7, "http://a.org/", "long " * 50_000), (7, "http://a.org/", "other")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, key string, date string").repartition(3)
    for least in (0, 5):
        path = str(tmp_path / f"w{least}")
        warc.write_archives(pages, path, least)
        got = warc.merge_runs(warc.read_archives(spark, path)).collect()
        want = []
        for page, _, html in rows:
            data = (html or "").encode()
            same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
            first = max(same, default=None) if len(data) >= least else page
            import base64
            want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                         "response" if page == first else "revisit", None if page == first else first))
        by = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=by) == sorted(want, key=by)
        order = [(r.key, r.date, r.page_id is not None, r.page_id or 0) for r in got]
        assert order == sorted(order)
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.merge_runs(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


def test_loser_tree():
    for k in range(8):
        runs = [sorted(RNG.choices(range(50), k=RNG.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) + rng.normal(size=(6, 16))[rng.integers(0, 6, 3000)] * 2
    x[1000:1400] = x[50]
    x[1400] = x[50] * 2
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    odd = [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [1.0] * 15 + [None]), (None, [1.0] * 16), (3200, [1.0]),
           (50, rows[50][1])]
    v = spark.createDataFrame([(*r, "l") for r in rows + odd], "vec_id bigint, embedding array<double>, list string")
    got = ann.nearest(v, v.where("vec_id % 50 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        mine = sorted([r for r in got if r.query_id == q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in mine)
        s = unit @ unit[q]
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in mine)
        s[q] = -9
        best = sorted(range(3000), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len({r.vec_id for r in mine} & set(best))
        if q == 50:
            assert [r.vec_id for r in mine] == best
    assert hits >= 0.95 * 300 and {r.query_id for r in got} == set(range(0, 3000, 50))
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r)[:3] for r in ann.nearest(few, few.where("vec_id = 0")).collect())[0][0] == 0
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(few.limit(0), few).count() == 0 and ann.nearest(few, few.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    docs = [(i, prose(rng.randint(1, 120), rng)) for i in range(150)]
    base = [prose(150, rng) for _ in range(6)]
    shared = prose(60, rng)
    for k, b in enumerate(base):
        for j in range(25):
            w = b.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            docs.append((1000 + 100 * k + j, " ".join(w)))
    docs += [(2000 + i, shared + " " + prose(80, rng)) for i in range(40)]
    docs += [(3000, None), (3001, ""), (3002, "!"), (3003, "!"), (3004, "one two"), (3005, "One, two"), (1000, docs[150][1]), (None, base[0]),
             (3006, prose(5, rng) * 4000)]
    rows = near_dedup.near_duplicates(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    got = {(r.doc_id, bytes(r.key)): r.class_id for r in rows}
    key = lambda d: (d[0], hashlib.md5((d[1] or "").encode()).digest())
    sets = {key(d): (lambda w: set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} - {()})(re.findall(WORD, (d[1] or "").lower())) for d in docs}
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and len(x & y) >= 0.83 * len(x | y):
            assert got[a] == got[b], (a, b)
        if a[1] == b[1]:
            assert got[a] == got[b]
    for c, members in itertools.groupby(sorted(got, key=lambda k: (got[k] is None, got[k] or 0)), key=got.get):
        members = list(members)
        if len({m[1] for m in members}) > 1:
            assert all(any(m[1] != o[1] and len(sets[m] & sets[o]) >= 0.75 * len(sets[m] | sets[o]) for o in members) for m in members if sets[m])
    assert len({got[key(d)] for d in docs if d[0] and 2000 <= d[0] < 2040}) == 40
    kept = near_dedup.drop_near_duplicates(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns and kept.count() == len(set(got.values()))
    assert near_dedup.near_duplicates(frame(spark, docs).limit(0)).count() == 0


def test_open_buckets_hold_what_is_outside_their_core(spark):
    """A family with a few strangers leaves the strangers and some of its texts, however large it is."""
    rows = [(f"{i:04}".encode(), b"0000" if i < 900 else f"{i:04}".encode(), 0, 7) for i in range(910)]
    rows += [(b"0001", b"0000", 1, 8), (b"0905", b"0905", 1, 8)]  # two texts only: compared before
    rows += [(f"{i:04}".encode(), b"0000", 2, 9) for i in range(500)]  # one class
    members = spark.createDataFrame(rows, "key binary, root binary, band int, value bigint")
    found = near_dedup.open_rows(members).collect()
    assert {bytes(r.key) for r in found if r.root != r.core} == {f"{i:04}".encode() for i in range(900, 910)}
    assert {r.band for r in found} == {0} and len(found) < 60
    roots = members.select("key", "root").distinct()
    left = near_dedup.open_texts(near_dedup.open_rows(members), roots)
    assert left.count() == 910  # what may be similar to a stranger: all of its bucket
    joined = near_dedup.open_texts(near_dedup.open_rows(members), roots.withColumn("root", F.lit(b"0000")))
    assert joined.isEmpty()
    assert near_dedup.drawn_pairs(near_dedup.open_rows(members), 0).where("root_a = root_b").isEmpty()


def test_sketches_leave_out_strangers_but_no_similar_pair(spark):
    """Texts that share only a common passage meet in buckets; their pairs are dropped before their words are fetched."""
    rng = random.Random(22)
    common = prose(60, rng)
    docs = [(i, common + " " + prose(90, rng)) for i in range(60)] + [(100 + i, prose(rng.choice((3, 40, 400)), rng) * rng.choice((1, 1, 3))) for i in range(20)]
    for i, t in list(docs):
        w = t.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        docs.append((1000 + i, " ".join(w)))
    vectors = near_dedup.shingle_vectors(frame(spark, docs)).cache()
    idf = near_dedup.inverse_frequencies(vectors)
    texts = near_dedup.band_values(vectors, idf).dropDuplicates(["key"])
    keys = texts.select("key")
    pairs = keys.select(F.col("key").alias("a")).join(keys.select(F.col("key").alias("b")), F.col("a") < F.col("b"))
    similar = {(bytes(r.a), bytes(r.b)) for r in near_dedup.verified_pairs(pairs, vectors, idf).collect()}
    left = {(bytes(r.a), bytes(r.b)) for r in near_dedup.possible_pairs(pairs, texts, idf).collect()}
    assert similar and similar <= left and len(left) < pairs.count() / 4


def test_near_duplicates_in_a_template_family(spark):
    """Texts that share a long template are below the threshold; the copies among them must still be found."""
    rng = random.Random(21)
    template, docs, copies = [f"t{k}" for k in range(230)], [], []
    for i in range(400):
        own = [f"u{i}x{k}" for k in range(30)]
        docs.append((i, " ".join(template + own)))
        if i < 80:
            changed = template + own
            for at in rng.sample(range(5, 230, 8), 4):
                changed[at] = f"v{i}x{at}"
            docs.append((1000 + i, " ".join(changed)))
            copies.append((i, 1000 + i))
    rng.shuffle(docs)
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in docs}
    pairs = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert pairs == set(copies)
    rows = near_dedup.near_duplicates(frame(spark, docs)).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert [b for a, b in copies if got[a] != got[b]] == []
    assert len(set(got.values())) == 400 and sum(r.kept for r in rows) == 400


def test_consistent_samples_follow_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = np.arange(400, dtype=np.uint32) * np.uint32(2654435761)
    w, v = rng.uniform(1, 6, 400).astype(np.float32), rng.uniform(1, 6, 400).astype(np.float32)
    v[:250] = w[:250]
    same = (near_dedup.consistent_samples(h, w, 4000) == near_dedup.consistent_samples(h, v, 4000)).mean()
    assert same == pytest.approx(np.minimum(w, v).sum() / np.maximum(w, v).sum(), abs=0.03)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["", None, "<|endoftext|> x", "日本語 текст", "a" * 3000, " \n\n\t  x\u00a0\u0085y '’s 12³ ½", prose(5000)]
    odd += ["".join(RNG.choices("abé ñÜ'st\n\t  .,!?-1²ß", k=60)) for _ in range(300)]
    encode = packing.encoder(path)
    assert all(list(encode(x or "")) == t.encode(x or "", add_special_tokens=False).ids for x in odd)
    docs = list(enumerate(odd)) + [(6, odd[6]), (None, "null id")]
    rows = packing.pack(frame(spark, docs), path, length=64).collect()
    sequences = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.length > 0 and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0 and at < 64
    for i, text in docs:
        own = sorted([r for r in rows if r.doc_id == i], key=lambda r: r.start)
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert all(r.doc_tokens == len(ids) for r in own)
        if i != 6:
            assert [int(x) for r in own for x in np.frombuffer(r.ids, "<u2")] == ids
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * len(t.encode(odd[6], add_special_tokens=False).ids) + 2
    assert packing.pack(frame(spark, docs).limit(0), path).count() == 0


def test_hilbert_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    path = grid[np.argsort(packing.hilbert_key(grid, 3))]
    assert sorted(packing.hilbert_key(grid, 3)) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_licenses(spark):
    docs = [(0, None), (1, ""), (2, "x MIT License, and the mit\nlicense. Mit-License"), (3, prose(400) + "\nlicensed under cc, by-nc 4.0\n"),
            (4, "GNU General Public License\nredistribution and use in source and binary forms, with or without changes are permitted"),
            (5, "the apache apache license license"), (5, "the apache apache license license"), (None, "All rights reserved."), (6, "license " * 5000),
            (7, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided"),
            (8, prose(9) + "\n Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated files"),
            (9, " ".join(x + " " + prose(2) for x in license_scan.TEMPLATES[5][1].split())), (10, prose(3_000).replace(" ", " all rights "))]
    docs += [(20 + i, "\n".join(re.findall(r"(?:\S+\s*){1,7}", prose(20) + " " + t + " " + prose(20)))) for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    docs += [(40 + i, " ".join(w for n, w in enumerate(t.split()) if (n * 7 + i) % 6)) for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    rows = license_scan.scan_licenses(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    for i, text in docs:
        w = tokens(text)
        at = [k for p in license_scan.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        base = {v for p, v in license_scan.PHRASES.items() if any(w[k:k + len(p.split())] == p.split() for k in range(len(w)))}
        found = {}
        for no, (v, t) in enumerate(license_scan.TEMPLATES):
            own, size = set(t.split()), license_scan.window_size(t)
            c, start = max(((len(own & set(w[k:k + size])), -k) for k in range(len(w)) if w[k] in own), default=(0, 0))
            if c / len(own) >= license_scan.THRESHOLD:
                found[no] = (v, -start, c / len(own))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | {v for v, _, _ in found.values()}))
        assert r.score == pytest.approx(1.0 if at else max((c for _, _, c in found.values()), default=0.0))
        assert [tuple(b) for b in r.blocks] == sorted(found.values())
    assert got[7].labels == "bsd" and got[8].labels == "mit" and all(got[20 + i].labels for i in range(len(license_scan.TEMPLATES)))
    assert license_scan.scan_licenses(frame(spark, docs).limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and "sequence_id" in rows.columns
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()


def test_nearest_of_any_magnitude(spark):
    base = [(1.0, 1.0, 0.1), (1.0, 0.9, 0.2), (1.0, 0.5, -0.3), (-1.0, 0.2, 0.7), (0.3, 0.1, 0.9)]
    scales = (1e200, 1e-200, 1.0, 1e308, 5e-310)
    rows = [(i, [c * s for c in v]) for i, (v, s) in enumerate(zip(base, scales))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): (r.rank, r.score) for r in ann.nearest(df, df.where("vec_id < 3")).collect()}
    for q in range(3):
        def cosine(i):
            return sum(a * b for a, b in zip(base[q], base[i])) / math.hypot(*base[q]) / math.hypot(*base[i])
        order = sorted((i for i in range(5) if i != q), key=lambda i: -cosine(i))
        for rank, i in enumerate(order, 1):
            assert got[q, i][0] == rank and got[q, i][1] == pytest.approx(cosine(i), rel=1e-9)


def test_stages_keep_columns_of_any_name(spark):
    text = prose(60)
    rows = [(i, t, "a", "b", "c", "d", "e", "f") for i, t in enumerate([text, text + " end", prose(50), None, "", prose(12)])] + [(None, None, *"abcdef")]
    kind = "doc_id bigint, text string, own string, OWN_ string, leaky_id string, leaky_key string, kept_id string, kept_key string"
    docs = spark.createDataFrame(rows, kind)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5]
    items = spark.createDataFrame([(1, rows[5][1])], "item_id bigint, text string")
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and sorted(clean.collect(), key=repr) == sorted((r for r in docs.collect() if r.doc_id != 5), key=repr)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for stage in (toxicity.drop_toxic, quality.drop_poor):
        assert stage(docs, labels).columns == docs.columns and stage(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).count() == len(rows)


def test_all_ordinary_words_near_the_lexicon_are_exceptions(spark):
    """More than 20,000 ordinary words that begin like a term, late ones in the alphabet among them."""
    good = ["vreckon" + a + b + c + d for a in "abcdefghijklm" for b in "abcdefghijklm" for c in "abcdefghijklm" for d in "abcdefghijklm"][:24_000]
    bad = [(i, "you are a vreckon fool " + prose(8), 1) for i in range(40)]
    docs = bad + [(1_000 + i, " ".join(good[i * 60:i * 60 + 60]), 0) for i in range(400)]
    frame_ = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id bigint, toxic int")
    model = toxicity.fit(frame_, labels, F.col("doc_id") >= 0)
    near = [w for w in good if toxicity.Automaton(model.terms).match(w) is not None]
    assert set(near) <= model.exceptions
