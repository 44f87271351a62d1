"""Lexical search, suffix dedup and the Merkle manifest against brute force, on odd input and with small blocks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphlake.llm import lexical, merkle, repeats

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefgéñ", k=RNG.randint(1, 6))) for _ in range(150)]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


# Lexical search


def lexical_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def ranked(docs, items, top):
    counts = [(i, Counter(lexical_terms(t))) for i, t in docs if lexical_terms(t)]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for key, text in items:
        scored = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in lexical_terms(text) if t in c)
            scored.append((-score, i is None, i if i is not None else 0))
        out += [(key, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(x for x in scored if x[0])[:top], 1)]
    return sorted(out, key=repr)


DOCS = [(i, prose(RNG.randint(1, 60))) for i in range(300)]
DOCS += [(None, prose(9)), (7, DOCS[7][1]), (900, ""), (901, None), (902, "!? ..."), (903, "ÀB àb KK x1"), (904, prose(20_000))]
DOCS += [(1000 + i, DOCS[3][1]) for i in range(15)]  # more equal scores than places
ITEMS = [(i, prose(RNG.randint(1, 30))) for i in range(12)]
ITEMS += [(1, DOCS[3][1]), (None, "ab Àb"), (50, ""), (51, None), (52, "unheard"), (53, " ".join(WORDS)), (53, " ".join(WORDS) * 2)]


@pytest.mark.parametrize("chunk, terms", [(16_384, 200_000), (50, 40)])
def test_search(spark, monkeypatch, chunk, terms):
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in DOCS], "doc_id bigint, text string, n int, item int, terms int")
    items = spark.createDataFrame([(i, t, "x", 0) for i, t in ITEMS], "item_id bigint, text string, doc_id string, rank int")
    rows = lexical.search(docs, items).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == ranked(DOCS, ITEMS, 10)


def test_search_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_groups_are_told_best_first():
    postings = [np.array([0, 1, 2]), np.array([1, 3]), np.array([2])]
    docs, bounds = lexical.presence_groups(postings, np.array([5, 4, 9]), 6)
    assert docs.tolist() == [2, 1, 0, 3] and bounds.tolist() == [14, 9, 5, 4]
    many = [np.array([k % 5]) for k in range(130)]  # masks of three words
    docs, bounds = lexical.presence_groups(many, np.ones(130, np.int64), 5)
    assert sorted(docs.tolist()) == [0, 1, 2, 3, 4] and bounds.tolist() == [26] * 5


# Suffix dedup


def cut_out(docs, window=50):
    first = {}
    rows = [(2 ** 63 - 1 if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in rows:
        for p in range(len(b) - window + 1):
            s = b[p:p + window]
            first[s] = min(i, first.get(s, i))
    out = []
    for (key, _), (i, b) in zip(docs, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p:p + window]] < i:
                gone[p:p + window] = b"\1" * window
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((key, len(b), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def repeating():
    shared = [prose(RNG.randint(12, 60)) for _ in range(6)]
    docs = []
    for i in range(90):
        parts = [prose(RNG.randint(0, 25)), RNG.choice(shared)[RNG.randint(0, 20):], prose(RNG.randint(0, 9)), RNG.choice(shared)]
        docs.append((i, " ".join(parts)))
    base = prose(300)
    docs += [(200 + i, base[:500 + i] + "#" * i + base[500 + i:]) for i in range(12)]  # near copies
    docs += [(i, t) for i, t in docs[:10]] + [(None, docs[5][1]), (None, docs[5][1]), (3, docs[60][1])]
    docs += [(300, ""), (301, None), (302, "a" * 49), (303, "a" * 50), (304, "a" * 120), (305, "b" + "a" * 50 + "c"), (306, "\0" * 70), (307, "\0" * 50)]
    docs += [(308, "xyz" * 40), (309, "zxyzxy" + "xyz" * 30), (310, prose(9_000)), (311, shared[0] * 3), (312, "é" * 40), (313, "xé" + "é" * 30)]
    exact = prose(40).encode()[:50].decode(errors="ignore").ljust(50, "q")[:50]
    docs += [(320, "left1 " + exact + " right1"), (321, "other " + exact + "?"), (322, exact), (-5, exact[:49])]
    RNG.shuffle(docs)
    return docs


REPEATING = repeating()


@pytest.mark.parametrize("sizes", [{}, {"CHUNK_BYTES": 3_000, "BUCKET_GRAMS": 200, "BUCKET_SUFFIXES": 40, "_SLICE": 700},
                                   {"CHUNK_DOCS": 1, "BUCKET_SUFFIXES": 7, "_SLICE": 64}])
def test_repeats(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(repeats, name, value)
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in REPEATING], "doc_id bigint, text string, chunk int, marks int, data string")
    rows = repeats.remove_repeats(docs).collect()
    got = [(r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in rows]
    assert sorted(got, key=repr) == cut_out(REPEATING)


def test_repeats_nothing(spark):
    docs = spark.createDataFrame([(1, "x"), (None, None)], "doc_id int, text string")
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    assert sorted(r.n_bytes for r in repeats.remove_repeats(docs).collect()) == [0, 1]


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, (6_000, 3)).astype(np.uint64)
    order = repeats.multikey_quicksort(words)
    assert sorted(order.tolist()) == list(range(6_000))
    assert [tuple(w) for w in words[order]] == sorted(map(tuple, words))
    strings = [rng.integers(97, 99, rng.integers(0, 20)).astype(np.uint8).tobytes() for _ in range(2_000)]
    order, common = repeats.sorted_strings(strings, 20)
    padded = [strings[i].ljust(24, b"\0") for i in order]
    assert padded == sorted(padded)
    for a, b, n in list(zip(padded, padded[1:], common[1:]))[:500]:
        assert a[:n] == b[:n] and (n == 24 or a[n] != b[n])


def test_equal_windows_have_equal_anchors():
    text = prose(200).encode()
    for shift in (0, 7, 63):
        data = np.frombuffer(b"y" * shift + text, np.uint8)
        e = repeats.Extents(data, np.array([shift, len(text)]))
        assert e.count.sum() == len(text) - 49 + max(0, shift - 49)
        found = {int(s) + k - shift: int(a) - shift for s, n, a in zip(e.start, e.count, e.anchor) for k in range(n) if s >= shift}
        if not shift:
            first = found
        assert found == first
        assert all(p <= a <= p + 30 for p, a in found.items())


# Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, place):
    out = []
    for nodes in levels[:-1]:
        first = place - place % 3
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1:first + 3])))
        place //= 3
    return out


def manifest(rows):
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        bare = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            bare = text.replace("\n", "")
        head = "".join(map(enc, (doc_id, source, lang, n_chars)))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, digest(head + enc(text)), digest(head + enc(bare)), doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([r[2] for r in sorted(groups[s])]) for s in order}
    top = climbed([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for place, s in enumerate(order):
        for i, (_, _, leaf, bad, doc_id) in enumerate(sorted(groups[s])):
            steps = path(trees[s], i) + path(top, place)
            folded = bad
            for a, b in steps:
                folded = digest(a + folded + b)
            out.append((doc_id, leaf, trees[s][-1][0], root, digest("".join(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=repr)


LEAVES = [(i, RNG.choice(["hot", "hot", "hot", "b", "Ä", "z", ""]), RNG.choice(["en", None]), RNG.choice([5, None]), prose(3) + RNG.choice(["\n", "", "\n\nx"]))
          for i in range(160)]
LEAVES += [(None, "b", None, None, None), (None, None, "en", 3, "a\nb"), (400, None, "en", 3, "a\nb"), (401, "alone", "", 0, ""), (402, "b", "en", 1, None)]
LEAVES += [LEAVES[4], LEAVES[4], (4, "hot", "xx", 9, "other\n")]
KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("levels, partition", [(8, 10_000), (1, 7), (2, 4)])
def test_manifest(spark, monkeypatch, levels, partition):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle.prove, "__defaults__", (partition,))
    docs = spark.createDataFrame([(*r, 1, "t", 3, "d") for r in LEAVES], KIND + ", pos int, tree string, n int, leaf string")
    rows = merkle.manifest(docs).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == manifest(LEAVES)


def test_manifest_of_little(spark):
    assert merkle.manifest(spark.createDataFrame([], KIND)).count() == 0
    for rows in ([(1, "s", "en", 1, "x\ny")], [(1, None, None, None, None), (2, "a", None, None, "\n")]):
        assert sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, KIND)).collect()), key=repr) == manifest(rows)


def test_a_part_of_the_leaves_fetches_what_it_lacks():
    for n in (1, 2, 3, 4, 10, 27, 28, 100):
        leaves = [digest(str(i)) for i in range(n)]
        levels = climbed(leaves)
        for _ in range(5):
            some = RNG.sample(range(n), RNG.randint(1, n))
            lacking = merkle.missing(some, n)
            nodes = {(0, p): leaves[p] for p in some}
            assert not set(lacking) & set(nodes) and len(set(lacking)) == len(lacking)
            nodes |= {(level, p): levels[level][p] for level, p in lacking}
            merkle.derive(nodes, some, n)
            assert nodes[len(levels) - 1, 0] == levels[-1][0]
            for p in some:
                assert list(merkle.siblings(nodes, p, n)) == path(levels, p)
    assert merkle.missing(list(range(9)), 27) == [(2, 1), (2, 2)]
