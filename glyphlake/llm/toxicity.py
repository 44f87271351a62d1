"""Toxicity by a learned lexicon, misspellings by automaton, quotation by context.

The lexicon holds words and word beginnings whose occurrences in labelled texts
are nearly all toxic. Its trie is intersected with Levenshtein automata: states
are sets of (trie node, edits so far), made on demand, so a word costs one table
step per letter and most words die after a few. Misspelled words that occur in
clean labelled texts are ordinary words and excepted. A hit counts less when the
words around it quote it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import WORD, words

#: Labelled rows that the model is fitted to at most, drawn by a hash of their id.
SAMPLE = 20_000
#: Occurrences in toxic texts, and their share, that make a word an entry.
LEAST, SHARE = 8, 0.8
STEMS = range(4, 9)
#: Words from this length on may have one edit, from the second on two.
EDITS = (5, 9)
#: Words to each side that are looked at for quotation, and what a quoted or a misspelled hit still counts.
WINDOW, QUOTED, MISSPELLED = 12, 0.3, 0.5
CUT = 0.7

OPENING, CLOSING = "\"«„“‹「『", "\"»“”›」』"


@dataclass
class Automaton:
    """The union of Levenshtein automata of a lexicon, on its trie; states are numbered as they are met.

    A state is a set of ((node, awaited letter), edits); two swapped letters are one edit.
    """

    terms: dict[str, tuple[float, bool]]  # weight, is a beginning
    exceptions: frozenset = frozenset()
    edits: tuple[int, int] = EDITS
    states: list = field(default_factory=list)
    numbers: dict = field(default_factory=dict)
    steps: dict = field(default_factory=dict)

    def __post_init__(self):
        self.children, self.ends, self.room = [{}], [None], [0]
        for term in sorted(self.terms):
            allowed = 0 if self.terms[term][1] else sum(len(term) >= n for n in self.edits)
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.room.append(0)
                self.room[node] = max(self.room[node], allowed)
                node = self.children[node][c]
            self.room[node] = max(self.room[node], allowed)
            self.ends[node] = (term, *self.terms[term], allowed)
        self.start = self._number({(0, ""): 0})

    def _number(self, state: dict) -> int:
        todo = list(state.items())  # letters left out: go down the trie
        while todo:
            (node, awaited), e = todo.pop()
            if not awaited and e < self.room[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.room[child] and state.get((child, ""), 99) > e + 1:
                        state[child, ""] = e + 1
                        todo.append(((child, ""), e + 1))
        key = tuple(sorted(state.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append((key, self._final(key, False), self._final(key, True)))
        return self.numbers[key]

    def _final(self, key, beginning):
        """Best (edits, -weight, term) that ends in this state."""
        found = [(e, -self.ends[n][1], self.ends[n][0]) for (n, awaited), e in key
                 if not awaited and self.ends[n] and self.ends[n][2] == beginning and e <= self.ends[n][3]]
        return min(found, default=None)

    def _step(self, number: int, letter: str) -> int:
        after: dict[tuple[int, str], int] = {}

        def reach(node, e, awaited=""):
            if e <= self.room[node] and after.get((node, awaited), 99) > e:
                after[node, awaited] = e

        for (node, awaited), e in self.states[number][0]:
            if awaited:  # the second of two swapped letters
                if letter == awaited:
                    reach(node, e)
                continue
            for c, child in self.children[node].items():
                reach(child, e if c == letter else e + 1)
                if letter in self.children[child] and letter != c:
                    reach(self.children[child][letter], e + 1, c)
            reach(node, e + 1)
        self.steps[number, letter] = to = self._number(after) if after else -1
        return to

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best entry for ``word``; beginnings match exactly, whole words with edits."""
        number, best = self.start, None
        for letter in word:
            to = self.steps.get((number, letter))
            number = self._step(number, letter) if to is None else to
            if number < 0:
                break
            stem = self.states[number][2]
            if stem:
                best = min(best or stem, stem)
        else:
            whole = self.states[number][1]
            if whole and (whole[0] == 0 or word not in self.exceptions):
                best = min(best or whole, whole)
        return best and (-best[1], best[0])


def _quoted(text: str, at: int, end: int) -> bool:
    """Whether an opening mark stands within the window before and a closing one within the window behind."""
    before = " ".join(text[max(0, at - 16 * WINDOW):at].split(" ")[-WINDOW:]).split("\n")[-1]
    behind = " ".join(text[end:end + 16 * WINDOW].split(" ")[:WINDOW]).split("\n")[0]
    opened = [m for m in before if m in OPENING or m in CLOSING]
    closed = [m for m in behind if m in OPENING or m in CLOSING]
    if not opened or not closed or opened[-1] not in OPENING or closed[0] not in CLOSING:
        return False
    return opened[-1] != '"' or before.count('"') % 2 == 1


def measure(text: str, automaton: Automaton, memo: dict, find) -> tuple[float, float]:
    """Weighted hits outside and inside of quotation."""
    lowered = text.lower()
    hits = {}
    for w in set(find(lowered)):
        m = memo.get(w, 0)
        if m == 0:
            m = memo[w] = automaton.match(w)
        if m:
            hits[w] = m[0] * MISSPELLED ** min(1, m[1])
    if not hits:
        return 0.0, 0.0
    plain = quoted = 0.0
    for m in re.finditer(WORD, lowered):
        weight = hits.get(m.group())
        if weight:
            if _quoted(lowered, m.start(), m.end()):
                quoted += weight
            else:
                plain += weight
    return plain, quoted


@dataclass
class ToxicityModel:
    terms: dict[str, tuple[float, bool]]
    exceptions: frozenset
    slope: float
    offset: float


def _evidence(plain, quoted):
    return np.log1p(np.asarray(plain) + QUOTED * np.asarray(quoted))


def _probability(model, plain, quoted):
    return 1 / (1 + np.exp(-(model.slope * _evidence(plain, quoted) + model.offset)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, bound: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y): texts of at most ``bound`` labelled ids that fulfil ``use``, drawn by a hash of the id.

    The chosen ids are what is broadcast, so the bound is its bound.
    """
    chosen = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
              .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & use)
              .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id")


def _family() -> Column:
    """The least hash of the five-word shingles of ``w``, which near copies mostly share."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1)))
    return F.array_min(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, 5))))


def fit(docs: DataFrame, labels: DataFrame, use: Column, doc_id: str = "doc_id", text: str = "text",
        bound: int = SAMPLE) -> ToxicityModel:
    """Learn lexicon, exceptions and scale from the labelled rows that fulfil ``use``.

    Equal texts and most near copies count once, or the rare words of a copied
    text would look like toxic terms. Lexicon and exceptions are words of the
    sample, whose ``bound`` is theirs too.
    """
    sample = labelled_sample(docs, labels, "toxic", use, bound, doc_id, text)
    sample = (sample.withColumn("w", words(F.lower("text"))).withColumn("family", _family()).drop("w")
              .dropDuplicates(["family", "y"]).drop("family"))
    counts = (sample.select("y", F.explode(F.array_distinct(words(F.lower("text")))).alias("word"))
              .groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")))
    counts = counts.persist()
    try:
        is_entry = (F.col("bad") >= LEAST) & (F.col("bad") >= SHARE * (F.col("bad") + F.col("good")))
        whole = counts.where(is_entry).orderBy(F.desc("bad"), "word").collect()
        stems = (counts.select(F.explode(F.transform(F.array(*map(F.lit, STEMS)), lambda n: F.when(
            F.length("word") > n, F.col("word").substr(F.lit(1), n)))).alias("word"), "bad", "good")
            .where(F.col("word").isNotNull()).groupBy("word").agg(
                F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("forms")))
        begun = (stems.where(is_entry & (F.col("forms") >= 5)).orderBy(F.desc("bad"), "word").collect())
        terms = _lexicon(whole, begun)
        automaton = Automaton(terms)
        near = counts.where("good > 0").select("word").mapInArrow(_near(automaton), "word string")
        exceptions = frozenset(r["word"] for r in near.collect())
    finally:
        counts.unpersist()
    model = ToxicityModel(terms, exceptions, 1.0, 0.0)
    seen = measured(sample, model, extra=("y",)).select("plain", "quoted", "y").toPandas()
    _scale(model, seen)
    return model


def _lexicon(whole, begun) -> dict[str, tuple[float, bool]]:
    """Words, and the longest beginnings that still cover nearly all of what a shorter one covers."""
    def weight(r):
        return float(np.log((r["bad"] + 0.5) / (r["good"] + 0.5)) / 5)

    stems = {r["word"]: r for r in begun}
    kept = {}
    for s, r in stems.items():
        longer = [x for x in stems if len(x) == len(s) + 1 and x.startswith(s)]
        shorter = stems.get(s[:-1])
        covers = shorter is None or r["bad"] >= 0.8 * shorter["bad"]
        if covers and not any(stems[x]["bad"] >= 0.8 * r["bad"] for x in longer):
            kept[s] = (weight(r), True)
    words_ = {r["word"]: (weight(r), False) for r in whole
              if not any(r["word"].startswith(s) and kept[s][0] >= weight(r) for s in kept)}
    return kept | words_


def _near(automaton):
    def run(batches):
        for batch in batches:
            keep = [(m := automaton.match(w)) is not None and m[1] > 0 for w in batch.column("word").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _scale(model: ToxicityModel, seen) -> None:
    """Logistic regression of the label on the evidence, by Newton steps with a little ridge."""
    x, y = _evidence(seen.plain.to_numpy(), seen.quoted.to_numpy()), seen.y.to_numpy(dtype=float)
    if not len(y):
        model.slope, model.offset = 2.0, -3.0
        return
    a = np.stack([x, np.ones(len(x))], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (p - y) + 0.5 * b * [1, 0]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.5, 1e-6])
        b = b - np.clip(np.linalg.solve(h, g), -2, 2)
    model.slope, model.offset = float(max(b[0], 0.0)), float(b[1])


def measured(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", extra=()) -> DataFrame:
    """(doc_id, *extra, plain, quoted, score) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *extra, F.coalesce(F.col(text), F.lit("")).alias("text"))
    word = WORD

    def run(batches):
        automaton, memo, find = Automaton(model.terms, model.exceptions), {}, re.compile(word).findall
        for batch in batches:
            found = []
            for value in batch.column("text"):
                if len(memo) > 500_000:
                    memo.clear()
                found.append(measure(value.as_py(), automaton, memo, find))
            plain, quoted = np.array(found).reshape(-1, 2).T
            out = batch.drop_columns(["text"])
            for name, c in (("plain", plain), ("quoted", quoted), ("score", _probability(model, plain, quoted))):
                out = out.append_column(name, pa.array(c, pa.float64()))
            yield out

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{head}, plain double, quoted double, score double")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, plain, quoted): one row per row of ``docs``.

    Labels are learned from rows outside of fold 1 of 3. Null and empty texts
    have no hits and the lowest score; so has every text if there are no labels
    to learn from. An id labelled twice has the higher label; null ids, null
    labels and labels without a document teach nothing. Repeated rows are scored
    each; other columns are not carried.
    """
    model = fit(docs, labels, id_fold(F.col("doc_id"), 3) != 1, doc_id, text)
    scored = measured(docs, model, doc_id, text)
    return scored.select("doc_id", (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"), "plain", "quoted")


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Null and empty texts stay. Repeated rows and rows without an id are judged each by their own text; an
    empty table stays empty, and without labels to learn from every row stays.
    """
    model = fit(docs, labels, id_fold(F.col("doc_id"), 3) != 1, doc_id, text)
    word = WORD

    def run(batches):
        automaton, memo, find = Automaton(model.terms, model.exceptions), {}, re.compile(word).findall
        for batch in batches:
            found = []
            for value in batch.column(text):
                if len(memo) > 500_000:
                    memo.clear()
                found.append(measure(value.as_py() or "", automaton, memo, find))
            plain, quoted = np.array(found).reshape(-1, 2).T
            yield batch.filter(pa.array(_probability(model, plain, quoted) < cut, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
