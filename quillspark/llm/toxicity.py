"""Toxicity scores from a lexicon trie searched by Levenshtein automata.

Lexicon: terms and word stems that mark labelled documents, mined by Spark from a
bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by a hash of the id; of rows with
one id the one with the least text), joined with a few seed words. A term must occur
after many different words, so that copies of one document cannot promote that
document's own words; Spark counts them exactly, however the rows lie.

Search: the Levenshtein automata of all terms, intersected with the lexicon trie,
form one automaton; it is determinised as words ask for transitions, and a word
that no term can match dies within its first letters. It accepts exact terms,
words that begin with a mined stem, and misspellings within one edit of terms of six
letters or more. A misspelled term of five letters is a hit only near an address, as
too many words lie one edit away from it, and shorter terms take none. Words that several clean
rows of the sample hold are no misspellings.

Score: each hit weighs by its context window. A hit between quotation marks (an odd
number in the ``QUOTE_CHARS`` before it and one in those after it) or after a word of
reporting ("said", "called") counts as quotation; one near an address ("you", "your")
as abuse. Logistic regression on the few resulting features, fitted on the same
bounded sample, gives the score.

Null or empty texts have no hits and get the score of hitless documents. Repeated rows
are scored alike; an empty table gives an empty result. Ties in
the mining order break by term. Rows of ``labels`` with null labels or unknown
ids are not used; with no usable labels the seed lexicon and fixed weights serve.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm.common import id_remainder
from quillspark.operators.durable import durable, release

SAMPLE_ROWS = 12_000
TERMS = 300
STEM_CHARS = (4, 5, 6)
FUZZY_FROM = 6
NEAR_FROM = 5
COMMON_ROWS = 2  # clean rows of the sample from which on a word is no misspelling
MOST_BEFORE = 20  # different preceding words that are always enough
THRESHOLD = 0.3
WINDOW = 4
QUOTE_CHARS = 60
SEEN_WORDS, SEEN_CHARS = 200_000, 40  # bounds of the cache of classified words

# Seed terms and context words.
SEEDS = "idiot moron scum loser stupid pathetic worthless disgusting trash clown".split()
REPORTING = frozenset("said says say called calls call wrote writes write quote quoted word term phrase".split())
ADDRESS = frozenset("you your youre yourself u".split())
QUOTES = re.compile("[\"“”„«»]")

_WORD = re.compile(r"[^\W_]+")
NO_HIT, NEAR, FUZZY, STEM, EXACT = range(5)


class LexiconAutomaton:
    """Trie of terms intersected with their Levenshtein automata (one edit), determinised on demand."""

    def __init__(self, words: list[str], stems: list[str], common: frozenset[str] | set[str] = frozenset(), fuzzy_from: int = FUZZY_FROM, near_from: int = NEAR_FROM):
        self.common = common
        self.letters = {c for t in [*words, *stems] for c in t}
        self.child: list[dict[str, int]] = [{}]
        self.kind: list[int] = [NO_HIT]
        self.near: list[bool] = [False]  # whether a term of this subtree may be misspelled
        for term, kind in [(w, EXACT) for w in words] + [(s, STEM) for s in stems]:
            fuzzy, node = kind == EXACT and len(term) >= near_from, 0
            for c in term:
                self.near[node] |= fuzzy
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.kind.append(NO_HIT)
                    self.near.append(False)
                node = self.child[node][c]
            self.near[node] |= fuzzy
            self.kind[node] = max(self.kind[node], kind)
        self.misspelled = [NO_HIT] * len(self.child)  # what a term that ends here is with one edit
        for w in words:
            node = 0
            for c in w:
                node = self.child[node][c]
            self.misspelled[node] = FUZZY if len(w) >= fuzzy_from else NEAR if len(w) >= near_from else NO_HIT
        self.start = self._close({(0, 0)})
        self.step: dict[frozenset, dict[str, frozenset]] = {}
        self.seen: dict[str, int] = {}

    def _close(self, state: set[tuple[int, int]]) -> frozenset:
        """Add what a skipped letter of a term reaches; an exact arrival makes a misspelled one needless."""
        state |= {(n, 1) for node, edits in list(state) if edits == 0 and node >= 0 and self.near[node] for n in self.child[node].values() if self.near[n]}
        return frozenset(state)

    def _advance(self, state: frozenset, c: str) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, edits in state:
            if node < 0 or self.kind[node] == STEM and edits == 0:
                out.add((-1, 0))  # past a stem, any ending
            if node < 0:
                continue
            if c in self.child[node] and (edits == 0 or self.near[self.child[node][c]]):
                out.add((self.child[node][c], edits))
            if edits == 0 and self.near[node]:
                out.add((node, 1))
                out.update((n, 1) for n in self.child[node].values() if self.near[n])
        return self._close(out)

    def classify(self, word: str) -> int:
        found = self.seen.get(word)
        if found is None:
            state = self.start
            for c in word:
                c = c if c in self.letters else ""  # all other letters are alike
                moves = self.step.setdefault(state, {})
                if c not in moves:
                    moves[c] = self._advance(state, c)
                state = moves[c]
                if not state:
                    break
            found = NO_HIT
            for node, edits in state:
                if node < 0:
                    found = max(found, STEM)
                elif edits == 0:
                    found = max(found, self.kind[node])
                else:
                    found = max(found, self.misspelled[node])
            if found in (NEAR, FUZZY) and word in self.common:
                found = NO_HIT
            if len(word) <= SEEN_CHARS:
                if len(self.seen) >= SEEN_WORDS:
                    self.seen.clear()
                self.seen[word] = found
        return found


FEATURES = ["bias", "exact", "stem", "fuzzy", "quoted", "addressed", "density"]


def features(automaton: LexiconAutomaton, text: str | None) -> list[float]:
    """Counts of hits by kind and context, damped by logarithms."""
    lowered = (text or "").lower()
    words = _WORD.findall(lowered)
    classify, seen = automaton.classify, automaton.seen
    hit_words = {w for w in set(words) if (seen[w] if w in seen else classify(w))}
    if not hit_words:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    count = dict.fromkeys((NEAR, FUZZY, STEM, EXACT), 0)
    quoted = addressed = 0
    at = {i for i, w in enumerate(words) if w in hit_words}
    for i, m in enumerate(_WORD.finditer(lowered)):
        if i not in at:
            continue
        address = any(w in ADDRESS for w in words[max(0, i - WINDOW) : i + WINDOW + 1])
        kind = classify(m[0])
        if kind == NEAR and not address:
            continue
        if _in_quotes(lowered, m.start(), m.end()) or any(w in REPORTING for w in words[max(0, i - WINDOW) : i]):
            quoted += 1
        else:
            count[kind] += 1
            addressed += address
    direct = count[EXACT] + count[STEM]
    return [1.0, math.log1p(count[EXACT]), math.log1p(count[STEM]), math.log1p(count[FUZZY] + count[NEAR]), math.log1p(quoted), math.log1p(addressed), math.log1p(100 * direct / len(words))]


def _in_quotes(text: str, start: int, end: int) -> bool:
    """Whether a quotation opens in the window before a place and a mark follows in the window after it."""
    before = len(QUOTES.findall(text, max(0, start - QUOTE_CHARS), start))
    return before % 2 == 1 and QUOTES.search(text, end, end + QUOTE_CHARS) is not None


def labelled_sample(docs: DataFrame, labels: DataFrame, fold: int, folds: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold: ``(text, toxic)``.

    The sampled ids, at most ``rows``, are the only thing that is broadcast.
    """
    ids = (
        labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (id_remainder(id_col, folds) != fold))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")
    return found.groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def mine_lexicon(sample: DataFrame, terms: int = TERMS) -> tuple[list[str], list[str]]:
    """Words and stems that mark toxic rows of the sample: ``(words, stems)``, ``terms`` of them at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(term, clean, toxic)``: rows that hold each term, summed up per batch."""
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in {t for w in set(_WORD.findall((text or "").lower())) for t in _terms(w)}:
                    tally.setdefault(t, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), *[pa.array([x[k] for x in tally.values()], pa.int64()) for k in (0, 1)]], names=["term", "clean", "toxic"])

    def precede(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(term, before)``: each promising term with each word before it, once per batch."""
        for batch in batches:
            pairs = set()
            for text in batch.column(0).to_pylist():
                words = _WORD.findall((text or "").lower())
                pairs.update((t, before) for before, w in zip(["", *words], words) for t in _terms(w) if t in promising)
            found = sorted(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["term", "before"])

    n_toxic, n_clean = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*") - F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return SEEDS, []
    counted = sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    least = max(5, round(0.01 * n_toxic))
    ranked = counted.where((F.col("toxic") >= least) & (lift > 3.0)).select("term", (lift * F.log1p("toxic")).alias("rank"))
    rank = dict(map(tuple, ranked.collect()))  # at most the terms of the sample that are in ``least`` of its toxic rows
    promising = frozenset(rank)
    apart = sample.where("toxic = 1").mapInArrow(precede, "term string, before string").groupBy("term").agg(F.countDistinct("before").alias("n"))
    enough = [r.term for r in apart.where(F.col("n") >= min(0.7 * least, MOST_BEFORE)).collect()]
    best = [(t, rank[t]) for t in sorted(enough, key=lambda t: (-rank[t], t))][: 10 * terms]
    stems: list[str] = []
    words: list[str] = []
    for term, _ in best:
        if term[0] != "=" and not any(term.startswith(s) for s in stems):
            stems = [s for s in stems if not s.startswith(term)] + [term]
    for term, _ in best:
        if term[0] == "=" and term[1:] not in words:
            words.append(term[1:])
    full = set(words) | set(SEEDS)
    stems = [s for s in stems if not _only_words(s, full)][:terms]
    words = [w for w in words if not any(w.startswith(s) for s in stems)][:terms]
    return sorted(full & set(SEEDS) | set(words)), stems


def _terms(word: str) -> list[str]:
    """What a word may be known by: itself, and the stems it goes beyond."""
    return [f"={word}", *[word[:n] for n in STEM_CHARS if len(word) > n]]


def common_words(sample: DataFrame, words: list[str], stems: list[str], least: int = COMMON_ROWS) -> set[str]:
    """Words that look like misspelled terms but stand in several clean rows of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(words, stems)
        for batch in batches:
            found = [w for text in batch.column(0).to_pylist() for w in set(_WORD.findall((text or "").lower())) if automaton.classify(w) in (NEAR, FUZZY)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    rows = sample.where("toxic = 0").mapInArrow(run, "word string").groupBy("word").count().where(F.col("count") >= least)
    return {r.word for r in rows.collect()}  # at most the words of the sample within one edit of a term


def _only_words(stem: str, words: set[str]) -> bool:
    """Whether the stem is just the beginning of a whole word of the lexicon."""
    return any(w.startswith(stem) for w in words)


class ToxicityModel:
    def __init__(self, words: list[str], stems: list[str], weights: list[float], common: set[str] | frozenset[str] = frozenset()):
        self.words, self.stems, self.weights, self.common = words, stems, weights, common
        self._automaton: LexiconAutomaton | None = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self) -> LexiconAutomaton:
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.words, self.stems, self.common)
        return self._automaton

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, features(self.automaton, text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


DEFAULT_WEIGHTS = [-3.0, 3.0, 3.0, 0.5, -0.5, 1.0, 0.5]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 50) -> list[float]:
    """Newton's method with a ridge on all weights but the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, fold: int = 2, folds: int = 4, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Mine the lexicon and fit the weights on at most ``rows`` labelled rows outside the held-out fold."""
    sample = durable(labelled_sample(docs, labels, fold, folds, rows, id_col, text_col))
    words, stems = mine_lexicon(sample)
    model = ToxicityModel(words, stems, DEFAULT_WEIGHTS, common_words(sample, words, stems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(model.automaton, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = sorted(sample.mapInArrow(run, "toxic int, x array<double>").collect())  # at most ``rows`` short vectors; sorted, so sums come out alike
    release(sample)
    y = np.array([r[0] for r in seen], dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = fit_logistic(np.array([r[1] for r in seen]), y)
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 per row."""
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([shared.value.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
