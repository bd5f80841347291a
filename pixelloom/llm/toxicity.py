"""Toxicity: a learned lexicon as a trie, met with misspelled words by Levenshtein automata, weighed by context.

``fit`` learns from labelled documents: words and word beginnings (stems) that are far more frequent in documents
labelled toxic become the lexicon; their log-odds are the weights. The trie of the lexicon and the automaton of at most one edit are
intersected: the states of the product are sets of (trie node, edits), made as words ask for them and remembered,
so a word costs one look-up a letter. Each hit has a context window: marks of quotation around it count towards
quotation; a person being addressed and further hits near it count towards abuse. A logistic regression over
these counts gives the score.

At most ``SAMPLE`` labelled documents (by hash of doc_id) are used to fit; scoring covers every document.

Edge cases: null and empty texts and texts without hits get the score of a document without hits; labels that are
null are left out, of several labels of a document the largest counts; without any toxic label nothing is learned and every score is
``PRIOR``. Repeated rows have equal scores; texts of any length are read whole; an empty table gives no rows; other columns are carried by
``scored`` and ``without_toxic`` whatever their names. Labels, language, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, saved

SAMPLE = 20_000
PRIOR = 0.05
THRESHOLD = 0.3
STEM = (4, 8)
#: Least letters of words, and of stems, that are found with an edit: a short stem with one would begin too many words.
FUZZY_FROM, FUZZY_STEM = 4, 6
WINDOW = 8
#: Words, and steps of the product automaton, that a worker remembers; what is forgotten costs time only.
KNOWN, STEPS = 150_000, 100_000
#: Least likelihood ratio of a term's uses: about what the best of a million terms without meaning reaches.
CHANCE = 28.0
#: Words with inner digits and signs are whole; PART cuts such a word into its letters.
TOKEN = re.compile(r"(?:(?<!\d)\d++)?[^\W\d_](?:[^\W_]|['’](?=[^\W\d_])|[*@$!#+|_](?=[^\W_]))*|[\"“”„«»‘]|[^\w\s]", re.UNICODE)
PART = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*", re.UNICODE)
#: Words that address a person, words of reported speech, and marks of quotation.
ADDRESS = frozenset("you your youre yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti tus".split())
SPEECH = frozenset("said says wrote quote quoted called word term sagte schrieb dit écrit dijo escribió".split())
MARKS = frozenset("\"“”„«»‘")


@dataclass
class Lexicon:
    """Entries (term, is a stem, weight) as a trie; ``match`` gives (weight, edits) of a word's best entry."""

    entries: list[tuple[str, bool, float]]
    #: Words near an entry that aren't it misspelled, as their own labels show.
    plain: frozenset = frozenset()
    children: list[dict[str, int]] = field(default_factory=list)
    ends: list[tuple[bool, float, int] | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.children, self.ends = [{}], [None]
        for term, stem, weight in self.entries:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = (stem, weight, len(term))
        self.words: dict[str, tuple[float, int]] = {}
        self._forget()

    def _forget(self) -> None:
        """Drops the product's states and steps, and the words; they are made again as words ask for them."""
        self._steps: dict[tuple[int, str], int] = {}
        self._states: list[frozenset] = []
        self._numbers: dict[frozenset, int] = {}
        self._stems: list[tuple[float, int] | None] = []
        self._full: list[tuple[float, int] | None] = []
        self.start = self._number(self._closed({(0, 0)}))
        self.words.clear()

    def _closed(self, states: set) -> frozenset:
        """With the entries' letters that the word leaves out."""
        out = set(states)
        for node, e in states:
            if e == 0:
                out |= {(child, 1) for child in self.children[node].values()}
        return frozenset(out)

    def _best(self, state: frozenset, stems: bool) -> tuple[float, int] | None:
        found = []
        for node, e in state:
            end = self.ends[node]
            if end and (end[0] or not stems) and (e == 0 or end[2] >= (FUZZY_STEM if end[0] else FUZZY_FROM)):
                found.append((-e, end[1]))
        return (lambda x: (x[1], -x[0]))(max(found)) if found else None

    def _number(self, state: frozenset) -> int:
        if state not in self._numbers:
            self._numbers[state] = len(self._states)
            self._states.append(state)
            self._stems.append(self._best(state, True))
            self._full.append(self._best(state, False))
        return self._numbers[state]

    def _step(self, at: int, c: str) -> int:
        new = set()
        for node, e in self._states[at]:
            child = self.children[node].get(c)
            if child is not None:
                new.add((child, e))
            if e == 0:
                new.add((node, 1))  # a letter too many
                new |= {(x, 1) for x in self.children[node].values()}  # another letter
        to = self._number(self._closed(new))
        self._steps[at, c] = to
        return to

    def match(self, word: str) -> tuple[float, int]:
        """(weight, edits) of the best entry, or (0, 0). Fewer edits are better, then more weight."""
        known = self.words.get(word)
        if known is not None:
            return known
        if len(self._steps) > STEPS:
            self._forget()
        elif len(self.words) > KNOWN:
            self.words.clear()
        at, best, steps = self.start, None, self._steps
        for c in word:
            at = steps[at, c] if (at, c) in steps else self._step(at, c)
            if not self._states[at]:
                break
            stem = self._stems[at]
            if stem and (best is None or (-stem[1], stem[0]) > (-best[1], best[0])):
                best = stem
        else:
            full = self._full[at]
            if full and (best is None or (-full[1], full[0]) > (-best[1], best[0])):
                best = full
        if not best and not word.isalpha():
            # the whole first, as a letter may be disguised; then what stands between digits and signs
            best = max((self.match(x) for x in PART.findall(word) if x != word and len(x) > 2), key=lambda x: (x[0] > 0, -x[1], x[0]), default=None)
        if best and best[1] and word in self.plain:
            best = None
        self.words[word] = out = best or (0.0, 0)
        return out


FEATURES = 7


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Exact and misspelled hits, weights of the best and of all, and the windows' counts for quotation and abuse."""
    tokens = TOKEN.findall((text or "").lower())
    words = lexicon.words
    match = lexicon.match
    hits = [(i, w) for i, t in enumerate(tokens) if len(t) > 2 and (w := words.get(t) or match(t))[0]]
    if not hits:
        return [0.0] * FEATURES
    exact = sum(w[1] == 0 for _, w in hits)
    quoted = abuse = 0.0
    for k, (i, _) in enumerate(hits):
        near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        marks = sum(t in MARKS for t in near)
        quoted += marks >= 2 or any(t in SPEECH for t in near)
        abuse += any(t in ADDRESS for t in near) or (k > 0 and i - hits[k - 1][0] <= WINDOW)
    n = len(hits)
    return [math.log1p(exact), math.log1p(n - exact), max(w[0] * (1 if w[1] == 0 else 0.5) for _, w in hits), min(1.0, exact), quoted / n, abuse / n, min(1.0, 20 * n / max(1, len(tokens)))]


@dataclass
class Model:
    entries: list[tuple[str, bool, float]]
    weights: list[float] | None  # bias last
    plain: frozenset = frozenset()

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), PRIOR)
        w = np.array(self.weights)
        z = rows @ w[:-1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.5) -> list[float]:
    """Newton's method with a ridge on all but the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _choose(counts: list, toxic: int, clean: int) -> list[tuple[str, bool, float]]:
    """counts: rows (term, stem, bad, good, bad_uses, good_uses), documents and uses (three a document at most).

    Telling terms are ten times as frequent in toxic documents, beyond chance by the likelihood ratio of their uses. The
    shortest stems are taken; a stem whose documents are nearly all one word's gives way to that word.
    """

    def ratio(r) -> float:
        n, share = r.bad_uses + r.good_uses, toxic / (toxic + clean)
        parts = ((r.bad_uses, n * share), (r.good_uses, n * (1 - share)))
        return 2 * sum(k * math.log(k / e) for k, e in parts if k)

    counts = [r for r in counts if ratio(r) >= CHANCE]
    odds = {(r.term, r.stem): math.log((r.bad + 0.5) / (toxic + 1)) - math.log((r.good + 0.5) / (clean + 1)) for r in counts}
    bad = {(r.term, r.stem): r.bad for r in counts}
    good = {(r.term, r.stem): r.good for r in counts}
    telling = {k for k in odds if good[k] <= 0.1 * bad[k] * clean / max(1, toxic) and odds[k] > math.log(10) and good[k] <= bad[k] / 2}
    out, taken = [], set()
    for term, stem in sorted(telling, key=lambda k: (len(k[0]), not k[1], k[0])):
        if stem:
            if any(term[:n] in taken for n in range(STEM[0], len(term))):
                continue
            words = [k for k in telling if not k[1] and k[0].startswith(term)]
            if words and max(bad[k] for k in words) >= 0.9 * bad[term, True]:
                continue
            taken.add(term)
            out.append((term, True, odds[term, True]))
        elif not any(term[:n] in taken for n in range(STEM[0], len(term) + 1)):
            out.append((term, False, odds[term, False]))
    return out


TERMS = "term string, stem boolean, toxic int, uses int"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic of the documents to learn from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, sample / max(1, n))
    cells = 1 << 20
    # the rows whose hash is low: about ``sample`` of them, the same ones in each run
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(cells)) < int(share * cells))
    # at most about SAMPLE rows of two integers: their size is bounded by that parameter
    held = saved(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "toxicity-sample")
    per = {r.toxic: r["count"] for r in held.groupBy("toxic").count().collect()}
    toxic, clean = per.get(1, 0), per.get(0, 0)
    if not toxic or not clean:
        return Model([], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, stems, marks, uses = [], [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TOKEN.findall((text or "").lower())
                tokens += [x for t in tokens if len(t) > 1 and not t.isalpha() for x in PART.findall(t) if x != t]
                words = Counter(t for t in tokens if len(t) >= STEM[0])
                cut: Counter = Counter()
                for t, k in words.items():
                    for n in range(STEM[0], min(STEM[1], len(t) - 1) + 1):
                        cut[t[:n]] += k
                terms += [*words, *cut]
                stems += [False] * len(words) + [True] * len(cut)
                marks += [y] * (len(words) + len(cut))
                uses += [min(3, k) for k in (*words.values(), *cut.values())]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(stems, pa.bool_()), pa.array(marks, pa.int32()), pa.array(uses, pa.int32())], ["term", "stem", "toxic", "uses"])

    support = max(3, math.ceil(0.002 * toxic))
    bad, good = F.col("toxic") == 1, F.col("toxic") != 1
    found = held.select("text", "toxic").transform(mapped(run, TERMS)).groupBy("term", "stem").agg(F.count_if(bad).alias("bad"), F.count_if(good).alias("good"), F.sum(F.when(bad, F.col("uses")).otherwise(0)).alias("bad_uses"), F.sum(F.when(good, F.col("uses")).otherwise(0)).alias("good_uses"))
    # telling terms only: few, as each needs its share of the toxic documents
    found = saved(found, "toxicity-terms")
    rows = found.where((F.col("bad") >= support) & (F.col("good") <= F.col("bad") / 2)).collect()
    entries = _choose(rows, toxic, clean)
    # words that clean documents use at least as often; few of them are near an entry
    usual = found.where(~F.col("stem") & (F.col("good") >= 2) & (F.col("good") * float(toxic) >= F.col("bad") * float(clean)))
    plain = frozenset(r.term for r in usual.select("term").transform(mapped(_near(entries), "term string")).collect())
    vectors = feature_rows(held.withColumn("doc_id", F.col("toxic").cast("long")), entries, plain).collect()
    x = np.array([list(r.features) for r in vectors])
    y = np.array([float(r.doc_id == 1) for r in vectors])
    return Model(entries, _logistic(x, y), plain)


def _near(entries: list):
    """Of words, those an edit away from an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for t in batch.column(0).to_pylist() if lexicon.match(t)[1]], pa.string())], ["term"])

    return run


def feature_rows(docs: DataFrame, entries: list, plain: frozenset = frozenset()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries, plain)
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    return docs.select("doc_id", "text").transform(mapped(run, "doc_id long, features array<double>"))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs and the score as column ``name``, for every row."""
    schema = docs.schema
    names = docs.columns
    if name in names:
        raise ValueError(f"docs already has a column {name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.entries, model.plain)
        at = names.index("text")
        for batch in batches:
            rows = np.array([features(t, lexicon) for t in batch.column(at).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(rows))], [*names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.transform(mapped(run, StructType([*schema.fields, StructField(name, DoubleType())])))


def held_out(doc_id) -> Column:
    """Rows that labels are never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, the same columns, without the rows that are judged toxic."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, learned(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scored(docs.select("doc_id", "text"), learned(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
