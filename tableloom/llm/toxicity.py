"""Toxicity: a lexicon trie met by Levenshtein automata, and scores of the hits' contexts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, slices, texts, written

TOKEN = re.compile(r"\w+")
#: Words that tell of what others say, and marks that quote.
REPORTING = frozenset("said says quote quoted quotes quoting called calls calling term word wrote writes".split())
QUOTES = frozenset("\"“”«»„‟`")
FEATURES = 6
#: The errors that learned lexicons admit; see Lexicon.
ERRORS = {"two_from": 8, "short_from": 4, "swaps": True}


@dataclass(frozen=True)
class Lexicon:
    """Terms and stems with their weights; a stem stands for every word that begins with it.

    `innocent` words are no misspelt terms, though near one.
    `covered` words begin with a stem, which their misspellings count for.
    `first_letter`: whether the first letter can be wrong.  Terms of
    `fuzzy_from` letters or more admit one error, of `two_from` or more two;
    those of `short_from` or more one wrong letter, but not the first.
    `swaps`: whether two neighbours in the wrong order are one error.
    """

    terms: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    innocent: frozenset[str] = frozenset()
    fuzzy_from: int = 5
    covered: dict[str, str] = field(default_factory=dict)
    first_letter: bool = False
    two_from: int = 1 << 30
    short_from: int = 1 << 30
    swaps: bool = False

    def errors(self, term: str) -> int:
        """How many errors a term admits."""
        n = len(term)
        return (n >= self.fuzzy_from or n >= self.short_from) + (n >= self.two_from)


class Automaton:
    """The trie of a lexicon met with the Levenshtein automata of words, determinised as words come.

    A state is the set of what a word's beginning can reach: trie nodes with
    the fewest errors on the way, and, where neighbours may be swapped, nodes
    that wait for the letter which the word has brought too late.  Words that a
    stem stands for are terms here too.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        #: node: children by letter, the term that ends here, the stem that ends here, the errors that a term below admits
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.most: list[int] = [0]
        for word, ends in [*((w, self.term) for w in [*lexicon.terms, *lexicon.covered]), *((w, self.stem) for w in lexicon.stems)]:
            node, most = 0, lexicon.errors(word) if ends is self.term else 0
            for ch in word:
                self.most[node] = max(self.most[node], most)
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.most.append(0)
                node = self.children[node][ch]
            ends[node] = word
            self.most[node] = max(self.most[node], most)
        first = self._state({(0, ""): 0})
        self.states, self.sets, self.next = {first: 0}, [first], [{}]

    def _state(self, reached: dict[tuple[int, str], int]) -> tuple:
        """What is reached, with what lacking letters of the word reach besides, in a fixed order."""
        queue = [(node, n) for (node, wait), n in reached.items() if not wait]
        while queue:
            node, n = queue.pop()
            if not node and not self.lexicon.first_letter:
                continue
            for child in self.children[node].values():
                if n < self.most[child] and n + 1 < reached.get((child, ""), 99):
                    reached[child, ""] = n + 1
                    queue.append((child, n + 1))
        return tuple(sorted((node, wait, n) for (node, wait), n in reached.items()))

    def step(self, state: int, ch: str) -> int:
        """The next state, or -1 if no term or stem can follow."""
        reached: dict[tuple[int, str], int] = {}

        def reach(node: int, n: int, wait: str = "") -> None:
            if n <= self.most[node] and n < reached.get((node, wait), 99) or not n:
                reached[node, wait] = n

        for node, wait, n in self.sets[state]:
            if wait:
                if wait == ch:
                    reach(node, n)
                continue
            follow = self.children[node]
            if ch in follow:
                reach(follow[ch], n)
            if n < self.most[node] and (node or self.lexicon.first_letter):
                reach(node, n + 1)  # ch is too much
                for letter, child in follow.items():
                    if letter == ch:
                        continue
                    reach(child, n + 1)  # ch stands for another letter
                    if self.lexicon.swaps and ch in self.children[child]:
                        reach(self.children[child][ch], n + 1, letter)  # the letter comes after ch
        if not reached:
            return -1
        key = self._state(reached)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
        return self.states[key]

    def match(self, word: str) -> tuple[str, int] | None:
        """(term or stem, errors) of the match with fewest errors (ties: the first term), or None; a covered word gives its stem."""
        state = 0
        for ch in word:
            follow = self.next[state]
            state = follow[ch] if ch in follow else follow.setdefault(ch, self.step(state, ch))
            if state < 0:
                return None
            for node, _, n in self.sets[state]:
                if not n and self.stem[node]:
                    return self.stem[node], 0
        found = [(n, self.term[node]) for node, wait, n in self.sets[state] if not wait and self.term[node] and self._admits(self.term[node], n, word)]
        if not found:
            return None
        n, term = min(found)
        return self.lexicon.covered.get(term, term), n

    def _admits(self, term: str, n: int, word: str) -> bool:
        if n and len(term) < self.lexicon.fuzzy_from:
            return n <= self.lexicon.errors(term) and len(word) == len(term) and word[0] == term[0]
        return n <= self.lexicon.errors(term)


class Scorer:
    """Features of a text from its hits and their contexts."""

    def __init__(self, lexicon: Lexicon, context: int = 8):
        self.lexicon, self.context = lexicon, context
        self.automaton = Automaton(lexicon)
        self.known: dict[str, tuple[str, int] | None] = {}

    def find(self, word: str) -> tuple[str, int] | None:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            met = self.automaton.match(word)
            self.known[word] = None if met and met[1] and word in self.lexicon.innocent else met
        return self.known[word]

    def features(self, text: str | None) -> list[float]:
        """Distinct terms and their weights (misspelt ones count half), quoted hits, the fullest context, hits a hundred words, hits."""
        words = TOKEN.findall(text.lower()) if text else []
        hits = {w: m for w in set(words) if (m := self.find(w))}
        if not hits:
            return [0.0] * FEATURES
        spans = list(TOKEN.finditer(text))
        # lower() may change a text's length, so words are taken from their spans
        at = [(k, hits[w]) for k, s in enumerate(spans) if (w := s.group().lower()) in hits]
        share, quoted, places = {}, 0, []
        for k, (term, errors) in at:
            span = spans[k]
            near = {spans[i].group().lower() for i in range(max(0, k - 3), k)}
            marks = text[max(0, span.start() - 2) : span.start()] + text[span.end() : span.end() + 2]
            if near & REPORTING or QUOTES & set(marks):
                quoted += 1
                continue
            places.append(k)
            share[term] = max(share.get(term, 0.0), 0.5 if errors else 1.0)
        full, begin = 0, 0
        for i, k in enumerate(places):
            while places[begin] < k - self.context:
                begin += 1
            full = max(full, i - begin + 1)
        weight = sum(v * (self.lexicon.terms.get(t, 0.0) + self.lexicon.stems.get(t, 0.0)) for t, v in share.items())
        return [
            min(sum(share.values()), 5.0),
            min(weight, 20.0) / 4,
            min(quoted, 4.0),
            min(full, 4.0) if len(share) > 1 else 0.0,
            min(100 * len(places) / len(spans), 5.0),
            math.log1p(len(places)),
        ]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float

    def score(self, features: list[float]) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(sample: DataFrame, stem_lengths: range) -> DataFrame:
    """term, stem: in how many toxic and clean documents of the sample each stands; tasks sum their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2} if text else set()
                found = {(w, False) for w in words} | {(w[:n], True) for w in words for n in stem_lengths if len(w) > n}
                seen[toxic].update(found)
        keys = list(seen[1].keys() | seen[0].keys())
        yield pa.record_batch(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), *(pa.array([seen[t][k] for k in keys], pa.int64()) for t in (1, 0))],
            names=["word", "stem", "toxic", "clean"],
        )

    parts = sample.mapInArrow(run, "word string, stem boolean, toxic bigint, clean bigint")
    return parts.groupBy("word", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(counts: DataFrame, n_toxic: int, n_clean: int, most: int) -> Lexicon:
    """Words and stems that stand in toxic documents far more than in clean ones, and in more of them than chance gives any word of the sample."""
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    # a word that stands in k documents has them all toxic by chance once in (share of toxic ones) ** -k words
    tried = counts.where("toxic > 0").count()
    chance = math.log(max(tried / 10, 1)) / math.log((n_toxic + n_clean) / n_toxic)  # about ten such words are let in
    least = max(3, round(n_toxic * 0.02), math.ceil(chance))
    rows = (
        counts.withColumn("w", weight)
        .where((F.col("toxic") >= F.when(F.col("stem"), 2 * least).otherwise(least)) & (F.col("w") >= 3.0) & (F.col("clean") * n_toxic <= F.col("toxic") * n_clean * 0.02))
        .orderBy(F.desc("toxic"), "word", "stem")
        .limit(most)
        .collect()
    )
    words = {r.word: r.toxic for r in rows if not r.stem}
    stems: dict[str, float] = {}
    for r in sorted((r for r in rows if r.stem), key=lambda r: len(r.word)):
        # a stem must be more than one frequent word's beginning, and not another stem's continuation
        if r.toxic > 1.5 * max((n for w, n in words.items() if w.startswith(r.word)), default=0) and not any(r.word.startswith(s) for s in stems):
            stems[r.word] = r.w
    covered = {w: s for w in words for s in stems if w.startswith(s)}
    terms = {r.word: r.w for r in rows if not r.stem and r.word not in covered}
    return Lexicon(terms, stems, covered=covered, first_letter=True)


def _innocent(sample: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Words of clean documents that only an error makes a term: no more than the sample has words near the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            words = set().union(*(TOKEN.findall(t.lower()) for t in texts(batch.column("text")) if t))
            yield pa.record_batch([pa.array([w for w in words if (m := scorer.find(w)) and m[1]], pa.string())], names=["word"])

    rows = sample.where("toxic = 0").select("text").mapInArrow(run, "word string").distinct().collect()
    return frozenset(r.word for r in rows)


def _nonnegative(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights with those below 0 left out, as no hit makes a text less toxic."""
    use = np.ones(x.shape[1], bool)
    while True:
        w, bias = _logistic(x[:, use], y)
        if (w >= 0).all():
            out = np.zeros(x.shape[1])
            out[use] = w
            return out, bias
        use[np.flatnonzero(use)[w.argmin()]] = False


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method for ridge logistic regression."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = 8000, most_terms: int = 4000) -> Model:
    """Learn the lexicon and the weights from labelled documents that are not held out.

    Input: documents with `doc_id` and `text`, labels with `doc_id` and `toxic`
    (0 or 1; null rows are left out; toxic if any row of a doc_id is).  At most
    `most_rows` labelled documents are used, half of them toxic where there are
    so many, taken in the order of a hash of doc_id; rows of one doc_id count
    once, by their smallest text; the lexicon has at most `most_terms` entries.
    Both are the bounds of what the driver sees, and neither depends on how
    rows are dealt over partitions.  The
    lexicon comes from one part of the sample and the weights from another, so
    terms that only look telling are found out.  Without toxic or without clean
    labels every score is the share of toxic labels, 0 if there are none.
    """
    known = pick(labels, "doc_id", toxic="int").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(5), "doc_id")
    half = most_rows // 2
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(half).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(half))
    # at most most_rows pairs of numbers; of rows of one doc_id the smallest text is taken, so the sample has no more rows than that
    sample = pick(docs, "doc_id", text="string").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = written(sample.select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(2)).alias("part")), "sample")
    sizes = {(r.part, r.toxic): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    n = {t: sum(v for (_, u), v in sizes.items() if u == t) for t in (0, 1)}
    if not n[0] or not n[1]:
        return Model(Lexicon({}), (0.0,) * FEATURES, 30.0 if n[1] else -30.0)
    apart = all(sizes.get((p, t), 0) >= 150 for p in (0, 1) for t in (0, 1))
    source = sample.where("part = 0") if apart else sample
    used = {t: sizes[0, t] if apart else n[t] for t in (0, 1)}
    counts = written(_counts(source, range(4, 6)), "counts")
    lexicon = replace(_lexicon(counts, used[1], used[0], most_terms), **ERRORS)
    lexicon = replace(lexicon, innocent=_innocent(source, lexicon))
    found = features(sample.where("part = 1") if apart else sample, lexicon, extra=("toxic",)).orderBy("doc_id").select("toxic", "features").collect()
    x, y = np.array([r.features for r in found]), np.array([r.toxic for r in found])
    # the sample holds more toxic documents than the corpus, so that 0.7 asks for clear cases
    w, bias = _nonnegative(x, y)
    return Model(lexicon, tuple(w.tolist()), bias)


def features(docs: DataFrame, lexicon: Lexicon, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the extra columns and the features of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in slices(batches, "text", 8_000_000):
            rows = [scorer.features(t) for t in texts(batch.column("text"))]
            yield pa.record_batch(
                [batch.column("doc_id"), *(batch.column(c) for c in extra), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", *extra, "features"]
            )

    types = dict(docs.dtypes)
    return docs.select("doc_id", "text", *(c for c in extra if c != "text")).mapInArrow(run, ", ".join([f"{c} {types[c]}" for c in ("doc_id", *extra)]) + ", features array<double>")


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in `keep` and score (0 to 1, higher: more likely toxic), a row for each input row.

    Input: `doc_id` and `text`; further columns are ignored.  Null and empty
    texts have no hits and get the score of such texts; texts of any length are
    read whole.  Nothing is shuffled; the model is at most `most_terms` words.
    """
    found = features(pick(docs, "doc_id", *keep, text="string"), model.lexicon, keep)
    z = F.lit(model.bias)
    for k, w in enumerate(model.weights):
        z = z + F.lit(w) * F.col("features")[k]
    return found.select("doc_id", *keep, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))
