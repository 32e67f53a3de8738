"""Token counts by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

import base64
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pick, raw, slices

#: Pre-tokens that together are the whole text: words with one space before them, and the rest of white space in runs.
PRE_TOKENS = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?= [^\x20\x09-\x0D])|[\x20\x09-\x0D]+")


@lru_cache(maxsize=2)
def unigrams(path: str) -> dict[bytes, float]:
    """Pieces of a vocabulary file (base64 piece and rank a line) with unigram log-probabilities.

    The file ranks pieces but gives no probabilities; by Zipf's law the piece
    of rank r has one in proportion to 1 / (r + 2.7).
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    total = math.log(sum(1 / (r + 2.7) for r in ranks.values()))
    return {piece: -math.log(r + 2.7) - total for piece, r in ranks.items()}


def counts(words: list[bytes], scores: dict[bytes, float]) -> Iterator[tuple[bytes, int]]:
    """Each distinct word with the number of pieces on its best path."""
    for word, path in paths(words, scores):
        yield word, path[len(word)][1]


def paths(words: list[bytes], scores: dict[bytes, float]) -> Iterator[tuple[bytes, list[tuple[float, int]]]]:
    """Each distinct word with its forward scores at each of its places: minus the score, and pieces.

    Words in ascending order are a walk through their trie: from one to the
    next, only the nodes below their common prefix are new.  A node's forward
    score is the best sum of scores of pieces that spell the way to it (ties:
    fewer pieces); it is computed once for all words that share the node, and
    a word's count is read where it ends.  Every byte is a piece, so each word
    has a path.
    """
    longest = max(map(len, scores))
    path: list[tuple[float, int]] = [(0.0, 0)]
    before = b""
    for word in sorted(words):
        shared = len(os.path.commonprefix((before, word)))
        del path[shared + 1 :]
        for d in range(shared + 1, len(word) + 1):
            best = None
            for k in range(max(0, d - longest), d):
                score = scores.get(word[k:d])
                if score is not None:
                    cost, n = path[k]
                    way = (cost - score, n + 1)
                    if best is None or way < best:
                        best = way
            path.append(best if best is not None else (path[d - 1][0] + 100.0, path[d - 1][1] + 1))
        yield word, path
        before = word


def best_pieces(word: bytes, path: list[tuple[float, int]], scores: dict[bytes, float]) -> Iterator[bytes]:
    """The pieces of a word's best path, from its end."""
    d = len(word)
    while d:
        k = next((k for k in range(d) if (s := scores.get(word[k:d])) is not None and (path[k][0] - s, path[k][1] + 1) == path[d]), d - 1)
        yield word[k:d]
        d = k


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])


def fitted(docs: DataFrame, vocabulary: str, at_once: int = 1_000_000) -> dict[bytes, float]:
    """Log-probabilities of the vocabulary's pieces, from all texts.

    Pre-tokens are counted over all documents, summed by word in each task and
    then in a shuffle; each distinct one is split along its best path under the
    ranks' prior (`unigrams`), and a piece's probability is its share of all
    pieces, each counted once more.  So the model is the unigram one that a
    single pass of hard expectation and maximisation gives; pieces are never
    made or dropped.  The driver sees at most the pieces of the vocabulary.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, "text", 8_000_000):
            for text in raw(batch.column("text")):
                if text:
                    seen.update(PRE_TOKENS.findall(text))
            if len(seen) > at_once:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, total = unigrams(vocabulary), Counter()
        for batch in batches:
            own = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
            for word, path in paths(list(own), prior):
                for piece in best_pieces(word, path, prior):
                    total[piece] += own[word]
        yield _counted(total)

    counted = pick(docs, text="string").mapInArrow(words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.mapInArrow(pieces, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    known = unigrams(vocabulary)
    n = {p: r.n for r in found.collect() if (p := bytes(r.word)) in known}  # at most the vocabulary
    total = math.log(sum(n.values()) + len(known))
    return {piece: math.log(n.get(piece, 0) + 1) - total for piece in known}


def token_counts(docs: DataFrame, *, vocabulary: str, scores: dict[bytes, float] | None = None, white_space: bool = False, most: int = 600_000) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of each document's whole text.

    n_tokens sums the pieces on the best paths of a text's pre-tokens under a
    unigram model: `scores` (see `fitted`), or the ranks of the vocabulary
    file.  Pre-tokens are the words that ASCII white space parts, each with a
    space before it; with `white_space` they are PRE_TOKENS, which make up the
    whole text.  n_words counts the words either way.  Input: `doc_id` and
    `text`; further columns are ignored.  Null and empty texts have no tokens.
    A row for each input row; nothing is shuffled.  A task counts each distinct
    pre-token of a batch once and remembers about `most` of them for the next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # no more than the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value or unigrams(vocabulary), {}
        for batch in slices(batches, "text", 8_000_000):
            texts = raw(batch.column("text"))
            words = [t.split() if t else [] for t in texts]
            split = [PRE_TOKENS.findall(t) if t else [] for t in texts] if white_space else [[b" " + w for w in x] for x in words]
            new = set().union(*split)
            if len(known) > most:
                known.clear()
            known.update(counts(list(new - known.keys()), own))
            get = known.__getitem__
            totals = [sum(map(get, x)) for x in split]
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([len(t or b"") for t in texts], [len(w) for w in words], totals))],
                names=["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

    d = pick(docs, "doc_id", text="string")
    return d.mapInArrow(run, f"doc_id {d.dtypes[0][1]}, n_bytes bigint, n_words bigint, n_tokens bigint")
