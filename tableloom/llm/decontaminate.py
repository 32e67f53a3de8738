"""Benchmark decontamination: a prefix-filtered join of documents and benchmark windows."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, pick, raw, slices, spread_join, written

#: Bytes of words: digits, a-z and everything beyond ASCII; all others become spaces.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def shingles(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of neighbours, the last word with nothing: every word begins one."""
    return zip(words, [*words[1:], b""], strict=True)


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id and words (joined by spaces) of each distinct window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (item, b" ".join(w[i : i + size]))
                for item, w in zip(batch.column("item_id").to_pylist(), map(words_of, raw(batch.column("text"))), strict=True)
                for i in range(max(1, len(w) - size + 1) if w else 0)
            ]
            yield pa.record_batch([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary())], names=["item_id", "words"])

    return pick(benchmark, item_id="string", text="string").where("item_id IS NOT NULL").mapInArrow(run, "item_id string, words binary").distinct()


def _prefixes(windows: list[list[bytes]]) -> list[list[tuple[bytes, bytes]]]:
    """The shingles of each window that stand wholly inside it; of a single word, the word itself."""
    return [list(zip(w, w[1:])) or [(w[0],)] for w in windows]


def _rarity(docs: DataFrame, wanted: set) -> Counter:
    """In how many of all documents each wanted shingle stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pairs, single = {x for x in wanted if len(x) == 2}, {x[0] for x in wanted if len(x) == 1}
        for batch in batches:
            for text in raw(batch.column("text")):
                w = words_of(text)
                seen.update(pairs.intersection(zip(w, w[1:])))
                seen.update((x,) for x in single.intersection(w))
        yield pa.record_batch([pa.array([b" ".join(x) for x in seen], pa.binary()), pa.array(seen.values(), pa.int64())], names=["shingle", "n"])

    counted = docs.select("text").mapInArrow(run, "shingle binary, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    return Counter({tuple(bytes(r.shingle).split(b" ")): r.n for r in counted.collect()})  # at most the wanted ones


def _probe(d: DataFrame, windows: list[tuple[list[bytes], list[str]]], rarity: Counter) -> DataFrame:
    """d with n_words, hits and items, by an index of the windows in each task."""
    index: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for k, (own, _) in enumerate(windows):
        tokens = _prefixes([own])[0]
        at = min(range(len(tokens)), key=lambda i: (rarity[tokens[i]], i))
        index[tokens[at]].append((k, at))
    shared, columns = d.sparkSession.sparkContext.broadcast((windows, dict(index))), d.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, index = shared.value
        pairs, single = {x for x in index if len(x) == 2}, {x[0] for x in index if len(x) == 1}
        for batch in batches:
            sizes, hits, items = [], [], []
            for text in raw(batch.column("text")):
                w = words_of(text)
                sizes.append(len(w))
                found = pairs.intersection(zip(w, w[1:])) if pairs else set()
                alone = single.intersection(w) if single else set()
                hit, seen = set(), set()
                if found or alone:
                    for pos, pair in enumerate(shingles(w)):
                        for token in (pair, pair[:1]):
                            if not (token in found if len(token) == 2 else token[0] in alone):
                                continue
                            for k, at in index[token]:
                                own, who = windows[k]
                                start = pos - at
                                # the window must lie in the document before its words are compared
                                if start >= 0 and start + len(own) <= len(w) and w[start : start + len(own)] == own:
                                    hit.update(range(start, start + len(own)))
                                    seen.update(who)
                hits.append(sorted(hit))
                items.append(sorted(seen))
            yield pa.record_batch(
                [*(batch.column(c) for c in columns), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=[*columns, "n_words", "hits", "items"],
            )

    kinds = [f"`{n}` {t}" for n, t in d.dtypes]
    return d.mapInArrow(run, ", ".join([*kinds, "n_words bigint, hits array<bigint>, items array<string>"]))


def _hashes(words: list[bytes]) -> np.ndarray:
    """A hash for each shingle of two words, then one for each word alone."""
    from xxhash import xxh64_intdigest

    pairs = [a + b" " + b for a, b in zip(words, words[1:])]
    return np.fromiter(map(xxh64_intdigest, [*pairs, *words]), "<u8", len(pairs) + len(words))


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, two of them set for each hash: what a task can hold of any number of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits - 6, "<u8")
        for batch in batches:
            h = batch.column("h").to_numpy().view("<u8")
            for at in (h, h >> np.uint64(32)):
                at = at & np.uint64((1 << bits) - 1)
                np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array(at), pa.array(own[at].view("<i8"))], names=["at", "word"])

    parts = hashes.mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # at most 2 ** bits bits
    out = np.zeros(1 << bits - 6, "<u8")
    out[parts.column("at").to_numpy()] = parts.column("word").to_numpy().view("<u8")
    return out


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    mask, out = np.uint64(64 * len(bits) - 1), np.ones(len(h), bool)
    for at in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _joined(d: DataFrame, pairs: DataFrame, size: int, bits: int) -> DataFrame:
    """d with n_words, hits and items, by a join of shingles: for benchmarks of any size.

    A Bloom filter of the windows' shingles leaves few of the documents', each
    with the words around it; these meet the windows whose rarest shingle they
    are, and the words around are compared with the window's.  Results are
    found once for each distinct text.
    """
    spark = d.sparkSession

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in raw(batch.column("words")):
                h = _hashes(own.split(b" "))
                h = h[: len(h) // 2] if len(h) > 1 else h
                rows += [(own, k, len(own.split(b" ")), x) for k, x in enumerate(h.view("<i8").tolist())]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((),) * 4, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["words", "at", "length", "h"])

    pairs = written(pairs.withColumn("words", F.col("words").cast("string")), "pairs")
    shingled = written(pairs.select("words").distinct().mapInArrow(tokens, "words string, at int, length int, h bigint"), "tokens")

    def found(known: np.ndarray, count: bool) -> DataFrame:
        """Shingles of documents that pass the filter: how many have each, or each with its place and the words around it."""
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 4_000_000):
                seen, rows = Counter(), []
                for digest, text in zip(batch.column("digest").to_pylist(), raw(batch.column("text")), strict=True):
                    w = words_of(text)
                    h = _hashes(w)
                    kept = np.flatnonzero(_passes(h, shared.value))
                    if count:
                        seen.update(set(h[kept].view("<i8").tolist()))
                        continue
                    for k in kept.tolist():
                        pos = k if k < len(w) - 1 else k - max(0, len(w) - 1)
                        begin = max(0, pos - size + 1)
                        rows.append((int(h[k : k + 1].view("<i8")[0]), digest, pos, pos - begin, b" ".join(w[begin : pos + size])))
                if count:
                    yield pa.record_batch([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["h", "n"])
                else:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string())
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((),) * 5, kinds, strict=True)], names=["h", "digest", "pos", "left", "around"])

        texts = d.select(F.md5("text").alias("digest"), "text").where("text IS NOT NULL")
        return texts.mapInArrow(run, "h bigint, n bigint" if count else "h bigint, digest string, pos bigint, left int, around string")

    rarity = found(_filter(shingled.select("h").distinct(), bits), count=True).groupBy("h").agg(F.sum("n").alias("n"))
    ranked = shingled.join(rarity, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.min_by(F.struct("at", "h", "n"), F.struct("n", "at")).alias("t")
    # a window with a shingle of no document is in none
    chosen = written(ranked.groupBy("words", "length").agg(first).select("words", "length", "t.*").where("n > 0"), "chosen")
    places = written(found(_filter(chosen.select("h").distinct(), bits), count=False).join(chosen.select("h").distinct(), "h", "left_semi").distinct(), "places")
    met = spread_join(places, chosen.select("words", "length", "at", "h"), "h", "around", places.groupBy("h").agg(F.count("*").alias("_n")))
    start = F.col("left") - F.col("at")
    same = F.expr("array_join(slice(split(around, ' '), greatest(left - at, 0) + 1, length), ' ')") == F.col("words")
    met = written(met.where((start >= 0) & same).select("digest", (F.col("pos") - F.col("at")).alias("start"), "length", "words").distinct(), "met")
    hits = met.select("digest", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("p")).groupBy("digest").agg(F.sort_array(F.collect_set("p")).alias("hits"))
    named = met.select("digest", "words").distinct().join(pairs, "words").select("digest", "item_id").distinct()
    items = named.groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    results = written(hits.join(items, "digest"), "results")
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("bigint")
    rows = d.withColumn("digest", F.md5("text"))
    copies = rows.groupBy("digest").agg(F.count("*").alias("_n")).join(results.select("digest"), "digest", "left_semi")
    out = spread_join(rows.withColumn("_by", F.monotonically_increasing_id()), results, "digest", "_by", written(copies, "copies"), "left")
    none = (F.array().cast("array<bigint>"), F.array().cast("array<string>"))
    return out.select(*d.columns, n_words.alias("n_words"), F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, most: int = 200_000, keep: tuple[str, ...] = (), filter_bits: int = 26) -> DataFrame:
    """Which words of each document stand inside a benchmark item's window.

    Words are runs of digits, letters a-z (A-Z lowered) and characters beyond
    ASCII.  A window is `window` consecutive words of an item, or a shorter
    item whole.  Input: documents with `doc_id` (integer) and `text`, items
    with `item_id` and `text`; further columns are ignored, but for those of
    documents named in `keep`, which go first (not n_words, hits or items).
    Output, a row for each document row: doc_id, text, n_words, hits (positions of hit words,
    ascending), items (their item_ids as strings, ascending).  Null and empty
    texts have no words and no hits; items without words or id have no windows;
    an empty benchmark hits nothing.

    A document can hold a window only if it holds each of its shingles (pairs
    of words), so one necessary shingle is enough to find it: the rarest by
    counts over all documents.  Where a document has that shingle, the window's
    place follows from its position; bounds on that place and an exact
    comparison of all words confirm it.  Up to `most` pairs of item and window,
    windows are broadcast and documents never shuffled; beyond, shingles of
    both sides meet in a shuffle (`_joined`), with the same result.
    """
    d = pick(docs, *keep, doc_id="bigint", text="string")
    pairs = written(_windows(benchmark, window), "windows")
    if pairs.count() > most:
        return _joined(d, pairs, window, filter_bits)
    own: dict[bytes, list[str]] = defaultdict(list)
    for r in pairs.collect():  # at most `most` rows
        own[bytes(r.words)].append(r.item_id)
    held = [(w.split(b" "), sorted(items)) for w, items in own.items()]
    rarity = _rarity(d, {x for p in _prefixes([w for w, _ in held]) for x in p})
    return _probe(d, held, rarity)


#: op9's result as DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, list_slice(ws, i, i + least(10, len(ws)) - 1) AS w
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0),
place AS (SELECT r, i, n, list_slice(ws, i, i + n - 1) AS w FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(ws) - n + 2)) AS t(i)),
hit AS (SELECT r, i, place.n, item_id FROM place JOIN win USING (w)),
per AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS t(j) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN its USING (r)
"""
