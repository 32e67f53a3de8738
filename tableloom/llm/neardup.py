"""Near copies by a multi-index Hamming join of b-bit MinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, pick, raw, slices, spread_join, written

SIGNATURE = "doc_id bigint, n bigint, cls binary, sig binary, odd binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _stream(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@dataclass(frozen=True)
class Plan:
    """The numbers of one join.

    A signature has `symbols` MinHash values of 16 bits.  Two sets of
    similarity s agree in a symbol with probability s, so pairs of at least
    `percent` differ in at most `errors` symbols, but for about one pair in
    10^5 at the very threshold.  The symbols are split into `chunks` chunks of
    which, by pigeonhole, one holds one error at most.
    """

    shingle: int = 3
    percent: int = 85
    symbols: int = 64

    @property
    def errors(self) -> int:
        p = 1 - self.percent / 100
        return int(self.symbols * p + 5 * (self.symbols * p * (1 - p)) ** 0.5)

    @property
    def bounds(self) -> np.ndarray:
        chunks = self.errors // 2 + 1  # errors // chunks == 1
        return np.linspace(0, self.symbols, chunks + 1).round().astype(int)

    @property
    def least(self) -> int:
        """The smallest set that another set can be linked with."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than `width` are one shingle, none is none."""
    import xxhash

    if not words:
        return np.empty(0, "<u8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", len(words))
    width = min(width, len(h))
    total = np.zeros(len(h) - width + 1, "<u8")
    for k, a in enumerate(_stream(width, 7) | np.uint64(1)):
        total += _mix(h[k : len(h) - width + 1 + k] + np.uint64(k)) * a
    return np.unique(_mix(total))


def signature(s: np.ndarray, symbols: int) -> np.ndarray:
    flips, factors = _stream(symbols, 11)[:, None], (_stream(symbols, 13) | np.uint64(1))[:, None]
    low = np.full(symbols, np.uint64(2**64 - 1))
    for at in range(0, len(s), 1024):  # a row a symbol, as much at once as a cache holds
        x = s[None, at : at + 1024] ^ flips
        x *= factors
        low = np.minimum(low, x.min(axis=1))
    return (_mix(low) >> np.uint64(48)).astype("<u2")


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the elements in each of at least 4 n bins.

    Bits that differ between two sketches are bins in which the symmetric
    difference has an odd count, so they never outnumber that difference.
    """
    bins = max(64, 1 << (4 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1, bitorder="little")


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """n (size of the set), cls (its digest), signature and odd sketch of each row; the last three null where unused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16_000_000):
            rows = []
            for text in raw(batch.column("text")):
                s = shingle_set(text.translate(LOWER).split() if text else [], plan.shingle)
                cls = digest(s) if len(s) else None
                long = len(s) >= plan.least
                rows.append((len(s), cls, signature(s, plan.symbols).tobytes() if long else None, odd_sketch(s).tobytes() if long else None))
            n, cls, sig, odd = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (cls, sig, odd))],
                names=["doc_id", "n", "cls", "sig", "odd"],
            )

    return docs.mapInArrow(run, SIGNATURE)


def keys_of(sig: np.ndarray, plan: Plan) -> np.ndarray:
    """Keys of signatures (rows): for each symbol, its chunk without it.

    Two signatures share a key exactly if in that chunk they differ in this
    symbol at most.
    """
    out = np.empty(sig.shape, "<u8")
    place = _stream(plan.symbols, 17)
    hashed = _mix(sig.astype("<u8") + place)
    for a, b in zip(plan.bounds[:-1], plan.bounds[1:], strict=True):
        total = hashed[:, a:b].sum(axis=1, dtype="<u8")
        for i in range(a, b):
            out[:, i] = _mix(total - hashed[:, i] + place[i])
    return out


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], most: int = 1_000_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups, values of `by` that the input is sorted by, and each group's first row; about `most` pairs of rows or one group at a time."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        begins = np.concatenate(([0], _changes(table, by), [table.num_rows]))
        part = np.diff(begins).astype(np.int64) ** 2
        part = part.cumsum() // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for first, after in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(begins[first], begins[after] - begins[first]), begins[first:after] - begins[first]

    for batch in batches:
        if not batch.num_rows:
            continue
        same = bool(held) and all(held[-1].column(n)[-1] == batch.column(n)[0] for n in by)
        changes = _changes(batch, by)
        if held and not same:
            yield from whole()
            held = []
        last = int(changes[-1]) if len(changes) else 0
        if last:
            held.append(batch.slice(0, last))
            yield from whole()
            held = []
        held.append(batch.slice(last))
    if held:
        yield from whole()


def _changes(rows: pa.RecordBatch | pa.Table, by: list[str]) -> np.ndarray:
    """Rows that differ in `by` from the one before."""
    change = np.zeros(max(0, rows.num_rows - 1), bool)
    for n in by:
        c = rows.column(n).to_numpy()
        change |= c[1:] != c[:-1]
    return np.flatnonzero(change) + 1


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _apart(odd: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the odd sketches of rows a and b differ; a longer one folds to a shorter one's length."""
    out = np.empty(len(a), np.int64)
    length = pc.binary_length(odd).to_numpy()
    shorter = np.minimum(length[a], length[b])
    for size in np.unique(shorter).tolist():
        of = np.flatnonzero(shorter == size)
        rows, place = np.unique(np.concatenate((a[of], b[of])), return_inverse=True)
        folded = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0) for x in odd.take(pa.array(rows)).to_pylist()]
        folded = np.stack(folded).view("<u8")
        x, y = place[: len(of)], place[len(of) :]
        step = max(1, 8_000_000 // size)
        for at in range(0, len(of), step):
            some = slice(at, at + step)
            out[of[some]] = np.bitwise_count(folded[x[some]] ^ folded[y[some]]).sum(axis=1)
    return out


def _met(rows: pa.Table, begins: np.ndarray, crossing: bool, small: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet in a group: of small groups all at once by how far they lie apart, of others row by row."""
    m = rows.num_rows
    ends = np.append(begins[1:], m)
    sizes = ends - begins
    if crossing:
        label, home = (rows.column(c).to_numpy() for c in ("label", "home"))
        minor = label != rows.column("major").to_numpy()
    after = np.repeat(np.where(sizes <= small, ends, 0), sizes) - np.arange(m)
    for d in range(1, int(sizes[sizes <= small].max(initial=1))):
        a = np.flatnonzero(after > d)
        if crossing:
            a = a[(label[a] != label[a + d]) & (home[a] | home[a + d])]
        yield a, a + d
    for first, end in zip(begins[sizes > small].tolist(), ends[sizes > small].tolist(), strict=True):
        if crossing:
            # of a pair off the major label, the first row looks for the second
            own = slice(first, end)
            for a in (first + np.flatnonzero(minor[own])).tolist():
                b = first + np.flatnonzero((label[own] != label[a]) & (home[own] | home[a]) & (~minor[own] | (np.arange(first, end) > a)))
                yield np.full(len(b), a), b
        else:
            for a in range(first, end - 1):
                yield np.full(end - a - 1, a), np.arange(a + 1, end)


def _probable(rows: pa.Table, begins: np.ndarray, plan: Plan, crossing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a block (a, b, bits apart) within the signature distance which no bound excludes.

    crossing: pairs of different labels, one of them at home in this block.
    Else all pairs, of which those of a key that is one block count only in the
    first such key that they share.
    """
    rep, n, pos, sides = (rows.column(c).to_numpy() for c in ("rep", "n", "pos", "sides"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(len(rep), -1)
    sig = np.pad(sig, ((0, 0), (0, -plan.symbols % 8)))  # so that eight bytes of differences are one number
    first = plan.bounds[:-1]
    chunk = np.searchsorted(first, pos, side="right") - 1
    chunks = np.searchsorted(first, np.arange(sig.shape[1]), side="right") - 1
    found = []
    for a, b in _met(rows, begins, crossing):
        near = (100 * np.minimum(n[a], n[b]) >= plan.percent * np.maximum(n[a], n[b])) & (rep[a] != rep[b])
        a, b = a[near], b[near]
        diff = sig[a] != sig[b]
        near = np.bitwise_count(diff.view("<u8")).sum(axis=1) <= plan.errors
        a, b, diff = a[near], b[near], diff[near]
        if len(a) and not crossing:
            # of the keys that a pair shares, the first stands for it
            errors = np.add.reduceat(diff, first, axis=1)
            wrong = diff & (chunks == chunk[a][:, None])
            symbol = np.where(wrong.any(axis=1), wrong.argmax(axis=1), first[chunk[a]])
            own = (sides[a] > 1) | ((errors <= 1).argmax(axis=1) == chunk[a]) & (symbol == pos[a])
            a, b = a[own], b[own]
        if len(a):
            found.append((a, b))
    if not found:
        return (np.empty(0, np.int64),) * 3
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    bits = _apart(rows.column("odd").combine_chunks(), a, b)
    near = bits * (100 + plan.percent) <= (n[a] + n[b]) * (100 - plan.percent)
    return a[near], b[near], bits[near]


def _links(members: DataFrame, plan: Plan, *, crossing: bool, forest: bool) -> DataFrame:
    """Probable links (a, b) of the blocks (key, side); see `_probable`.

    forest: of each block as few as join whatever its probable links join,
    nearest pairs first, so at most one for each member, or label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _groups(batches, ["key", "side"]):
            a, b, bits = _probable(rows, begins, plan, crossing)
            if not len(a):
                continue
            rep = rows.column("rep").to_numpy()
            if forest:
                group = np.searchsorted(begins, a, side="right") - 1
                order = np.lexsort((b, a, bits, group))
                a, b, group = a[order], b[order], group[order]
                names = rows.column("label").to_numpy() if crossing else rep
                joined, kept = _Forest(len(rep)), []
                ends = np.append(begins[1:], len(rep))
                at = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
                for k, until in zip(at, [*at[1:], len(group)], strict=True):
                    first, end = begins[group[k]], ends[group[k]]
                    place = first + np.unique(names[first:end], return_inverse=True)[1]
                    left = place.max() - first
                    for x, y in zip(place[a[k:until] - first].tolist(), place[b[k:until] - first].tolist(), strict=True):
                        if joined.join(x, y):
                            kept.append(k)
                            left -= 1
                            if not left:
                                break
                        k += 1
                a, b = a[kept], b[kept]
            yield pa.record_batch([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], names=["a", "b"])

    blocks = members.repartition("key", "side").sortWithinPartitions("key", "side", "rep")
    return blocks.mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, plan: Plan, most_ids: int) -> DataFrame:
    """pairs with `linked`: whether their full shingle sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    ids = written(nodes.select("rep", "doc", "cls").join(ids, "rep").select("rep", F.col("doc").alias("doc_id"), F.col("cls").alias("_cls")), "ids")
    wanted = ids.count()
    few = wanted <= most_ids  # 32 bytes each, so a broadcast of known size

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8_000_000):
            rep, out = [], []
            for r, cls, text in zip(batch.column("rep").to_pylist(), batch.column("_cls").to_pylist(), raw(batch.column("text")), strict=True):
                s = shingle_set(text.translate(LOWER).split() if text else [], plan.shingle)
                if digest(s) == cls:  # a doc_id may have other texts besides
                    rep.append(r)
                    out.append(s.tobytes())
            yield pa.record_batch([pa.array(rep, pa.int64()), pa.array(out, pa.binary())], names=["rep", "items"])

    items = written(docs.join(F.broadcast(ids) if few else ids, "doc_id").select("rep", "_cls", "text").mapInArrow(sets, "rep bigint, items binary"), "sets")
    if items.count() > wanted:  # rows of one doc_id and text
        items = written(items.dropDuplicates(["rep"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= plan.percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    total = pairs.count()

    def counts(key: str) -> DataFrame:
        return pairs.groupBy(key).agg(F.count("*").alias("_n"))

    with_a = spread_join(pairs, items.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a", "b", counts("a"), total=total)
    with_b = spread_join(with_a, items.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b", "a", counts("b"), total=total)
    return with_b.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint, linked boolean")


def components(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """(node, label): for each node of the edges (a, b) the smallest node that it reaches.

    Large-star and small-star rounds in turn: each node hangs its larger, then
    its smaller neighbours under the smallest of them, until nothing changes.
    Each round's edges are written, so none is ever computed twice; nodes with
    many neighbours are dealt over tasks (`spread_join`).  No round has more
    edges than the input; up to `most` of them, the smallest neighbours (16
    bytes a node) are broadcast instead and rounds are written by fewer tasks.
    """

    def kept(now: DataFrame, name: str) -> DataFrame:
        return written(now.coalesce(16 + n // 20_000) if n <= most else now, name)

    def hung(pairs: DataFrame, name: str) -> DataFrame:
        """pairs (u, v) with `low`, the smallest v of each u, or u if that is smaller."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("_n"))
        if n <= most:
            return pairs.join(F.broadcast(low.select("u", "low")), "u")
        low = written(low, name)
        return spread_join(pairs, low.select("u", "low"), "u", "v", low.select("u", "_n"))

    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    n, seen = now.count(), None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = kept(hung(both, "low").where("v > u").select(F.col("low").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "large")
        small = hung(large.select(F.col("b").alias("u"), F.col("a").alias("v")), "lower")
        now = kept(small.select(F.col("low").alias("a"), F.explode(F.array("v", "u")).alias("b")).where("a <> b").distinct(), "small")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Classes of equal sets as nodes, and links between the classes of a doc_id that has several texts (None without any).

    A node is named by its smallest doc_id, `rep`; where two have the same one,
    all but one take a number that no doc_id reaches, and `doc` keeps the
    doc_id.
    """
    known = rows.where("doc_id IS NOT NULL AND cls IS NOT NULL")
    firsts = known.groupBy("cls", "n").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.first("odd").alias("odd"), F.count("*").alias("copies"))
    nodes = written(firsts.select("*", F.col("doc").alias("rep"), F.monotonically_increasing_id().alias("at")), "nodes")
    h = F.xxhash64("cls")
    torn = written(known.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("doc_id"), "torn")
    if torn.isEmpty():
        return nodes, None
    same = nodes.groupBy("doc").agg(F.min("at").alias("first"), F.count("*").alias("k")).where("k > 1").select("doc", "first")
    last = F.lit(2**63 - 1) - F.col("at")
    nodes = written(nodes.join(same, "doc", "left").withColumn("rep", F.when(F.col("at") != F.col("first"), last).otherwise(F.col("doc"))).drop("first"), "nodes")
    held = written(known.join(torn, "doc_id", "left_semi").select("doc_id", "cls").distinct().join(nodes.select("cls", "rep"), "cls").select("doc_id", F.col("rep").alias("b")), "held")
    low = held.groupBy("doc_id").agg(F.min("b").alias("a"))
    return nodes, held.join(low, "doc_id").where("a <> b").select("a", "b")


def near_copies(docs: DataFrame, *, shingle: int = 3, percent: int = 85, symbols: int = 64, block: int = 1024, most_ids: int = 1_000_000) -> DataFrame:
    """The component of each document in the graph of near copies.

    Words are what white space parts, A-Z lowered; a document's set holds its
    distinct `shingle`-word shingles.  Documents are linked if their sets'
    similarity is at least `percent` / 100, and components are what links
    join.  Input: `doc_id` (integer) and `text`; further columns are ignored.
    Output, a row for each input row: doc_id, n_shingles, component_id (the
    smallest doc_id reached, its own included), kept (doc_id = component_id).
    A text of fewer words is one shingle; null, empty and blank texts have an
    empty set and no links.  Rows of one doc_id are one document: repeated rows
    share their verdict, and different texts of one doc_id are linked with each
    other.  Rows without doc_id never stand for others and are not kept.

    Equal sets form a class, which its smallest doc_id represents; so a hot
    group of copies is summed before anything else.  Representatives meet by
    the keys of `keys_of`, of which pairs within `Plan.errors` share one by
    pigeonhole.  Keys of up to `block` members are compared whole.  Larger ones
    are dealt over blocks, differently for each key, so that most of a large
    group joins by comparing within blocks; what then lies in one component is
    never compared again, and only pairs that cross components meet all other
    blocks.  A block yields a forest, never all its pairs.  Every edge is
    confirmed on the full sets.  Where one fails, which is rare as sketches
    exclude all but pairs near the threshold, the forests may hide other links
    of the components that it touches, so pairs across these are listed and
    confirmed as well: no link within the signature distance is lost.
    """
    plan = Plan(shingle, percent, symbols)
    d = pick(docs, doc_id="bigint", text="string")
    rows = written(signatures(d, plan), "signatures")
    nodes, torn = _classes(rows)
    signed = nodes.where("sig IS NOT NULL").select("rep", "n", "sig", "odd")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(batch.num_rows, -1)
            keys = keys_of(sig, plan).view("<i8").ravel()
            pos = np.tile(np.arange(plan.symbols, dtype="<i4"), batch.num_rows)
            names = [c for c in batch.schema.names if c != "sig"]
            own = [pa.array(np.repeat(batch.column(c).to_numpy(), plan.symbols)) for c in names]
            yield pa.record_batch([pa.array(keys), pa.array(pos), *own], names=["key", "pos", *names])

    def keys(of: DataFrame) -> DataFrame:
        """Computing keys again costs less than writing them; labels go along."""
        own = [c for c in ("rep", "label") if c in of.columns]
        return of.select(*own, "sig").mapInArrow(keyed, f"key bigint, pos int, {', '.join(f'{c} bigint' for c in own)}")

    def met(of: DataFrame, live: DataFrame, few: bool = False) -> DataFrame:
        """The keys of nodes that others have too, and each row's block among `sides`; few: at most `most_ids` keys."""
        sides = F.ceil(F.col("size") / block).cast("int")
        found = keys(of).join(F.broadcast(live), "key") if few else spread_join(keys(of), live, "key", "rep", live.select("key", F.col("size").alias("_n")))
        out = found.withColumn("sides", sides)
        return out.withColumn("side", F.pmod(F.xxhash64("rep", "key"), F.col("sides")).cast("int")).drop("size")

    live = written(keys(signed).groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "live")
    pairs = written(_links(met(signed, live).join(signed, "rep"), plan, crossing=False, forest=True).distinct(), "pairs")
    checked = written(_confirmed(pairs, nodes, d, plan, most_ids), "checked")
    links = checked.where("linked").select("a", "b")
    if torn is not None:
        links = links.union(torn)
    labels = components(links)
    failed, hot = checked.where("NOT linked"), written(live.where(F.col("size") > block), "hot")
    n_hot = hot.count()
    for forest in [True, False] if n_hot else [False]:
        if not forest and failed.isEmpty():
            break  # forests of links that all hold hide no others
        label = labels.groupBy(F.col("node").alias("rep")).agg(F.min("label").alias("label"))
        named = written(signed.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "named")
        ends = failed
        for x in ("a", "b"):
            ends = ends.join(named.select(F.col("rep").alias(x), F.col("label").alias(f"label_{x}")), x)
        # a failed link within a component hides nothing
        touched = written(ends.where("label_a <> label_b").select(F.explode(F.array("label_a", "label_b")).alias("label")).distinct(), "touched")
        if not forest and touched.isEmpty():
            break
        doubtful = named.join(touched, "label", "left_semi")
        # once a forest has joined the blocks of a hot key, what it hides lies in doubtful components as well
        again = met(doubtful, live.where(F.col("size") <= block) if forest else live)
        if forest:
            again = again.unionByName(met(signed, hot, n_hot <= most_ids).join(named.select("rep", "label"), "rep"))
        again = written(again, "meeting")
        counted = again.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("label", "k").alias("major"), F.sum("k").alias("_n"), F.count("*").alias("labels"))
        counted = written(counted.where("labels > 1"), "counted")
        if counted.isEmpty():
            break  # no key holds two components, and no later round finds others
        apart = spread_join(again, counted.select("key", "major"), "key", "rep", counted.select("key", "_n"))
        # rows off the major label of a key visit all its blocks, the others stay at home
        own = F.col("side")
        visits = F.when(F.col("label") == F.col("major"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("sides") - 1))
        apart = apart.withColumn("at", F.explode(visits)).withColumn("home", F.col("at") == own).withColumn("side", F.col("at")).drop("at")
        more = _links(apart.join(signed, "rep"), plan, crossing=True, forest=forest).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
        more = written(_confirmed(written(more, "crossing"), nodes, d, plan, most_ids), "again")
        checked = checked.union(more)
        failed = checked.where("NOT linked")
        if not more.where("linked").isEmpty():
            # stars in place of the links that made them
            links = labels.select(F.col("label").alias("a"), F.col("node").alias("b")).union(more.where("linked").select("a", "b"))
            labels = components(links)
    labels = labels.groupBy("node").agg(F.min("label").alias("label"))
    classes = nodes.join(labels, nodes["rep"] == labels["node"], "left").select("cls", F.coalesce("label", "rep").alias("label"), F.col("copies").alias("_n"))
    classes = written(classes, "classes")
    placed = spread_join(rows.select("doc_id", "n", "cls"), classes.select("cls", "label"), "cls", "doc_id", classes.select("cls", "_n"), "left")
    component = F.coalesce(F.col("label"), F.col("doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


#: op1's result as DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(list_slice(ws, i, i + 2), ' ') for i in range(1, len(ws) - 1)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, sh
"""
