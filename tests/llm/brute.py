"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text or ""))
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def components(texts: dict[int, str | None], width: int, percent: int) -> dict[int, int]:
    """The smallest document that each is linked with, by comparing all pairs."""
    sets = {k: shingles(t, width) for k, t in texts.items()}
    label = {k: k for k in texts}

    def root(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            p, q = root(a), root(b)
            label[max(p, q)] = min(p, q)
    return {k: root(k) for k in texts}


def encode(path: str, texts: list[str | None], end: int) -> list[list[int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def check_pieces(rows: list, ids_of: dict[int, list[int]], size: int) -> float:
    """Assert that packed pieces cover all documents; the share of padding."""
    assert len(ids_of) == len({r.doc_id for r in rows})
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            assert r.ids_crc32 == crc(ids_of[doc_id][at : at + r.length])
            assert r.doc_tokens == len(ids_of[doc_id])
            at += r.length
        assert at == len(ids_of[doc_id])
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(1, total)


def distance(a: str, b: str) -> int:
    """Levenshtein's distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def swap_distance(a: str, b: str) -> int:
    """Levenshtein's distance where two neighbours in the wrong order are one error, no letter being changed twice."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and y == a[i - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]
