"""Encoding of whole texts inside tasks with a public tokenizer's file."""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space before a word: neither pre-tokenizer joins what lies on its two sides,
#: so a text's ids are those of its pieces one after another.
CUT = re.compile(r"(?= \S)")
#: Words, cut at every space, that may not stand apart from what lies before them.
SPACED = r"^($|[\s\x1c-\x1f\x{85}\p{Z}])"
#: Latin letters and digits with ASCII punctuation after them, once more after a line's end.
#: Pre-tokenizers part letters and digits from punctuation, and both from a single line end.
PARTS = r"^(?P<a> ?{0})(?P<b>{1})(?:(?P<c>\n)(?P<d>{0})(?P<e>{1}))?$".format("[A-Za-z0-9À-ÖØ-öø-ɏ]+", r"[!-&(-/:-@\[-`{-~]*")


def ids_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def strings(column: pa.Array) -> list[str]:
    """The same as to_pylist, for short strings many times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def lay(flat: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of the runs of `sizes` that make up flat, those named by place, end to end."""
    starts, n = sizes.cumsum() - sizes, sizes[place]
    ends = n.cumsum()
    return flat[np.repeat(starts[place] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Words recur, so each distinct part (PARTS) of the pieces between cuts goes
    to the tokenizers library once: at most `most` parts of 40 bytes on average
    are remembered, those used last, in Arrow and numpy arrays, as a Python
    object for each would take several times the memory.  New ones go joined
    into long texts with a mark after each, whose ids tell where a part ends.
    Words of letters need none where the model ends each word with a suffix.
    """

    MARK = " \x01"

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a special token that takes white space beside it would cross a cut
        crossing = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.lstrip or t.rstrip or re.search(r"\s", t.content)]
        self.split = None if crossing else CUT.split
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.ends = self._ends()
        self.new: dict[str, bytes] = {}
        self.most = most
        #: what is remembered: parts, their ids end to end, how many each has, when it was used last
        self.known = pa.array([], pa.string())
        self.laid, self.sizes, self.used, self.now = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def _ends(self) -> np.ndarray | None:
        """Whether an id ends a word, for byte-level models that end all words with a suffix and have every byte with it, so that no word's end is dropped."""
        from tokenizers import pre_tokenizers

        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        if not suffix or "ByteLevel" not in str(self.tokenizer.pre_tokenizer) or any(x + suffix not in vocab for x in pre_tokenizers.ByteLevel.alphabet()):
            return None
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[k for x, k in vocab.items() if x.endswith(suffix)]] = True
        return ends

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as default encoding without added special tokens gives them; none for null.

        Arrow splits the texts at spaces, numbers the distinct words and parts
        them; numpy then lays the ids of parts and of words end to end.
        """
        if self.split is None or not len(texts):
            return [ids_bytes(e.ids) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        split = pc.split_pattern(pc.fill_null(pc.cast(texts, pa.string()), ""), " ")
        begins = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        place, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        firsts = words.take(pa.array(place[begins[:-1]]))
        # a word that is empty or begins with white space belongs to what lies before it
        inner = np.ones(len(place), bool)
        inner[begins[:-1]] = False
        joined = pc.match_substring_regex(words, SPACED).to_numpy(zero_copy_only=False)[place] & inner
        whole = np.flatnonzero(np.logical_or.reduceat(joined, begins[:-1])).tolist()
        place[begins[:-1]] = len(words) + np.arange(len(firsts))
        spaced = pc.binary_join_element_wise(pa.scalar(""), words, " ")
        flat, sizes = self.pieces(pa.concat_arrays([spaced, firsts]))
        out = self.cut(lay(flat, sizes, place), np.add.reduceat(sizes[place], begins[:-1]))
        if whole:
            pieces = [self.split(t) for t in texts.take(pa.array(whole)).to_pylist()]
            flat, sizes = self.pieces(pa.array(chain.from_iterable(pieces), pa.string()))
            ends = np.cumsum([len(p) for p in pieces])
            for k, ids in zip(whole, self.cut(flat, np.add.reduceat(sizes, np.concatenate(([0], ends[:-1])))), strict=True):
                out[k] = ids
        pa.default_memory_pool().release_unused()
        return out

    @staticmethod
    def cut(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        laid, ends = flat.tobytes(), (4 * sizes.cumsum()).tolist()
        return [laid[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces end to end, and how many each has; a piece's ids are those of its parts."""
        found = pc.extract_regex(pieces, PARTS)
        columns = [pc.fill_null(pc.struct_field(found, k), "") for k in range(5)]
        columns[0] = pc.if_else(pc.is_null(found), pieces, columns[0])
        coded = pa.concat_arrays(columns).dictionary_encode()
        flat, sizes = self.ids(coded.dictionary)
        place = coded.indices.to_numpy().astype(np.int64).reshape(5, -1).T.ravel()
        return lay(flat, sizes, place), sizes[place].reshape(-1, 5).sum(axis=1)

    def ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts end to end, and how many each has."""
        found = pc.index_in(parts, value_set=self.known)
        place = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        place[new] = len(self.known) + np.arange(len(new))
        self.add(parts.take(pa.array(new)))
        self.now += 1
        self.used[place] = self.now
        out = lay(self.laid, self.sizes, place), self.sizes[place]
        self.forget()
        return out

    def add(self, parts: pa.Array, at_once: int = 5000) -> None:
        """Learn and remember new parts; few at once, as the library's encodings take far more memory than ids do."""
        laid, sizes = [self.laid], [self.sizes]
        for k in range(0, len(parts), at_once):
            some = strings(parts[k : k + at_once])
            self.learn(set(some))
            ids = list(map(self.new.__getitem__, some))
            self.new = {}
            laid.append(np.frombuffer(b"".join(ids), "<u4"))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        self.known = pa.concat_arrays([self.known, parts])
        self.laid, self.sizes = np.concatenate(laid), np.concatenate(sizes)
        self.used = np.pad(self.used, (0, len(parts)))

    def forget(self, part_bytes: int = 40) -> None:
        """Keep half of what may be remembered, where it is more than that."""
        cost = pc.binary_length(self.known).to_numpy() + 4 * self.sizes
        if len(cost) <= self.most and cost.sum() <= part_bytes * self.most:
            return
        last = np.argsort(-self.used, kind="stable")[: self.most // 2]
        kept = np.sort(last[cost[last].cumsum() <= part_bytes * self.most // 2])
        self.known, self.laid = self.known.take(pa.array(kept)), lay(self.laid, self.sizes, kept)
        self.sizes, self.used = self.sizes[kept], self.used[kept]

    def learn(self, parts: set[str], at_once: int = 100) -> None:
        """Encode new parts; those that begin with a space, a letter or a digit, many in one text."""
        if self.ends is not None:
            self._learn_joined([p for p in parts if p[:1] == " " and p[1:].isalpha()], "", at_once)
        marked = [p for p in parts.difference(self.new) if (p[:1] == " " or p[:1].isalnum()) and "\x01" not in p]
        self._learn_joined(marked, self.MARK, at_once)
        for part in parts.difference(self.new):
            self.new[part] = ids_bytes(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _learn_joined(self, parts: list[str], mark: str, at_once: int) -> None:
        size, last = 4 * len(self.mark) if mark else 0, self.mark[-1]
        groups = [parts[k : k + at_once] for k in range(0, len(parts), at_once)]
        done = self.tokenizer.encode_batch_fast([mark.join([*g, ""]) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, done, strict=True):
            ids = np.array(encoding.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == last if mark else self.ends[ids]) + 4).tolist()
            if len(ends) == len(group):  # else the mark's id stands for something else as well, or a part is several words
                laid = ids.tobytes()
                self.new.update(zip(group, (laid[a : b - size] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))


@lru_cache(maxsize=2)
def encoder(path: str, most: int = 600_000) -> Encoder:
    """One for each file and Python worker."""
    return Encoder(path, most)
