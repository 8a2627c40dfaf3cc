"""Encoding whole texts with a tokenizer file, for token files and counts."""

from __future__ import annotations

import json
import os
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are parallel already

from tokenizers import Tokenizer  # noqa: E402

#: Pieces a worker remembers the ids of before it drops those met least.
REMEMBERED = 1_000_000
#: Bytes of text that are cut into pieces at once.
AT_ONCE = 6_000_000
#: New pieces that are encoded as one text.
TOGETHER = 500

#: White space, in any reading of the term, other than blank, tab and line ends; and the cut.
_OTHER_SPACE = r"[\x00\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_UNEVEN = r"[ \n][ \n]|[\t\r]"
_CUT = "\x00"


class Encoder:
    """Ids of texts, as the tokenizer gives them without special tokens added.

    A byte-level tokenizer that splits text by the usual pattern never joins a
    character other than white space to white space that follows it. A text is
    hence encoded piece by piece, each piece being white space and the word after
    it, and the ids of a piece are remembered: pieces recur far more often than
    they are new. New pieces are encoded together and told apart by the number
    of bytes that each id stands for. Tokenizers of other kinds, texts with rarer
    white space and texts that hold the string of a special token are encoded as
    a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        pre = told.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and told.get("normalizer") is None
        self.special = [x["content"] for x in told.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        # the pieces remembered: where their ids begin in ``ids``, how many they are, and uses
        self.known = pa.array([], pa.string())
        self.start = self.length = np.empty(0, np.int32)
        self.uses = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _forget(self) -> None:
        """Drops the pieces met least, half of those remembered at least."""
        least = max(1, int(np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2])) if len(self.uses) else 1
        stay = self.uses > least
        self.known, start, self.length = self.known.filter(pa.array(stay)), self.start[stay], self.length[stay]
        upto = np.cumsum(self.length)
        self.ids = self.ids[np.repeat(start - upto + self.length, self.length) + np.arange(self.length.sum())]
        self.start = (upto - self.length).astype(np.int32)
        self.uses = np.zeros(len(self.known), np.int64)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text."""
        even = pc.invert(pc.match_substring_regex(texts, _UNEVEN))
        if pc.all(even).as_py():
            marked = reduce(lambda x, c: pc.replace_substring(x, c, _CUT + c), " \n", texts)
            # a blank at the very beginning opens the first piece
            marked = pc.replace_substring_regex(marked, rf"\A{_CUT}", "")
        else:
            marked = pc.replace_substring_regex(texts, r"([^ \n\t\r])([ \n\t\r])", rf"\1{_CUT}\2")
        return pc.split_pattern(marked, _CUT)

    def _each(self, pieces: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each piece, encoded for itself, and their numbers."""
        found = []
        for i in range(0, len(pieces), TOGETHER):
            found += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces[i : i + TOGETHER], add_special_tokens=False)]
        return found, np.fromiter(map(len, found), np.int64, len(found))

    def _together(self, pieces: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """As ``_each`` for pieces that begin with white space and end with a
        word, several in one text and told apart by bytes."""
        found, sizes = [], [np.empty(0, np.int64)]
        lengths = pc.binary_length(pieces).to_numpy().astype(np.int64)
        for i in range(0, len(pieces), TOGETHER):
            text = "".join(pieces[i : i + TOGETHER].to_pylist())
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(lengths[i : i + TOGETHER]), "left") + 1
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return found, np.concatenate(sizes)

    def _learn(self, new: pa.Array) -> None:
        joins = pc.match_substring_regex(new, r"\A[ \n\t\r][^\x00]*[^ \n\t\r]\z")
        for pieces, encode in ((new.filter(joins), self._together), (new.filter(pc.invert(joins)), lambda x: self._each(x.to_pylist()))):
            found, sizes = encode(pieces)
            self.known = pa.concat_arrays([self.known, pieces])
            self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.length = np.concatenate([self.length, sizes.astype(np.int32)])
            self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
            self.ids = np.concatenate([self.ids, *found])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of all texts' pieces begin in a list of ids, how many each
        has, how many pieces each text has, and the list."""
        if len(self.known) > REMEMBERED:
            self._forget()
        pa.default_memory_pool().release_unused()  # what the last batch took, before this one takes as much
        whole = np.full(len(texts), not self.by_piece)
        if self.by_piece and len(texts):
            tests = [pc.match_substring_regex(texts, _OTHER_SPACE), *(pc.match_substring(texts, x) for x in self.special)]
            whole = reduce(pc.or_, tests).to_numpy(zero_copy_only=False)
        cut = self._cut(texts.filter(pa.array(~whole)))
        coded = cut.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(at.is_null())
        if len(new):
            place = pc.fill_null(at, -1).to_numpy().copy()
            before = len(self.known)
            self._learn(new)
            place[place < 0] = before + pc.index_in(new, value_set=self.known[before:]).to_numpy()
        else:
            place = at.to_numpy()
        numbers = place[coded.indices.to_numpy()].astype(np.int64)
        self.uses += np.bincount(numbers, minlength=len(self.known))
        counts = np.ones(len(texts), np.int64)
        counts[~whole] = np.diff(cut.offsets.to_numpy())
        start, length, ids = self.start[numbers], self.length[numbers], self.ids
        if whole.any():
            found, sizes = self._each(texts.filter(pa.array(whole)).to_pylist())
            own = np.zeros(int(counts.sum()), bool)
            own[(np.cumsum(counts) - 1)[whole]] = True
            start, length = (np.zeros(len(own), np.int64) for _ in range(2))
            start[~own], length[~own] = self.start[numbers], self.length[numbers]
            start[own], length[own] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.concatenate([ids, *found])
        return start, length, counts, ids

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; null as empty."""
        _, sizes, counts, _ = self._pieces(pc.fill_null(texts.cast(pa.string()), ""))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(upto[np.cumsum(counts)], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number for each text."""
        starts, sizes, counts, ids = self._pieces(pc.fill_null(texts.cast(pa.string()), ""))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat((starts - upto[:-1]).astype(np.int32), sizes)  # the list has under 2**31 ids
        at += np.arange(len(at), dtype=np.int32)
        return ids[at], np.diff(upto[np.cumsum(counts)], prepend=0)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
