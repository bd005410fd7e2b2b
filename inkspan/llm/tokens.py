"""Exact, vectorised encoding with a tokenizers file: each distinct word is encoded once per worker, then gathered."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Latin-1 letters and trailing marks: such words are normal once in lower case, and split into exactly these two pieces.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,!?;:]*$"
_MARKS = ".,!?;:"
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up.
_BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SEEN))}


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat's runs (starts, lens) one after another, and where each ends."""
    ends = np.cumsum(lens, dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((starts - (ends - lens)).astype(kind), lens) + np.arange(n, dtype=kind)], ends


class WordEncoder:
    """encode(texts) gives the ids that Tokenizer.encode(text, add_special_tokens=False) gives.

    For word_bpe_49k.json: white space always ends a piece and is dropped, and no special token holds any, so a text's ids
    are those of its white-space separated words in turn. Arrow splits the plain ones into letters and marks, which go to the library's
    BPE model itself (the normaliser is the identity on them); all others go through the whole library, in one call
    for many words. Up to max_units letters, marks and other words are kept from call to call.
    """

    def __init__(self, path: str, max_units: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.max_units = self.tok.model, max_units
        mark = self.tok.encode("\x00", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {"": 0}
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def piece(self, x: str) -> list[int]:
        return [t.id for t in self.model.tokenize(x if x.isascii() else "".join(map(_BYTES.__getitem__, x.encode())))]

    def library(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(words), 400):
            part = words[i : i + 400]
            if self.mark is not None and not any("\x00" in w for w in part):
                ids = self.tok.encode(" \x00 ".join(part), add_special_tokens=False).ids
                at = [-1, *(k for k, x in enumerate(ids) if x == self.mark), len(ids)]
                if len(at) == len(part) + 1:
                    out += [ids[a + 1 : b] for a, b in zip(at, at[1:])]
                    continue
            out += [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _add(self, names: list[str], found: list[list[int]]) -> None:
        lens = np.fromiter(map(len, found), np.int64, len(found))
        n, k = int(lens.sum()), len(self.units)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(found) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        self.flat[self.used : self.used + n] = np.fromiter(chain.from_iterable(found), np.uint32, n)
        self.lens[k : k + len(found)] = lens
        self.starts[k : k + len(found)] = self.used + np.cumsum(lens) - lens
        self.units.update(zip(names, range(k, k + len(found))))
        self.used += n

    def _known(self, names: list[str], encode) -> np.ndarray:
        """The numbers of units, which are encoded where they are new."""
        if fresh := [x for x in names if x not in self.units]:
            self._add(fresh, encode(fresh))
        return np.fromiter(map(self.units.__getitem__, names), np.int64, len(names))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and where each text's begin (one more at the end). A null text is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        offsets = split.offsets.to_numpy()
        d = split.flatten().dictionary_encode()
        plain = pc.match_substring_regex(d.dictionary, _PLAIN)
        whole = plain.to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(d.dictionary.filter(plain))
        letters = pc.ascii_rtrim(lower, _MARKS).dictionary_encode()
        marks = pc.replace_substring_regex(lower, f"^[^{_MARKS}]+", "").dictionary_encode()
        parts = [x.dictionary.to_pylist() for x in (letters, marks)]
        other = d.dictionary.filter(pc.invert(plain)).to_pylist()
        if len(self.units) + sum(map(len, parts)) + len(other) > self.max_units:
            self.clear()
        unit = np.zeros((len(whole), 2), np.int64)  # each word's two units; unit 0 is empty
        for k, x in enumerate((letters, marks)):
            unit[whole, k] = self._known(parts[k], lambda new: [*map(self.piece, new)])[x.indices.to_numpy()]
        unit[~whole, 0] = self._known(other, self.library)
        unit = unit.ravel()
        flat, ends = _gather(self.flat, self.starts[unit], self.lens[unit])
        ends = ends[1::2]
        lens = np.diff(ends, prepend=0)
        at = d.indices.to_numpy()
        ids, ends = _gather(flat, (ends - lens)[at], lens[at])
        return ids, np.concatenate([[0], ends])[offsets - offsets[0]].astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process: it keeps its words from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batches, column: str, most: int = 8 << 20):
    """The batches in slices of at most about `most` bytes of text (one row at least), to bound memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b
