"""SentencePiece encoding and decoding for merge-type vocabularies: an agenda of adjacent pairs in the order of their scores."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import table
from .tokens import _gather, slices

#: A space inside pieces.
SPACE = "▁"
#: The spaces and letters at the start of a unit.
_HEAD = rf"^{SPACE}*\p{{L}}+"
#: Widths of the matrices for units, and rows in one at most; longer units have a heap each.
_WIDTHS, _ROWS = (4, 8, 12, 16, 24, 32), 1 << 14
#: The rank of a pair that makes no piece.
_NO_PAIR = (1 << 31) - 1


class MergeVocabulary:
    """Pieces and scores of a model file, for models that are merge-type (BPE), fall back on bytes, and leave characters as they
    are (identity normalizer, spaces kept, one space put before a text). ValueError for others."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m = proto.ModelProto()
        m.ParseFromString(self.library.serialized_model_proto())
        kind, norm = proto.ModelProto.SentencePiece, m.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if m.trainer_spec.model_type != proto.TrainerSpec.BPE or not m.trainer_spec.byte_fallback or not plain:
            raise ValueError("only merge-type models with byte fallback and the identity normalizer")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == kind.NORMAL}
        # no merge leads from a character to a space after it: what starts with a run of spaces can be encoded by itself
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces with a space behind a character are not supported")
        # nor does one from a letter to anything else behind it, so that the letters of a unit can be cut off, too
        self.letters_end = not any(a.isalpha() and not b.isalpha() for p in self.pieces for a, b in zip(p, p[1:]))
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.library.eos_id()

        self._symbols()

    def _symbols(self) -> None:
        """Numbers for what a merge can meet: all pieces, then the characters that are only parts of pieces. Pairs that make
        a piece as an open-addressed table: left and right number, rank among scores (best first, equal ones alike), piece."""
        names = dict.fromkeys(self.pieces) | dict.fromkeys(c for p in self.pieces for c in p)
        number = {p: k for k, p in enumerate(names)}
        self.n_symbols = len(number)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        self.id_of = np.array([self.pieces[p][0] if p in self.pieces else -1 for p in number], np.int32)
        self.names = list(number)
        order = {x: r for r, x in enumerate(sorted({x for _, x in self.pieces.values()}, reverse=True))}
        pairs = [(number[p[:i]], number[p[i:]], order[x], number[p]) for p, (_, x) in self.pieces.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        left, right, rank, made = np.array(pairs or np.zeros((0, 4)), np.int64).T
        self.slots = 1 << max(4, int(2 * len(pairs)).bit_length() + 1)
        self.pair_key, self.pair_rank, self.pair_made = np.full(self.slots, -1, np.int64), np.full(self.slots, _NO_PAIR, np.int32), np.zeros(self.slots, np.int32)
        key = left << 32 | right
        at = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):  # each free slot takes one of those that want it, the others go on to the next slot
            free = self.pair_key[at[todo]] < 0
            self.pair_key[at[todo[free]]] = key[todo[free]]
            won = self.pair_key[at[todo]] == key[todo]
            self.pair_rank[at[todo[won]]], self.pair_made[at[todo[won]]] = rank[todo[won]], made[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) % self.slots

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(-7046029254386353131)) >> np.int64(20)) & (self.slots - 1)

    def offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols, _NO_PAIR where they make no piece, and what they make."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        todo = np.flatnonzero((self.pair_key[at] != key) & (self.pair_key[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.slots - 1)
            found = self.pair_key[at[todo]]
            todo = todo[(found != key[todo]) & (found >= 0)]
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], _NO_PAIR), self.pair_made[at]

    def agendas(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in turn, and how many each has. Units of like length are rows of one matrix: each row has the ranks of its adjacent pairs as
        its agenda, takes its best one (of equal ones the leftmost) in each round, and enters the new pairs to its left and right."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        parts, order, counts = [np.zeros(0, np.int32)], [], np.zeros(len(units), np.int64)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(lens) - lens
        for low, high in zip((0, *_WIDTHS), _WIDTHS):
            own = np.flatnonzero((lens > low) & (lens <= high))
            for i in range(0, len(own), _ROWS):
                rows = own[i : i + _ROWS]
                at = starts[rows, None] + np.arange(high)
                inside = np.arange(high) < lens[rows, None]
                chars = flat[np.minimum(at, len(flat) - 1)].astype(np.int32)
                symbols = self.of_char[chars]
                symbols = np.where(inside, np.where(symbols < 0, self.n_symbols + chars, symbols), -1)
                ids, counts[rows] = self._merged(symbols)
                parts.append(ids)
                order.append(rows)
        for k in np.flatnonzero(lens > _WIDTHS[-1]).tolist():
            parts.append(np.array(self.agenda(units[k]), np.int32))
            order.append(np.array([k]))
            counts[k] = len(parts[-1])
        made = np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int64)
        ends = np.zeros(len(units), np.int64)
        ends[made] = np.cumsum(counts[made])
        return _gather(np.concatenate(parts), ends - counts, counts)[0], counts

    def _merged(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbols (-1 behind the last) merged until no pair is left: all ids in turn, and how many each row has."""
        n, w = symbols.shape
        ranks, made = np.full((n, w), _NO_PAIR, np.int32), np.zeros((n, w), np.int32)
        a, b = symbols[:, :-1], symbols[:, 1:]
        both = (b >= 0) & (a < self.n_symbols) & (b < self.n_symbols)
        ranks[:, :-1][both], made[:, :-1][both] = self.offers(a[both], b[both])
        final, row = symbols.copy(), np.arange(n)
        cols = np.arange(w)
        while len(row):
            best = ranks.argmin(1)
            i = np.arange(len(row))
            go = ranks[i, best] < _NO_PAIR
            if not go.all():
                final[row[~go], : symbols.shape[1]] = symbols[~go]
                final[row[~go], symbols.shape[1] :] = -1
                row, symbols, ranks, made, best = row[go], symbols[go], ranks[go], made[go], best[go]
                if not len(row):
                    break
                i = np.arange(len(row))
            into = made[i, best]
            # what stands behind the merged pair moves up by one
            shift = np.minimum(cols[None, : symbols.shape[1]] + (cols[None, : symbols.shape[1]] > best[:, None]), symbols.shape[1] - 1)
            symbols, ranks, made = (np.take_along_axis(x, shift, 1) for x in (symbols, ranks, made))
            symbols[:, -1], ranks[:, -1] = -1, _NO_PAIR
            symbols[i, best] = into
            for k in (best - 1, best):  # the pairs that the new symbol is in
                ok = (k >= 0) & (k + 1 < symbols.shape[1])
                r, c = i[ok], k[ok]
                x, y = symbols[r, c], symbols[r, c + 1]
                real = (y >= 0) & (x < self.n_symbols) & (y < self.n_symbols)
                ranks[r[~real], c[~real]] = _NO_PAIR
                ranks[r[real], c[real]], made[r[real], c[real]] = self.offers(x[real], y[real])
            if symbols.shape[1] > 2 and (symbols[:, -2] < 0).all():
                symbols, ranks, made = (np.ascontiguousarray(x[:, :-1]) for x in (symbols, ranks, made))
        held = final >= 0
        ids = np.where(held & (final < self.n_symbols), self.id_of[np.clip(final, 0, self.n_symbols - 1)], -1)
        count = held.sum(1)
        out = ids[held]
        if (out < 0).any():  # characters that are no pieces
            whole = [[x] if x >= 0 else self._ids([self.names[y] if y < self.n_symbols else chr(y - self.n_symbols)]) for x, y in zip(out.tolist(), final[held].tolist())]
            count = np.add.reduceat(np.fromiter(map(len, whole), np.int64, len(whole)), np.cumsum(count) - count)
            out = np.fromiter(chain.from_iterable(whole), np.int32, int(count.sum()))
        return out.astype(np.int32), count

    def _ids(self, parts) -> list[int]:
        """Ids of merged symbols; a character that is no piece: of its bytes."""
        ids: list[int] = []
        for p in parts:
            found = self.pieces.get(p)
            ids += [found[0]] if found else [self.bytes[b] for b in p.encode()]
        return ids

    def agenda(self, unit: str) -> list[int]:
        """The ids of a long unit, by a heap. All adjacent pairs that make a piece are on the agenda; the best score goes first, of equal
        ones the leftmost; a merge puts the new pairs to its left and right on it. Entries whose symbols have
        changed meanwhile are passed over."""
        known = self.pieces
        parts: list[str] = list(unit)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        todo: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := known.get(both := parts[i] + parts[j])):
                heapq.heappush(todo, (-found[1], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while todo:
            _, i, j, both = heapq.heappop(todo)
            if not parts[i] or not parts[j] or after[i] != j or len(parts[i]) + len(parts[j]) != len(both):
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return self._ids(filter(None, parts))


def _heads(x: pa.Array, n: np.ndarray) -> pa.Array:
    """The first n bytes of each string."""
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x)]
    data, ends = _gather(np.frombuffer(x.buffers()[2] or b"", np.uint8), at, n.astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(x), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data))


class PieceEncoder:
    """encode(texts): all ids in turn, and where each text's begin (one more at the end), without an end id.

    A text is cut before each run of spaces into units; distinct units of a batch go through the agenda, are held against
    the library, and their ids are gathered for all texts by numpy. Up to max_units units are kept from call to call."""

    def __init__(self, path: str, max_units: int = 600_000):
        self.vocabulary, self.max_units = MergeVocabulary(path), max_units
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lens, self.stock, self.used = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 13, np.int32), 0

    def _learn(self, units: list[str]) -> None:
        ids, lens = self.vocabulary.agendas(units)
        # the library puts the first space before a text itself
        n, k, m = len(ids), len(self.known), len(units)
        while self.used + n > len(self.stock):
            self.stock = np.concatenate([self.stock, np.zeros_like(self.stock)])
        while k + m > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        self.stock[self.used : self.used + n] = ids
        self.lens[k : k + m], self.starts[k : k + m] = lens, self.used + np.cumsum(lens) - lens
        self.known.update(zip(units, range(k, k + m)))
        self.used += n

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts, and how many each text has."""
        space, none = (pa.scalar(x, pa.large_string()) for x in (SPACE, ""))
        whole = pc.binary_join_element_wise(space, pc.replace_substring(texts, " ", SPACE), none)
        whole = pc.if_else(pc.equal(pc.binary_length(texts), 0), none, whole)
        split = pc.split_pattern(whole, SPACE)
        flat, at = split.flatten(), split.offsets.to_numpy()
        at = at - at[0]
        # what is before a text's first space is nothing; an empty word only adds its space to the next, unless it is the last
        first, last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
        some = np.diff(at) > 0
        first[at[:-1][some]] = True
        last[at[1:][some] - 1] = True
        ends = ~first & (last | (pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0))
        spaces = np.cumsum(~first)[ends]
        spaces = np.diff(spaces, prepend=0)
        runs, which = np.unique(spaces, return_inverse=True)
        heads = pa.array([SPACE * int(n) for n in runs], pa.large_string()).take(pa.array(which))
        return pc.binary_join_element_wise(heads, flat.filter(pa.array(ends)), none), np.diff(np.concatenate([[0], np.cumsum(ends)])[at])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The third: whether the library agrees on all units of a text."""
        flat, count = self.units(pc.fill_null(texts, "").cast(pa.large_string()))
        d = flat.dictionary_encode()
        parts = [d.dictionary]
        if self.vocabulary.letters_end:
            rest = pc.replace_substring_regex(d.dictionary, _HEAD, "")
            cut = pc.subtract(pc.binary_length(d.dictionary), pc.binary_length(rest)).to_numpy()
            parts = [_heads(d.dictionary, cut), rest]
        parts = [x.dictionary_encode() for x in parts]
        names = [x.dictionary.to_pylist() for x in parts]
        if len(self.known) + sum(map(len, names)) > self.max_units or self.used > 16 * self.max_units:
            self.clear()
        numbers = [[*map(self.known.get, x)] for x in names]
        if fresh := {u: None for x, own in zip(names, numbers) for u, k in zip(x, own) if k is None}:
            self._learn([*fresh])
            numbers = [[self.known[u] if k is None else k for u, k in zip(x, own)] for x, own in zip(names, numbers)]
        own = [np.array(x, np.int64)[p.indices.to_numpy()] for x, p in zip(numbers, parts)]
        unit = np.stack(own, 1)
        flat, ends = _gather(self.stock, self.starts[unit.ravel()], self.lens[unit.ravel()])
        ends = ends.reshape(-1, len(parts))[:, -1]
        lens = np.diff(ends, prepend=0)
        at = d.indices.to_numpy()
        out, ends = _gather(flat, (ends - lens)[at], lens[at])
        text = np.concatenate([[0], np.cumsum(count)])
        same = self._same(d.dictionary.to_pylist(), flat, lens)
        agrees = np.ones(len(count), bool) if same.all() else np.diff(np.concatenate([[0], np.cumsum(~same[at])])[text]) == 0
        return out, np.concatenate([[0], ends])[text].astype(np.int64), agrees

    def _same(self, units: list[str], ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Whether the library has the same ids for each unit; it puts the first space before a text itself, unless that is empty."""
        library = self.vocabulary.library
        found = library.encode([u[1:] for u in units], num_threads=1)
        if SPACE in units:
            found[units.index(SPACE)] = [library.piece_to_id(SPACE)]
        same = np.fromiter(map(len, found), np.int64, len(found)) == lens
        if not same.all() or not np.array_equal(np.fromiter(chain.from_iterable(found), np.int32, len(ids)), ids):
            at = np.cumsum(lens) - lens
            same &= [ids[a : a + n].tolist() == x for a, n, x in zip(at.tolist(), lens.tolist(), found)]
        return same


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One for each worker process: it keeps its units from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model: str | None = None, text: str = "text", whole: bool = False, most: int = 4 << 20) -> DataFrame:
    """docs with piece_ids (array of int, the end id last), decoded (the library's text of them) and agrees (whether the
    library encodes all units of the text, with `whole` also the text as a whole, to the same ids); an own column of such a
    name gives way to the new one.

    Map-only: Arrow batches in slices of `most` bytes of text, one text at least. Every unit goes through the agenda, and
    is then checked against the library; no merge of such vocabularies leads over the border between two units. Null text: as an empty one, whose ids are the end id only. Repeated rows: alike.
    Empty table: no rows."""
    path = model or default_model()
    kept = [c for c in docs.columns if c not in ("piece_ids", "decoded", "agrees")]
    source = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(path)
        library, end = enc.vocabulary.library, enc.vocabulary.end
        for b in slices(batches, text, most):
            texts = pc.fill_null(b.column(text), "")
            ids, at, agrees = enc.encode(texts)
            ids = np.insert(ids, at[1:], end)
            at = at + np.arange(len(at))
            flat = ids.tolist()
            own = [flat[x:y] for x, y in zip(at.tolist(), at[1:].tolist())]
            if whole:
                agrees &= [x == y for x, y in zip(own, library.encode(texts.to_pylist(), add_eos=True, num_threads=1))]
            listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            decoded = pa.array(library.decode(own, num_threads=1), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, listed, decoded, pa.array(agrees)], made.names)

    made = StructType([*source.schema.fields]).add("piece_ids", ArrayType(IntegerType())).add("decoded", "string").add("agrees", "boolean")
    return source.mapInArrow(run, made)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of encode_pieces: key, n_tokens, ids_sha256 (of decimal ids with a space between), decoded_sha256, agrees."""
    ids = F.array_join(F.col("piece_ids").cast("array<string>"), " ")
    n = F.size("piece_ids").cast("long").alias("n_tokens")
    return encoded.select(key, n, F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op13_score_agenda_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
